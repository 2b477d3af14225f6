"""Parameter initialisation and data-parallel gradient rounds.

Parameters live in one table ``params(tensor, block, row, vec ARRAY<DOUBLE>)``:

=========  =====  ===========================  ==========
tensor     block  row                          vec length
=========  =====  ===========================  ==========
embed      -1     token id (V rows)            C
unembed    -1     token id (column v of U)     C
query/key/value  b  h*C + i                    C/H
atn_out    b      i (C rows)                   C
ff1        b      i (C rows)                   F
ff1_b      b      0                            F
ff2        b      i (F rows)                   C
ff2_b      b      0                            C
ln_scale   b      0                            C
ln_bias    b      0                            C
=========  =====  ===========================  ==========

A gradient round (batch) is a chain of Spark jobs:

1. the (current, next) pair counts of the batch -- read from a parquet table sorted by
   ``batch_id`` so the filter skips row groups (``PushedFilters``) -- and of the validation set;
2. one ``mapInArrow`` over the distinct current tokens with broadcast chunks of U: softmax
   normalisers, the losses of the pairs, ``G = n_x p(x) - counts(x, .)``, the embedding gradient
   ``G U^T`` per token and the unembedding gradient ``E[x]^T G`` summed over the
   partition before it is emitted (map-side combine);
3. pair losses meet the samples' pairs: batch and validation figures;
4. ``groupBy(tensor, block, row)`` vector sum (partial + final aggregate), scaled by 1/B, into
   the hash buckets that the parameters lie in, and the global L2 norm (one aggregate row);
5. clip and update: a join of two tables in the same buckets, so the parameters are never shuffled.

For a model and batches that fit a task, many rounds run in two jobs (``operators.rounds``): one task
does steps 1, 2, 4 and 5 of one batch after the other from the batches' added-up pair counts, and all tasks do
step 3 for the windows of these batches.

The model's predictions use only the embedding and unembedding tensors (the
attention blocks feed neither logits nor loss), so the gradient works on pair counts
alone.  Block tensors are initialised and stored like any others; training them is
left out (see the README on the attention blocks).
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions.vectors import BIGE, SMOL
from glyphmill.operators import rounds, samples, scoring, vector_ops
from glyphmill.session import drop_bucketed, drop_scratch, ensure_worker_import, save_bucketed, save_scratch, scratch_root
from glyphmill.sources.corpus import check_output, path_exists, seeded_uint32

PARAM_SCHEMA = "tensor string, block int, row bigint, vec array<double>"


@dataclass(frozen=True)
class ModelShape:
    vocab_size: int
    embed_dim: int = 64
    n_blocks: int = 0
    n_heads: int = 8
    ff_dim: int = 128

    def check(self) -> None:
        """Heads must divide the embedding width."""
        if self.embed_dim % self.n_heads != 0:
            raise ValueError(
                f"num_heads ({self.n_heads}) must evenly divide embed_dim ({self.embed_dim})")

    def tensors(self) -> list[tuple[str, int, int, int, float | str]]:
        """(tensor, blocks, rows, cols, init) with init = bound l of U(-l, l), 'ones' or 'zeros'.

        ``blocks`` 0 means a tensor outside the blocks (block -1).
        """
        V, C, H, Fd, B = self.vocab_size, self.embed_dim, self.n_heads, self.ff_dim, self.n_blocks
        hs = C // H
        lim = lambda *dims: 1.0 / math.sqrt(float(np.prod(dims)))
        out = [("embed", 0, V, C, lim(V, C)), ("unembed", 0, V, C, lim(V, C))]
        if B:
            out += [("ln_scale", B, 1, C, "ones"), ("ln_bias", B, 1, C, "zeros")]
            out += [(t, B, H * C, hs, lim(H, hs, C)) for t in ("query", "key", "value")]
            out += [("atn_out", B, C, C, lim(C, C)),
                    ("ff1", B, C, Fd, lim(C, Fd)), ("ff1_b", B, 1, Fd, lim(Fd)),
                    ("ff2", B, Fd, C, lim(C, Fd)), ("ff2_b", B, 1, C, lim(C))]
        return out


def init_params(spark: SparkSession, shape: ModelShape, seed: int) -> DataFrame:
    """Seeded uniform parameters; each value is a hash of (seed, tensor, block, row, col).

    One ``spark.range`` per kind of tensor covers all blocks, so the plan does not grow with
    their number; the values are the same for any partitioning or executor loss.
    """
    shape.check()
    out = None
    for tensor, blocks, rows, cols, init in shape.tensors():
        at = F.col("id")
        r = spark.range(rows * max(1, blocks)).select(
            F.lit(tensor).alias("tensor"),
            (F.floor(at / rows) if blocks else F.lit(-1)).cast("int").alias("block"),
            F.pmod(at, F.lit(rows)).cast("bigint").alias("row"))
        cidx = F.sequence(F.lit(0), F.lit(cols - 1))
        if init in ("ones", "zeros"):
            vec = F.array_repeat(F.lit(1.0 if init == "ones" else 0.0), cols)
        else:
            vec = F.transform(cidx, _uniform_draw(seed, tensor, float(init)))
        part = r.withColumn("vec", vec)
        out = part if out is None else out.unionByName(part)
    return out


def _uniform_draw(seed: int, tensor: str, bound: float):
    """Element j of a row: U(-bound, bound) from the first 32 bits of md5(seed:tensor:block:row:j)."""
    def draw(j):
        u = seeded_uint32(seed, F.lit(tensor), F.col("block"), F.col("row"), j).cast("double") / float(1 << 32)
        return (u * 2.0 - 1.0) * F.lit(bound)
    return draw


def _grad_fn(bc, lo: int, cols: int, step: int):
    """mapInArrow body: partial gradients for one chunk of vocabulary columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = bc.value                      # (C, chunk)
        acc = None                        # unembed partial (C, chunk), summed over the partition
        for batch in scoring.row_slices(batches, step):
            if batch.num_rows == 0:
                continue
            xs = batch.column("x").to_numpy()
            ev = scoring.vectors(batch.column("evec"))
            zsum = batch.column("zsum").to_numpy()
            nx = batch.column("nx").to_numpy().astype(np.float64)
            ex = np.exp(ev @ u)
            ex = np.minimum(np.where(np.abs(ex) > SMOL, ex, SMOL), BIGE)
            zc = np.minimum(np.where(np.abs(zsum) > SMOL, zsum, SMOL), BIGE)
            g = ex / zc[:, None] * nx[:, None]                     # n_x * p(x)
            ys, ns = batch.column("ys"), batch.column("ns")
            row = np.repeat(np.arange(len(xs)), np.diff(ys.offsets.to_numpy()))
            y, n = ys.flatten().to_numpy() - lo, ns.flatten().to_numpy()
            here = (y >= 0) & (y < cols)
            np.subtract.at(g, (row[here], y[here]), n[here])       # minus one-hot counts
            g_embed = g @ u.T                                       # (b, C)
            part = ev.T @ g                                         # (C, chunk)
            acc = part if acc is None else acc + part
            yield _vector_rows("embed", xs, g_embed)
        if acc is not None:
            yield _vector_rows("unembed", np.arange(lo, lo + acc.shape[1]), acc.T)

    return run


_ROUND_SCHEMA = "tensor string, row bigint, vec array<double>, ys array<bigint>"


def _round_fn(parts: list, step: int):
    """mapInArrow body: normalisers, pair losses and partial gradients of a round, in one pass.

    ``parts`` are the chunks (lo, width, broadcast) of U; a product is of at most ``step`` rows and one chunk.
    Rows with ``ys`` carry the losses of the pairs (row, ys); the others are gradients.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [None] * len(parts)             # unembed partials (C, chunk), summed over the partition
        for batch in scoring.row_slices(batches, step):
            if batch.num_rows == 0:
                continue
            xs = batch.column("x").to_numpy()
            ev = scoring.vectors(batch.column("evec"))
            nx = batch.column("nx").to_numpy().astype(np.float64)
            ys, ns = batch.column("ys"), batch.column("ns")
            row = np.repeat(np.arange(len(xs)), np.diff(ys.offsets.to_numpy()))
            y, n = ys.flatten().to_numpy(), ns.flatten().to_numpy()
            terms, g_embed, found = rounds.dense_pass(ev, nx, row, y, n, [(lo, width, bc.value) for lo, width, bc in parts])
            sums = [part if acc is None else acc + part for acc, part in zip(sums, found, strict=True)]
            losses = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(xs)))).astype(np.int32)),
                                              pa.array(terms))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(xs), pa.string()), pa.array(xs, pa.int64()), losses, ys.cast(pa.list_(pa.int64()))],
                                             names=["tensor", "row", "vec", "ys"])
            yield _gradients("embed", xs[nx > 0], g_embed[nx > 0])
        for (lo, _, _), part in zip(parts, sums, strict=True):
            if part is not None:
                yield _gradients("unembed", np.arange(lo, lo + part.shape[1]), part.T)

    return run


def _gradients(tensor: str, rows: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    found = _vector_rows(tensor, rows, values)
    return pa.RecordBatch.from_arrays([*found.columns, pa.nulls(len(rows), pa.list_(pa.int64()))], names=["tensor", "row", "vec", "ys"])


def round_pass(batch: DataFrame, validation: DataFrame | None, params: DataFrame, chunks: scoring.UnembedChunks,
               one_task: bool = False) -> DataFrame:
    """The pass of step 2 over the pairs ``(x, y, n)`` of a batch; validation pairs add losses but no gradient.

    ``one_task``: batch and parameters are small enough that a shuffle would cost more than it spreads.
    """
    ensure_worker_import(batch.sparkSession)
    pairs = batch.select("x", "y", "n")
    if validation is not None:
        pairs = pairs.unionByName(validation.select("x", "y", F.lit(0).cast("bigint").alias("n")))
    pairs = _fitted(pairs, one_task).groupBy("x", "y").agg(F.sum("n").alias("n"))
    known = (F.col("y") >= chunks.lo) & (F.col("y") <= chunks.hi)
    y = F.when(known, F.col("y")).otherwise(F.raise_error(
        F.concat(F.lit("gradient: no model row for id "), F.col("y").cast("string"))))
    # one list entry per distinct next token of a current token: at most V of them
    per_x = (pairs.select("x", y.alias("y"), "n").groupBy("x")
             .agg(F.sum("n").alias("nx"), F.collect_list(F.struct("y", "n")).alias("yn")))
    embed = _fitted(params.filter(F.col("tensor") == "embed").select(F.col("row").alias("x"), F.col("vec").alias("evec")), one_task)
    per_x = scoring.required(per_x, embed, "x", "evec", "gradient").select(
        "x", "nx", "evec", F.col("yn.y").alias("ys"), F.col("yn.n").alias("ns"))
    widest = max(width for _, width, _ in chunks.parts)
    return per_x.mapInArrow(_round_fn(chunks.parts, scoring.slice_rows(widest)), _ROUND_SCHEMA)


def _fitted(df: DataFrame, one_task: bool) -> DataFrame:
    """A single partition needs no exchange for the grouping and joins that follow."""
    return df.coalesce(1) if one_task else df


def round_losses(found: DataFrame, batch: DataFrame, validation: DataFrame | None, one_task: bool = False) -> list:
    """[(avg, min, max, count) of the batch's samples, the same of the validation samples], in one job."""
    terms = found.filter("tensor IS NULL").select(F.col("row").alias("x"), F.explode(F.arrays_zip("ys", "vec")).alias("t")).select(
        "x", F.col("t.ys").alias("y"), F.col("t.vec").alias("term"))
    rows = batch.select(F.lit(0).alias("part"), "doc_id", "k", "x", "y", "n")
    if validation is not None:
        rows = rows.unionByName(validation.select(F.lit(1).alias("part"), "doc_id", F.lit(0).alias("k"), "x", "y", "n"))
    losses = scoring.losses_from_terms(_fitted(rows, one_task), _fitted(terms, one_task), ["part", "doc_id", "k"])
    got = {r["part"]: r for r in losses.groupBy("part").agg(
        F.avg("loss").alias("avg"), F.min("loss").alias("min"), F.max("loss").alias("max"), F.count(F.lit(1)).alias("n")).collect()}
    return [got.get(0), got.get(1)]


def _vector_rows(tensor: str, rows: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    at = np.arange(len(rows) + 1, dtype=np.int32) * values.shape[1]
    vec = pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(values).reshape(-1)))
    return pa.RecordBatch.from_arrays([pa.array([tensor] * len(rows)), pa.array(rows, pa.int64()), vec],
                                      names=["tensor", "row", "vec"])


def batch_gradients(pairs: DataFrame, params: DataFrame, z: DataFrame | None = None,
                    chunks: scoring.UnembedChunks | None = None) -> DataFrame:
    """Summed gradients ``(tensor, block, row, vec)`` of one batch's pair counts.

    ``pairs(x, y, n)`` are model ids aggregated over the batch's samples; an id without a
    model row is an error.  ``z`` may carry the batch's precomputed softmax normalisers and
    ``chunks`` the round's unembedding chunks.
    """
    ensure_worker_import(pairs.sparkSession)
    embed = params.filter(F.col("tensor") == "embed").select(F.col("row").alias("idx"), "vec")
    unembed = params.filter(F.col("tensor") == "unembed").select(F.col("row").alias("idx"), "vec")
    chunks = chunks or scoring.UnembedChunks(unembed)
    if z is None:
        z = scoring.normalizers(pairs.select("x"), embed, unembed, chunks)
    known = (F.col("y") >= chunks.lo) & (F.col("y") <= chunks.hi)
    y = F.when(known, F.col("y")).otherwise(F.raise_error(
        F.concat(F.lit("gradient: no model row for id "), F.col("y").cast("string"))))
    # one list entry per distinct next token of a current token: at most V of them
    per_x = (pairs.select("x", y.alias("y"), "n").groupBy("x")
             .agg(F.sum("n").alias("nx"), F.collect_list(F.struct("y", "n")).alias("yn")))
    per_x = scoring.required(per_x, embed.select(F.col("idx").alias("x"), F.col("vec").alias("evec")),
                             "x", "evec", "gradient")
    per_x = per_x.join(z.select("x", "zsum"), "x").select(
        "x", "nx", "evec", "zsum", F.col("yn.y").alias("ys"), F.col("yn.n").alias("ns"))
    raw = None
    for lo, width, bc in chunks.parts:
        part = per_x.mapInArrow(_grad_fn(bc, lo, width, scoring.slice_rows(width)),
                                "tensor string, row bigint, vec array<double>")
        raw = part if raw is None else raw.unionByName(part)
    return vector_ops.sum_vectors(raw.withColumn("block", F.lit(-1)), ["tensor", "block", "row"], "vec", "vec")


#: Pairs of a batch (a thousand windows of a thousand tokens hold at most a million) that one task handles.
ONE_TASK_PAIRS = 2_000_000
#: Bytes of parameters in a hash bucket of a round's tables.
BUCKET_BYTES = 8 << 20


def param_buckets(spark: SparkSession, chunks: scoring.UnembedChunks) -> int:
    """Hash buckets of the parameters by their size, so that a small model's rounds are not all task starts."""
    size = 2 * 8 * (chunks.hi - chunks.lo + 1) * chunks.width
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))


def _unembed_chunks(params: DataFrame, like: scoring.UnembedChunks | None = None) -> scoring.UnembedChunks:
    return scoring.UnembedChunks(params.filter(F.col("tensor") == "unembed").select(F.col("row").alias("idx"), "vec"), like)


@dataclass
class TrainConfig:
    batch_size: int = 10
    lr: float = 3e-5
    max_norm: float = 1.0
    checkpoint_every: int = 0        # S08: write params every k batches (0 = never)
    output_dir: str | None = None
    resume: bool = False             # go on behind the last round that output_dir's commit log holds
    max_batches: int | None = None   # stop early (None = all complete batches)


#: Samples of a partition of the training pairs (some 3 KB each).
PARTITION_SAMPLES = 8_192


def write_training_pairs(per_sample: DataFrame, batch_ids: DataFrame, folders: bool = True) -> DataFrame:
    """Join per-sample pair counts to batch ids and write a row ``(doc_id, k, xs, ys, ns)`` a sample, in the order of the batches.

    Rows of ``samples.window_pairs`` whose batches follow the order of the keys are not joined: their batch is looked up in the
    batches' first and last keys, and they are shuffled once.  ``folders``: a batch has a folder of its own, so a round
    lists and reads its own files only.
    """
    keys = ["doc_id", "k"]
    batch_ids = save_scratch(batch_ids.select(*keys, "batch_id"), "batch-ids")
    spans = _spans(per_sample, batch_ids) if "xs" in per_sample.columns else None
    if spans is None:
        tagged = samples.merged_pairs(per_sample, keys).join(batch_ids, keys).repartitionByRange("batch_id")
    else:
        n_samples, ids = spans[0], [b for b, _, _ in spans[1]]
        parts = max(1, min(int(per_sample.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(ids), -(-n_samples // PARTITION_SAMPLES)))
        tagged = per_sample.select(*keys, "xs", "ys", "ns", _batch_of(spans[1], F.col("doc_id"), F.col("k")).alias("batch_id"))
        tagged = tagged.filter("batch_id IS NOT NULL")
        part = F.floor((F.col("batch_id") - min(ids)) * (parts / (max(ids) - min(ids) + 1))).cast("int")
        tagged = tagged.repartitionById(parts, F.least(part, F.lit(parts - 1)))
    written = save_scratch(tagged.sortWithinPartitions("batch_id"), "pairs", "batch_id" if folders else None)
    drop_scratch(batch_ids)
    return written


def _spans(per_sample: DataFrame, batch_ids: DataFrame) -> tuple[int, list[tuple]] | None:
    """The number of samples, and (batch, first key, last key) of each batch, in the order of the keys.

    None unless the keys ``(doc_id, k)`` are integers, each on one row of either table, batches do not overlap in them, and
    ``per_sample`` has just the keys of ``batch_ids`` from the first to the last of these.
    """
    keys, key = ["doc_id", "k"], F.struct("doc_id", "k")
    if not all(isinstance(df.schema[c].dataType, T.IntegralType) for df in (per_sample, batch_ids) for c in keys):
        return None
    # a row a round, as the metrics
    found = batch_ids.groupBy("batch_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    spans = [(r["batch_id"], tuple(r["lo"]), tuple(r["hi"])) for r in found]
    if not spans or any(None in (*lo, *hi) for _, lo, hi in spans):
        return None
    spans.sort(key=lambda s: s[1])
    if any(a[2] >= b[1] for a, b in zip(spans[:-1], spans[1:], strict=True)):
        return None
    if not batch_ids.groupBy(*keys).count().filter("count > 1").isEmpty():
        return None
    (d0, k0), (d1, k1) = spans[0][1], spans[-1][2]
    doc, k = F.col("doc_id"), F.col("k")
    inside = ((doc > d0) | ((doc == d0) & (k >= k0))) & ((doc < d1) | ((doc == d1) & (k <= k1)))
    figures = [F.count(F.lit(1)), F.sum(F.xxhash64(doc.cast("bigint"), k.cast("bigint")).cast("decimal(38,0)"))]
    mine = batch_ids.agg(*figures).first()
    return (mine[0], spans) if per_sample.filter(inside).agg(*figures).first() == mine else None


def _batch_of(spans: list[tuple], doc: Column, k: Column) -> Column:
    """The batch whose span holds the key ``(doc, k)``, by binary search; null before the first and behind the last.

    An expression, not a Python function: rows that wait for one are queued as they are, on disk at last.
    """
    def numbers(values) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")   # folded to a literal

    docs, ks = numbers(hi[0] for _, _, hi in spans), numbers(hi[1] for _, _, hi in spans)
    steps = [1 << i for i in reversed(range(len(spans).bit_length()))]

    def ends_before(at: Column) -> Column:
        there = F.get(docs, at - 1)
        return F.coalesce((there < doc) | ((there == doc) & (F.get(ks, at - 1) < k)), F.lit(False))

    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(ends_before(at + step), step).otherwise(0))
    d0, k0 = spans[0][1]
    return F.when((doc > d0) | ((doc == d0) & (k >= k0)), F.get(numbers(b for b, _, _ in spans), at))


def train(per_sample_pairs: DataFrame, batch_ids: DataFrame, params: DataFrame,
          cfg: TrainConfig, val_pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The batch loop.  Returns (final params, metrics per batch).

    ``per_sample_pairs(doc_id, k, x, y, n)`` or rows of ``samples.window_pairs`` in model ids; ``batch_ids(doc_id, k,
    batch_id, complete)`` from ``samples.limit_samples``.  Per batch: train loss
    avg/min/max (L08), validation loss before the update (L09), gradient norm,
    then scale 1/B, clip and update with ``lr * B``.  Only complete batches are
    applied, as in the reference.

    The corpus is read once, for the pair tables.  A model that fits one bucket does runs of rounds, of which
    all parameters together are at most a broadcast chunk, in two jobs each.  Otherwise, or where a batch has more than
    ``ONE_TASK_PAIRS`` pairs, a round reads the unembedding once, in
    chunks that losses, validation and gradient share; broadcasts and the last round's
    tables are dropped when the round ends.

    With ``checkpoint_every`` and ``output_dir`` a round's parameters are written, and then its
    entry of the commit log, which holds the metrics since the last entry (a run of rounds writes those of all its rounds).  With ``resume`` training
    starts behind the last entry (``params`` when there is none); a log of another configuration is an error.
    """
    spark = params.sparkSession
    if not params.filter(~F.col("tensor").isin("embed", "unembed")).isEmpty():
        raise ValueError("attention blocks are not trained here; pass the embedding tensors alone")
    metrics, begun, logged = [], 0, 0
    if cfg.resume and cfg.output_dir and (last := last_commit(spark, cfg)) is not None:
        metrics, params, begun = committed_metrics(spark, cfg, last), spark.read.parquet(_round_path(cfg.output_dir, last)), last + 1
        logged = len(metrics)
    chunks = _unembed_chunks(params)
    buckets = param_buckets(spark, chunks)
    model = rounds.read_model(params, chunks) if buckets == 1 else None
    val_tbl = None if val_pairs is None else save_scratch(val_pairs, "validation")
    val_known = rounds.validation_pairs(val_tbl, ONE_TASK_PAIRS) if model else False
    runs = model is not None and val_known is not False
    # of the complete batches, those whose rounds this call does
    applied = batch_ids.filter("complete").filter(F.col("batch_id") >= begun)
    if cfg.max_batches is not None:
        applied = applied.filter(F.col("batch_id") < cfg.max_batches)
    pairs_tbl = write_training_pairs(per_sample_pairs, applied, folders=not runs)
    counts = rounds.round_pairs(pairs_tbl) if runs else None
    # a row a round, as the metrics
    sizes = counts.groupBy("batch_id").agg(F.sum("n_pairs").alias("n")) if runs else pairs_tbl.groupBy("batch_id").agg(
        F.sum(F.size("xs")).alias("n"))
    n_pairs = {r["batch_id"]: r["n"] for r in sizes.collect()}
    n_batches = max(n_pairs, default=begun - 1)
    pairs_root, sample = scratch_root(pairs_tbl), pairs_tbl.drop("batch_id").schema
    most = max(1, scoring.MAX_CHUNK_DOUBLES // model.doubles) if runs else 0
    held = None                                    # parameters are in this table, or in the model
    if runs:
        chunks.destroy()
    else:
        params, held = _bucketed(params, buckets)
    b = begun
    while b <= n_batches:
        t0, end = time.time(), b
        while runs and end <= n_batches and end - b < most and n_pairs.get(end, 0) <= ONE_TASK_PAIRS:
            end += 1
        if end > b:
            if held:
                model = rounds.read_model(params, chunks)
                chunks.destroy()
                drop_bucketed(spark, held)
                held = None
            found = rounds.run_rounds(counts, model, val_known, b, end, cfg.batch_size, cfg.lr, cfg.max_norm)
            after, figures = rounds.read_rounds(found, model, b, end)
            losses = rounds.window_losses(pairs_tbl, [model, *after[:-1]], b)
            each = (time.time() - t0) / (end - b)
            for i, (norm, val) in enumerate(figures, b):
                m = losses[i]
                metrics.append((i, float(m["avg"]), float(m["min"]), float(m["max"]), int(m["n"]), val, norm, each))
            if cfg.checkpoint_every and cfg.output_dir:
                done = [i for i in range(b, end) if (i + 1) % cfg.checkpoint_every == 0]
                write_rounds(found, cfg, done)
                logged = commit_rounds(spark, cfg, done, metrics, logged)
            drop_scratch(found)
            model, b = after[-1], end
            continue
        if held is None:
            params, held = _bucketed(rounds.param_table(spark, model), buckets)
            chunks = _unembed_chunks(params, chunks)
        rows = (pairs_tbl.filter(F.col("batch_id") == b).select(sample.names) if runs
                else spark.read.schema(sample).parquet(f"{pairs_root}/batch_id={b}"))
        small = buckets == 1 and n_pairs.get(b, 0) <= ONE_TASK_PAIRS
        batch = samples.exploded_pairs(_fitted(rows, small))
        found = save_scratch(round_pass(batch, val_tbl, params, chunks, small), "round")
        m, v = round_losses(found, batch, val_tbl, small)
        val = None if v is None else v["avg"]
        raw = _fitted(found, small).filter("tensor IS NOT NULL").select("tensor", F.lit(-1).alias("block"), "row", "vec")
        grads, grad_table = save_bucketed(vector_ops.scale_vectors(vector_ops.sum_vectors(
            raw, vector_ops.PARAM_KEYS, "vec", "vec"), 1.0 / cfg.batch_size), vector_ops.PARAM_KEYS, buckets)
        norm = vector_ops.global_l2_norm(grads).first()[0]
        coeff = cfg.max_norm / min(max(norm, SMOL), BIGE)
        clipped = vector_ops.scale_vectors(grads, coeff) if coeff < 1.0 else grads
        new_params, new_held = save_bucketed(
            vector_ops.apply_update(params, clipped.hint("merge"), cfg.lr * cfg.batch_size), vector_ops.PARAM_KEYS, buckets)
        drop_scratch(found)
        for old in (held, grad_table):
            drop_bucketed(spark, old)
        chunks.destroy()
        params, held = new_params, new_held
        metrics.append((b, float(m["avg"]), float(m["min"]), float(m["max"]), int(m["n"]),
                        None if val is None else float(val), float(norm), time.time() - t0))
        if cfg.checkpoint_every and cfg.output_dir and (b + 1) % cfg.checkpoint_every == 0:
            # a folder without its log entry was left by a run that ended in between
            write_params(params, cfg.output_dir, b, "overwrite" if cfg.resume else "errorifexists")
            logged = commit_rounds(spark, cfg, [b], metrics, logged)
        b += 1
        if b <= n_batches:
            chunks = _unembed_chunks(params, chunks)
    if held is None:
        params, _ = _bucketed(rounds.param_table(spark, model), buckets)
    for old in (pairs_tbl, val_tbl, counts):
        if old is not None:
            drop_scratch(old)
    return params, spark.createDataFrame(metrics, METRIC_SCHEMA)


def _bucketed(params: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    return save_bucketed(params.select(*vector_ops.PARAM_KEYS, "vec").repartition(buckets, *vector_ops.PARAM_KEYS),
                         vector_ops.PARAM_KEYS, buckets)


METRIC_SCHEMA = ("batch_id bigint, avg_loss double, min_loss double, max_loss double, "
                 "n_samples bigint, val_loss double, grad_norm double, seconds double")


def _round_path(output_dir: str, round_no: int) -> str:
    return f"{output_dir.rstrip('/')}/round={round_no:06d}"


def _log_path(cfg: TrainConfig) -> str:
    return f"{cfg.output_dir.rstrip('/')}/commits"


def _configuration(cfg: TrainConfig) -> str:
    return f"batch_size={cfg.batch_size} lr={cfg.lr!r} max_norm={cfg.max_norm!r}"


def commit_rounds(spark: SparkSession, cfg: TrainConfig, done: list[int], metrics: list[tuple], logged: int) -> int:
    """Entries of the commit log for the rounds ``done``, after the write of their parameters; returns how many metrics the log holds then.

    An entry has the metrics from ``logged`` on, or since the entry before, up to its round (``metrics`` has a row a round, from round 0).
    """
    if not done:
        return logged
    entry = {i: next(r for r in done if r >= i) for i in range(logged, done[-1] + 1)}
    rows = spark.createDataFrame([(*m, entry[m[0]]) for m in metrics[logged: done[-1] + 1]], f"{METRIC_SCHEMA}, committed bigint")
    _write_folders(rows.withColumn("configuration", F.lit(_configuration(cfg))).coalesce(1), _log_path(cfg), "committed")
    return done[-1] + 1


def _write_folders(rows: DataFrame, path: str, column: str) -> None:
    """A folder a value of ``column``; of those that exist, only these are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def _log(spark: SparkSession, cfg: TrainConfig) -> DataFrame:
    return spark.read.schema(f"{METRIC_SCHEMA}, configuration string, committed bigint").parquet(_log_path(cfg))


def last_commit(spark: SparkSession, cfg: TrainConfig) -> int | None:
    """The last round of the commit log up to which it has the metrics of every round; None without one."""
    if not path_exists(spark, _log_path(cfg)):
        return None
    found = _log(spark, cfg).select("configuration", "committed", "batch_id").collect()  # a row a round
    for configuration in {r["configuration"] for r in found}:
        if configuration != _configuration(cfg):
            raise ValueError(f"{cfg.output_dir} holds a training with {configuration}, not {_configuration(cfg)}")
    # entries are written together, so a run that ended meanwhile may have left some of them
    last, known = None, {r["batch_id"] for r in found}
    for committed in sorted({r["committed"] for r in found}):
        if not known.issuperset(range(committed + 1)):
            break
        last = int(committed)
    return last


def committed_metrics(spark: SparkSession, cfg: TrainConfig, last: int) -> list[tuple]:
    rows = _log(spark, cfg).filter(F.col("committed") <= last).drop("configuration", "committed")
    return list({r["batch_id"]: tuple(r) for r in rows.orderBy("batch_id").collect()}.values())


def write_rounds(found: DataFrame, cfg: TrainConfig, done: list[int]) -> None:
    """S08 for the rounds ``done`` of ``rounds.run_rounds``, in one job: the folders of ``write_params``."""
    for i in [] if cfg.resume else done:
        # with resume, a folder without its log entry was left by a run that ended in between
        check_output(found.sparkSession, _round_path(cfg.output_dir, i), "errorifexists")
    if done:
        rows = found.filter(F.col("tensor").isNotNull() & F.col("batch_id").isin(done))
        _write_folders(rows.select(*vector_ops.PARAM_KEYS, "vec", F.format_string("%06d", "batch_id").alias("round")),
                       cfg.output_dir.rstrip("/"), "round")


def write_params(params: DataFrame, output_dir: str, round_no: int,
                 mode: str = "errorifexists") -> str:
    """One parquet folder per round under ``output_dir``."""
    path = _round_path(output_dir, round_no)
    params.write.mode(mode).parquet(path)
    return path
