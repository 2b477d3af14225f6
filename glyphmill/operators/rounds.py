"""Gradient rounds of a small model, many in one task.

A round needs of its batch only how often each (current, next) pair occurs, and of the round before
only the parameters.  So for a model that fits a task, the pairs are counted by batch in one pass over the
windows (``round_pairs``); a task walks through the batches of a run of rounds with the model in its memory
(``run_rounds``); and the losses of the run's windows are summed where the windows are, with the parameters
of their rounds broadcast (``window_losses``).  Two jobs serve all rounds of a run, whose parameters
together are at most a broadcast chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.vectors import BIGE, SMOL
from glyphmill.operators import samples, scoring
from glyphmill.session import ensure_worker_import, save_scratch


def clipped(values: np.ndarray) -> np.ndarray:
    """C05 for values that are not negative."""
    return np.minimum(np.where(np.abs(values) > SMOL, values, SMOL), BIGE)


def dense_pass(ev: np.ndarray, nx: np.ndarray, row: np.ndarray, y: np.ndarray, n: np.ndarray, parts: list):
    """Pair losses and gradients of some current tokens: ``(terms, embedding gradients, unembedding gradients by part)``.

    ``ev`` are the tokens' embeddings, ``nx`` their counts, ``(row, y, n)`` the pairs of token ``row``; ``parts``
    are the chunks (lo, width, matrix) of U.
    """
    total = sum(np.exp(ev @ u).sum(axis=1) for _, _, u in parts)
    zsum, terms, g_embed, sums = clipped(total), np.zeros(len(y)), np.zeros_like(ev), []
    for lo, width, u in parts:
        p = clipped(np.exp(ev @ u)) / zsum[:, None]
        here = (y >= lo) & (y < lo + width)
        terms[here] = -np.log(np.maximum(p[row[here], y[here] - lo], SMOL))
        g = p * nx[:, None]
        np.subtract.at(g, (row[here], y[here] - lo), n[here])
        g_embed += g @ u.T
        sums.append(ev.T @ g)
    return terms, g_embed, sums


@dataclass(frozen=True)
class Model:
    """Rows of E and columns of U of the ids ``lo`` on."""
    lo: int
    embed: np.ndarray      # (V, C)
    unembed: np.ndarray    # (C, V)

    def known(self, ids: np.ndarray) -> np.ndarray:
        """Places of the ids; one without a model row is an error."""
        odd = (ids < self.lo) | (ids >= self.lo + len(self.embed))
        if odd.any():
            raise ValueError(f"gradient: no model row for id {ids[odd][0]}")
        return ids - self.lo

    @property
    def doubles(self) -> int:
        return 2 * self.embed.size


def read_model(params: DataFrame, chunks: scoring.UnembedChunks) -> Model | None:
    """The model of a parameter table; None if E has not the ids of U once each."""
    found = params.filter(F.col("tensor") == "embed").select("row", "vec").toArrow().combine_chunks()
    ids = found.column("row").to_numpy()
    if not np.array_equal(np.sort(ids), np.arange(chunks.lo, chunks.hi + 1)):
        return None
    embed = np.zeros((len(ids), chunks.width))
    for batch in found.to_batches():
        embed[batch.column("row").to_numpy() - chunks.lo] = scoring.vectors(batch.column("vec"))
    return Model(chunks.lo, embed, np.concatenate([bc.value for _, _, bc in chunks.parts], axis=1))


def _matrix(values: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.reshape(-1)))


def param_rows(model: Model) -> pa.Table:
    """``(tensor, block, row, vec)`` of a model."""
    v = len(model.embed)
    vec = pa.chunked_array([_matrix(model.embed), _matrix(model.unembed.T)])
    return pa.table({"tensor": ["embed"] * v + ["unembed"] * v, "block": pa.array([-1] * 2 * v, pa.int32()),
                     "row": pa.array(np.tile(np.arange(v) + model.lo, 2)), "vec": vec})


def round_pairs(windows: DataFrame) -> DataFrame:
    """Stored rows ``(batch_id, xs, ys, ns, n_pairs)``: the pairs of a batch added up, a row a task and run of windows.

    ``windows`` are rows ``(batch_id, xs, ys, ns)``, mostly in the order of the batches.  ``n_pairs`` is the number of the windows' pairs.
    """
    ensure_worker_import(windows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n_pairs = None, (np.zeros(0, np.int64),) * 3, 0

        def row():
            lists = [pa.array([v], pa.list_(pa.int64())) for v in held]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *lists, pa.array([n_pairs], pa.int64())],
                                              names=["batch_id", "xs", "ys", "ns", "n_pairs"])

        for batch in batches:
            for b, rows in by_batch(batch):
                if b != now and now is not None:
                    yield row()
                if b != now:
                    now, held, n_pairs = b, (np.zeros(0, np.int64),) * 3, 0
                more = _lists(rows)
                n_pairs += len(more[0])
                held = samples.counted_pairs(*(np.concatenate(v) for v in zip(held, more, strict=True)))[1:]
        if now is not None:
            yield row()

    found = windows.select("batch_id", "xs", "ys", "ns").mapInArrow(
        run, "batch_id bigint, xs array<bigint>, ys array<bigint>, ns array<bigint>, n_pairs bigint")
    return save_scratch(found, "round-pairs")


def _lists(rows: pa.RecordBatch) -> list[np.ndarray]:
    return [rows.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in ("xs", "ys", "ns")]


def by_batch(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of equal ``batch_id``."""
    ids = batch.column("batch_id").to_numpy()
    begins = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(ids)], strict=True):
        yield int(ids[lo]), batch.slice(lo, hi - lo)


def one_round(model: Model, pairs: tuple, validation: tuple | None, step: int, batch_size: int, lr: float,
              max_norm: float) -> tuple[Model, float, float | None]:
    """A gradient round: ``(updated model, gradient norm, validation loss before the update)``.

    ``pairs`` are (x, y, n) of the batch, ``validation`` is (x, y, n) of its pairs and the number of its samples.
    """
    x, y, n = pairs
    vx, vy, vn, n_samples = validation or (x[:0], y[:0], n[:0], 0)
    x, y, weight = np.concatenate([x, vx]), np.concatenate([y, vy]), np.append(np.zeros(len(x)), vn)
    n = np.append(n, np.zeros(len(vx), np.int64)).astype(np.float64)
    x, y = model.known(x), model.known(y)
    order = np.argsort(x, kind="stable")
    x, y, n, weight = x[order], y[order], n[order], weight[order]
    tokens, begins = np.unique(x, return_index=True)
    row, nx = np.repeat(np.arange(len(tokens)), np.diff(np.append(begins, len(x)))), np.add.reduceat(n, begins) if len(x) else n
    g_embed, g_unembed, val = np.zeros((len(tokens), model.embed.shape[1])), np.zeros_like(model.unembed), 0.0
    parts = [(0, model.unembed.shape[1], model.unembed)]
    ends = np.append(begins, len(x))
    for lo in range(0, len(tokens), step):
        hi = min(lo + step, len(tokens))
        at = slice(ends[lo], ends[hi])
        terms, g_embed[lo: hi], (part,) = dense_pass(model.embed[tokens[lo: hi]], nx[lo: hi], row[at] - lo, y[at], n[at], parts)
        g_unembed += part
        val += (terms * weight[at]).sum()
    g_embed, g_unembed = g_embed * (1.0 / batch_size), g_unembed * (1.0 / batch_size)       # M07
    norm = float(np.sqrt((g_embed * g_embed).sum() + (g_unembed * g_unembed).sum()))       # M08
    coeff = max_norm / min(max(norm, SMOL), BIGE)
    if coeff < 1.0:                                                                         # M09
        g_embed, g_unembed = g_embed * coeff, g_unembed * coeff
    embed = model.embed.copy()
    embed[tokens] -= g_embed * (lr * batch_size)                                            # M10
    new = Model(model.lo, embed, model.unembed - g_unembed * (lr * batch_size))
    return new, norm, val / n_samples if n_samples else None


ROUNDS_SCHEMA = "batch_id bigint, tensor string, block int, row bigint, vec array<double>"


def run_rounds(pairs: DataFrame, model: Model, validation: tuple | None, begin: int, end: int, batch_size: int,
               lr: float, max_norm: float) -> DataFrame:
    """Stored parameters ``(batch_id, tensor, block, row, vec)`` after each of the rounds ``begin`` to ``end`` (not included).

    ``pairs`` are ``round_pairs``; a row without a tensor holds a round's gradient norm and, with validation pairs, its validation loss.
    """
    spark = pairs.sparkSession
    ensure_worker_import(spark)
    bc, step = spark.sparkContext.broadcast((model, validation)), scoring.slice_rows(len(model.embed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, val = bc.value

        def whole():
            """(batch, its pairs): the rows of a batch are added up."""
            b, held = None, []
            for batch in batches:
                for found, rows in by_batch(batch):
                    if found != b and held:
                        yield b, held
                        held = []
                    b = found
                    held.append(_lists(rows))
            if held:
                yield b, held

        for b, held in whole():
            total = samples.counted_pairs(*(np.concatenate(v) for v in zip(*held, strict=True)))[1:]
            now, norm, loss = one_round(now, total, val, step, batch_size, lr, max_norm)
            rows = param_rows(now)
            figures = pa.table({"tensor": pa.array([None], pa.string()), "block": pa.array([None], pa.int32()), "row": pa.array([None], pa.int64()),
                                "vec": pa.array([[norm] if loss is None else [norm, loss]], pa.list_(pa.float64()))})
            for batch in pa.concat_tables([rows, figures]).combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, b)), *batch.columns],
                                                 names=["batch_id", *batch.schema.names])

    rows = pairs.filter((F.col("batch_id") >= begin) & (F.col("batch_id") < end)).select("batch_id", "xs", "ys", "ns")
    found = save_scratch(rows.coalesce(1).sortWithinPartitions("batch_id").mapInArrow(run, ROUNDS_SCHEMA), "rounds")
    bc.destroy()
    return found


def read_rounds(found: DataFrame, model: Model, begin: int, end: int) -> tuple[list[Model], list[tuple]]:
    """From ``run_rounds``: the models after the rounds, and (gradient norm, validation loss or None) of each."""
    n, width = model.embed.shape
    models = [Model(model.lo, np.zeros((n, width)), np.zeros((width, n))) for _ in range(begin, end)]
    figures = [None] * (end - begin)
    for batch in found.toArrow().to_batches():
        at, tensor = batch.column("batch_id").to_numpy() - begin, batch.column("tensor").to_numpy(zero_copy_only=False)
        for i in np.unique(at).tolist():
            here = at == i
            for vec in batch.filter(pa.array(here & (tensor == None))).column("vec").to_pylist():  # noqa: E711
                figures[i] = (vec[0], vec[1] if len(vec) > 1 else None)
            for name in ("embed", "unembed"):
                rows = batch.filter(pa.array(here & (tensor == name)))
                if rows.num_rows:
                    row, values = rows.column("row").to_numpy() - model.lo, scoring.vectors(rows.column("vec"))
                    if name == "embed":
                        models[i].embed[row] = values
                    else:
                        models[i].unembed[:, row] = values.T
    return models, figures


def pair_losses(model: Model, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """``-ln p(y | x)`` of the pairs, from slices of ``step`` distinct current tokens."""
    x, y, out = model.known(x), model.known(y), np.zeros(len(x))
    tokens, row = np.unique(x, return_inverse=True)
    for lo in range(0, len(tokens), step):
        ex = np.exp(model.embed[tokens[lo: lo + step]] @ model.unembed)
        term = -np.log(np.maximum(clipped(ex) / clipped(ex.sum(axis=1))[:, None], SMOL))
        at = slice(None) if len(tokens) <= step else (row >= lo) & (row < lo + step)
        out[at] = term[row[at] - lo, y[at]]
    return out


def window_losses(windows: DataFrame, models: list[Model], begin: int) -> dict:
    """batch_id -> row (avg, min, max, n) of the losses of its samples, each with the model ``models[batch_id - begin]``.

    Rows ``(batch_id, doc_id, k, xs, ys, ns)``; what is shuffled is a loss a window.
    """
    spark = windows.sparkSession
    ensure_worker_import(spark)
    bc, step = spark.sparkContext.broadcast(models), scoring.slice_rows(len(models[0].embed))
    rows = windows.filter((F.col("batch_id") >= begin) & (F.col("batch_id") < begin + len(models)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, rows in by_batch(batch):
                x, y, n = _lists(rows)
                sizes = np.diff(rows.column("xs").offsets.to_numpy())
                row = np.repeat(np.arange(rows.num_rows), sizes)
                loss = np.bincount(row, n * pair_losses(bc.value[b - begin], x, y, step), minlength=rows.num_rows)
                found = pa.RecordBatch.from_arrays([rows.column("batch_id"), rows.column("doc_id"), rows.column("k"), pa.array(loss, pa.float64())],
                                                   names=["batch_id", "doc_id", "k", "loss"])
                yield found.filter(pa.array(sizes > 0))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.schema.fields if f.name in ("doc_id", "k"))
    names = ["batch_id", "doc_id", "k"]
    rows = rows.select(*names, "xs", "ys", "ns").mapInArrow(
        run, f"batch_id bigint, {kinds}, loss double")
    losses = rows.groupBy(*names).agg(F.sum("loss").alias("loss"))
    got = losses.groupBy("batch_id").agg(F.avg("loss").alias("avg"), F.min("loss").alias("min"), F.max("loss").alias("max"),
                                         F.count(F.lit(1)).alias("n")).collect()
    bc.destroy()
    return {r["batch_id"]: r for r in got}


def validation_pairs(rows: DataFrame | None, most: int) -> tuple | None | bool:
    """(x, y, n, number of samples) of the validation pairs ``(doc_id, x, y, n)``; None without any, False if above ``most``."""
    if rows is None:
        return None
    n_samples = rows.select("doc_id").distinct().count()
    total = rows.groupBy("x", "y").agg(F.sum("n").alias("n"))
    if not n_samples:
        return None
    if total.count() > most:
        return False
    found = total.toArrow()
    return *(found.column(c).to_numpy() for c in ("x", "y", "n")), n_samples


def param_table(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame(param_rows(model)).select("tensor", F.col("block").cast("int").alias("block"), "row", "vec")
