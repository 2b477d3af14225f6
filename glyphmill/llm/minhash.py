"""Near-duplicate texts by b-bit MinHash over five-word shingles.

1. One pass makes each text's shingle set (64-bit hashes), its size, a digest of the set, the
   low bits of 256 minima packed into words, and 32 band keys of four full minima each.
2. Texts with equal sets form a class with a number of its own, which stands for it until the
   end: a repeated ``doc_id`` with other texts is a member of several classes.
3. Representatives that share a band key are candidates.  Each bucket first gives the pairs
   with one hub, its text with the most bucket mates in all; members that links join need no
   pair among themselves.
4. Where a bucket still lies in several components, the texts outside its largest one meet all
   of the bucket in tiles of bounded size.  A tile estimates similarity from the packed bits by
   bit counts, corrected for chance collisions; what is far below the threshold falls (``SLACK``
   is more than five standard deviations).  Of the rest a text's ``BEST`` likeliest pairs across
   components leave the task, and are confirmed on the full sets like the hubs' pairs.
5. Texts with further likely pairs across components meet once more, with their full sets: the
   task itself tests every likely pair whose texts its links have not joined yet, and gives the
   links that join components, fewer than its texts.  So near misses, which can grow with the
   square of a group, cost comparisons but leave no task.
6. Links give components by star contraction.

At the threshold a pair shares no band with probability (1 - 0.75^4)^32 < 6e-6.

Edge cases: a null text, or one without words, has an empty set and links with nothing; with
fewer words than a shingle the whole sequence is one shingle; repeated rows each return a row,
and rows that share a ``doc_id`` are linked by their own texts only; a row with a null ``doc_id`` links with nothing; an empty table gives an
empty result; other columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import textbytes as tb
from glyphmill.llm.common import drop_saved, in_bit_table, salt, save
from glyphmill.llm.components import components

SHINGLE = 5
BANDS, ROWS = 32, 4
#: Minima; the bands are made of the first ones, the estimate of all.
HASHES = 256
BITS = 2
#: Similarity in hundredths that links, and how far below it an estimate may lie.
PERCENT = 75
SLACK = 0.17
#: Rows of a bucket's tile, and the pairs of a text that leave it.
TILE = 4096
BEST = 4
#: Shingles of a tile whose full sets meet.
SET_TILE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_WORDS = HASHES // 64


def shingle_sets(body: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, text = tb.word_hashes(body, offs, lower=True)
    n = len(offs) - 1
    at = np.searchsorted(text, np.arange(n + 1))
    grams = tb.windows(hashes, SHINGLE)
    short = tb.running(hashes) if len(hashes) < 2 * tb.SLICE else None
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            s = np.sort(grams[a: b - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            whole = short if short is not None else tb.running(hashes[a:b])
            lo = a if short is not None else 0
            out.append(tb.span_hash(whole, np.array([lo]), np.array([lo + b - a])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(non-empty sets, HASHES) minima of multiply-add hashes of the shingles."""
    sizes = np.array([len(s) for s in sets])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint32)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat(x * _A[i] + _B[i], first)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    wide = m[:, : BANDS * ROWS].astype(np.uint64).reshape(len(m), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
    for r in range(0, ROWS, 2):
        key = tb.mix(key * np.uint64(0x9E3779B97F4A7C15) + (wide[:, :, r] << np.uint64(32) | wide[:, :, r + 1]))
    return key.view(np.int64)


def packed_bits(m: np.ndarray) -> np.ndarray:
    """(texts, BITS * HASHES / 64) words: one bit plane of all minima after the other."""
    planes = [np.packbits((m >> np.uint32(p + 3)) & np.uint32(1), axis=1).view(np.int64) for p in range(BITS)]
    return np.hstack([p.reshape(len(m), -1) for p in planes])


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2) figures that tell unequal sets of one size apart; zeros for an empty set."""
    return np.array([[int(np.bitwise_xor.reduce(tb.mix(s)).view(np.int64)),
                      int(tb.mix(s + np.uint64(7)).sum(dtype=np.uint64).view(np.int64))] if len(s) else [0, 0]
                     for s in sets], np.int64).reshape(-1, 2)


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offs = tb.column(batch.column("text"))
        for lo, hi in tb.slices(offs):
            sets = shingle_sets(body, offs[lo: hi + 1])
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            bands = np.zeros((len(sets), BANDS), np.int64)
            bits = np.zeros((len(sets), BITS * _WORDS), np.int64)
            digest = digests(sets)
            if len(full):
                m = minima([sets[i] for i in full.tolist()])
                bands[full], bits[full] = band_keys(m), packed_bits(m)

            def lists(x):
                at = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.reshape(-1), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(sizes),
                 pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), lists(bits), lists(bands)],
                names=["doc_id", "n", "d1", "d2", "bits", "bands"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offs = tb.column(batch.column("text"))
        for lo, hi in tb.slices(offs):
            sets = shingle_sets(body, offs[lo: hi + 1])
            sizes = np.array([len(s) for s in sets], np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            digest = digests(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(sizes),
                 pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["doc_id", "n", "d1", "d2", "set"])


def estimate(a: str, b: str) -> Column:
    """Similarity from packed bits: shared minima's low bits agree, others by chance 2^-BITS."""
    same = None
    for w in range(_WORDS):
        differ = None
        for p in range(BITS):
            i = p * _WORDS + w
            x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
            differ = x if differ is None else differ.bitwiseOR(x)
        n = F.lit(64) - F.bit_count(differ)
        same = n if same is None else same + n
    chance = 2.0 ** -BITS
    return (same / F.lit(float(HASHES)) - chance) / (1 - chance)


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, na, nb): the pairs (a, b) that their sizes and packed bits allow."""
    side = reps.select("id", "n", "bits")
    p = pairs.join(side.toDF("a", "na", "bits_a"), "a").join(side.toDF("b", "nb", "bits_b"), "b")
    return p.filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
                    & (estimate("bits_a", "bits_b") >= PERCENT / 100 - SLACK)).select("a", "b", "na", "nb")


def _tile_turns(table: pa.Table):
    """A slot's columns and its turns (left rows, right rows), each within one (bucket, tile pair)."""
    table = table.sort_by([(c, "ascending") for c in ("bucket", "t", "u")])
    keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("bucket", "t", "u")])
    cols = {c: table.column(c).to_numpy() for c in ("id", "n", "comp")} | {"bucket": keys[0]}
    n = len(cols["id"])
    cols["bits"] = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(n, -1)
    left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
    cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), n]
    turns = []
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        ours, theirs = x + np.flatnonzero(left[x:y]), x + np.flatnonzero(~left[x:y])
        if len(ours) and len(theirs):
            turns.append((ours, theirs))
    return table, cols, turns


def _able(cols: dict, rows: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs sizes and packed bits allow, across components; agreeing minima)."""
    chance = 2.0 ** -BITS
    need = HASHES * ((PERCENT / 100 - SLACK) * (1 - chance) + chance) - 1e-6
    bits, n, comp = cols["bits"], cols["n"], cols["comp"]
    same = np.zeros((len(rows), len(theirs)), np.int16)
    for w in range(_WORDS):
        differ = np.zeros(same.shape, np.uint64)
        for c in range(w, BITS * _WORDS, _WORDS):
            differ |= bits[rows, c][:, None] ^ bits[theirs, c][None, :]
        same += 64 - np.bitwise_count(differ).astype(np.int16)
    na, nb = n[rows][:, None], n[theirs][None, :]
    return ((same >= need) & (comp[rows][:, None] != comp[theirs][None, :])
            & (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * PERCENT)), same


def _nearest(best: int):
    """Each left row's ``best`` likeliest pairs across components, and (``b`` null) the rows that have further ones.

    Pairs with the bucket's hub were tried before.
    """
    def fn(table: pa.Table) -> pa.Table:
        table, cols, turns = _tile_turns(table)
        hub, ids, n, bucket = table.column("hub").to_numpy(), cols["id"], cols["n"], cols["bucket"]
        none = np.zeros(0, np.int64)
        got, on = [(none, none)], [none]
        for ours, theirs in turns:
            further = np.zeros(len(ids), bool)
            for lo in range(0, len(ours), 256):
                rows = ours[lo: lo + 256]
                able, same = _able(cols, rows, theirs)
                able[ids[rows] == hub[rows]] = False
                able[:, ids[theirs] == hub[theirs]] = False
                chosen = able
                if (able.sum(axis=1) > best).any():
                    first = np.argpartition(np.where(able, -same, 1), best - 1, axis=1)[:, :best]
                    chosen = np.zeros_like(able)
                    np.put_along_axis(chosen, first, True, axis=1)
                    chosen &= able
                    able &= ~chosen
                    further[rows] |= able.any(axis=1)
                    further[theirs] |= able.any(axis=0)
                i, j = np.nonzero(chosen)
                got.append((rows[i], theirs[j]))
            on.append(np.flatnonzero(further))
        i, j = (np.concatenate(x) for x in zip(*got, strict=True))
        more = np.concatenate(on)
        swap = ids[i] > ids[j]
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        empty = pa.nulls(len(more), pa.int64())
        return pa.table({"bucket": np.concatenate([bucket[i], bucket[more]]), "a": np.concatenate([ids[a], ids[more]]),
                         "b": pa.concat_arrays([pa.array(ids[b]), empty]), "na": np.concatenate([n[a], n[more]]),
                         "nb": pa.concat_arrays([pa.array(n[b]), empty])})
    return fn


def _exact(table: pa.Table) -> pa.Table:
    """Links by the full sets that join a (bucket, tile pair)'s components: a forest, not all pairs."""
    table, cols, turns = _tile_turns(table)
    ids, n = cols["id"], cols["n"]
    sets = table.column("set").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(n)])
    shingles, local = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    part = np.unique(cols["comp"], return_inverse=True)[1]
    held = np.zeros(len(shingles), bool)
    links: list[tuple[int, int]] = []
    for ours, theirs in turns:
        label = part.copy()  # a bucket's components, as its links join them
        for lo in range(0, len(ours), 256):
            rows = ours[lo: lo + 256]
            able, _ = _able(cols, rows, theirs)
            for row, likely in zip(rows.tolist(), able, strict=True):
                other = theirs[likely & (label[theirs] != label[row])]
                if not len(other):
                    continue
                sizes = n[other]
                firsts = np.cumsum(sizes) - sizes
                at = np.arange(sizes.sum()) + np.repeat(ends[other] - firsts, sizes)
                held[local[ends[row]: ends[row + 1]]] = True
                common = np.add.reduceat(held[local[at]], firsts, dtype=np.int64)
                held[local[ends[row]: ends[row + 1]]] = False
                for one in other[common * 100 >= (n[row] + sizes - common) * PERCENT].tolist():
                    if label[one] != label[row]:
                        links.append((row, one))
                        label[label == label[one]] = label[row]
    i, j = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table({"a": ids[i], "b": ids[j]})


def _across(rows: DataFrame, open_: DataFrame, most: int) -> DataFrame:
    """``rows`` (bucket, id, comp, ...) of the buckets ``open_``, dealt to slots of tile pairs.

    A bucket's texts outside its largest component (``left``) meet all of it.  A tile holds some
    ``most`` of what ``size`` and ``outside`` of ``open_`` sum up (rows, or shingles); a slot holds many
    small buckets, or a tile pair of a large one.
    """
    def tile(n):
        return F.ceil(F.col(n) / F.lit(most)).cast("int")

    def placed(n):
        return F.pmod(F.xxhash64("id"), tile(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), tile(n) - 1))
    here = rows.join(open_, "bucket")
    columns = rows.columns
    total = open_.agg(F.sum(F.col("size") * tile("outside") + F.col("outside") * tile("size"))).first()[0] or 0
    slot = F.pmod(F.xxhash64("bucket", "t", "u"), F.lit(int(total) // most + 1)).alias("slot")
    few = here.filter("comp <> most").select(*columns, F.lit(True).alias("left"), placed("outside").alias("t"),
                                             every("size").alias("u"))
    all_ = here.select(*columns, F.lit(False).alias("left"), placed("size").alias("u"), every("outside").alias("t"))
    return few.unionByName(all_).groupBy(slot)


def _open(rows: DataFrame, weight) -> DataFrame:
    """(bucket, size, outside, most): buckets of several components, by the sum of ``weight``."""
    each = rows.groupBy("bucket", "comp").agg(F.sum(weight).alias("n"))
    return save(each.groupBy("bucket").agg(
        F.sum("n").alias("size"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("most")).filter(
        "comps > 1").select("bucket", "size", (F.col("size") - F.col("most.n")).alias("outside"),
                            F.col("most.comp").alias("most")), "minhash-open")


def _placed(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """``rows`` with their component so far, ``comp``."""
    return rows.join(comps.select("id", "component"), "id", "left").withColumn(
        "comp", F.coalesce("component", "id")).drop("component")


def _full_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, set) of the representatives ``wanted``, a saved table."""
    texts = in_bit_table(docs.select("doc_id", "text"), wanted, "doc_id", "_read").filter("_read")
    found = texts.select("doc_id", "text").mapInArrow(_set_batches, "doc_id long, n long, d1 long, d2 long, set array<long>")
    return save(found.join(wanted, ["doc_id", "n", "d1", "d2"]).dropDuplicates(["id"]).select("id", "set"), "minhash-sets")


def _confirm(likely: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) among likely pairs, by the full sets; ``likely`` is a saved table."""
    ids = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    wanted = save(reps.select("id", "doc_id", "n", "d1", "d2").join(ids, "id", "left_semi"), "minhash-wanted")
    sets = _full_sets(wanted, docs)
    both = likely.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    links = save(both.withColumn("c", common).filter(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * PERCENT)
                 .select("a", "b"), "minhash-links")
    drop_saved(sets)
    drop_saved(wanted)
    return links


def _joined(links: DataFrame, comps: DataFrame) -> DataFrame:
    """``links`` with those that stand for the components so far."""
    return links.unionByName(comps.select(F.col("id").alias("a"), F.col("component").alias("b")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept for every row of (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    sigs = save(docs.mapInArrow(_signature_batches, "doc_id long, n long, d1 long, d2 long, "
                                "bits array<long>, bands array<long>"), "minhash-signatures")
    narrow = sigs.select("doc_id", "n", "d1", "d2")
    linked = narrow.filter("n > 0 AND doc_id IS NOT NULL")
    first = linked.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("doc_id"))
    reps = save(sigs.join(first, ["doc_id", "n", "d1", "d2"], "left_semi").dropDuplicates(["n", "d1", "d2"])
                .withColumn("id", F.monotonically_increasing_id()), "minhash-representatives")
    rows = reps.select(F.explode("bands").alias("bucket"), "id")
    several = save(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "minhash-buckets")
    # both sides are read as they are, so that a hot bucket's side can be split
    sized = save(rows.join(several, "bucket"), "minhash-bucket-rows")
    # a bucket's hub is the text with the most bucket mates in all: what copies were made from
    mates = save(sized.groupBy("id").agg(F.sum("size").alias("mates")), "minhash-mates")
    best = sized.join(mates, "id").groupBy("bucket").agg(F.max(F.struct("mates", (-F.col("id")).alias("neg"))).alias("m"))
    rows = save(sized.join(save(best.select("bucket", (-F.col("m.neg")).alias("hub")), "minhash-hubs"), "bucket"),
                "minhash-bucket-rows")

    pairs = rows.filter("id <> hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
    hub_pairs = save(_likely(pairs, reps), "minhash-likely")
    comps = components(_confirm(hub_pairs, reps, docs))
    side = reps.select("id", "n", "bits")
    apart = save(_placed(rows.select("bucket", "id", "hub"), comps), "minhash-apart")
    open_ = _open(apart, F.lit(1))
    met = apart.join(open_.select("bucket"), "bucket", "left_semi").join(side, "id")
    found = save(_across(met, open_, TILE).applyInArrow(
        _nearest(BEST), "bucket long, a long, b long, na long, nb long"), "minhash-nearest")
    tried = hub_pairs.select("a", "b")
    new = save(found.filter("b IS NOT NULL").select("a", "b", "na", "nb").distinct().join(tried, ["a", "b"], "left_anti"),
               "minhash-likely")
    comps = components(_joined(_confirm(new, reps, docs), comps))
    # where a text has further likely pairs, those that have them meet with their sets
    further = found.filter("b IS NULL").select("bucket", F.col("a").alias("id"), F.col("na").alias("n")).distinct()
    apart = save(_placed(further, comps), "minhash-apart")
    open_ = _open(apart, F.greatest("n", F.lit(SET_TILE // TILE)))  # so a tile has some TILE texts at most
    further_rows = save(apart.join(open_.select("bucket"), "bucket", "left_semi"), "minhash-bucket-rows")
    if not further_rows.isEmpty():
        wanted = save(reps.select("id", "doc_id", "n", "d1", "d2").join(further_rows.select("id").distinct(), "id", "left_semi"),
                      "minhash-wanted")
        sides = save(_full_sets(wanted, docs).join(reps.select("id", "bits"), "id"), "minhash-sides")
        links = save(_across(further_rows.join(sides, "id"), open_, SET_TILE).applyInArrow(_exact, "a long, b long"), "minhash-links")
        drop_saved(sides)
        if not links.isEmpty():
            comps = components(_joined(links, comps))
    # classes' numbers become the smallest doc_id of their component
    numbered = reps.select("id", "n", "d1", "d2", F.col("doc_id").alias("class_id")).join(comps, "id", "left")
    least = numbered.groupBy("component").agg(F.min("class_id").alias("component_id")).filter("component IS NOT NULL")
    classes = save(numbered.join(least, "component", "left").select(
        "n", "d1", "d2", "class_id", F.coalesce("component_id", "class_id").alias("component_id")), "minhash-classes")
    for read in (reps, several, sized, rows, hub_pairs, apart, found, further_rows):  # what the result does not read
        drop_saved(read)
    key = ["n", "d1", "d2"]
    salted = linked.withColumn("_salt", salt("doc_id"))
    spread = salted.select(*key, "_salt").distinct().join(classes, key)  # at most SALTS rows a class
    every = salted.join(spread, [*key, "_salt"]).select("doc_id", "n", "class_id", "component_id").unionByName(
        narrow.filter("n = 0 OR doc_id IS NULL").select(
            "doc_id", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id",
                        F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))
