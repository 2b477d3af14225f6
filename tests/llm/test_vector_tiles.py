"""Vectors travel a copy a tile, not a copy a grid cell, and the grids in the task miss no pair."""

import os

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import embed_dedup


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x[n // 2:] = x[rng.integers(0, n // 4, n - n // 2)] + rng.normal(size=(n - n // 2, dims)) * 0.25
    return x.astype(np.float32)


def brute(x, cosine=embed_dedup.COSINE):
    u = embed_dedup.unit(x.astype(np.float64))
    linked = u @ u.T >= cosine
    np.fill_diagonal(linked, False)
    return linked


def test_scratch_tables_hold_few_copies(spark, tmp_path, monkeypatch):
    x = vectors(3000, 64, 1)
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(path)
    written = []

    def save(df, name, save=embed_dedup.save):
        saved = save(df, name)
        written.append((name, sum(os.path.getsize(f.removeprefix("file:")) for f in saved.inputFiles())))
        return saved

    monkeypatch.setattr(embed_dedup, "save", save)
    got = {r.vec_id: r.n_links for r in embed_dedup.near_vectors(spark.read.parquet(path)).collect()}
    label = np.arange(len(x)) % 2
    want = (brute(x) & (label[:, None] == label)).sum(1)
    assert want.max() > 2 and got == dict(enumerate(want.tolist()))
    assert sum(n for _, n in written) < 3 * x.nbytes, written


@pytest.mark.parametrize("dims", [2, 3, 64])
@pytest.mark.parametrize("depth", [1, 2, 3])
def test_grids_find_every_pair_once(dims, depth):
    x = vectors(300, dims, depth)
    y = embed_dedup.unit(x.astype(np.float64)) @ embed_dedup.rotation(dims)
    everything, other = np.arange(0, 200), np.arange(200, 300)
    for block, (lo, hi) in enumerate(embed_dedup.blocks(dims)):
        own, budget = y[:, lo: hi], embed_dedup.budgets(dims, 0.93)[block]
        near = ((own[:, None] - own[None]) ** 2).sum(2) <= budget
        for left, right in ((everything, everything), (everything, other)):
            found = [tuple(sorted(p)) for i, j in embed_dedup._candidates(own, left, right, budget, min(depth, hi - lo))
                     for p in zip(i.tolist(), j.tolist())]
            assert len(found) == len(set(found))
            assert {(i, j) for i in left.tolist() for j in right.tolist() if i < j and near[i, j]} <= set(found)


@pytest.mark.parametrize("cell", [256, 2])
def test_tiles_that_meet(monkeypatch, cell):
    monkeypatch.setattr(embed_dedup, "CELL", cell)     # 2: a deep grid
    monkeypatch.setattr(embed_dedup, "PAIRS", 50)
    monkeypatch.setattr(embed_dedup, "MATRIX", 64)
    x = vectors(400, 64, 5)
    n, tile = len(x), np.arange(400) % 3
    linked, links, roots = brute(x), np.zeros(n, int), []
    for t, u in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)):
        at = np.flatnonzero((tile == t) | (tile == u))
        out = embed_dedup._meet(0.93, np.float32)(pa.table({
            "id": at, "mult": np.ones(len(at), np.int64), "raw": pa.array([v.tobytes() for v in x[at]], pa.binary()),
            "tile": tile[at], "t": np.full(len(at), t), "u": np.full(len(at), u)}))
        links[out["id"].to_numpy()] += out["links"].to_numpy()
        roots += zip(out["id"].to_pylist(), out["root"].to_pylist())
    assert links.tolist() == linked.sum(1).tolist() and links.sum() > 200
    part = list(range(n))                              # every link is joined by the forests, and nothing else
    for a, b in roots:
        old, new = part[a], part[b]
        part = [new if p == old else p for p in part]
    reach = linked | np.eye(n, dtype=bool)
    for _ in range(9):
        reach = reach.astype(int) @ reach.astype(int) > 0
    assert (np.equal.outer(part, part) == reach).all()


def test_bytes_of_odd_vectors():
    rows = [[1.0, 2.0], None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [3.0, 4.0, 5.0]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10), pa.int64()), pa.array([0] * 10),
                                        pa.array([[9.0], *rows, [7.0]], pa.list_(pa.float32()))], names=["vec_id", "label", "embedding"]).slice(1, 8)
    out = pa.Table.from_batches(embed_dedup._valid_batches(np.float32)(iter([batch])))
    assert out["vec_id"].to_pylist() == list(range(1, 9))
    assert [r and np.frombuffer(r, np.float32).tolist() for r in out["raw"].to_pylist()] == [[1, 2], *[None] * 6, [3, 4, 5]]
