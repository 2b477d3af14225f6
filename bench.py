"""Headline timings at one scale factor; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is run to completion with a no-op sink (``write.format("noop")``),
so the whole plan executes without collecting rows to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from glyphmill.operators import codec, nseq, samples, training  # noqa: E402
from glyphmill.operators.vocab import train_vocab  # noqa: E402
from glyphmill.plans import queries as Q  # noqa: E402
from glyphmill.session import checkpoint_dir, local_session  # noqa: E402
from glyphmill.sources.corpus import read_corpus  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


REPEATS = 3


def many_files(spark, sf_dir: str, cpus: int) -> str:
    """A copy of the tables in as many files as cores, as a corpus of real size has.

    The given tables are single row groups, which one task would read alone; the library adds no
    exchange of its own for that, so that the benched plans are the shipped ones.
    """
    out = f"{checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}"
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(cpus).write.parquet(f"{out}/{t}.parquet")
    return out


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus=cpus, shuffle_partitions=cpus, app="glyphmill-bench")
    tables = many_files(spark, sf_dir, cpus)
    docs = read_corpus(spark, f"{tables}/documents.parquet")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    times: dict[str, float] = {}

    def timed(name, fn, repeats=REPEATS):
        """Best of ``repeats`` runs, on a cleared cache each time."""
        best = None
        for _ in range(repeats):
            spark.catalog.clearCache()
            t0 = time.time()
            fn()
            best = min(time.time() - t0, best or 1e9)
        times[name] = round(best, 3)

    run(nseq.nseq_counts(docs, 2))  # warm-up: JVM and code generation
    timed("bigram_counts", lambda: run(nseq.nseq_counts(docs, 2)))
    timed("trigram_counts", lambda: run(nseq.nseq_counts(docs, 3)))
    timed("segment_counts", lambda: run(nseq.segment_counts(docs)))
    holder = {}
    timed("train_vocab_1k", lambda: holder.update(v1k=train_vocab(docs, 2, 1_000)), 1)
    timed("train_vocab_10k", lambda: holder.update(v10k=train_vocab(docs, 2, 10_000)), 1)
    v, report = holder["v10k"]
    timed("encode_corpus", lambda: run(codec.encode(docs, v)))
    timed("encode_decode_roundtrip",
          lambda: run(codec.decode(codec.encode(docs, v), v, "tokens", "back")))
    for name in ("sample_windows", "shift_pairs", "pair_loss", "batch_metrics", "vector_layernorm", "clip_by_norm"):
        timed(name, lambda f=Q.registry()[name]: run(f(spark, tables)), 2)
    # gradient rounds at the reference's batch size, on character tokens
    toks, mv, emb = Q._model(spark, tables)
    wins = samples.sample_windows(toks, Q.SAMPLE_SIZE, Q.SEED)
    pairs = Q._to_idx(samples.pair_counts(wins, ["doc_id", "k"]), mv, ["x", "y"])
    ids = samples.limit_samples(wins.select("doc_id", "k"), None, samples.BATCH_SIZE)
    params = training.init_params(spark, training.ModelShape(vocab_size=mv.count()), Q.SEED)
    cfg = training.TrainConfig(batch_size=samples.BATCH_SIZE, max_batches=4)
    _, metrics = training.train(pairs, ids, params, cfg)
    rounds = [r["seconds"] for r in metrics.orderBy("batch_id").collect()][1:]
    times["gradient_round"] = round(min(rounds), 3)

    total = round(sum(times.values()), 3)
    out = {
        "metric": "total_headline_seconds",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus,
        "corpus_bytes": int(n_bytes or 0),
        "bigram_bytes_per_sec": round((n_bytes or 0) / max(times["bigram_counts"], 1e-9)),
        "encode_bytes_per_sec": round((n_bytes or 0) / max(times["encode_corpus"], 1e-9)),
        "vocab_rounds_10k": report.count(),
        "vocab_seconds_per_round_10k": round(times["train_vocab_10k"] / max(1, report.count()), 3),
        "gradient_samples_per_sec": round(samples.BATCH_SIZE / max(times["gradient_round"], 1e-9), 3),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
