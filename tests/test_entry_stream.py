"""Driver contract and the streaming encoder."""

import os

import __spark_entry__ as E
from glyphmill.operators.codec import encode
from glyphmill.operators.vocab import train_vocab
from glyphmill.sources.corpus import read_corpus
from glyphmill.streaming.encode_stream import encode_stream, read_document_stream


def test_entry_runs(spark):
    rows = E.entry(spark).limit(3).collect()
    assert rows[0]["nseq"] == "th" and rows[0]["cnt"] >= rows[1]["cnt"]


def test_registry_names_match(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)


def test_stream_encode_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    docs = read_corpus(spark, f"{src}/documents.parquet")
    v, _ = train_vocab(docs, 2, 200)
    sink = str(tmp_path / "sink")
    q = encode_stream(read_document_stream(spark, src, file_glob="documents.parquet"), v, sink,
                      checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    got = {r["doc_id"]: r["tokens"] for r in spark.read.parquet(sink).collect()}
    want = {r["doc_id"]: r["tokens"] for r in encode(docs, v).collect()}
    assert got == want and os.path.isdir(sink)
