"""Structured Streaming: encode documents as they arrive.

Encoding (E02) is stateless and row-wise, so the same ``mapInArrow`` job runs on
a streaming DataFrame: a file source of parquet documents -> segment + encode ->
parquet sink.  No state store, no watermark; exactly-once through the sink's
commit log, with the checkpoint location under the shared checkpoint folder
unless one is given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphmill.operators.codec import encode
from glyphmill.session import checkpoint_dir, ensure_worker_import


def read_document_stream(spark: SparkSession, src_dir: str, schema: str | None = None,
                         max_files_per_trigger: int | None = None,
                         file_glob: str | None = None) -> DataFrame:
    """A stream of ``(doc_id, text)`` from parquet files landing in the folder ``src_dir``."""
    schema = schema or "doc_id bigint, text string, lang string, source string, n_chars bigint"
    reader = spark.readStream.schema(schema).format("parquet")
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(src_dir).select("doc_id", "text").filter(F.col("text").isNotNull())


def encode_stream(docs: DataFrame, vocab, sink_path: str, checkpoint: str | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """Start the streaming encode job; returns the running query."""
    spark = docs.sparkSession
    ensure_worker_import(spark)
    if checkpoint is None:
        base = checkpoint_dir(spark)
        if base is None:
            raise RuntimeError("spark.checkpoint.dir is not set; pass checkpoint=")
        checkpoint = f"{base.rstrip('/')}/glyphmill-stream-{uuid.uuid4().hex}"
    encoded = encode(docs, vocab).select("doc_id", "tokens")
    writer = (encoded.writeStream.format("parquet").option("path", sink_path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
