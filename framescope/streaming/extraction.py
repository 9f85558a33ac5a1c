"""The extraction operator on documents that arrive as files (Structured Streaming).

The reference reads complete files once and has no streaming operator
(SURVEY §2.8). Each document is complete within the file that brings it, so
the per-document top-k needs no state across micro-batches: every batch of
new documents is scored with the batch operator inside ``foreachBatch`` and
written to its own ``epoch=<id>`` partition. A replayed batch after a
failure overwrites its partition (dynamic partition overwrite), so the sink
holds each batch exactly once; the stream's progress lives in a checkpoint
under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import sparse

DOCUMENT_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def start_extraction_stream(
    spark: SparkSession,
    source_dir: str,
    queries: DataFrame,
    sink_dir: str,
    *,
    k: int = 5,
    min_score: float | None = None,
    schema: T.StructType = DOCUMENT_SCHEMA,
    checkpoint: str | None = None,
    available_now: bool = True,
    name: str = "extraction",
):
    """Start a stream: new Parquet document files in ``source_dir`` -> top-k matches in ``sink_dir``.

    ``queries`` is the (small, size-checked) framework: (query_id, text).
    Returns the ``StreamingQuery``; with ``available_now`` it stops after the
    files present at start have been processed.
    """
    if checkpoint is None:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            raise ValueError("set spark.checkpoint.dir or pass checkpoint=")
        checkpoint = os.path.join(base, f"stream-{name}")
    docs = spark.readStream.schema(schema).parquet(source_dir)

    def process(batch: DataFrame, epoch_id: int) -> None:
        out = sparse.topk_sparse(batch, queries, k, min_score=min_score, with_sentence=True)
        (
            out.withColumn("epoch", F.lit(epoch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("epoch")
            .parquet(sink_dir)
        )

    writer = docs.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
