"""The streaming extraction equals the batch operator over all files, batch by batch."""

import os

from framescope.operators import sparse
from framescope.streaming import start_extraction_stream


def test_stream_matches_batch(spark, tmp_dir):
    src, sink, ckpt = (os.path.join(tmp_dir, d) for d in ("src", "sink", "ckpt"))
    os.makedirs(src)
    queries = spark.createDataFrame([(0, "fair wages for workers"), (1, "safety rules")], "query_id long, text string")
    first = spark.createDataFrame(
        [(1, "Fair wages now. Unrelated words. Safety rules apply."), (2, "Wages are fair. Rules.")], "doc_id long, text string"
    )
    second = spark.createDataFrame([(3, "Safety first. Fair pay and fair wages.")], "doc_id long, text string")
    first.write.parquet(os.path.join(src, "p1"))
    q = start_extraction_stream(spark, os.path.join(src, "*"), queries, sink, checkpoint=ckpt, k=2)
    q.awaitTermination(120)
    second.write.parquet(os.path.join(src, "p2"))
    q = start_extraction_stream(spark, os.path.join(src, "*"), queries, sink, checkpoint=ckpt, k=2)
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(sink).drop("epoch").select(
        "doc_id", "query_id", "rank", "score", "sentence_index", "sentence").collect())
    exp = sorted(tuple(r) for r in sparse.topk_sparse(first.unionByName(second), queries, 2, with_sentence=True).select(
        "doc_id", "query_id", "rank", "score", "sentence_index", "sentence").collect())
    assert got == exp
    assert spark.read.parquet(sink).select("epoch").distinct().count() == 2
