"""The reference's two runs as Spark jobs that write their result tables.

* ``write_extraction_report``: documents -> sentences -> top-k per
  (document, parameter) -> adherence grid -> adherence matrix with metadata.
* ``write_analysis_report``: reviewed codes -> by-document matrix, overall and
  subcategory frequency, coverage per document, top/bottom parameters.

Tables are written by the executors (CSV with a header, or Parquet). The
melted codes feed every analysis table, so they are materialised once with a
reliable ``checkpoint()`` into the session's ``spark.checkpoint.dir`` (a
shared folder on a cluster), which also cuts their lineage; a lost executor
then recomputes from the checkpoint, not from the raw review table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import codes, search, sparse
from ..operators import coverage as cov
from ..sources.sinks import write_csv, write_parquet

METADATA_COLUMNS = ["title", "org", "doc_type", "org_type", "worker_focus", "geography", "date"]


def _writer(fmt: str):
    if fmt == "csv":
        return lambda df, path: write_csv(df, path, single_file=False)
    if fmt == "parquet":
        return write_parquet
    raise ValueError("fmt must be 'csv' or 'parquet'")


def _checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    if not spark.sparkContext.getCheckpointDir():
        raise ValueError("set spark.checkpoint.dir (a shared folder) before writing a report")
    return df.checkpoint(eager=True)


def write_analysis_report(
    review: DataFrame, metadata: DataFrame, framework: DataFrame, out_dir: str, *, fmt: str = "csv", top_n: int = 10
) -> list[str]:
    """Write the reviewed-code tables; returns the table names written.

    ``review``: (policy_title, sentence, corpus_size, primary_paramater, alt_parameter_1..4);
    ``metadata``: the document metadata with ``title``; ``framework``:
    (pos, parameter, category, subcategory, definition).
    """
    write = _writer(fmt)
    params = [r.parameter for r in framework.select("pos", "parameter").orderBy("pos").collect()]
    melted = _checkpointed(codes.melt_codes(review, framework))
    counts = codes.count_codes(melted)
    sizes = review.select("policy_title", "corpus_size").distinct()
    meta = metadata.select(*[c for c in METADATA_COLUMNS if c in metadata.columns])
    freq = codes.parameter_frequency(melted, framework)
    out = {
        "param_frequency_by_policy": codes.doc_parameter_matrix(counts, meta, params, corpus_sizes=sizes),
        "param_frequency_overall": freq.drop("pos"),
        "subcategory_frequency_overall": codes.rollup_frequency(freq),
        "adherence_summary_by_policy": cov.coverage_by_doc(counts, meta, len(params)),
        "top_10_most_adopted_parameters": codes.top_parameters(freq, "num_docs", top_n).drop("pos"),
        "top_10_most_frequent_parameters": codes.top_parameters(freq, "total_appearances", top_n).drop("pos"),
        "bottom_10_least_adopted_parameters": codes.top_parameters(freq, "num_docs", top_n, ascending=True).drop("pos"),
    }
    for name, df in out.items():
        write(df, os.path.join(out_dir, name))
    return list(out)


def write_extraction_report(
    documents: DataFrame, framework: DataFrame, out_dir: str, *, threshold: float, k: int = 5,
    key: str = "title", text: str = "raw_text", fmt: str = "csv",
) -> list[str]:
    """Write the extraction table, the adherence grid and the adherence matrix.

    ``documents``: metadata with ``key`` and ``text``; ``framework``:
    (pos, parameter, category, definition) -- the definitions are the queries.
    Sentences are scored by term-count cosine (pass vectors through
    ``operators.dense`` when a model is available).
    """
    write = _writer(fmt)
    queries = framework.select(F.col("pos").alias("query_id"), F.col("definition").alias("qtext"))
    top = sparse.topk_sparse(
        documents.select(key, text), queries, k, key=key, text=text, query_text="qtext",
        with_sentence=True, with_corpus_size=True,
    )
    names = framework.select(F.col("pos").alias("query_id"), "parameter", "category", F.col("definition").alias("query"))
    extraction = top.join(names, "query_id").select(
        F.col(key).alias("policy_title"), "corpus_size", "query_id", "parameter", "category", "query",
        F.col("rank").alias("sentence_rank"), F.col("score").alias("sentence_score"), "sentence", "sentence_index",
    )
    docs = documents.select(F.col(key).alias("doc"))
    adh = search.adherence_long(
        top.select(F.col(key).alias("doc"), "query_id", "score"), docs, queries, threshold
    ).join(names.drop("query"), "query_id")
    long = adh.select(F.col("doc").alias("policy_title"), "parameter", "category", "adheres")
    alphabetical = sorted(r.parameter for r in framework.select("parameter").collect())
    wide = search.pivot_matrix(long, "policy_title", "parameter", "adheres", alphabetical, fill=0)
    meta_cols = [c for c in ["org", "doc_type", "org_type", "geography", "date"] if c in documents.columns]
    matrix = documents.select(key, *meta_cols).join(wide, documents[key] == wide["policy_title"], "left").drop("policy_title")
    out = {"semantic_search_extractions": extraction, "adherence_long": long, "semantic_search_adherence": matrix}
    for name, df in out.items():
        write(df, os.path.join(out_dir, name))
    return list(out)
