"""Search-family operators: adherence grid, matrix, coverage, review candidates, thresholds.

Inputs are long frames: ``matches`` is the top-k output
(doc, query_id, rank, score, sentence_index); ``docs`` lists every document
key, including documents without sentences (they score 0 everywhere).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .guards import MAX_BROADCAST_QUERIES, checked_broadcast, collect_small


def query_ids(queries: DataFrame, query_id: str = "query_id") -> list:
    """The framework's query ids, sorted: the *columns* of a wide matrix, which a plan must know beforehand (size-checked)."""
    q = queries.select(query_id).distinct()
    return sorted(r[0] for r in collect_small(q, MAX_BROADCAST_QUERIES, "framework"))


def mean_topk_threshold(matches: DataFrame, *, doc: str = "doc") -> float:
    """The derived threshold: mean over documents of the mean over queries of the mean top-k score.

    The reference takes its adherence threshold this way (definition-only
    strategy). Three partial aggregations; one scalar reaches the driver.
    """
    per_query = matches.groupBy(doc, "query_id").agg(F.avg("score").alias("m"))
    per_doc = per_query.groupBy(doc).agg(F.avg("m").alias("m"))
    return per_doc.agg(F.avg("m").alias("t")).first()["t"]


def _threshold(matches: DataFrame, threshold, doc: str) -> float:
    if isinstance(threshold, str):
        if threshold != "mean":
            raise ValueError("threshold must be a number or 'mean'")
        return mean_topk_threshold(matches, doc=doc)
    return float(threshold)


def parameter_grid(docs: DataFrame, queries: DataFrame, query_id: str = "query_id", *, doc: str = "doc") -> DataFrame:
    """Every (document, query_id): the dense grid is the result itself, one row per cell.

    The framework's ids are joined, not collected: broadcast behind a size
    check, without a hint beyond it -- the same rows at every size.
    """
    ids = checked_broadcast(queries.select(F.col(query_id).alias("query_id")).distinct(), MAX_BROADCAST_QUERIES, "framework").df
    return docs.select(doc).distinct().join(ids)


def adherence_long(
    matches: DataFrame,
    docs: DataFrame,
    queries: DataFrame,
    threshold=0.3610,
    *,
    doc: str = "doc",
    query_id: str = "query_id",
) -> DataFrame:
    """Dense (doc, query_id, adheres) grid: 1 when a top-k score is >= threshold (inclusive).

    ``matches`` may be the top-k rows or any superset/subset that keeps each
    (doc, query)'s best score -- e.g. ``dense.best_dense`` -- since
    any(top-k >= t) is max >= t. A document with no matches for a query (or
    no sentences at all) gets 0; documents outside ``docs`` are left out.
    ``threshold='mean'`` derives it from the matches (G12).
    """
    t = _threshold(matches, threshold, doc)
    qtype = matches.schema["query_id"].dataType
    grid = parameter_grid(docs, queries, query_id, doc=doc).select(
        doc, F.col("query_id").cast(qtype).alias("query_id"), F.lit(None).cast("double").alias("score"), F.lit(1).alias("in_grid")
    )
    scored = matches.select(doc, "query_id", F.col("score").cast("double").alias("score"), F.lit(0).alias("in_grid"))
    # grid and scores meet in one aggregation (partial max on the map side) instead of a join
    best = grid.unionByName(scored).groupBy(doc, "query_id").agg(
        F.max("score").alias("best_score"), F.max("in_grid").alias("in_grid")
    )
    flag = F.coalesce((F.col("best_score") >= F.lit(t)).cast("int"), F.lit(0))
    return best.where(F.col("in_grid") == 1).select(doc, "query_id", flag.alias("adheres"))


def coverage(adherence: DataFrame, *, doc: str = "doc") -> DataFrame:
    """Per document: parameters covered, framework size and coverage share."""
    return adherence.groupBy(doc).agg(
        F.sum("adheres").cast("long").alias("total_params_mentioned"),
        F.count("*").cast("long").alias("n_params"),
        F.round(F.sum("adheres") / F.count("*"), 6).alias("framework_coverage"),
    )


def pivot_matrix(
    long: DataFrame,
    row_key: str,
    column_key: str,
    value: str,
    columns: list,
    *,
    names: list | None = None,
    fill=None,
    strict: bool = False,
) -> DataFrame:
    """Long -> wide with explicit column values in the given order.

    ``columns`` fixes the output columns and their order (absent ones are
    created). ``strict`` raises when a (row, column) pair occurs twice, as
    ``DataFrame.pivot`` does in pandas; otherwise the first value is kept.
    """
    if strict:
        dup = long.groupBy(row_key, column_key).count().where(F.col("count") > 1).limit(1).count()
        if dup:
            raise ValueError("duplicate (row, column) pairs in pivot input")
    wide = long.groupBy(row_key).pivot(column_key, columns).agg(F.first(value))
    cols = [F.col(f"`{c}`") for c in map(str, columns)]
    out_names = names or [str(c) for c in columns]
    if fill is not None:
        cols = [F.coalesce(c, F.lit(fill)) for c in cols]
    return wide.select(F.col(row_key), *[c.alias(n) for c, n in zip(cols, out_names)])


def review_candidates(matches: DataFrame, threshold: float) -> DataFrame:
    """Matches at or above the threshold: the sentences handed to human review."""
    return matches.where(F.col("score") >= F.lit(float(threshold)))


def mask_below(score: Column, threshold: float) -> Column:
    """Score where it reaches the threshold, else NULL (archive mask)."""
    return F.when(score >= F.lit(float(threshold)), score)


def binarise(score: Column, threshold: float) -> Column:
    """1 where the score reaches the threshold, else 0."""
    return (F.coalesce(score, F.lit(float("-inf"))) >= F.lit(float(threshold))).cast("int")
