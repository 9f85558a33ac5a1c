"""Reviewed-code analysis (CMP8-CMP11, CMP15, CMP19): melt, count, matrix, frequency, roll-up, rankings.

The review table has one row per coded sentence with up to five codes
(``primary_paramater`` [sic, as in the reference] and ``alt_parameter_1..4``);
codes are parameter *definitions*, mapped to names through the framework by
definition text (G14). The framework is small and size-checked before it
is broadcast.

Long frames everywhere; pivots only at the edge with explicit columns in
framework order (G5). pandas drops NULL group keys, so every count filters
NULL keys first (G1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .guards import MAX_BROADCAST_LOOKUP, checked_broadcast

CODE_COLUMNS = ["primary_paramater", "alt_parameter_1", "alt_parameter_2", "alt_parameter_3", "alt_parameter_4"]


def _small(df: DataFrame, what: str) -> DataFrame:
    return checked_broadcast(df, MAX_BROADCAST_LOOKUP, what).df


def melt_codes(
    review: DataFrame, framework: DataFrame, *, doc: str = "policy_title", sentence: str = "sentence",
    code_columns=CODE_COLUMNS, keep=(),
) -> DataFrame:
    """(doc, sentence, *keep, variable, parameter_value, parameter): one row per non-NULL code (RSH1, FLT1, JN1).

    ``framework`` has (parameter, definition); a code missing from it keeps a NULL parameter.
    """
    long = review.unpivot([doc, sentence, *keep], list(code_columns), "variable", "parameter_value")
    long = long.where(F.col("parameter_value").isNotNull())
    names = _small(framework.select(F.col("definition").alias("parameter_value"), "parameter"), "framework")
    return long.join(names, "parameter_value", "left")


def count_codes(melted: DataFrame, *, doc: str = "policy_title", carry=()) -> DataFrame:
    """(doc, parameter, count, *carry) over codes with a known document and parameter (AGG1).

    ``carry`` columns are per-document values (e.g. corpus_size) kept alongside.
    """
    return (
        melted.where(F.col(doc).isNotNull() & F.col("parameter").isNotNull())
        .groupBy(doc, "parameter")
        .agg(F.count("*").cast("long").alias("count"), *[F.max(c).alias(c) for c in carry])
    )


def parameter_frequency(
    melted: DataFrame, framework: DataFrame, *, doc: str = "policy_title", approx_docs: float | None = None
) -> DataFrame:
    """Overall frequency in framework order (CMP10): (pos, parameter, category, subcategory, definition,
    total_appearances, num_docs); parameters never coded get 0 (PRJ6).

    ``num_docs`` is exact by default (the reference's ``nunique``); pass
    ``approx_docs`` (a relative standard deviation, e.g. 0.01) to opt in to
    HyperLogLog++ (``approx_count_distinct``), which needs no (parameter,
    document) shuffle on very large corpora.
    """
    docs = F.countDistinct(doc) if approx_docs is None else F.approx_count_distinct(doc, approx_docs)
    agg = (
        melted.where(F.col("parameter").isNotNull())
        .groupBy("parameter")
        .agg(F.count("*").cast("long").alias("total_appearances"), docs.cast("long").alias("num_docs"))
    )
    fw = framework.select("pos", "parameter", "category", "subcategory", "definition")
    return fw.join(agg, "parameter", "left").select(
        "pos", "parameter", "category", "subcategory", "definition",
        F.coalesce("total_appearances", F.lit(0)).cast("long").alias("total_appearances"),
        F.coalesce("num_docs", F.lit(0)).cast("long").alias("num_docs"),
    )


def rollup_frequency(freq: DataFrame, level: str = "subcategory") -> DataFrame:
    """One level up the hierarchy (CMP11): total appearances summed, num_docs averaged."""
    return freq.where(F.col(level).isNotNull()).groupBy(level).agg(
        F.sum("total_appearances").cast("long").alias("total_appearances"),
        F.avg("num_docs").alias("num_docs"),
    )


def hierarchy_rollup(freq: DataFrame, levels=("category", "subcategory", "parameter")) -> DataFrame:
    """Frequencies rolled up the framework hierarchy in one aggregation (``rollup``):
    one row per node at every level plus the grand total; ``level`` names the
    deepest grouped column ('total' for the grand total)."""
    levels = list(levels)
    agg = freq.rollup(*levels).agg(
        F.sum("total_appearances").cast("long").alias("total_appearances"),
        F.avg("num_docs").alias("num_docs"),
        F.grouping_id(*levels).alias("_gid"),
    )
    depth = F.lit(len(levels)) - sum(
        (F.col("_gid").bitwiseAND(F.lit(1 << (len(levels) - 1 - i))) > 0).cast("int") for i in range(len(levels))
    )
    label = F.element_at(F.array(F.lit("total"), *[F.lit(l) for l in levels]), depth + 1)
    return agg.select(label.alias("level"), *levels, "total_appearances", "num_docs")


def with_mentions_per_doc(freq: DataFrame) -> DataFrame:
    """Adds avg_mentions_per_doc = total / num_docs, NULL for 0/0."""
    return freq.withColumn("avg_mentions_per_doc", F.try_divide(F.col("total_appearances").cast("double"), F.col("num_docs")))


def top_parameters(freq: DataFrame, metric: str, n: int = 10, ascending: bool = False) -> DataFrame:
    """``nlargest``/``nsmallest`` with stable ties in framework order (TOP1, G6)."""
    order = F.asc(metric) if ascending else F.desc(metric)
    return with_mentions_per_doc(freq).orderBy(order, F.asc("pos")).limit(n)


def quadrants(freq: DataFrame, x_mid=6, y_mid=20) -> DataFrame:
    """Breadth (num_docs) x depth (total_appearances) quadrant per parameter (CMP19, MTH3).

    A point on a mid-line counts as high (G25). ``x_mid``/``y_mid`` may be
    'median' to take the medians of the two measures.
    """
    if x_mid == "median" or y_mid == "median":
        m = freq.agg(F.median("num_docs").alias("x"), F.median("total_appearances").alias("y")).first()
        x_mid = m["x"] if x_mid == "median" else x_mid
        y_mid = m["y"] if y_mid == "median" else y_mid
    hb = F.col("num_docs") >= F.lit(x_mid)
    hd = F.col("total_appearances") >= F.lit(y_mid)
    label = (
        F.when(hb & hd, "high breadth, high depth")
        .when(hb, "high breadth, low depth")
        .when(hd, "low breadth, high depth")
        .otherwise("low breadth, low depth")
    )
    return freq.select("pos", "parameter", "num_docs", "total_appearances", label.alias("quadrant"))


def plot_bounds(freq: DataFrame) -> DataFrame:
    """Axis limits of the quadrant chart (AGG14): min/max with the reference's margins."""
    return freq.agg(
        (F.min("num_docs") - F.lit(0.5)).alias("x_min"),
        (F.max("num_docs") + F.lit(0.5)).alias("x_max"),
        (F.min("total_appearances") - F.lit(1)).cast("long").alias("y_min"),
        (F.max("total_appearances") + F.lit(2)).cast("long").alias("y_max"),
    )


def doc_parameter_matrix(
    counts: DataFrame, metadata: DataFrame, parameters: list[str], *, doc: str = "policy_title",
    title: str = "title", corpus_sizes: DataFrame | None = None,
) -> DataFrame:
    """Documents x parameters (CMP9): metadata, corpus size, one count column per parameter in the given order.

    One ``pivot`` with explicit values (PivotFirst: a lookup per count row,
    not one condition per parameter); when ``counts`` carries ``corpus_size``
    (constant per document) it is a grouping key of the same pass.
    Counts are zero-filled *before* the metadata join (G3): a document with
    no codes at all has NULL counts (and NULL corpus size), a document with
    codes has 0 for the parameters it lacks. ``corpus_sizes`` (doc,
    corpus_size) may be given instead, one size per document (G17).
    """
    carried = ["corpus_size"] if "corpus_size" in counts.columns else []
    extra = carried
    # explicit pivot values: PivotFirst, one lookup per count row whatever the number of parameters
    piv = counts.groupBy(doc, *carried).pivot("parameter", parameters).agg(F.first("count"))
    wide = piv.select(doc, *carried, *[F.coalesce(F.col(f"`{p}`"), F.lit(0)).cast("long").alias(p) for p in parameters])
    meta = metadata
    if corpus_sizes is not None and not extra:
        meta = meta.join(corpus_sizes.withColumnRenamed(doc, "_k"), meta[title] == F.col("_k"), "left").drop("_k")
    out = meta.join(wide.withColumnRenamed(doc, "_k"), meta[title] == F.col("_k"), "left").drop("_k")
    if extra:
        out = out.select(*metadata.columns, "corpus_size", *parameters)
    return out


def counts_long(counts: DataFrame, docs: DataFrame, *, doc: str = "policy_title", title: str = "title") -> DataFrame:
    """(title, parameter, count) restricted to documents in the metadata (the by-document path of G2)."""
    keys = docs.select(F.col(title).alias(doc)).distinct()
    return counts.join(keys, doc, "left_semi").withColumnRenamed(doc, title)


