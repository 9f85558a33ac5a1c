"""Coverage and distribution operators over long (document, parameter, count) frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def documents_by(docs: DataFrame, columns: list[str], *, key: str = "title") -> DataFrame:
    """(column, value, n): non-null ``key`` count per value of each column, NULL values dropped (CMP20).

    One scan: each row fans out to one (column, value) pair per listed column.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    long = docs.select(F.col(key), pairs.alias("p")).select(key, "p.column", "p.value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(key).cast("long").alias("n"))


def coverage_by_doc(counts: DataFrame, docs: DataFrame, n_params: int, *, title: str = "title", doc: str = "policy_title") -> DataFrame:
    """(title, total_params_mentioned, total_mentions, framework_coverage) for every document (CMP13).

    Long form of the row-wise ``(m > 0).sum(axis=1)`` / ``m.sum(axis=1)``;
    documents without codes get 0 (NULL counts sum to 0, G3).
    """
    per = counts.groupBy(doc).agg(
        F.count_if(F.col("count") > 0).cast("long").alias("p"), F.sum("count").cast("long").alias("m")
    )
    out = docs.select(title).join(per.withColumnRenamed(doc, title), title, "left")
    p = F.coalesce(F.col("p"), F.lit(0)).cast("long")
    return out.select(
        title,
        p.alias("total_params_mentioned"),
        F.coalesce(F.col("m"), F.lit(0)).cast("long").alias("total_mentions"),
        (F.round(p / F.lit(float(n_params)), 6) + F.lit(0.0)).alias("framework_coverage"),
    )


def coverage_averages(cov: DataFrame) -> DataFrame:
    """(metric, average_value): the mean of each coverage metric, one row per metric (AGG7)."""
    cols = ["total_params_mentioned", "total_mentions", "framework_coverage"]
    means = cov.agg(*[F.avg(c).alias(c) for c in cols])
    return means.unpivot([], cols, "metric", "average_value").select(
        "metric", (F.round("average_value", 6) + F.lit(0.0)).alias("average_value")
    )


def coverage_by(cov: DataFrame, docs: DataFrame, dims: list[str], *, title: str = "title") -> DataFrame:
    """(dimension, value, n_docs, mean_coverage) for each metadata dimension in one pass (CMP14)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]))
    long = cov.join(docs.select(title, *dims), title).select(title, "framework_coverage", pairs.alias("p"))
    long = long.select(title, "framework_coverage", "p.dimension", "p.value").where(F.col("value").isNotNull())
    return long.groupBy("dimension", "value").agg(
        F.count("*").cast("long").alias("n_docs"), (F.round(F.avg("framework_coverage"), 6) + F.lit(0.0)).alias("mean_coverage")
    )


def distribution_by(
    counts_long: DataFrame, docs: DataFrame, dims: list[str], parameters: list[str], *, title: str = "title"
) -> DataFrame:
    """(dimension, value, parameter, n, pct): parameter counts per dimension value and their row share in % (CMP12).

    Dense like the reference's ``groupby(dim)[param_cols].sum()``: every
    (dimension value, parameter) appears, n = 0 when never coded, pct NULL
    when the value has no codes at all (0/0). All dimensions in one pass;
    the share divides by the value's total with a window over (dimension, value).
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]))
    doc_dims = docs.select(title, pairs.alias("p")).select(title, "p.dimension", "p.value").where(F.col("value").isNotNull())
    sums = counts_long.join(doc_dims, title).groupBy("dimension", "value", "parameter").agg(F.sum("count").alias("n"))
    grid = doc_dims.select("dimension", "value").distinct().select(
        "dimension", "value", F.explode(F.array(*[F.lit(p) for p in parameters])).alias("parameter")
    )
    full = grid.join(sums, ["dimension", "value", "parameter"], "left").withColumn(
        "n", F.coalesce(F.col("n"), F.lit(0)).cast("long")
    )
    total = F.sum("n").over(Window.partitionBy("dimension", "value"))
    return full.withColumn("pct", F.round(F.try_divide(F.col("n") * F.lit(100.0), total), 6) + F.lit(0.0))


def coverage_over_time(cov: DataFrame, docs: DataFrame, *, date: str = "date", fmt: str = "MM-dd-yyyy", title: str = "title") -> DataFrame:
    """(title, date, framework_coverage) for documents with a parseable date; bad or missing dates dropped (CMP14, G22)."""
    d = docs.select(title, F.to_date(F.try_to_timestamp(F.col(date), F.lit(fmt))).alias("date"))
    return cov.join(d, title).where(F.col("date").isNotNull()).select(title, "date", "framework_coverage")
