"""Distribution summaries: describe, profile, histogram, box plot, KDE, bootstrap interval.

All exact, all distributed:

* The column is read once: the (group, value) pairs are checkpointed, and what
  needs several looks at them reads those. Quantiles are selections with
  state independent of the distinct values (:mod:`quantiles`), linearly
  interpolated as numpy and ``percentile`` do, of raw doubles too.
* Min/max/n for the histogram and KDE come from one global aggregate; only
  that one summary row reaches the driver.
* The KDE joins every distinct value to the grid points its kernel reaches, and
  no others. The bootstrap draws one weight for each (distinct value,
  replicate), a Poisson number with the value's count, from an MD5 hash: seeded,
  the same on every engine, and independent of the number of rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .quantiles import exact_quantiles

_R = 6  # rounding digits for reported statistics


def _r(c: Column) -> Column:
    return F.round(c, _R) + F.lit(0.0)


def _groups(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _kept(df: DataFrame, col: str, by=None) -> DataFrame:
    """The groups and the column as doubles ``_v``, evaluated once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.select(*_groups(by), F.col(col).cast("double").alias("_v")).checkpoint()


def _with_quantiles(agg: DataFrame, kept: DataFrame, probabilities: list[float], by) -> DataFrame:
    """One row a group: the aggregates and the array ``_q`` of quantiles."""
    keys = _groups(by)
    q = exact_quantiles(kept, "_v", probabilities, by)
    if not keys:
        return agg.crossJoin(q.withColumnRenamed("quantiles", "_q"))  # one row each
    q = q.select(*[F.col(k).alias(f"_q_{k}") for k in keys], F.col("quantiles").alias("_q"))
    return agg.join(q, reduce(lambda a, b: a & b, [agg[k].eqNullSafe(F.col(f"_q_{k}")) for k in keys]))


def describe(df: DataFrame, col: str, by=None) -> DataFrame:
    """pandas ``describe()``: count, mean, sample std, min, 25/50/75 %, max (AGG12)."""
    kept, x = _kept(df, col, by), F.col("_v")
    agg = kept.groupBy(*_groups(by)).agg(
        F.count(x).cast("long").alias("count"),
        _r(F.avg(x)).alias("mean"),
        _r(F.stddev_samp(x)).alias("std"),
        _r(F.min(x)).alias("min"),
        _r(F.max(x)).alias("max"),
    )
    q = [_r(F.col("_q")[i]).alias(name) for i, name in enumerate(("p25", "p50", "p75"))]
    return _with_quantiles(agg, kept, [0.25, 0.5, 0.75], by).select(*_groups(by), "count", "mean", "std", "min", *q, "max")


def profile(df: DataFrame, col: str, by=None) -> DataFrame:
    """numpy-style profile: mean, median, population std, min, max, 25/50/75/90/95 % (AGG13)."""
    kept, x = _kept(df, col, by), F.col("_v")
    probs = [0.25, 0.5, 0.75, 0.9, 0.95]
    agg = kept.groupBy(*_groups(by)).agg(
        F.count(x).cast("long").alias("n"),
        _r(F.avg(x)).alias("mean"),
        _r(F.stddev_pop(x)).alias("std"),
        _r(F.min(x)).alias("min"),
        _r(F.max(x)).alias("max"),
    )
    return _with_quantiles(agg, kept, probs, by).select(
        *_groups(by), "n", "mean", _r(F.col("_q")[1]).alias("median"), "std", "min", "max",
        *[_r(F.col("_q")[i]).alias(f"p{int(p * 100)}") for i, p in enumerate(probs)],
    )


def _range(df: DataFrame, col: str):
    x = F.col(col).cast("double")
    row = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd")).first()
    return row["n"], row["lo"], row["hi"], row["sd"]


def bin_index(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin of ``x`` in [lo, hi]; the last bin is closed (numpy ``histogram``)."""
    if hi == lo:
        return F.lit(0)
    raw = F.floor((x - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo))
    return F.least(raw, F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """(bin, lo, hi, count) for ``bins`` equal-width bins between min and max; empty bins count 0 (AGG15)."""
    df, col = _kept(df, col), "_v"
    n, lo, hi, _ = _range(df, col)
    spark = df.sparkSession
    if n == 0:
        return spark.createDataFrame([], "bin int, lo double, hi double, count long")
    if lo == hi:  # a constant column: half a unit to each side, as numpy does
        lo, hi = lo - 0.5, hi + 0.5
    x = F.col(col).cast("double")
    counts = df.where(x.isNotNull()).groupBy(bin_index(x, lo, hi, bins).alias("bin")).agg(F.count("*").alias("count"))
    width = (hi - lo) / bins
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return edges.join(counts, "bin", "left").select(
        "bin",
        _r(F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
        _r(F.when(F.col("bin") == bins - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(width))).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
    )


def boxplot(df: DataFrame, col: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last points inside ``whisker`` x IQR, and the outlier count (AGG16)."""
    df = _kept(df, col)
    x = F.col("_v")
    q = exact_quantiles(df, "_v", [0.25, 0.5, 0.75]).first()["quantiles"]
    if q is None:
        return df.sparkSession.createDataFrame(
            [], "q1 double, median double, q3 double, iqr double, whisker_lo double, whisker_hi double, n_outliers long"
        )
    q1, med, q3 = q
    iqr = q3 - q1
    lo_f, hi_f = q1 - whisker * iqr, q3 + whisker * iqr
    inside = (x >= F.lit(lo_f)) & (x <= F.lit(hi_f))
    return df.agg(
        _r(F.lit(q1)).alias("q1"),
        _r(F.lit(med)).alias("median"),
        _r(F.lit(q3)).alias("q3"),
        _r(F.lit(iqr)).alias("iqr"),
        _r(F.min(F.when(inside, x))).alias("whisker_lo"),
        _r(F.max(F.when(inside, x))).alias("whisker_hi"),
        F.count_if(x.isNotNull() & ~inside).cast("long").alias("n_outliers"),
    )


def kde(df: DataFrame, col: str, gridsize: int = 200, cut: float = 0.0, hist_bins: int = 15) -> DataFrame:
    """Gaussian KDE on a grid, Scott bandwidth h = n^(-1/5) x sample std (AGG17).

    A value meets only the grid points within ``REACH`` bandwidths: beyond, the
    kernel is below exp(-REACH^2 / 2) = 2e-16 of its top, so the density is off
    by less than 2e-16 / h, under the rounding of the sum. Rows a value: at most
    2 x REACH x h / (grid step) + 1. Output (point, x, density, count_density): ``count_density`` is scaled by
    n x histogram bin width to overlay a count histogram with ``hist_bins`` bins.
    """
    df, col = _kept(df, col), "_v"
    n, lo, hi, sd = _range(df, col)
    spark = df.sparkSession
    if not n or not sd:
        return spark.createDataFrame([], "point int, x double, density double, count_density double")
    h = n ** (-1.0 / 5.0) * sd
    g_lo, g_hi = lo - cut * h, hi + cut * h
    step = (g_hi - g_lo) / (gridsize - 1)
    x = F.col(col)
    values = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count("*").alias("w"))
    near = lambda d: (F.col("v") + F.lit(d * REACH * h) - F.lit(g_lo)) / F.lit(step)
    first, last = F.greatest(F.ceil(near(-1)), F.lit(0)).cast("int"), F.least(F.floor(near(1)), F.lit(gridsize - 1)).cast("int")
    pts = values.select("v", "w", F.explode(F.when(first <= last, F.sequence(first, last))).alias("point"))
    z = (F.lit(g_lo) + F.col("point") * F.lit(step) - F.col("v")) / F.lit(h)
    dens = pts.groupBy("point").agg(F.sum(F.col("w") * F.exp(-z * z / 2)).alias("s"))
    grid = spark.range(gridsize).select(F.col("id").cast("int").alias("point")).join(dens, "point", "left")
    d = F.coalesce(F.col("s"), F.lit(0.0)) / F.lit(n * h * math.sqrt(2 * math.pi))
    width = (hi - lo) / hist_bins
    return grid.select(
        "point",
        _r(F.lit(g_lo) + F.col("point") * F.lit(step)).alias("x"),
        _r(d).alias("density"),
        _r(d * F.lit(n * width)).alias("count_density"),
    )


#: bandwidths beyond which a Gaussian kernel adds nothing to a double sum
REACH = 8.5
#: counts up to this are drawn from their own distribution function, larger ones from its normal limit
SMALL = 30


def uniform(*parts: Column, draw: int = 0) -> Column:
    """A number in [0, 1) from 48 bits of the MD5 of the parts."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substr(digest, F.lit(1 + 12 * draw), F.lit(12)), 16, 10).cast("double") / F.lit(float(1 << 48))


def poisson_cdf(mean: Column) -> Column:
    """Array of P(K <= k), k = 0 ..: far enough that the rest rounds to nothing for means up to ``SMALL``."""
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("all"))

    def more(acc, k):
        term = acc["term"] * mean / k
        return F.struct(term.alias("term"), F.concat(acc["all"], F.array(F.element_at(acc["all"], -1) + term)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(4 * SMALL)), start, more, lambda acc: acc["all"])


def bootstrap_mean(df: DataFrame, value: str, by: str, key: str | None = None, replicates: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Group mean with a Poisson-bootstrap interval: (by, n, mean, lo, hi) (AGG18).

    Rows are counted by (group, value) first; a replicate weighs each cell with one
    Poisson number of mean ``count`` (the sum of as many Poisson(1) numbers), drawn
    by MD5 of group, value in millionths, replicate and seed. The work is distinct
    values x replicates, whatever the rows; ``key`` is not needed. NULL values carry no weight.
    """
    x = F.col(value).cast("double")
    cells = df.select(F.col(by).alias("_by"), x.alias("_x")).groupBy("_by", "_x").agg(F.count("_x").alias("_c"))
    cells = cells.select("_by", "_x", "_c", F.when((F.col("_c") > 0) & (F.col("_c") <= SMALL), poisson_cdf(F.col("_c").cast("double"))).alias("_cdf"))
    reps = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("_rep"))
    name = (F.coalesce(F.col("_by").cast("string"), F.lit("")), F.round(F.col("_x") * 1e6).cast("long").cast("string"), F.col("_rep").cast("string"), F.lit(str(seed)))
    # columns of their own, so that a lambda does not draw anew at every step
    reps = reps.withColumns({"_u": uniform(*name), "_v": uniform(*name, draw=1)})
    u, v = F.col("_u"), F.col("_v")
    c = F.col("_c").cast("double")
    normal = F.floor(c + F.sqrt(c) * F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v) + 0.5)
    drawn = F.when(F.col("_cdf").isNotNull(), F.size(F.filter("_cdf", lambda p: p <= u))).otherwise(F.greatest(normal, F.lit(0)))
    w = F.when(F.col("_c") == 0, F.lit(0)).when(F.col("_rep") == 0, F.col("_c")).otherwise(drawn)
    per_rep = reps.select("_by", "_rep", "_x", w.cast("long").alias("_w")).groupBy("_by", "_rep").agg(
        (F.sum(F.col("_w") * F.col("_x")) / F.nullif(F.sum("_w"), F.lit(0))).alias("m"), F.sum("_w").alias("n")
    )
    a = (1 - level) / 2
    point = F.col("_rep") == 0
    # at most ``replicates`` numbers a group
    out = per_rep.groupBy("_by").agg(
        F.max(F.when(point, F.col("n"))).alias("n"),
        F.max(F.when(point, F.col("m"))).alias("mean"),
        F.percentile(F.when(~point, F.col("m")), F.array(F.lit(a), F.lit(1 - a))).alias("ci"),
    )
    return out.select(F.col("_by").alias(by), "n", _r(F.col("mean")).alias("mean"), _r(F.col("ci")[0]).alias("lo"), _r(F.col("ci")[1]).alias("hi"))
