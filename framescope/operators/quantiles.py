"""Exact quantiles of doubles by repeated selection, grouped, with state that does not grow with the distinct values.

``percentile`` keeps a map of every distinct value in one buffer. Here a quantile's
two order statistics are found from outside in: each pass counts the rows of at
most ``BUCKETS`` buckets between the bounds known so far (partial counts meet in
the shuffle, ``BUCKETS`` rows a group and bound), and the bucket that holds the
wanted rank gives the next, narrower bounds: its least and greatest value. A
selection ends when the bounds meet, or when at most ``FINISH`` rows lie between
them, which are then sorted. Buckets only need to keep the order of values, so
rounding in their formula cannot change a result; they split the signs first and
are then equal in width, or in ratio where the bounds lie far apart, so that a few passes suffice for
values of any spread. Groups of any number: bounds are a table joined to the
rows (broadcast only behind the size check).

NULL and NaN do not count; infinite values do. A group without values has NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .guards import MAX_BROADCAST_LOOKUP, checked_broadcast

BUCKETS, FINISH, FAR = 1024, 50_000, 1e6


def _bucket(x: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """Number of a bucket between the bounds, growing with ``x``; bounds and infinite values are apart."""
    infinite = F.lit(float("inf"))
    # halves, so that the difference of two large values stays finite
    linear = (x / 2 - lo / 2) / (hi / 2 - lo / 2)
    up = (F.ln(x) - F.ln(lo)) / (F.ln(hi) - F.ln(lo))
    down = (F.ln(-lo) - F.ln(-x)) / (F.ln(-lo) - F.ln(-hi))
    share = F.when((lo > 0) & (hi / lo > FAR), up).when((hi < 0) & (lo / hi > FAR), down).otherwise(linear)
    share = F.greatest(F.least(F.floor(share * (buckets - 2)) + 1, F.lit(buckets - 2)), F.lit(1))
    signs = F.when(x < 0, 1).when(x == 0, 2).otherwise(3)
    inner = F.when((lo == -infinite) | (hi == infinite), F.lit(1)).when((lo < 0) & (hi > 0), signs).otherwise(share)
    return F.when(x <= lo, 0).when(x >= hi, buckets - 1).otherwise(inner).cast("int")


def _matching(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the ranges of their group they lie in (``_lo``, ``_hi``)."""
    side = checked_broadcast(ranges.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], "_lo", "_hi").distinct(), MAX_BROADCAST_LOOKUP, "bounds").df
    inside = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)], F.lit(True))
    return rows.join(side, same & inside).select(*keys, "_x", "_lo", "_hi")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """Inner join on the group (NULL is a group) and on ``more``."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    same = [left[k].eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [left[c] == F.col(f"_r_{c}") for c in more]
    rest = [c for c in right.columns if c not in (*keys, *more)]
    return left.join(r, reduce(lambda a, b: a & b, same)).select(*left.columns, *[F.col(f"_r_{c}").alias(c) for c in rest])


def exact_quantiles(df: DataFrame, col: str | Column, probabilities: list[float], by=None, *, buckets: int = BUCKETS, finish: int = FINISH) -> DataFrame:
    """(by..., quantiles): linearly interpolated quantiles of each group, as ``percentile`` and numpy define them."""
    keys = [] if by is None else [by] if isinstance(by, str) else list(by)
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    ensure_checkpoint_dir(df.sparkSession)
    all_rows = df.select(*keys, x.alias("_x"))
    rows = all_rows.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    ok = F.when(F.col("_x").isNotNull() & ~F.isnan("_x"), F.col("_x"))
    sizes = all_rows.groupBy(*keys).agg(F.count(ok).alias("_n"), F.min(ok).alias("_lo"), F.max(ok).alias("_hi")).checkpoint()
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(p) * (F.col("_n") - 1)), F.ceil(F.lit(p) * (F.col("_n") - 1))) for p in probabilities])))
    open_ = sizes.where("_n > 0").select(*keys, F.explode(ranks.cast("array<bigint>")).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_inside"))
    columns = [*keys, "_rank", "_lo", "_hi", "_before", "_inside"]
    done = []
    while True:
        ready = (F.col("_lo") == F.col("_hi")) | (F.col("_inside") <= finish)
        open_ = open_.checkpoint()  # a few rows a group
        done.append(open_.where(ready))
        open_ = open_.where(~ready)
        if open_.isEmpty():
            break
        counted = _matching(rows, open_, keys).groupBy(*keys, "_lo", "_hi", _bucket(F.col("_x"), F.col("_lo"), F.col("_hi"), buckets).alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most")
        )
        below = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_below", F.coalesce(F.sum("_c").over(below), F.lit(0)))
        at = F.col("_rank") - F.col("_before") - F.col("_below")
        open_ = _joined(open_, counted, keys, ["_lo", "_hi"]).where((at >= 0) & (at < F.col("_c"))).select(
            *keys, "_rank", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_before") + F.col("_below")).alias("_before"), F.col("_c").alias("_inside")
        )
    found = reduce(DataFrame.unionByName, [d.select(*columns) for d in done])
    same = found.where("_lo = _hi").select(*keys, "_rank", F.col("_lo").alias("_v"))
    left = found.where("_lo < _hi")
    # at most ``finish`` rows a range
    lists = _matching(rows, left, keys).groupBy(*keys, "_lo", "_hi").agg(F.sort_array(F.collect_list("_x")).alias("_all"))
    rest = _joined(left, lists, keys, ["_lo", "_hi"]).select(*keys, "_rank", F.element_at("_all", (F.col("_rank") - F.col("_before") + 1).cast("int")).alias("_v"))
    values = same.unionByName(rest).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    whole = _joined(sizes, values, keys, []) if keys else sizes.where("_n > 0").crossJoin(values)  # one row each
    none = sizes.where("_n = 0").select(*keys, F.lit(None).cast("array<double>").alias("quantiles"))

    def interpolated(p: float) -> Column:
        place = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.floor(place), F.ceil(place)
        a, b = F.element_at("_at", lo.cast("long")), F.element_at("_at", hi.cast("long"))
        return F.when((lo == hi) | (a == b), a).otherwise((hi - place) * a + (place - lo) * b)

    return whole.select(*keys, F.array(*[interpolated(p) for p in probabilities]).alias("quantiles")).unionByName(none)
