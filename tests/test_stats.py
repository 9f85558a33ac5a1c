"""Statistics against numpy/pandas definitions (G21), histogram, box plot, KDE, bootstrap."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framescope.operators import stats

VALUES = [0.0188, 0.2298, 0.1705, 0.2804, 0.3481, 0.3741, 0.5007, 0.229, 0.1, 0.9, 0.31, 0.31]


def frame(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "k long, x double")


def test_describe_matches_pandas(spark):
    got = stats.describe(frame(spark, VALUES), "x").first()
    exp = pd.Series(VALUES).describe()
    assert got["count"] == exp["count"]
    for ours, theirs in [("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
        assert got[ours] == pytest.approx(exp[theirs], abs=1e-6)


def test_profile_matches_numpy(spark):
    got = stats.profile(frame(spark, VALUES), "x").first()
    a = np.array(VALUES)
    assert got.std == pytest.approx(np.std(a), abs=1e-6)  # population std
    assert got.median == pytest.approx(np.median(a), abs=1e-6)
    for p in (25, 50, 75, 90, 95):
        assert got[f"p{p}"] == pytest.approx(np.percentile(a, p), abs=1e-6)


def test_histogram_matches_numpy(spark):
    got = stats.histogram(frame(spark, VALUES), "x", 5).orderBy("bin").collect()
    counts, edges = np.histogram(VALUES, bins=5)
    assert [r["count"] for r in got] == counts.tolist()
    assert [r.lo for r in got] == pytest.approx(edges[:-1].tolist(), abs=1e-6)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-100, max_value=100, allow_nan=False), min_size=1, max_size=40), st.integers(1, 12))
def test_histogram_counts_sum_to_n(spark, values, bins):
    got = stats.histogram(frame(spark, values), "x", bins).collect()
    assert len(got) == bins and sum(r["count"] for r in got) == len(values)


def test_boxplot_whiskers_and_outliers(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 100]
    got = stats.boxplot(frame(spark, vals), "x").first()
    q1, q3 = np.percentile(vals, [25, 75])
    assert (got.q1, got.q3) == (q1, q3)
    assert got.whisker_lo == 1 and got.whisker_hi == 8 and got.n_outliers == 1


def test_kde_matches_gaussian_formula(spark):
    vals = np.array(VALUES)
    got = stats.kde(frame(spark, VALUES), "x", gridsize=20).orderBy("point").collect()
    n, sd = len(vals), vals.std(ddof=1)
    h = n ** (-0.2) * sd
    grid = np.linspace(vals.min(), vals.max(), 20)
    dens = np.exp(-((grid[:, None] - vals[None, :]) / h) ** 2 / 2).sum(axis=1) / (n * h * math.sqrt(2 * math.pi))
    assert [r.density for r in got] == pytest.approx(dens.tolist(), abs=1e-6)
    width = (vals.max() - vals.min()) / 15
    assert got[3].count_density == pytest.approx(dens[3] * n * width, abs=1e-5)


def test_bootstrap_is_seeded_and_brackets_the_mean(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "a" if i % 3 else "b", float(v)) for i, v in enumerate(rng.normal(5, 1, 300))]
    df = spark.createDataFrame(rows, "k long, g string, x double")
    a = sorted(tuple(r) for r in stats.bootstrap_mean(df, "x", "g", "k", replicates=100, seed=7).collect())
    b = sorted(tuple(r) for r in stats.bootstrap_mean(df, "x", "g", "k", replicates=100, seed=7).collect())
    assert a == b
    for g, n, mean, lo, hi in a:
        assert lo < mean < hi and hi - lo < 1.0


def test_poisson_numbers_have_their_mean_and_variance(spark):
    from pyspark.sql import functions as F

    for mean in (1, 7, 400):
        # one cell of ``mean`` equal values a group: its weights add up to a Poisson number
        df = spark.range(1500).select(F.col("id").cast("string").alias("g"), F.explode(F.array_repeat(F.lit(2.0), mean)).alias("x"))
        cells = df.groupBy("g", "x").agg(F.count("x").alias("c"))
        u = stats.uniform(F.col("g"), F.lit("1"))
        if mean <= stats.SMALL:
            w = cells.select(u.alias("u"), stats.poisson_cdf(F.col("c").cast("double")).alias("p")).select(F.size(F.filter("p", lambda p: p <= F.col("u"))).alias("w"))
            m, v = w.agg(F.avg("w"), F.var_pop("w")).first()
            assert m == pytest.approx(mean, rel=0.08) and v == pytest.approx(mean, rel=0.15)
        r = stats.bootstrap_mean(df.where("g = '3'"), "x", "g", replicates=40).first()
        assert (r.n, r.mean, r.hi) == (mean, 2.0, 2.0)


def test_bootstrap_interval_has_the_width_of_the_standard_error(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(10, 2, 4000), 1)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [(None, 1.0), (None, 3.0), ("n", None)], "g string, x double")
    rows = {r.g: r for r in stats.bootstrap_mean(df, "x", "g", replicates=400, seed=5).collect()}
    a = rows["a"]
    assert a.n == 4000 and a.mean == pytest.approx(x.mean(), abs=1e-6)
    assert (a.hi - a.lo) == pytest.approx(2 * 1.96 * x.std() / math.sqrt(4000), rel=0.15)
    assert rows[None].mean == 2.0 and rows["n"].mean is None and rows["n"].n == 0


def test_bootstrap_point_estimate_ignores_nulls(spark):
    rows = [(i, "g", float(i)) for i in range(1, 11)] + [(99, "g", None)]
    df = spark.createDataFrame(rows, "k long, g string, x double")
    r = stats.bootstrap_mean(df, "x", "g", "k", replicates=50).first()
    assert r.n == 10 and r.mean == 5.5 and r.lo < 5.5 < r.hi


def test_histogram_of_a_constant_column_is_numpys(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    got = stats.histogram(df, "x", 10).orderBy("bin").toPandas()
    counts, edges = np.histogram([3.0] * 4, 10)
    assert got["count"].tolist() == counts.tolist() and np.allclose(got["lo"], edges[:-1])


WILD = [1e300, -1e300, 1e-300, -1e-300, 0.0, 5e-324, float("inf"), float("-inf"), 1.5, 1.5, -2.25, 3e7]


@pytest.mark.parametrize("buckets, finish", [(1024, 50_000), (4, 1), (8, 3)])
def test_exact_quantiles(spark, buckets, finish):
    from framescope.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(8)
    groups = {
        "normal": rng.normal(size=300).tolist(), "spread": (10.0 ** rng.uniform(-200, 200, 200) * rng.choice([-1, 1], 200)).tolist(), "ties": rng.integers(0, 3, 400).astype(float).tolist(),
        "one": [7.5], "wild": WILD, "same": [2.0] * 50, None: [1.0, 2.0, 4.0],
    }
    rows = [(g, v) for g, x in groups.items() for v in x] + [("one", None), ("one", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.quantiles for r in exact_quantiles(df, "x", probabilities, "g", buckets=buckets, finish=finish).collect()}
    assert set(got) == {*groups, "empty"} and got["empty"] is None
    for g, x in groups.items():
        x = sorted(x)
        for p, q in zip(probabilities, got[g], strict=True):
            place = p * (len(x) - 1)
            lo, hi = math.floor(place), math.ceil(place)
            want = x[lo] if x[lo] == x[hi] else (hi - place) * x[lo] + (place - lo) * x[hi]
            assert q == pytest.approx(want, rel=1e-12), (g, p)
    whole = exact_quantiles(df.where("g = 'normal'"), "x", [0.5], buckets=buckets, finish=finish).first().quantiles
    assert whole == pytest.approx([float(np.median(groups["normal"]))])
    assert exact_quantiles(df.where("false"), "x", [0.5]).first().quantiles is None
