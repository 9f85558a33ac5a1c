"""Reviewed-code analysis: melt, counts, matrix, frequency, rankings, quadrants, coverage."""

import pytest
from pyspark.sql import functions as F

from fixtures import framework_df, metadata_df, review_df
from framescope.operators import codes
from framescope.operators import coverage as cov

PARAMS = ["Pay floor", "Paid on time", "Rest breaks", "Right to organise", "Never coded"]


@pytest.fixture()
def melted(spark):
    return codes.melt_codes(review_df(spark), framework_df(spark))


def test_melt_drops_null_codes_and_keeps_unknown_as_null(melted):
    rows = melted.collect()
    assert len(rows) == 10  # 7 primaries + 3 non-NULL alternates
    unknown = [r for r in rows if r.parameter is None]
    assert [r.parameter_value for r in unknown] == ["A definition outside the framework."]  # G1


def test_count_codes_by_definition_and_duplicates(melted):
    counts = {(r.policy_title, r.parameter): r["count"] for r in codes.count_codes(melted).collect()}
    assert counts == {
        ("Harbor Charter", "Pay floor"): 3,  # the same code twice in one sentence counts twice
        ("Harbor Charter", "Paid on time"): 1,
        ("Harbor Charter", "Right to organise"): 1,
        ("Lantern Code", "Rest breaks"): 1,
        ("Lantern Code", "Paid on time"): 1,
        ("Ghost Policy", "Pay floor"): 1,
        ("Harbor Charter ", "Rest breaks"): 1,
    }


def test_overall_frequency_framework_order_and_zero_rows(spark, melted):
    freq = codes.parameter_frequency(melted, framework_df(spark)).orderBy("pos").collect()
    assert [r.parameter for r in freq] == PARAMS
    assert [(r.total_appearances, r.num_docs) for r in freq] == [(4, 2), (2, 2), (2, 2), (1, 1), (0, 0)]


def test_by_document_matrix_vs_overall_g2_g3_g17(spark, melted):
    counts = codes.count_codes(melted)
    sizes = review_df(spark).select("policy_title", "corpus_size").distinct()
    meta = metadata_df(spark).select("title", "org", "doc_type")
    m = codes.doc_parameter_matrix(counts, meta, PARAMS, corpus_sizes=sizes)
    assert m.columns == ["title", "org", "doc_type", "corpus_size"] + PARAMS
    rows = {r.title: r for r in m.collect()}
    # G2: 'Ghost Policy' (absent from metadata) and the trailing-space title are not in the matrix
    assert set(rows) == {"Harbor Charter", "Lantern Code", "Meadow Pledge", "Quiet Note"}
    # No codes -> NULL counts and NULL corpus size; coded docs get 0 for missing parameters
    assert rows["Meadow Pledge"]["Pay floor"] is None and rows["Meadow Pledge"].corpus_size is None
    assert rows["Lantern Code"]["Pay floor"] == 0 and rows["Harbor Charter"]["Pay floor"] == 3
    assert rows["Harbor Charter"].corpus_size == 10  # G17: one size per title
    # Overall total (4 for Pay floor) exceeds the by-document column sum (3)
    assert sum(r["Pay floor"] or 0 for r in rows.values()) == 3


def test_rollup_and_mentions_per_doc(spark, melted):
    freq = codes.parameter_frequency(melted, framework_df(spark))
    roll = {r.subcategory: (r.total_appearances, r.num_docs) for r in codes.rollup_frequency(freq).collect()}
    assert roll == {"Wages": (6, 2.0), "Hours": (2, 2.0), "Voice": (1, 0.5)}
    m = {r.parameter: r.avg_mentions_per_doc for r in codes.with_mentions_per_doc(freq).collect()}
    assert m["Never coded"] is None and m["Pay floor"] == 2.0  # G7: 0/0 -> NULL
    mean = codes.with_mentions_per_doc(freq).agg(F.avg("avg_mentions_per_doc")).first()[0]
    assert mean == pytest.approx((2.0 + 1.0 + 1.0 + 1.0) / 4)  # NULL skipped


def test_top_and_bottom_ties_in_framework_order(spark, melted):
    freq = codes.parameter_frequency(melted, framework_df(spark))
    top = [r.parameter for r in codes.top_parameters(freq, "num_docs", 3).collect()]
    assert top == ["Pay floor", "Paid on time", "Rest breaks"]  # G6: three-way tie at 2 in framework order
    bottom = [r.parameter for r in codes.top_parameters(freq, "num_docs", 2, ascending=True).collect()]
    assert bottom == ["Never coded", "Right to organise"]


def test_quadrants_inclusive_midlines(spark, melted):
    freq = codes.parameter_frequency(melted, framework_df(spark))
    q = {r.parameter: r.quadrant for r in codes.quadrants(freq, x_mid=2, y_mid=2).collect()}
    assert q["Paid on time"] == "high breadth, high depth"  # on both lines -> high (G25)
    assert q["Right to organise"] == "low breadth, low depth"
    b = codes.plot_bounds(freq).first()
    assert (b.x_min, b.x_max, b.y_min, b.y_max) == (-0.5, 2.5, -1, 6)


def test_coverage_per_document_and_by_dimension(spark, melted):
    counts = codes.count_codes(melted)
    meta = metadata_df(spark)
    c = {r.title: (r.total_params_mentioned, r.total_mentions, r.framework_coverage) for r in
         cov.coverage_by_doc(counts, meta, len(PARAMS), doc="policy_title").collect()}
    assert c == {"Harbor Charter": (3, 5, 0.6), "Lantern Code": (2, 2, 0.4), "Meadow Pledge": (0, 0, 0.0), "Quiet Note": (0, 0, 0.0)}
    avgs = {r.metric: r.average_value for r in cov.coverage_averages(cov.coverage_by_doc(counts, meta, 5)).collect()}
    assert avgs == {"total_params_mentioned": 1.25, "total_mentions": 1.75, "framework_coverage": 0.25}
    by = {(r.dimension, r.value): r.mean_coverage for r in
          cov.coverage_by(cov.coverage_by_doc(counts, meta, 5), meta, ["doc_type", "org_type"]).collect()}
    # NULL org_type (Meadow Pledge) is dropped, as pandas groupby does (G1)
    assert by[("doc_type", "guideline")] == 0.0 and ("org_type", None) not in by and by[("org_type", "union")] == 0.6


def test_distribution_rows_sum_to_100_or_null(spark, melted):
    counts = codes.counts_long(codes.count_codes(melted), metadata_df(spark))
    d = cov.distribution_by(counts, metadata_df(spark), ["doc_type", "geography"], PARAMS).collect()
    groups = {}
    for r in d:
        groups.setdefault((r.dimension, r.value), []).append(r)
    for key, rows in groups.items():
        assert len(rows) == len(PARAMS)
        pcts = [r.pct for r in rows]
        if all(p is None for p in pcts):
            assert sum(r.n for r in rows) == 0, key
        else:
            assert sum(pcts) == pytest.approx(100.0), key
    assert all(r.pct is None for r in groups[("doc_type", "guideline")])


def test_documents_by_drops_null_values(spark):
    rows = {(r.column, r.value): r.n for r in cov.documents_by(metadata_df(spark), ["org_type", "geography"]).collect()}
    assert rows == {("org_type", "union"): 1, ("org_type", "company"): 1, ("org_type", "nonprofit"): 1,
                    ("geography", "Global"): 1, ("geography", "US"): 1, ("geography", "EU"): 2}


def test_coverage_over_time_drops_bad_dates(spark, melted):
    counts = codes.count_codes(melted)
    meta = metadata_df(spark)
    rows = cov.coverage_over_time(cov.coverage_by_doc(counts, meta, 5), meta).collect()
    # 'January 2026' and the NULL date are dropped
    assert sorted((r.title, str(r.date)) for r in rows) == [("Harbor Charter", "2024-03-14"), ("Quiet Note", "2023-11-02")]


def test_hierarchy_rollup_levels(spark, melted):
    freq = codes.parameter_frequency(melted, framework_df(spark))
    rows = {(r.level, r.category, r.subcategory, r.parameter): (r.total_appearances, r.num_docs)
            for r in codes.hierarchy_rollup(freq).collect()}
    assert rows[("total", None, None, None)] == (9, 1.4)
    assert rows[("category", "Working conditions", None, None)] == (8, 2.0)
    assert rows[("subcategory", "Contracts", "Voice", None)] == (1, 0.5)
    assert rows[("parameter", "Working conditions", "Wages", "Pay floor")] == (4, 2.0)


def test_approximate_document_counts_are_opt_in(spark, melted):
    exact = {r.parameter: r.num_docs for r in codes.parameter_frequency(melted, framework_df(spark)).collect()}
    approx = {r.parameter: r.num_docs for r in codes.parameter_frequency(melted, framework_df(spark), approx_docs=0.01).collect()}
    assert approx == exact  # HyperLogLog++ is exact at these cardinalities


def test_null_title_counts_overall_but_not_per_document(spark):
    from fixtures import D, REVIEW, REVIEW_SCHEMA

    rows = REVIEW + [(None, "Untitled sentence.", 3, D["Right to organise"], None, None, None, None)]
    melted = codes.melt_codes(spark.createDataFrame(rows, REVIEW_SCHEMA), framework_df(spark))
    freq = {r.parameter: (r.total_appearances, r.num_docs) for r in codes.parameter_frequency(melted, framework_df(spark)).collect()}
    # pandas: size() counts the row, nunique() ignores the NULL title
    assert freq["Right to organise"] == (2, 1)
    per_doc = codes.count_codes(melted).where("parameter = 'Right to organise'").collect()
    assert [(r.policy_title, r["count"]) for r in per_doc] == [("Harbor Charter", 1)]  # NULL key dropped (G1)
