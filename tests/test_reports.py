"""The two end-to-end runs write their tables; spot-check their content and shape."""

import os

from fixtures import METADATA, METADATA_COLS, framework_df, metadata_df, review_df
from framescope.plans import reports


def read_csv(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def test_analysis_report(spark, tmp_dir):
    names = reports.write_analysis_report(review_df(spark), metadata_df(spark), framework_df(spark), tmp_dir)
    assert set(names) == {n for n in os.listdir(tmp_dir)}
    overall = {r.parameter: (r.total_appearances, r.num_docs) for r in read_csv(spark, os.path.join(tmp_dir, "param_frequency_overall")).collect()}
    assert overall["Pay floor"] == ("4", "2") and overall["Never coded"] == ("0", "0")
    summary = {r.title: r.framework_coverage for r in read_csv(spark, os.path.join(tmp_dir, "adherence_summary_by_policy")).collect()}
    assert summary["Harbor Charter"] == "0.6" and summary["Meadow Pledge"] == "0.0"
    bottom = read_csv(spark, os.path.join(tmp_dir, "bottom_10_least_adopted_parameters")).collect()
    assert len(bottom) == 5


def test_extraction_report(spark, tmp_dir):
    texts = {
        "Harbor Charter": "We pay a living wage. Unions are welcome here. Breaks are paid.",
        "Lantern Code": "Payment arrives on a fixed schedule. Workers can pause during long tasks.",
        "Meadow Pledge": "Nothing relevant at all.",
    }
    rows = [tuple(r) + (texts.get(r[0]),) for r in METADATA]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in METADATA_COLS) + ", raw_text string")
    names = reports.write_extraction_report(docs, framework_df(spark), tmp_dir, threshold=0.3, k=2)
    ext = read_csv(spark, os.path.join(tmp_dir, "semantic_search_extractions"))
    # k = min(2, sentences) rows per (document with text, parameter); Quiet Note has no text
    assert ext.count() == (2 + 2 + 1) * 5
    matrix = read_csv(spark, os.path.join(tmp_dir, "semantic_search_adherence"))
    params = sorted(r[0] for r in framework_df(spark).select("parameter").collect())
    assert matrix.columns == ["title", "org", "doc_type", "org_type", "geography", "date"] + params
    got = {r.title: r for r in matrix.collect()}
    assert got["Quiet Note"]["Pay floor"] == "0"  # no sentences -> 0 everywhere
    assert got["Harbor Charter"]["Pay floor"] == "1"
