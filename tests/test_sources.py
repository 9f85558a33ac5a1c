"""Readers and writers on invented files: CSV quoting, NULL dates (G22), nested JSON, text folders."""

import csv
import json
import os

from pyspark.sql import functions as F

from fixtures import FRAMEWORK, METADATA, METADATA_COLS
from framescope.sources import readers, sinks


def write_metadata(path):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(METADATA_COLS)
        for r in METADATA:
            w.writerow(["" if v is None else v for v in r])


def test_metadata_csv_quotes_and_dates(spark, tmp_dir):
    p = os.path.join(tmp_dir, "standards.csv")
    write_metadata(p)
    df = readers.read_metadata(spark, p)
    rows = {r.title: r for r in df.collect()}
    assert rows["Lantern Code"].org == "Lantern Guild, Inc."  # quoted value with a comma
    dates = {r.title: r.d for r in df.select("title", readers.parse_date(F.col("date")).alias("d")).collect()}
    assert str(dates["Harbor Charter"]) == "2024-03-14"
    assert dates["Meadow Pledge"] is None and dates["Lantern Code"] is None  # 'January 2026' and empty -> NULL


def test_framework_json_and_csv_agree_on_definitions(spark, tmp_dir):
    jp = os.path.join(tmp_dir, "framework.json")
    items = [
        {"parameter": p + (" (json)" if i == 1 else ""), "category": c, "subcategory": s, "definition": d,
         "keywords": [k.strip() for k in (kw or "").split(",") if k.strip()]}
        for i, (p, c, s, d, kw) in enumerate(FRAMEWORK)
    ]
    with open(jp, "w") as f:
        json.dump({"framework": items}, f, indent=2)
    fj = readers.read_framework_json(spark, jp).orderBy("pos").collect()
    assert [r.pos for r in fj] == list(range(len(FRAMEWORK)))
    assert fj[1].parameter == "Paid on time (json)" and fj[1].keywords == []  # names differ (G14), empty keywords (G13)
    cp = os.path.join(tmp_dir, "framework.csv")
    with open(cp, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["Parameter", "Category", "Subcategory", "Definition", "Related keywords"])
        for p, c, s, d, kw in FRAMEWORK:
            w.writerow([p, c, s, d, "" if kw is None else kw])
    fc = readers.read_framework_csv(spark, cp).orderBy("pos").collect()
    assert [r.definition for r in fc] == [r.definition for r in fj]
    assert fc[0].keywords == ["wage", "pay"] and fc[1].keywords == []


def test_text_folder_bom_unicode_space_and_missing_file(spark, tmp_dir):
    d = os.path.join(tmp_dir, "docs")
    os.makedirs(d)
    texts = {
        "harbor.txt": "﻿We pay a living wage. Unions are welcome.",
        "lantern.txt": "Breaks every hour. Pay is on schedule.",
        "meadow.txt": "",
    }
    for name, t in texts.items():
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(t)
    with open(os.path.join(d, "notes.md"), "w") as f:
        f.write("not a text file")
    df = readers.read_text_folder(spark, d)
    rows = {r.filename: r for r in df.collect()}
    assert set(rows) == set(texts)  # only .txt files
    for name, t in texts.items():
        assert rows[name].raw_text == t  # BOM kept (G18)
        assert rows[name].word_count == len(t.split())  # U+202F splits like Python (G19)
    stripped = {r.filename: r.raw_text for r in readers.read_text_folder(spark, d, strip_bom_char=True).collect()}
    assert stripped["harbor.txt"].startswith("We")
    meta = spark.createDataFrame(METADATA, ", ".join(f"{c} string" for c in METADATA_COLS))
    joined = {r.title: r for r in readers.attach_text(meta, df).collect()}
    assert joined["Quiet Note"].raw_text is None  # file absent (G26)
    assert joined["Harbor Charter"].word_count == 8


def test_unmatched_keys_report(spark):
    a = spark.createDataFrame([("x",), ("y ",)], "k string")
    b = spark.createDataFrame([("x",), ("y",)], "k string")
    rows = sorted(tuple(r) for r in readers.unmatched_keys(a, b, "k", "k").collect())
    assert rows == [("left_only", "y "), ("right_only", "y")]  # exact join: trailing space does not match (G15)


def test_csv_and_parquet_sinks_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a, b", ["x", "y"]), (2, 'quote "q"', [])], "id long, s string, arr array<string>")
    out = os.path.join(tmp_dir, "out_csv")
    sinks.write_csv(df, out, single_file=True)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(out)
    assert sorted(tuple(r) for r in back.collect()) == [("1", "a, b", "x; y"), ("2", 'quote "q"', None)] or \
        sorted(tuple(r) for r in back.collect()) == [("1", "a, b", "x; y"), ("2", 'quote "q"', "")]
    pq = os.path.join(tmp_dir, "out_pq")
    sinks.write_parquet(df, pq)
    assert sorted(tuple(r) for r in spark.read.parquet(pq).collect()) == sorted(tuple(r) for r in df.collect())


def test_encode_with_user_batch_encoder(spark):
    def make_encoder():
        import numpy as np

        def enc(texts):
            return np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

        return enc

    df = spark.createDataFrame([("aa",), ("bab",)], "s string")
    rows = sorted((r.s, r.embedding) for r in sinks.encode_with(df, "s", make_encoder, batch_size=1).collect())
    assert rows == [("aa", [2.0, 2.0]), ("bab", [3.0, 1.0])]


def test_review_csv_and_preview(spark, tmp_dir, capsys):
    from fixtures import REVIEW

    p = os.path.join(tmp_dir, "review_results.csv")
    with open(p, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(["policy_title", "sentence", "corpus_size", "primary_paramater", "alt_parameter_1",
                    "alt_parameter_2", "alt_parameter_3", "alt_parameter_4"])
        for r in REVIEW:
            w.writerow(["" if v is None else v for v in r])
    df = readers.read_review(spark, p)
    rows = df.collect()
    assert len(rows) == len(REVIEW)
    assert {r.policy_title for r in rows} >= {"Harbor Charter ", "Ghost Policy"}  # trailing space kept (G15)
    assert sum(r.alt_parameter_1 is None for r in rows) == 4
    sinks.preview(df, 2)
    out = capsys.readouterr().out
    assert "policy_title" in out and "only showing top 2 rows" in out


def test_text_folder_skips_undecodable_file(spark, tmp_dir):
    d = os.path.join(tmp_dir, "docs")
    os.makedirs(d)
    with open(os.path.join(d, "good.txt"), "w", encoding="utf-8") as f:
        f.write("Fine text.")
    with open(os.path.join(d, "bad.txt"), "wb") as f:
        f.write(b"broken \xff\xfe bytes")
    names = [r.filename for r in readers.read_text_folder(spark, d).collect()]
    assert names == ["good.txt"]  # the reference skips a file it cannot decode


def test_text_folder_reads_line_ends_like_text_mode(spark, tmp_path):
    from framescope.sources.readers import read_text_folder

    path = tmp_path / "crlf.txt"
    path.write_bytes(b"one\r\ntwo\rthree\nfour\r\r\n")
    got = read_text_folder(spark, str(tmp_path)).first()["raw_text"]
    assert got == path.read_text(encoding="utf-8")
