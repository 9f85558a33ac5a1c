"""Every stage of the corpus pipeline against brute force on small tables: clashing columns, NULL and repeated ids, copies."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from framescope.llm import quality_crf
from framescope.llm.soft_mixing import soft_mixing

RNG = np.random.default_rng(3)
WORDS = {"en": "the and with from river stone cloud walk green paper".split(), "de": "und der nicht wasser gehen blatt wolke stein".split()}
ITEM = " ".join(f"item{i} word{i % 4}" for i in range(14))
COLUMNS = "doc_id long, text string, lang string, source string, score int, th string, key int, copies int"


def _prose(lang, n):
    return "\n".join(" ".join(RNG.choice(WORDS[lang], 8)) + f" u{RNG.integers(10**7)}." for _ in range(n))


def _junk(n):
    return "\n".join(" ".join(f"{w.upper()}!!{RNG.integers(99)}" for w in RNG.choice(WORDS["en"], 6)) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    rows = [(i, _prose("en" if i % 3 else "de", 6), "en" if i % 3 else "de") for i in range(90)]
    rows += [(100 + i, _junk(6), "en") for i in range(60)]
    good = rows[5][1]
    rows += [(300 + i, good, "en") for i in range(20)] + [(None, good, "en"), (None, _prose("en", 5), "en"), (400, rows[7][1] + " tail", "en")]
    rows += [(8, rows[8][1], "de"), (8, rows[8][1], "en"), (9, _prose("de", 7), "de"), (None, "", "en"), (500, None, "en"), (501, "", "en")]
    rows += [(600, _prose("en", 4) + " " + ITEM, "en"), (None, _prose("en", 4) + "\n" + ITEM + ".", "en"), (601, _prose("en", 4) + " " + ITEM[: len(ITEM) // 3], "en")]
    data = [(i, t, lang, "s", 7, "x", n, 1) for n, (i, t, lang) in enumerate(rows)]
    spark.createDataFrame(data, COLUMNS).repartition(4).write.parquet(str(path / "documents.parquet"))
    labels = [(i, int(i < 100), 0) for i, _, _ in rows[:150]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(0, ITEM), (1, "short other words of an item that stands in no document here at all")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def _documents(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_quality(spark, tables):
    docs = _documents(spark, tables)
    got = P.quality(spark, docs, tables)
    assert got.columns == docs.columns
    labels = spark.read.parquet(f"{tables}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality_crf.train(docs, labels)
    want = Counter(tuple(r) for r in docs.collect() if quality_crf.score_texts([(r.text or "").encode()], model)[0] >= P.THRESHOLD)
    assert _rows(got) == want
    kept = {r[0] for r in want}
    assert sum(i in kept for i in range(90)) >= 88 and sum(100 + i in kept for i in range(60)) <= 2


def test_near_duplicates(spark, tables):
    docs = _documents(spark, tables)
    got = P.near_duplicates(spark, docs, tables)
    assert got.columns == docs.columns
    rows = [tuple(r) for r in docs.collect()]
    # one document an (id, text); the first of its rows in JSON order of their columns (here: lang, then key, one digit count each)
    once = {}
    for r in sorted(rows, key=lambda r: (r[2], str(r[6]))):
        once.setdefault((r[0], r[1] or ""), r)
    sets = {}
    for d, t in once:
        w = t.encode().lower().split()
        sets[d, t] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    names, root = list(sets), {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    groups = {}
    for x in names:
        groups.setdefault(find(x), []).append(x)
    kept = [tuple(r) for r in got.collect()]
    assert Counter((r[0], r[1] or "") for r in kept) <= Counter(names) and len(kept) == len(groups)
    for group in groups.values():
        mine = [r for r in kept if (r[0], r[1] or "") in group]
        ids = Counter(d for d, _ in names if d is not None)
        plain = [d for d, _ in group if d is not None and ids[d] == 1]
        assert len(mine) == 1 and mine[0] in rows
        if len(plain) == len(group):
            assert mine[0][0] == min(plain)
    eight = [r for r in kept if r[0] == 8]
    assert len(eight) == 1 and eight[0][2] == "de"


def test_decontamination(spark, tables):
    docs = _documents(spark, tables)
    got = P.decontamination(spark, docs, tables)
    assert got.columns == docs.columns
    assert _rows(got) == Counter(tuple(r) for r in docs.collect() if ITEM not in (r.text or ""))


def test_mixing(spark, tables):
    docs = _documents(spark, tables)
    got = P.mixing(spark, docs, tables)
    assert got.columns == docs.columns
    labels = spark.read.parquet(f"{tables}/labels.parquet").select("doc_id").distinct()
    times = {(r.doc_id, r.th): r.copies for r in soft_mixing(docs, docs.select("doc_id", F.col("lang").alias("domain")).join(labels, "doc_id"), P.TEMPERATURE).collect()}
    hashed = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    want = Counter()
    for r in docs.collect():
        want[tuple(r)] += times[r.doc_id, hashed[r.doc_id, r.text]]
    assert _rows(got) == want and set(_rows(docs)) == set(want) and sum(want.values()) > docs.count()


def test_whole_run_and_token_ids(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = _documents(spark, tables)
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, tables).collect(), docs.schema)
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = P.token_ids(spark, docs, tables).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    whole = P.run(spark, tables).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in whole) == want
    kept = {r.doc_id for r in whole}
    assert kept.isdisjoint({600, *range(301, 320), 400, *range(100, 160)} - {101}) and 5 in kept and 601 in kept
