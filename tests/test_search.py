"""Search family: dense and term-count top-k, adherence grid, thresholds, pivots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescope.operators import dense, search, sparse


def vec_frames(spark, sents, queries):
    s = spark.createDataFrame(sents, "doc string, sentence_index long, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    return s, q


def brute_topk(sents, queries, k):
    out = {}
    for qid, qv in queries:
        qv = np.asarray(qv, float)
        for doc in {d for d, _, _ in sents}:
            rows = []
            for d, i, v in sents:
                if d != doc:
                    continue
                v = np.asarray(v, float)
                den = np.linalg.norm(v) * np.linalg.norm(qv)
                rows.append((round(float(v @ qv / den), 6) if den else 0.0, i))
            rows.sort(key=lambda r: (-r[0], r[1]))
            out[(doc, qid)] = rows[:k]
    return out


def test_topk_dense_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    sents = [(f"d{d}", i, rng.normal(size=8).astype(np.float32).tolist()) for d in range(3) for i in range(7 + d)]
    queries = [(q, rng.normal(size=8).astype(np.float32).tolist()) for q in range(4)]
    s, q = vec_frames(spark, sents, queries)
    got = {}
    for r in dense.topk_dense(s, q, 3).collect():
        got.setdefault((r.doc, r.query_id), []).append((r.rank, r.score, r.sentence_index))
    exp = brute_topk(sents, queries, 3)
    for key, rows in exp.items():
        g = sorted(got[key])
        assert [x[0] for x in g] == [1, 2, 3]
        assert [(sc, i) for _, sc, i in g] == [(pytest.approx(sc, abs=1e-6), i) for sc, i in rows]


def test_topk_k_is_min_of_k_and_sentences_and_ties_by_index(spark):
    # One sentence -> one row; G10: equal scores ordered by sentence index; zero vector scores 0
    sents = [("a", 0, [1.0, 0.0]), ("b", 5, [0.0, 1.0]), ("b", 2, [0.0, 1.0]), ("b", 9, [0.0, 0.0])]
    s, q = vec_frames(spark, sents, [(7, [0.0, 2.0])])
    rows = dense.topk_dense(s, q, 5).orderBy("doc", "rank").collect()
    assert [(r.doc, r.rank, r.score, r.sentence_index) for r in rows] == [
        ("a", 1, 0.0, 0), ("b", 1, 1.0, 2), ("b", 2, 1.0, 5), ("b", 3, 0.0, 9)
    ]


def test_query_blocks_path_equals_single_broadcast(spark):
    rng = np.random.default_rng(2)
    sents = [("d", i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(20)]
    queries = [(q, rng.normal(size=4).astype(np.float32).tolist()) for q in range(9)]
    s, q = vec_frames(spark, sents, queries)
    one = sorted(tuple(r) for r in dense.rank_topk(dense.score_dense(s, q, 2), 2).collect())
    blocks = sorted(tuple(r) for r in dense.rank_topk(dense.score_dense(s, q, 2, max_broadcast_queries=2), 2).collect())
    assert one == blocks and len(one) == 18


def test_partial_topk_is_exact_across_batches(spark):
    # force tiny Arrow batches so one document spans many batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = np.random.default_rng(3)
        sents = [("d", i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(40)]
        queries = [(0, rng.normal(size=4).astype(np.float32).tolist())]
        s, q = vec_frames(spark, sents, queries)
        got = [(r.score, r.sentence_index) for r in dense.topk_dense(s, q, 5).orderBy("rank").collect()]
        exp = brute_topk(sents, queries, 5)[("d", 0)]
        assert [i for _, i in got] == [i for _, i in exp]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_adherence_grid_threshold_inclusive_and_missing_docs(spark):
    matches = spark.createDataFrame(
        [("a", 1, 1, 0.361, 0), ("a", 2, 1, 0.3609, 4), ("b", 1, 1, 0.5, 1)],
        "doc string, query_id long, rank int, score double, sentence_index long",
    )
    docs = spark.createDataFrame([("a",), ("b",), ("empty",)], "doc string")  # 'empty' has no sentences (G26)
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    adh = {(r.doc, r.query_id): r.adheres for r in search.adherence_long(matches, docs, queries, 0.3610).collect()}
    assert adh == {("a", 1): 1, ("a", 2): 0, ("b", 1): 1, ("b", 2): 0, ("empty", 1): 0, ("empty", 2): 0}
    cov = {r.doc: (r.total_params_mentioned, r.framework_coverage) for r in search.coverage(
        search.adherence_long(matches, docs, queries, 0.3610)).collect()}
    assert cov == {"a": (1, 0.5), "b": (1, 0.5), "empty": (0, 0.0)}


def test_derived_threshold_is_mean_of_means(spark):
    # doc a: query 1 mean .4, query 2 mean .2 -> .3; doc b: query 1 mean .5 -> .5; grand mean .4
    matches = spark.createDataFrame(
        [("a", 1, 0.5), ("a", 1, 0.3), ("a", 2, 0.2), ("b", 1, 0.5)], "doc string, query_id long, score double"
    )
    assert search.mean_topk_threshold(matches) == pytest.approx(0.4)


def test_pivot_explicit_order_fill_and_strict(spark):
    long = spark.createDataFrame([("t1", "beta", 1), ("t1", "alpha", 2), ("t2", "beta", 3)], "doc string, p string, v long")
    wide = search.pivot_matrix(long, "doc", "p", "v", ["beta", "gamma", "alpha"], fill=0)
    assert wide.columns == ["doc", "beta", "gamma", "alpha"]  # G5: the given order, absent column created
    assert sorted(tuple(r) for r in wide.collect()) == [("t1", 1, 0, 2), ("t2", 3, 0, 0)]
    dup = long.unionByName(long.limit(1))
    with pytest.raises(ValueError):
        search.pivot_matrix(dup, "doc", "p", "v", ["alpha", "beta"], strict=True)  # G4


def test_mask_and_binarise(spark):
    df = spark.createDataFrame([(0.35,), (0.3499,), (None,)], "s double")
    rows = df.select(search.mask_below(F.col("s"), 0.35).alias("m"), search.binarise(F.col("s"), 0.35).alias("b")).collect()
    assert [(r.m, r.b) for r in rows] == [(0.35, 1), (None, 0), (None, 0)]


def test_sparse_topk_scores_and_zero_fill(spark):
    docs = spark.createDataFrame(
        [(1, "Fair wages now. Unrelated words here. Wages wages wages. Nothing."), (2, "Single sentence about safety.")],
        "doc_id long, text string",
    )
    queries = spark.createDataFrame([(10, "fair wages"), (11, "safety rules")], "query_id long, text string")
    rows = sparse.topk_sparse(docs, queries, 3).collect()
    got = {(r.doc_id, r.query_id, r.rank): (r.score, r.sentence_index) for r in rows}
    # doc 1, query 10: s0 'fair wages' ('now' is a stopword) = 1; s2 = 3/(3*sqrt(2)); then zero-fill by index (s1)
    assert got[(1, 10, 1)] == (1.0, 0)
    assert got[(1, 10, 2)] == (round(3 / (3 * 2 ** 0.5), 6), 2)
    assert got[(1, 10, 3)] == (0.0, 1)
    # Doc 2 has one sentence -> one row per query, even at score 0
    assert got[(2, 10, 1)] == (0.0, 0) and (2, 10, 2) not in got
    assert got[(2, 11, 1)][1] == 0 and got[(2, 11, 1)][0] > 0
    assert len(rows) == 3 * 2 + 1 * 2


def test_keyword_query_phrasing(spark):
    df = spark.createDataFrame([("Pay on time.", ["wage", "salary"]), ("Safe work", [])], "d string, k array<string>")
    rows = df.select(sparse.keyword_query(F.col("d"), F.col("k")).alias("q")).collect()
    # Double dot when the definition ends with one; no keywords -> trailing space
    assert [r.q for r in rows] == ["Pay on time.. Related terms: wage, salary", "Safe work. Related terms: "]


def test_mean_vectors(spark):
    rows = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("b", [2.0, 2.0])], "doc string, embedding array<float>")
    got = {r.doc: r.embedding for r in dense.mean_vectors(rows, key="doc").collect()}
    assert got == {"a": [2.0, 4.0], "b": [2.0, 2.0]}


def test_topk_text_with_user_encoder(spark):
    # a toy encoder: letter counts of a, e, i, o, u -- enough to make the flow observable
    def make_encoder():
        def enc(texts):
            return np.array([[t.lower().count(c) for c in "aeiou"] for t in texts], dtype=np.float32)

        return enc

    docs = spark.createDataFrame([(1, "Aaa aa. Eee ee. Mixed ae."), (2, "Only one sentence here.")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "aaaa"), (1, "eeee")], "query_id long, text string")
    rows = dense.topk_text(docs, queries, make_encoder, 2).orderBy("doc_id", "query_id", "rank").collect()
    got = [(r.doc_id, r.query_id, r.rank, r.sentence) for r in rows]
    assert got[:4] == [(1, 0, 1, "Aaa aa."), (1, 0, 2, "Mixed ae."), (1, 1, 1, "Eee ee."), (1, 1, 2, "Mixed ae.")]
    assert [(r.doc_id, r.rank) for r in rows[4:]] == [(2, 1), (2, 1)]  # one sentence -> one row per query (G9)


def test_results_do_not_depend_on_the_framework_limit(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Fair pay now. Safe work here. Nothing."), (2, "Other words")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "fair pay"), (2, "safe work"), (3, "absent")], "query_id long, text string")

    def results():
        top = sparse.topk_sparse(docs, queries, 2)
        adh = search.adherence_long(top.withColumnRenamed("doc_id", "doc"), docs.withColumnRenamed("doc_id", "doc"), queries, 0.3)
        return [sorted(tuple(r) for r in d.collect()) for d in (top, adh, sparse.compare_strategies(docs, queries, 2))]

    want = results()
    assert len(want[0]) == 9 and len(want[1]) == 6
    for module in (sparse, search):
        monkeypatch.setattr(module, "MAX_BROADCAST_QUERIES", 1)
    assert results() == want


def test_sparse_topk_same_when_query_terms_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(1, "Fair wages now. Unrelated words here. Wages wages wages. Nothing."), (2, "Safety rules and fair pay.")],
        "doc_id long, text string",
    )
    queries = spark.createDataFrame([(10, "fair wages"), (11, "safety rules pay")], "query_id long, text string")
    a = sorted(tuple(r) for r in sparse.topk_sparse(docs, queries, 3, with_sentence=True).collect())
    monkeypatch.setattr(sparse, "MAX_BROADCAST_QUERY_TERMS", 0)  # shuffle join on the term instead
    b = sorted(tuple(r) for r in sparse.topk_sparse(docs, queries, 3, with_sentence=True).collect())
    assert a == b and len(a) == 3 * 2 + 1 * 2  # doc 2 has one sentence (G9)


def test_empty_framework_gives_empty_results(spark):
    docs = spark.createDataFrame([(1, "Fair wages. Safe work."), (2, None)], "doc_id long, text string")
    noq = spark.createDataFrame([], "query_id long, text string")
    assert sparse.topk_sparse(docs, noq, 3).collect() == []
    assert sparse.compare_strategies(docs, noq, 3).collect() == []
    empty_vecs = spark.createDataFrame([], "query_id long, embedding array<float>")
    s = spark.createDataFrame([("a", 0, [1.0, 0.0])], "doc string, sentence_index long, embedding array<float>")
    assert dense.topk_dense(s, empty_vecs, 3).collect() == []
    assert search.adherence_long(dense.best_dense(s, empty_vecs), s.select("doc"), empty_vecs, 0.3).collect() == []


def test_topk_text_ranks_whole_documents_in_one_task(spark, monkeypatch):
    """Documents over several batches, repeated and NULL keys, ties: as by brute force, and without a window over the scores."""
    import random

    import numpy as np

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) + "." for _ in range(rng.randint(0, 40))) for _ in range(12)]
    keys = [1, 2, 3, 3, None, None, 7, 8, 9, 10, 11, 12]
    docs = spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string")
    queries = spark.createDataFrame([(0, "ab"), (1, "c"), (2, "abc")], "query_id int, text string")

    def make_encoder():
        def encode(texts):
            return np.array([[str(t).count(c) for c in "abc"] for t in texts], np.float32).reshape(-1, 3)

        return encode

    vec = lambda t: np.array([t.count(c) for c in "abc"], float)
    unit = lambda v: v / np.linalg.norm(v)
    want = set()
    for key in set(keys):
        sents = [(i, s) for k, t in zip(keys, texts, strict=True) if k == key for i, s in enumerate(t.split())]
        for q, text in enumerate(("ab", "c", "abc")):
            best = sorted((-round(float(unit(vec(s)) @ unit(vec(text))), 6), i) for i, s in sents)[:2]
            want |= {(key, q, r + 1, -s, i) for r, (s, i) in enumerate(best)}
    monkeypatch.setattr(dense, "_MAX_CELLS", 15)
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = dense.topk_text(docs, queries, make_encoder, 2, with_sentence=False)
            assert {(r[0], r[1], r[2], round(r[3], 6) + 0.0, r[4]) for r in got.collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Window" not in got._jdf.queryExecution().toString()
