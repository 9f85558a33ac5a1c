"""Nearest neighbours, ranked lexical search and vector codes against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescope.llm.equal_average_codes import equal_average_codes, nearest
from framescope.llm.interval_ranking import RangeMaximum, interval_ranking, terms
from framescope.llm.stable_knn import chi2_bound, chi2_cdf, stable_knn

RNG = np.random.default_rng(9)
NAN, INF = float("nan"), float("inf")


# ---- nearest neighbours --------------------------------------------------------


def _vector_rows(n=700, dim=12):
    centres = RNG.standard_normal((20, dim)) * 3
    m = centres[RNG.integers(0, 20, n)] + RNG.standard_normal((n, dim)) * RNG.uniform(0.2, 1, (n, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(m)]
    rows += [(40, rows[40][1])] * 3 + [(n + i, rows[40][1]) for i in range(300)]  # repeated rows, and a large group of copies
    rows += [(2000, None), (2020, []), (2040, [0.0] * dim), (2060, [NAN] * dim), (2080, [INF] + [0.0] * (dim - 1)), (2100, [None] + [1.0] * (dim - 1)), (None, [1.0] * dim)]
    return rows + [(3000 + i, RNG.standard_normal(5).tolist()) for i in range(8)]  # another dimension


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, v array<double>").withColumn("cell", F.lit("x")).withColumn("q", F.lit(7)).withColumn("score", F.lit(0)).repartition(3)


def _nearest_rows(rows, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    want = {}
    for a, (i, q) in enumerate(ok):
        if i % 20 == 0:
            scored = []
            for b, (j, v) in enumerate(ok):
                if a != b and len(v) == len(q):
                    s = 0.0
                    for x, y in zip(q, v, strict=True):
                        s += x * y
                    scored.append((-s, j))
            want.setdefault(i, []).append([(j, -s) for s, j in sorted(scored)[:k]])
    return want


@pytest.mark.parametrize("block_rows", [64, 2048])
def test_stable_knn(spark, block_rows):
    rows = _vector_rows()
    want = _nearest_rows(rows, 20)
    got = {}
    for r in stable_knn(_vectors(spark, rows), F.col("vec_id") % 20 == 0, 20, block_rows=block_rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i, lists in want.items() if lists[0]}
    hit = total = 0
    score_of = {i: {j: s for j, s in _nearest_rows(rows, 10**6)[i][0]} for i in (0, 40)}
    for i, lists in want.items():
        mine = sorted(got.get(i, []))
        assert Counter(x[0] for x in mine) == Counter(n for one in lists for n in range(1, len(one) + 1))
        by_rank = {}
        for n, j, s in mine:
            by_rank.setdefault(n, []).append((j, s))
            assert i not in score_of or score_of[i][j] == s  # exactly the product of the original vectors
        if len(lists) == 1:
            assert [(-s, j) for _, j, s in mine] == sorted((-s, j) for _, j, s in mine)
            # copies are interchangeable in recall: compare scores
            have = Counter(round(s, 9) for _, _, s in mine)
            need = Counter(round(s, 9) for _, s in lists[0])
            hit, total = hit + sum((have & need).values()), total + len(lists[0])
    assert hit / total >= 0.9


def test_stable_knn_with_full_confidence_is_exact(spark):
    rows = _vector_rows(300)
    got = {}
    for r in stable_knn(_vectors(spark, rows), F.col("vec_id") % 20 == 0, 5, confidence=1 - 1e-13, block_rows=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for i, lists in _nearest_rows(rows, 5).items():
        want = sorted((n + 1, j, s) for one in lists for n, (j, s) in enumerate(one))
        assert sorted(got.get(i, [])) == want


def test_stable_knn_empty_and_chi_square(spark):
    assert stable_knn(spark.createDataFrame([], "vec_id long, v array<double>"), F.lit(True)).collect() == []
    assert stable_knn(spark.createDataFrame([(1, [1.0])], "vec_id long, v array<double>"), F.lit(False)).collect() == []
    assert chi2_cdf(3.841458820694124, 1) == pytest.approx(0.95) and chi2_bound(0.95, 8) == pytest.approx(15.50731305586545)
    sample = (RNG.standard_normal((200_000, 6)) ** 2).sum(1)
    assert (sample <= chi2_bound(0.9, 6)).mean() == pytest.approx(0.9, abs=0.005)


# ---- ranked lexical search --------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def _ranking(docs, items, k):
    bags = [(d, Counter(_terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(_terms(t))
    out = []
    for i, wanted in own.items():
        scored = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in wanted if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, n + 1, None if unknown else d, -s) for n, (s, unknown, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_postings, group_terms", [(40, 2_000_000), (300, 20), (1 << 20, 2_000_000)])
def test_interval_ranking(spark, block_postings, group_terms):
    words = ["Ab", "c9", "été", "ZÉ", "x_y", "o'k", "k", "m", "n", "p", "q", "r", "日本", "s-t"]
    docs = [(int(d), " ".join(RNG.choice(words, RNG.integers(1, 30)))) for d in RNG.permutation(150)]
    docs += [(500 + i, docs[0][1]) for i in range(40)] + [docs[1], docs[1], (None, docs[2][1]), (None, None), (700, None), (701, ""), (702, "-- \t\x00 '"), (703, "ab " * 5000)]
    items = [(0, "ab C9 ab"), (1, "zÉ, été! 日本"), (2, "k m n p q r s t"), (3, None), (4, "..."), (5, "unknown"), (6, "m"), (6, "x y"), (6, "m"), (None, "o k")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("terms", F.lit(1)).withColumn("item_id", F.lit(2)).repartition(4)
    got = interval_ranking(df, spark.createDataFrame(items, "item_id int, text string").withColumn("term", F.lit("k")), 10, block_postings, group_terms, 2)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _ranking(docs, items, 10)


def test_interval_ranking_empty(spark):
    docs, items = (spark.createDataFrame([], f"{i} long, text string") for i in ("doc_id", "item_id"))
    full = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert interval_ranking(docs, full.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert interval_ranking(full, items).collect() == []
    assert interval_ranking(full.withColumn("text", F.lit("")), full.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_long_text_is_cut_between_terms():
    text = "wörd,".encode() * 1_500_000
    assert sum(len(x) for x in terms(text)) == 1_500_000 and {t for x in terms(text) for t in x} == {"wörd".encode()}
    assert [t for x in terms(b"a" * 9_000_000) for t in x] == [b"a" * 9_000_000]


def test_range_maximum():
    v = RNG.integers(0, 9, 100)
    table = RangeMaximum(v, 60)
    lo = RNG.integers(0, 40, 500)
    hi = lo + RNG.integers(1, 60, 500)
    for a, b, at in zip(lo, hi, table.places(lo, hi), strict=True):
        assert a <= at < b and v[at] == v[a:b].max()


# ---- vector codes ------------------------------------------------------------------


def _codes(rows, parts=4, entries=256, rounds=4):
    ok = [r for r in rows if r[1] and all(x is not None for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(ok[0][1])
    m = np.array([r[1] for r in ok if len(r[1]) == dim])
    books = [p[:entries].copy() for p in np.split(m[: min(len(m), entries)], parts, axis=1)]

    def assign(x, book):
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for i, x in enumerate(np.split(m, parts, axis=1)):
            at = assign(x, books[i])[0]
            books[i] = np.array([x[at == c].sum(0) // (at == c).sum() if (at == c).any() else books[i][c] for c in range(len(books[i]))])
    coded = [assign(x, books[i]) for i, x in enumerate(np.split(m, parts, axis=1))]
    code = ["".join(f"{c:02x}" for c in x) for x in np.stack([a for a, _ in coded], 1).tolist()]
    error = sum(d for _, d in coded).tolist()
    done = iter(zip(code, error, strict=True))
    out = [(r[0], r[2], *(next(done) if len(r[1]) == dim else (None, None))) for r in ok]
    total = {}
    for _, label, _, e in out:
        if e is not None:
            total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    return Counter((i, c, e, total.get(label), sha) for i, label, c, e in out)


@pytest.mark.parametrize("n", [3, 40, 600])
def test_equal_average_codes(spark, n):
    rows = [(int(i), RNG.integers(-9, 9, 8).tolist(), [None, "a", "b"][i % 3]) for i in RNG.permutation(n)]
    rows += [rows[0], rows[0], (None, rows[1][1], "a"), (9001, None, "a"), (9002, [], "a"), (9003, [1, None, 1, 1, 1, 1, 1, 1], "b"), (9004, [1, 2, 3, 4], "c"), (5, [1, 2], None)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, label string").withColumn("code", F.lit("x")).withColumn("part", F.lit(1)).repartition(3)
    assert Counter(tuple(r) for r in equal_average_codes(df).collect()) == _codes(rows)


def test_equal_average_codes_defined_cases(spark):
    assert equal_average_codes(spark.createDataFrame([], "vec_id long, v array<long>, label int")).collect() == []
    far = spark.createDataFrame([(1, [1 << 30] * 4, 0)], "vec_id long, v array<long>, label int")
    with pytest.raises(ValueError, match="beyond"):
        equal_average_codes(far)


def test_equal_average_search_is_exact_and_skips():
    book = np.cumsum(RNG.integers(0, 50, (256, 4)), axis=0)[RNG.permutation(256)]
    book[17] = book[200]
    x = book[RNG.integers(0, 256, 500)] + RNG.integers(-9, 9, (500, 4))
    at, far, tried = nearest(x, book)
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (at == d.argmin(1)).all() and (far == d.min(1)).all() and tried < d.size / 4
