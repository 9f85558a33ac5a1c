"""The pruned term search gives what the joins give, in blocks, chunks and with a bar, and sums fewer pairs."""

import random

import numpy as np
import pytest

from framescope.operators import pruned, sparse

WORDS = [f"{a}{b}" for a in "kamori" for b in ("ta", "ne", "lo", "pi", "su")]


def _corpus(seed):
    rng = random.Random(seed)

    def sentence():
        return " ".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.randint(1, 9))) + rng.choice([".", "!", "?"])

    docs = [(i, " ".join(sentence() for _ in range(rng.choice([1, 2, 5, 30, 200])))) for i in range(25)]
    docs += [(100, ""), (101, None), (102, "... ! ?"), (103, "the and of. The."), (104, docs[3][1]), (105, " ".join(["kata ne."] * 90))]
    queries = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 8)))) for i in range(9)] + [(50, ""), (51, "unknown"), (52, "the and"), (53, None)]
    return docs, queries


def _frames(spark, seed):
    docs, queries = _corpus(seed)
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")


@pytest.mark.parametrize("layer, block, chunk", [(64, 8, 1 << 15), (2, 3, 7)])
@pytest.mark.parametrize("k, min_score", [(5, None), (2, 0.4), (40, None)])
def test_same_rows_as_the_joins(spark, monkeypatch, layer, block, chunk, k, min_score):
    for name, value in (("LAYER", layer), ("BLOCK", block), ("CHUNK", chunk)):
        monkeypatch.setattr(pruned, name, value)
    docs, queries = _frames(spark, k)

    def rows():
        top = sparse.topk_sparse(docs, queries, k, with_sentence=True, with_corpus_size=True, min_score=min_score)
        assert top.columns == ["doc_id", "query_id", "rank", "score", "sentence_index", "sentence", "corpus_size"]
        return [sorted(tuple(r) for r in x.collect()) for x in (top, sparse.compare_strategies(docs, queries, k))]

    got = rows()
    monkeypatch.setattr(pruned, "query_side", lambda *a: None)
    assert got == rows() and len(got[0]) > 50


def test_fewer_pairs_are_summed():
    rng = np.random.default_rng(1)
    n, terms = 4000, 40
    counts = np.where(rng.random((n, terms)) < rng.uniform(0.02, 0.5, (n, 1)), rng.integers(1, 4, (n, terms)), 0)
    counts[counts.sum(1) == 0, 0] = 1
    norm = np.sqrt((counts**2).sum(1) + rng.integers(0, 200, n))
    document = np.repeat([0, 1, 2], [3000, 900, 100])
    place = np.arange(n) - np.array([0, 3000, 3900])[document]
    side = pruned.QuerySide([(q,) for q in range(6)], [(f"t{t:02d}", q, int(rng.integers(1, 3))) for q in range(6) for t in rng.choice(terms, 3, replace=False)])
    own = counts[:, [int(w[1:]) for w in side.words.to_pylist()]]
    dense = np.zeros((own.shape[1], 6))
    dense[side.term, side.query] = side.count
    score = pruned.micro(own @ dense / (norm[:, None] * side.norm))
    row, term = np.nonzero(own)

    def run(k, least):
        scorer = pruned.Scorer(side, k, least)
        return scorer.run(row, term, own[row, term].astype(float), norm, document, place, pruned.Found()), scorer.scored

    found, scored = run(5, 0)
    got = sorted(zip(found.group.tolist(), (-found.score).tolist(), found.place.tolist(), strict=True))
    want = []
    for d in range(3):
        for q in range(6):
            mine = sorted((-score[i, q], place[i]) for i in np.flatnonzero((document == d) & (score[:, q] > 0)))[:5]
            want += [(d * 6 + q, int(s), int(p)) for s, p in mine]
    assert got == sorted(want)
    assert scored < (score > 0).sum() / 2
    barred, few = run(5, 600_000)
    high = barred.score >= 600_000
    assert [x for x in sorted(zip(barred.group[high].tolist(), (-barred.score[high]).tolist(), barred.place[high].tolist(), strict=True))] == [x for x in got if x[1] <= -600_000]
    assert few < scored


def test_rounding_is_half_up_on_the_decimal_form():
    x = np.array([0.0078125, 0.5, 1 / 3, 0.1234565, 0.1234575, 2 / 3, 0.0])
    assert pruned.micro(x).tolist() == [7813, 500000, 333333, 123457, 123458, 666667, 0]


def test_repeated_and_null_keys_are_one_document(spark):
    docs = spark.createDataFrame([("a", "kata ne. pi lo."), ("a", "kata. su ta."), (None, "kata"), (None, "kata su"), ("b", "ne")], "doc string, text string")
    queries = spark.createDataFrame([(1, "kata")], "query_id long, text string")
    rows = sparse.topk_sparse(docs, queries, 3, key="doc", with_corpus_size=True).collect()
    assert sorted((str(r.doc), r["rank"], r.score, r.corpus_size) for r in rows) == [
        ("None", 1, 1.0, 2), ("None", 2, 0.707107, 2), ("a", 1, 1.0, 4), ("a", 2, 0.707107, 4), ("a", 3, 0.0, 4), ("b", 1, 0.0, 1),
    ]
