"""Tagger, noun chunks and lemma scripts against enumeration, plain Python and held-out words."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framescope.functions.text import is_alpha, word_tokens
from framescope.operators import tagging as G
from framescope.operators import terms

STEMS = ["kam", "lor", "pin", "tev", "sud", "bar", "mel", "gro", "fix", "dal", "nur", "wos"]
ENDINGS = {"NOUN": "tion", "VERB": "ize", "ADJ": "ous", "ADV": "ly"}
FIXED = {"DET": ["the", "a"], "ADP": ["of", "in"]}


def _grammar(rng, stems):
    def word(tag):
        return rng.choice(FIXED[tag]) if tag in FIXED else "".join(rng.choices(stems, k=2)) + ENDINGS[tag]

    def phrase():
        return ["DET", *rng.choice([[], ["ADJ"], ["ADV", "ADJ"]]), "NOUN"]

    tags = [*phrase(), *rng.choice([[], ["ADV"]]), "VERB", *phrase(), *rng.choice([[], ["ADP", *phrase()]])]
    # one open word in ten has no ending: only its place in the sentence tells its tag
    return [(w if t in FIXED or rng.random() > 0.1 else w[: -len(ENDINGS[t])], t) for w, t in ((word(t), t) for t in tags)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    return [_grammar(rng, STEMS) for _ in range(600)], [_grammar(rng, [s[::-1] for s in STEMS]) for _ in range(120)]


@pytest.fixture(scope="module")
def model(spark, corpus):
    rows = [(i, p, w, t) for i, s in enumerate(corpus[0]) for p, (w, t) in enumerate(s)] + [(0, 99, None, "NOUN"), (1, 99, "x", None)]
    df = spark.createDataFrame(rows, "s long, position int, token string, tag string").withColumn("_t", F.lit(1)).drop("_t").repartition(4)
    return G.train(df, ["s"])


def test_counts(corpus, model):
    trigrams, words, total = Counter(), Counter(), Counter()
    for s in corpus[0]:
        tags = [G.START, G.START, *(t for _, t in s), G.END]
        trigrams.update(zip(tags, tags[1:], tags[2:]))
        words.update((w.lower(), t) for w, t in s)
        total.update(w.lower() for w, _ in s)
    suffixes = Counter()
    for (w, t), n in words.items():
        if total[w] <= G.RARE:
            for i in range(1, min(len(w), G.SUFFIX) + 1):
                suffixes[w[-i:], t] += n
    assert {(r.t1, r.t2, r.t3): r.n for r in model.trigrams.collect()} == trigrams
    assert {(r.word, r.tag): r.n for r in model.words.collect()} == words
    assert {(r.suffix, r.tag): r.n for r in model.suffixes.collect()} == suffixes


def test_emissions_by_recursion(spark, model):
    t = G.Transitions([tuple(r) for r in model.trigrams.select("t1", "t2", "t3", "n").collect()])
    tags = t.tags[:-2]
    words = {(r.word, r.tag): r.n for r in model.words.collect()}
    suffixes = {(r.suffix, r.tag): r.n for r in model.suffixes.collect()}
    n_tag = Counter()
    for (_, tag), n in words.items():
        n_tag[tag] += n
    asked = ["the", "qqqtion", "zzz", "ly", "xously", sorted(w for w, _ in words)[7]]
    got = {r.word: dict(zip(r.tags, r.scores, strict=True)) for r in G.emissions(spark.createDataFrame([(w,) for w in asked], "word string"), model, t).collect()}
    assert set(got) == set(asked)
    for w in asked:
        known = {tag: n for (x, tag), n in words.items() if x == w}
        if known:
            want = {tags.index(tag): math.log(n / n_tag[tag]) for tag, n in known.items()}
        else:
            p = t.prior.copy()
            for i in range(1, min(len(w), G.SUFFIX) + 1):
                n = np.array([suffixes.get((w[-i:], tag), 0) for tag in tags], float)
                if not n.sum():
                    break
                p = (n / n.sum() + t.theta * p) / (1 + t.theta)
            want = {i: math.log(max(p[i], 1e-12) / t.prior[i]) for i in range(len(tags))}
        assert got[w] == pytest.approx(want)


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = 4
        log = np.log(rng.random((n + 2,) * 3))
        places = [np.sort(rng.choice(n, rng.integers(1, n + 1), replace=False)) for _ in range(rng.integers(1, 6))]
        scores = [np.log(rng.random(len(p))) for p in places]

        def value(path):
            tags = [n, n, *(places[i][j] for i, j in enumerate(path)), n + 1]
            return sum(log[a, b, c] for a, b, c in zip(tags, tags[1:], tags[2:])) + sum(scores[i][j] for i, j in enumerate(path))

        best = max(itertools.product(*(range(len(p)) for p in places)), key=value)
        assert G.viterbi(places, scores, log) == [int(places[i][j]) for i, j in enumerate(best)]


def test_accuracy_on_unseen_words(spark, corpus, model):
    held = corpus[1]
    df = spark.createDataFrame([(i, [w for w, _ in s]) for i, s in enumerate(held)] + [(900, []), (901, None), (0, ["the"])], "s long, tokens array<string>").repartition(3)
    got = G.tag(df, model, ["s"]).collect()
    assert len(got) == len(held) + 1
    right = total = unseen = 0
    known = {r.word for r in model.words.select("word").distinct().collect()}
    for r in got:
        if len(r.tokens) > 1:
            assert r.tokens == [w for w, _ in held[r.s]]
            right += sum(a == b for a, (_, b) in zip(r.tags, held[r.s], strict=True))
            total += len(r.tags)
            unseen += sum(w not in known for w in r.tokens)
    assert unseen / total > 0.4 and right / total > 0.97
    empty = spark.createDataFrame([], "s long, position int, token string, tag string")
    assert G.tag(df, G.train(empty, ["s"]), ["s"]).collect() == []


def test_noun_chunks(spark):
    s = [
        ("the fair wage of big old safety rules".split(), "DET ADJ NOUN ADP ADJ ADJ NOUN NOUN".split()),
        ("fair people safe water".split(), "ADJ NOUN ADJ NOUN".split()),  # an edge between two chunks: no pair across it
        ("quick and fair".split(), "ADJ CCONJ ADJ".split()),
        ("covid19 health don't report".split(), "NOUN NOUN NOUN NOUN".split()),
        ([], []),
    ]
    df = spark.createDataFrame(s, "tokens array<string>, tags array<string>")
    got = [r.c for r in df.select(G.noun_chunks(F.col("tokens"), F.col("tags")).alias("c")).collect()]
    assert got == [[["the", "fair", "wage"], ["big", "old", "safety", "rules"]], [["fair", "people"], ["safe", "water"]], [], [s[3][0]], []]
    phrases = {r.phrase: r.n for r in G.chunk_phrases(df, custom=["old", "big"]).collect()}
    assert phrases == {"fair wage": 1, "safety rules": 1, "fair people": 1, "safe water": 1, "health report": 1}
    lemmas = spark.createDataFrame([("rules", "rule"), ("people", "person"), ("water", "old")], "surface string, lemma string")
    phrases = {r.phrase: r.n for r in G.chunk_phrases(df.union(df), custom=["old", "big"], lemmas=lemmas).collect()}
    assert phrases == {"fair wage": 2, "safety rule": 2, "fair person": 2, "health report": 2}


def test_lemma_scripts(spark):
    rng = random.Random(4)
    irregular = [("mice", "mouse"), ("went", "go"), ("a", "a"), ("is", "be")]
    make = lambda stem: [(stem + "ies", stem + "y"), (stem + "sses", stem + "ss"), (stem + "nts", stem + "nt"), (stem + "ating", stem + "ate")]
    stems = ["".join(rng.choices("bcdfglmnprt", k=3)) for _ in range(60)]
    seen = [p for s in stems[:40] for p in make(s)] + irregular
    held = [p for s in stems[40:] for p in make(s)]
    rules = G.learn_lemmas(spark.createDataFrame(seen + [(None, "x"), ("x", None)], "surface string, lemma string"))
    words = spark.createDataFrame([(w,) for w, _ in seen + held] + [(None,), ("Mice",)], "word string")
    got = {r.word: r.lemma for r in G.lemmatise(words, rules).collect()}
    assert all(got[w] == lemma for w, lemma in seen)  # exact on the table
    assert sum(got[w] == lemma for w, lemma in held) / len(held) > 0.95 and got["mice"] == "mouse"
    assert G.lemmatise(words, rules.where("false")).where("word <> lemma").count() == 0


def test_whole_tokens(spark):
    df = spark.createDataFrame([("Don't use covid19 data, well-being! élan 3.5 the",)], "text string")
    toks = df.select(word_tokens(F.col("text")).alias("t")).first().t
    assert toks == ["Don't", "use", "covid19", "data", ",", "well", "-", "being", "!", "élan", "3", ".", "5", "the"]
    assert [r.a for r in df.select(F.explode(word_tokens(F.col("text"))).alias("w")).select(is_alpha(F.col("w")).alias("a")).collect()].count(True) == 6
    counts = {r.term for r in terms.word_counts(df, whole=True, surface_stopwords=["the", "data"], stopwords=["being"], min_length=3).collect()}
    assert counts == {"use", "well", "élan"}


def test_training_on_arrays_is_training_on_rows(spark):
    """Sentences as arrays are counted where they stand; rows that share a key are one sentence, as in ``train``."""
    rows = [(1, 0, ["A", "cat"], ["DET", "NOUN"]), (1, 0, ["a", "Dog", "x"], ["DET", "NOUN", "NOUN"]), (2, 0, ["Cat"], ["NOUN"]), (None, 1, ["b"], ["X"]), (None, 1, ["a"], ["Y"]), (3, 0, [], [])]
    arrays = spark.createDataFrame(rows, "doc long, i long, tokens array<string>, tags array<string>")
    each = arrays.select("doc", "i", F.posexplode(F.arrays_zip("tokens", "tags")).alias("position", "x")).select("doc", "i", "position", F.col("x.tokens").alias("token"), F.col("x.tags").alias("tag"))
    want = G.train(each, ["doc", "i"])
    repeated = spark.createDataFrame([(1,), (None,)], "doc long")
    got = G.train_sentences(arrays, ["doc", "i"], repeated)
    for a, b in ((want.trigrams, got.trigrams), (want.words, got.words), (want.suffixes, got.suffixes)):
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    # only rows with a repeated key are brought together
    alone = G.train_sentences(arrays.where("doc = 2"), ["doc", "i"], repeated.limit(0))
    assert {tuple(r) for r in alone.trigrams.collect()} == {("<s>", "<s>", "NOUN", 1), ("<s>", "NOUN", "</s>", 1)}


def test_chunks_of_a_long_sentence_take_linear_work(spark):
    n = 40_000
    df = spark.range(1).select(F.array_repeat(F.lit("w"), n).alias("tokens"), F.flatten(F.array_repeat(F.array(F.lit("ADJ"), F.lit("NOUN")), n // 2)).alias("tags"))
    got = df.select(G.noun_chunks(F.col("tokens"), F.col("tags")).alias("c")).select(F.size("c"), F.array_max(F.transform("c", F.size))).first()
    assert tuple(got) == (n // 2, 2)
