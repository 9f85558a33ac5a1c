"""Learned sentence boundaries against a brute-force learner and splitter in plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framescope.operators import boundaries as B

ABBREVIATIONS = ["Dr.", "Mr.", "e.g.", "approx.", "vol."]
NAMES = ["Smith", "Jones", "Miller", "Brown"]
WORDS = "workers wage health policy report audit people safety training contract between across measure".split()


def _corpus(n=400):
    rng = random.Random(5)
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choices(WORDS, k=rng.randint(3, 7))
            if rng.random() < 0.4:
                w.insert(rng.randint(1, len(w) - 1), f"Dr. {rng.choice(NAMES)}" if rng.random() < 0.5 else f"Mr. {rng.choice(NAMES)}")
            if rng.random() < 0.3:
                w.insert(rng.randint(1, len(w) - 1), rng.choice([f"e.g. {rng.choice(WORDS)}", "approx. 5 percent", "vol. 3 of it", "J. Miller", "the 3. part"]))
            start = rng.choice(["However", "The", "In"]) + " "
            parts.append(start + " ".join(w) + rng.choice([".", ".", ".", "!", "?", '."', "..."]))
        out.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    return out + [(900, None), (901, ""), (902, "   "), (903, "No end"), (904, "Only one. "), (904, "Repeated key. Two here.")]


def _strip(t):
    return re.sub(r"^[\"“”‘’'(\[{]+|[,;:\"“”‘’')\]}]+$", "", t)


def _describe(t):
    c = _strip(t)
    bare = re.sub(r"\.$", "", c)
    kind = B.NUMBERS if re.search(r"^[-+]?[0-9][0-9.,]*$", bare) else bare.lower()
    shape = "upper" if c[:1].isupper() else "lower" if c[:1].islower() else "none"
    return kind, bool(re.search(r"[^.]\.$", c)), bool(re.search("[!?][\"”’)\\]]*$", t)), shape


def _xlog(n, p):
    return 0.0 if n == 0 else n * math.log(max(p, 1e-300))


def _llr(a, b, ab, n):
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
    same = _xlog(ab, p) + _xlog(a - ab, 1 - p) + _xlog(b - ab, p) + _xlog(n - a - b + ab, 1 - p)
    apart = _xlog(ab, p1) + _xlog(a - ab, 1 - p1) + _xlog(b - ab, p2) + _xlog(n - a - b + ab, 1 - p2)
    return -2 * (same - apart)


def _learn(docs):
    texts = [[_describe(t) for t in (x or "").split()] for _, x in docs]
    total, period, lower = Counter(), Counter(), Counter()
    for w in texts:
        for kind, dot, _, shape in w:
            total[kind] += 1
            period[kind] += dot
            lower[kind] += shape == "lower"
    n, n_dot = sum(total.values()), sum(period.values())
    abbreviations = {}
    for kind, ab in period.items():
        if ab and any(c.isalpha() for c in kind) and kind != B.NUMBERS:
            a, p, bare = total[kind], n_dot / n, len(kind.replace(".", ""))
            score = -2 * (_xlog(ab, p) + _xlog(a - ab, 1 - p) - _xlog(ab, 0.99) - _xlog(a - ab, 0.01))
            score *= math.exp(-bare) * (kind.count(".") + 1) * float(bare) ** -(a - ab)
            if score >= 0.3:
                abbreviations[kind] = ab
    ends, upper, weak = Counter(), Counter(), Counter()
    for w in texts:
        for (kind, dot, sure, _), (follow, _, _, shape) in zip(w, w[1:]):
            uncertain = kind in abbreviations or kind == B.NUMBERS or (len(kind) == 1 and kind.isalpha())
            ends[follow] += sure or (dot and not uncertain)
            upper[follow] += shape == "upper" and not dot and not sure
            weak[kind, follow] += dot and uncertain
    n_ends = sum(ends.values())
    letter = lambda s: any(c.isalpha() for c in s)
    starters = {k: c for k, c in ends.items() if c and letter(k) and _llr(n_ends, total[k], c, n) >= 30 and c * n > total[k] * n_ends}
    pairs = {(a, b): c for (a, b), c in weak.items() if c > 1 and letter(b) and _llr(total[a], total[b], c, n) >= 7.88 and c * n > total[a] * total[b]}
    return abbreviations, starters, pairs, lower, upper


def _split(text, model):
    abbreviations, starters, pairs, lower, upper = model
    text = (text or "").strip()
    pieces = re.split("\u0001", re.sub(r"([.!?]+[\"”’)\]]*)(\s+)", "\\1\u0001\\2", text))
    out, now = [], pieces[0]
    for a, b in zip(pieces, pieces[1:]):
        (kind, dot, sure, _), (follow, _, _, shape) = _describe(a.split()[-1]), _describe(b.split()[0])
        up = shape == "upper"
        if sure or not dot:
            end = True
        elif (kind, follow) in pairs:
            end = False
        elif kind in abbreviations:
            end = up and (follow in starters or (lower[follow] > 0 and upper[follow] == 0))
        elif len(kind) == 1 and kind.isalpha():
            end = not (up and lower[follow] == 0)
        elif kind == B.NUMBERS:
            end = shape != "lower"
        else:
            end = True
        if end:
            out.append(now.strip())
            now = ""
        now += b
    return [x for x in [*out, now.strip()] if x]


@pytest.fixture(scope="module")
def frames(spark):
    docs = _corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return docs, df, B.learn(df)


def test_learned_tables(frames):
    docs, _, model = frames
    abbreviations, starters, pairs, _, _ = _learn(docs)
    assert {r.type: r.n for r in model.abbreviations.collect()} == abbreviations
    assert {r.type: r.n for r in model.starters.collect()} == starters
    assert {(r.type, r.next): r.n for r in model.collocations.collect()} == pairs
    assert {"dr", "mr", "e.g", "approx", "vol"} <= set(abbreviations) <= {"dr", "mr", "e.g", "approx", "vol", "j"} and {"however", "the", "in"} <= set(starters) and ("dr", "smith") in pairs


def test_split(frames):
    docs, df, model = frames
    got = {}
    for r in B.split(df, model).collect():
        got.setdefault(r.doc_id, []).append((r.sentence_index, r.sentence))
    brute = _learn(docs)
    want = {}
    for d, t in docs:
        own = list(enumerate(_split(t, brute)))
        if own:
            want.setdefault(d, []).extend(own)
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}
    inside = [s for x in got.values() for _, s in x if re.search(r"\b(Dr|Mr|approx|vol|e\.g)\. \S", s)]
    assert len(inside) > 200 and not any(s.endswith(("Dr.", "Mr.")) for x in got.values() for _, s in x)


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = B.learn(empty)
    assert model.table().collect() == [] and B.split(empty, model).collect() == []


def test_telling_pairs_are_the_pairs_that_count(spark):
    """Equal tokens are described once and only pairs that can count are looked at; the counts stay those of all pairs."""
    texts = ["Dr. Who said \"No!\" (Ünder) 3.5 e.g. This ... it's U.S.A. 'Tis end", "a A. a. “Quote.” [B] 12. twelve? 𝐀x", "", None, "one", "a. a. a. B a"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    pairs = B.token_pairs(docs)
    counts = pairs.groupBy("type").agg(F.count_if("period").alias("n_with"), F.count_if(~F.col("period")).alias("n_without"), F.count_if(F.col("shape") == "lower").alias("n_lower"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(B.token_counts(docs)) == rows(counts)
    capital = (F.col("next_shape") == "upper") & ~F.col("period") & ~F.col("sure")
    counting = F.col("next").isNotNull() & (F.col("sure") | F.col("period") | capital)
    told = B.telling_pairs(docs)
    assert rows(told.where(counting)) == rows(pairs.where(counting))
    assert told.count() < pairs.count()
    plan = docs.select("text").transform(B._raw_pairs, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # each text is cut into words once
