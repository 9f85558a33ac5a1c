"""The operators against brute force on small fixtures: nulls, empty and repeated rows, ties, empty tables, clashing columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framescope.llm import quality_crf
from framescope.llm import suffix_dedup as suffix
from framescope.llm.jaccard_join import divide_skip, jaccard_join
from framescope.llm.latent_decontamination import latent_decontamination, lcs
from framescope.llm.soft_mixing import fold, soft_mixing
from framescope.llm.substring_dedup import substring_dedup
from framescope.llm.suffix_dedup import RunIndex, suffix_dedup, suffix_order
from framescope.llm.token_output import WordEncoder, _by_pair, decode_document, expand, gather, packed, repair, token_output, unpacked, write_tokens
from framescope.llm.topk_search import topk_search

RNG = np.random.default_rng(5)
VOCABULARY = ["alpha", "beta", "gamma", "delta", "omega", "Sigma", "kappa,", "rho.", "été", "x1"]
PASSAGE = " ".join(f"w{i}" for i in range(70))


def _text(n):
    return " ".join(RNG.choice(VOCABULARY, n)) + "".join(f" u{i}" for i in RNG.integers(0, 10**6, n))


@pytest.fixture(scope="module")
def rows():
    base = [_text(60) for _ in range(6)]
    texts = [*base, base[0], base[1] + " tail", _text(5) + " " + PASSAGE, PASSAGE + "\t" + _text(9), "", None, "one two", "ONE two", "a " * 300, "\x0b\x0c "]
    return [(i, t, "n") for i, t in enumerate(texts)] + [(3, base[3], "n"), (None, base[2], "n")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # extra columns whose names clash with those the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, th string").withColumn("gram", F.lit(1)).withColumn("pos", F.lit("x")).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_substring_dedup(docs, rows, empty):
    starts = {}
    for d, t, _ in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - 19):
            if d is not None:
                starts.setdefault(tuple(w[i : i + 20]), set()).add(d)
    want = []
    for d, t, _ in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - 19):
            if d is not None and min(starts[tuple(w[i : i + 20])]) < d:
                gone |= set(range(i, i + 20))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in substring_dedup(docs, 20).drop("kept_text").collect()]
    assert Counter(got) == Counter(want)
    assert substring_dedup(empty).count() == 0


@pytest.mark.parametrize("most", [2, 4096])
def test_suffix_dedup(docs, rows, empty, most):
    count = Counter()
    for _, t, _ in rows:
        b = (t or "").encode()
        count.update(b[i : i + 50] for i in range(len(b) - 49))
    want = []
    for d, t, _ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if count[b[i : i + 50]] > 1:
                gone[i : i + 50] = [True] * 50
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    got = [tuple(r) for r in suffix_dedup(docs, 50, 16, most).drop("kept_bytes").collect()]
    assert Counter(got) == Counter(want)
    if most == 2:
        assert suffix_dedup(empty).count() == 0


def _repeated(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return {(d, i) for d, t in enumerate(texts) for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1}


def _framed(n, passage=300, frame=60):
    """Texts that hold parts of one passage between bytes of their own."""
    rng = np.random.default_rng(9)
    letters = lambda k, to: rng.integers(97, to, k).astype(np.uint8).tobytes()
    shared = letters(passage, 123)
    return [letters(rng.integers(0, frame), 100) + shared[rng.integers(0, 100) : rng.integers(150, passage)] + letters(rng.integers(0, frame), 100) for _ in range(n)]


def _anchored(texts, length, gram):
    batch = pa.RecordBatch.from_pydict({"text": texts, "doc": list(range(len(texts))), "th": [0] * len(texts)})
    return batch, [r for b in suffix._anchor_rows(length, gram, False)(iter([batch])) for r in b.to_pylist()]


def test_index_of_neighbourhoods_that_share_half():
    texts, length, gram = _framed(12), 50, 16
    _, found = _anchored(texts, length, gram)
    groups = {}
    for r in found:
        left = max(0, r["pos"] + gram - length)
        groups.setdefault(r["gram"], []).append([r["doc"], 0, left, texts[r["doc"]][left : r["pos"] + length], r["pos"] - left])
    got = set()
    for group in groups.values():
        own = suffix._sharing(group, length, gram)
        # equal neighbourhoods in a row match beyond their ends; matches must not be cut there
        got |= {(d, s) for d, _, a, b in (suffix._index_block(own, length) if own else []) for s in range(a, b)}
    assert got == _repeated(texts, length)
    # the same gram among bytes that differ on both sides is not indexed
    alone = [[d, 0, 0, bytes([97 + d]) * 34 + b"g" * 16 + bytes([97 + d]) * 34, 34] for d in range(20)]
    assert suffix._sharing(alone, length, gram) == []
    assert len(suffix._sharing([*alone, [20, 0, 0, b"-" * 17 + alone[3][3][17:], 34]], length, gram)) == 2


def test_pieces_of_neighbourhoods():
    texts, length, gram = _framed(12), 50, 16
    batch, found = _anchored(texts, length, gram)
    by = {}
    for r in found:
        by.setdefault(r["doc"], []).append(r["pos"])
    asked = batch.append_column("pos", pa.array([by.get(d, []) for d in range(len(texts))], pa.list_(pa.int64())))
    pieces = [r for b in suffix._piece_rows(length, gram)(iter([asked])) for r in b.to_pylist()]
    assert len(pieces) <= len(found) * 6  # not 35, one for each string
    places = Counter((r["doc"], s) for r in pieces for s in range(r["start"], r["stop"]))
    assert len(places) == sum(len(t) - length + 1 for t in texts) and set(places.values()) == {1}  # each string by one anchor
    alike = {}
    for r in pieces:
        alike.setdefault((r["common"], r["c1"], r["c2"]), []).append((r["doc"], r["start"], r["stop"]))
    n = Counter(k[0] for k in alike)
    got = {(d, s) for own in alike.values() if len(own) > 1 for d, a, b in own for s in range(a, b)}
    left = {}
    for k, own in alike.items():
        if n[k[0]] > 1:
            d, a, b = min(own)
            left.setdefault(d, []).append({"start": a, "stop": b})
    rest = pa.RecordBatch.from_pydict({"text": [texts[d] for d in left], "doc": list(left), "th": [0] * len(left), "pieces": list(left.values())})
    strings = [r for b in suffix._string_rows(length)(iter([rest])) for r in b.to_pylist()]
    times = Counter((r["h1"], r["h2"]) for r in strings)
    assert got | {(r["doc"], r["pos"]) for r in strings if times[r["h1"], r["h2"]] > 1} == _repeated(texts, length)


def test_run_index():
    s = RNG.integers(1, 4, 400)
    s[300:340] = s[100:140]
    order = suffix_order(s)
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    reach = RunIndex(np.append(s, 0), 8, 400).matches()[:-1]
    for i in range(len(s)):
        best = max(next((k for k in range(len(s)) if i + k >= len(s) or j + k >= len(s) or s[i + k] != s[j + k]), 0) for j in range(len(s)) if j != i)
        assert (reach[i] >= 8) == (best >= 8) and reach[i] <= max(best, 8)


@pytest.mark.parametrize("block", [200, 1 << 19])
def test_jaccard_join(docs, rows, empty, block):
    sets = {}
    for d, t, _ in rows:
        if d is None:
            continue
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.setdefault(d, set()).update(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else sets.setdefault(d, set()).update({tuple(w)} if w else ())
    root = {d: d for d in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = jaccard_join(docs, block_grams=block, long=50).collect()
    assert Counter((r[0], r[2]) for r in got) == Counter((d, None if d is None else find(d)) for d, _, _ in rows)
    assert all(r[1] == len(sets[r[0]]) for r in got if r[0] is not None)
    if block == 200:
        assert jaccard_join(empty).count() == 0


def test_divide_skip_keeps_links_of_sets_that_do_not_ask():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 10, 20)]  # a chain: the ends do not link
    assert len(divide_skip(sets, np.array([True] * 3), 80)) == 2
    assert divide_skip(sets, np.array([False] * 3), 80) == []


def test_topk_search(spark):
    v = RNG.integers(-20, 20, (60, 6)).tolist()
    v[7] = v[3]
    data = [(i, x) for i, x in enumerate(v)] + [(100, None), (101, [1, None, 2, 3, 4, 5]), (102, []), (50, v[50]), (0, [1, 2])]
    vectors = spark.createDataFrame(data, "vec_id long, v array<long>")
    good = [(i, x) for i, x in data if x and None not in x]
    want = []
    for a, (i, x) in enumerate(good):
        if i % 50 == 0:
            scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), j) for b, (j, y) in enumerate(good) if b != a and len(y) == len(x))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    for rows_ in (7, 4096):
        got = [tuple(r) for r in topk_search(vectors, vectors.where("vec_id % 50 = 0"), 5, rows_, 2).collect()]
        assert Counter(got) == Counter(want)
    assert topk_search(vectors.where("false"), vectors.where("false")).count() == 0


def test_token_output(spark, docs, rows, empty, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    enc = WordEncoder(path)
    assert enc.by_word
    letters = ["a", "É", "'s", "'", ".", " ", ",", "\n", "1", "İ", "ß", "<|endoftext|>", "中", "́", ")", "²", "\x85", "😀"]
    texts = ["".join(RNG.choice(letters, RNG.integers(0, 25))) for _ in range(2000)]
    flat, off, seq, ends = enc.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert flat[gather(off[:-1], np.diff(off), seq[ends[i] : ends[i + 1]])].tolist() == enc.tok.encode(t, add_special_tokens=False).ids
    ids = {t: np.array([*enc.tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t, _ in rows}
    got = token_output(docs, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(ids[t]), zlib.crc32(ids[t].tobytes())) for d, t, _ in rows)
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order)])[:-1].tolist()
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in order), key=lambda d: (d is not None, d or 0))
    write_tokens(docs, str(tmp_path / "t"), path)
    for shard in spark.read.parquet(str(tmp_path / "t")).collect():
        for j, d in enumerate(np.frombuffer(shard["doc_ids"], "<i8").tolist()):
            if not shard["doc_null"][j]:
                assert any(len(decode_document(shard, j)) == len(ids[t]) and (decode_document(shard, j) == ids[t]).all() for i, t, _ in rows if i == d)
    assert token_output(empty, path).count() == 0


@pytest.mark.parametrize("symbols", [300, 1 << 30])  # as one number, and where pair and place do not fit in one
def test_pairs_are_ordered_with_their_places(symbols):
    rng = np.random.default_rng(4)
    left, right = rng.integers(symbols - 30, symbols, (2, 5000))
    at = rng.permutation(9000)[:5000]
    key, places, wide = _by_pair(left, right, at, symbols, 9000)
    order = np.lexsort((right, left))
    assert (key >> wide == left[order]).all() and (key & ((1 << wide) - 1) == right[order]).all()
    pair = dict(zip(at.tolist(), zip(left.tolist(), right.tolist(), strict=True), strict=True))
    assert sorted(places.tolist()) == sorted(pair)
    assert [pair[x] for x in places.tolist()] == list(zip((key >> wide).tolist(), (key & ((1 << wide) - 1)).tolist(), strict=True))


def test_repair_leaves_no_frequent_pair():
    types = [RNG.integers(0, 6, n) for n in (1, 3, 2, 7, 12)] + [np.array([5], np.int64)]
    off = np.append(0, np.cumsum([len(t) for t in types]))
    seq = np.concatenate([RNG.integers(0, 5, 3000), np.full(500, 0), np.tile([1, 2, 4], 200)])
    cut = np.sort(RNG.integers(0, len(seq), 6))
    doc_off = np.concatenate([[0], cut, [len(seq), len(seq)]])
    flat = np.concatenate(types)
    rules, lengths, symbols, ends = repair(flat, off, seq, doc_off, 6, most=5, least=4)
    raw = np.concatenate([types[t] for t in seq])
    assert (expand(rules, lengths, symbols, 6) == raw).all()
    size = np.append(np.ones(6, np.int64), lengths)
    want = [sum(len(types[t]) for t in seq[: e]) for e in doc_off[1:]]
    assert [int(size[symbols[:e]].sum()) for e in ends] == want
    counts = Counter()
    for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
        own, k = symbols[lo:hi].tolist(), 0
        while k + 1 < len(own):  # occurrences that do not overlap
            counts[own[k], own[k + 1]] += 1
            k += 2 if own[k] == own[k + 1] and own[k + 1 : k + 3] == [own[k]] * 2 else 1
    assert max(counts.values(), default=0) < 4
    width = int(symbols.max()).bit_length()
    assert (unpacked(packed(symbols, width), width, 0, len(symbols)) == symbols).all()
    assert (unpacked(packed(symbols, width), width, 5, 40) == symbols[5:40]).all()


def test_quality_crf(spark, empty):
    good = ["\n".join(" ".join(RNG.choice(VOCABULARY, 9)) + "." for _ in range(4)) for _ in range(120)]
    bad = ["\n".join(" ".join(f"{w.upper()}!!" for w in RNG.choice(VOCABULARY, 9)) for _ in range(4)) for _ in range(120)]
    data = [(i, t, i % 2) for i, t in enumerate(x for pair in zip(bad, good, strict=True) for x in pair)]
    df = spark.createDataFrame([*data, (9001, None, 0), (9002, "", 0), (None, "A\n\n", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, label int")
    got = quality_crf.quality_crf(df, quality_crf.train(df, labels)).collect()
    held = [r for r in got if r.held_out and r.doc_id < 9000]
    assert len(got) == 243 and len(held) > 20 and np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and all(bool(r.held_out) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert quality_crf.quality_crf(empty, quality_crf.train(empty, labels)).count() == 0


def test_soft_mixing(spark, empty):
    data = [(i, " ".join(RNG.choice(["the", "and", "with"] if i % 4 else ["und", "der", "nicht"], 30))) for i in range(200)] + [(500, None), (501, ""), (3, "the the")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "en" if i % 4 else "de") for i in range(100)], "doc_id long, domain string")
    got = soft_mixing(df, labelled, {"en": 0.5, "de": 0.5}).toPandas()
    p, rate, t = np.array(got.posterior.tolist()), got.rate.to_numpy(), got.tokens.to_numpy()
    total = (rate * t) @ p
    assert abs(total[0] / total[1] - 1) < 0.01 and rate.min() >= 1 and (got.copies >= 1).all() and len(got) == len(data)
    assert (fold(np.eye(2), [np.array([0.5, -1.0]), np.array([2.0, 0.0])], 0.0) == [0.0, 2.0]).all()
    assert soft_mixing(empty, labelled.where("false")).count() == 0


def test_latent_decontamination(spark, empty):
    assert lcs([1, 2, 3, 4], [9, 1, 3, 7, 4]) == 3
    items = [" ".join(f"q{k}v{i}" for i in range(25)) for k in range(4)]
    words = items[1].split()
    words[3] = words[11] = "changed"
    rows = [(i, _text(80)) for i in range(20)] + [(50, _text(20) + " " + items[0] + " " + _text(20)), (51, _text(9) + " " + " ".join(words)), (52, None), (53, ""), (None, items[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    assert sorted(((r.doc_id, r.item_id) for r in latent_decontamination(df, bench).collect()), key=str) == [(50, 0), (51, 1), (None, 2)]
    assert sorted(((r.doc_id, r.item_id) for r in latent_decontamination(df, bench, items_per_block=2).collect()), key=str) == [(50, 0), (51, 1), (None, 2)]
    assert latent_decontamination(empty, bench).count() == 0 and latent_decontamination(df, bench.where("false")).count() == 0


def test_latent_decontamination_of_an_item_changed_in_many_copies(spark):
    items = [" ".join(f"q{k}v{i}" for i in range(25)) for k in range(4)]
    words = items[1].split()
    words[3] = "changed"
    # a third of the rows, so that all words of the item but one are common
    rows = [(i, _text(80)) for i in range(40)] + [(100 + i, _text(40) + " " + " ".join(words) + " " + _text(9 + i)) for i in range(20)]
    rows += [(200, _text(30) + " " + " ".join(w for i, w in enumerate(words) if i % 5 != 2) + " " + _text(30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = latent_decontamination(df, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(100 + i, 1) for i in range(20)]
    assert all(r.lcs == 24 / 25 for r in got)


def test_latent_decontamination_of_long_items(spark):
    items = [" ".join(f"q{k}v{i}" for i in range(n)) for k, n in enumerate([25, 400, 700, 1500])]
    part = items[3].split()
    changed = [w if i % 6 else "changed" for i, w in enumerate(part)]
    rows = [(i, _text(80)) for i in range(30)] + [(50 + k, _text(7 * k + 3) + " " + x + " " + _text(11)) for k, x in enumerate(items)]
    rows += [(60, " ".join(changed)), (61, " ".join(part[:1000])), (62, _text(20) + " " + items[2].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    want = [(50, 0), (51, 1), (52, 2), (53, 3), (60, 3), (62, 2)]
    assert sorted((r.doc_id, r.item_id) for r in latent_decontamination(df, bench).collect()) == want
    assert sorted((r.doc_id, r.item_id) for r in latent_decontamination(df, bench, items_per_block=9).collect()) == want


def test_soft_mixing_of_skewed_targets_is_optimal(spark):
    # texts of mixed words, so that posteriors are soft; most are of one domain, which is hardly wanted
    words = [[f"{c}{x}" for x in ("ba", "ce", "di", "fo")] for c in "abcd"]
    share, target = [0.9, 0.05, 0.03, 0.02], [0.05, 0.05, 0.2, 0.7]
    of = RNG.choice(4, 1500, p=share)
    data = [(i, " ".join(words[d if RNG.random() < 0.6 else RNG.integers(4)][RNG.integers(4)] for _ in range(40))) for i, d in enumerate(of)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "abcd"[d]) for i, d in enumerate(of)], "doc_id long, domain string")
    got = soft_mixing(df, labelled, dict(zip("abcd", target, strict=True))).toPandas()
    p, rate, t = np.array(got.posterior.tolist()), got.rate.to_numpy(), got.tokens.to_numpy()
    gram, now, want = (p * t[:, None]).T @ p, t @ p, np.array(target)
    b = want * (now / want).max()
    g = np.linalg.solve(gram, (rate * t) @ p - b)
    # the projected gradient of every document
    assert np.abs(rate - np.maximum(1, rate - p @ g)).max() < 1e-3
    total = (rate * t) @ p
    assert np.abs(total / total.sum() - want).max() < 0.02
    with pytest.raises(RuntimeError, match="rounds"):
        soft_mixing(df, labelled, dict(zip("abcd", target, strict=True)), rounds=2)


def test_soft_mixing_keeps_rare_domains(spark):
    # one labelled document in 400 is "fr", and all of those are long
    data = [(i, " ".join(RNG.choice(["the", "and", "with"], 30))) for i in range(2000)] + [(3000 + i, "vous êtes quelque " * 2000) for i in range(5)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "en" if i < 3000 else "fr") for i, _ in data] + [(9999, "de")], "doc_id long, domain string")
    got = soft_mixing(df, labelled, {"en": 0.5, "fr": 0.5}, train_docs=60).toPandas()
    p, rate, t = np.array(got.posterior.tolist()), got.rate.to_numpy(), got.tokens.to_numpy()
    total = (rate * t) @ p
    assert p.shape[1] == 2 and np.abs(total / total.sum() - 0.5).max() < 0.03  # as near as the floor lets it
    assert (p[got.doc_id >= 3000, 1] > 0.5).all() and (p[got.doc_id < 3000, 0] > 0.5).all()
    with pytest.raises(ValueError, match="de"):
        soft_mixing(df, labelled, {"en": 0.5, "de": 0.5})


def _thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_words_that_collide_modulo_a_power_of_two(spark):
    one, two = "".join(_thue_morse(1024, "a", "b")), "".join(_thue_morse(1024, "b", "a"))
    same = " ".join(["x"] * 49)
    rows = [(1, one), (2, two), (3, f"{same} {one}"), (4, f"{same} {two}"), (5, " ".join(_thue_morse(2048, "x", "y"))), (6, " ".join(_thue_morse(2048, "y", "x")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join(docs.where("doc_id < 3")).collect()} == {1: 1, 2: 2}
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs.where("doc_id < 5"), 50).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs.where("doc_id > 4"), 2048).collect()} == {5: 0, 6: 0}
    assert {r.doc_id: r.n_removed for r in suffix_dedup(docs.where("doc_id < 3"), 600).collect()}.keys() == {1, 2}


def test_prime_hash():
    from framescope.llm import common as C

    a, b = (RNG.integers(0, C.PRIME, 1000, np.uint64) for _ in range(2))
    assert C.times(a, b).tolist() == [int(x) * int(y) % C.PRIME for x, y in zip(a, b, strict=True)]
    v = np.concatenate([a, b, a])
    p = C.prefix_sums(v, C.WORD_BASE_1)
    at = np.arange(900)
    assert (C.span_hash(p, at, at + 100, C.WORD_BASE_1) == C.span_hash(p, at + 2000, at + 2100, C.WORD_BASE_1)).all()
    assert len(np.unique(C.span_hash(p, np.arange(2900), np.arange(2900) + 100, C.WORD_BASE_1))) == 2000
    small, wide = C.prefix_sums(v % np.uint64(256), C.BYTE_BASE), C.prefix_sums(np.append(v % np.uint64(256), np.uint64(1 << 50)), C.BYTE_BASE)
    assert (C.span_hash(small, at, at + 7, C.BYTE_BASE) == C.span_hash(wide, at, at + 7, C.BYTE_BASE)).all()
