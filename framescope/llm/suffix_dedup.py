"""Suffix-array dedup over a run-length index.

Every ``length``-byte string that stands in two places is removed. Strings meet
through anchors (winnowed 32-byte grams: equal strings pick the same gram at
the same offset), so the index is built where copies are and nowhere else:

1. Anchors are counted over all texts; those standing once end here.
2. The neighbourhood an anchor decides (all strings around it) is compared as
   a 128-bit class. A class seen twice is removed whole wherever it stands, and
   one member represents it from here on; so a group of thousands of copies
   enters the index once.
3. Representatives of anchors with differing neighbourhoods are dealt by anchor.
   Those that share neither half of their neighbourhood with another of their
   anchor hold no common string and end here; the rest
   are indexed in blocks of bounded size: suffix order, its Burrows-Wheeler
   transform as runs, and samples (position, neighbour, common length) at run
   heads and run ends only. Between two samples the text is streamed and the
   matching statistics follow by counting down from the last one, because a
   match of the previous position, less one byte, is a match of this one.
   Positions matching ``length`` bytes of another place are marked.
4. An anchor with more neighbourhoods than one block holds is settled exactly
   another way. The strings it was picked for (it is their first least gram, which
   equal strings agree on) are taken in pieces of neighbouring starts: a piece
   whose strings' common part stands once ends; pieces equal throughout are
   removed whole and represented once; only strings of pieces that remain are
   counted one by one, as 128-bit hashes with map-side combine.

Defined cases: NULL or empty text has no bytes. Identical rows are two places.
Rows with NULL ``doc_id`` take part. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm import common as C

_U = np.uint64
GRAM = 32
#: texts are hashed in chunks, and indexed in blocks, that stay in the processor's cache
ANCHOR_BYTES = 1 << 16
BLOCK_BYTES = 1 << 16
#: neighbourhoods of one anchor that are indexed together; beyond it, strings are hashed
MOST_IN_BLOCK = 4096


def _prefixes(buf: np.ndarray):
    v = buf.astype(_U) + _U(1)
    return C.prefix_sums(v, C.WORD_BASE_1), C.prefix_sums(v, C.WORD_BASE_2)


def _joined(texts: list[bytes]):
    """One byte array of the texts, their bounds and the owner of each byte."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    end = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), np.uint8), end - sizes, end, np.repeat(np.arange(len(texts), dtype=np.int32), sizes)


def _order_keys(buf: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit value of every gram, by which anchors are picked; never zero.

    It only orders grams: equal ones must be equal, and nothing is decided on unequal ones that collide.
    """
    k = _U(0x9E3779B97F4A7C15)
    size = 8 if gram >= 8 else 1
    h = (np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,)) if size == 8 else buf.astype(_U) + _U(1)) * k
    while size < gram:
        step = min(size, gram - size)
        h = h[:-step] * k + h[step:]
        size += step
    return ((h * k) >> _U(32)).astype(np.uint32) | np.uint32(1)


def _gram_hashes(buf: np.ndarray, pos: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of the grams at the given places; they deal rows, equal bytes are told by other hashes or the bytes."""
    h = np.zeros(len(pos), _U)
    for k in range(0, gram, 8):
        word = np.zeros((len(pos), 8), np.uint8)
        size = min(8, gram - k)
        word[:, :size] = buf[pos[:, None] + np.arange(k, k + size)]
        h = C.mix(h * _U(0x9E3779B97F4A7C15) + word.view("<u8")[:, 0] + _U(1))
    return h


def _anchor_rows(length: int, gram: int, counting: bool):
    """Anchors: only their grams, or with neighbourhood class and place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = C.text_bytes(batch.column("text"))
            doc, th = batch.column("doc").to_numpy(), batch.column("th").to_numpy()
            for lo, hi in C.chunks(texts, ANCHOR_BYTES):
                buf, first, last, owner = _joined(texts[lo:hi])
                if len(buf) < length:
                    continue
                pos = C.anchors(_order_keys(buf, gram), owner, gram, length)
                g = _gram_hashes(buf, pos, gram)
                if counting:
                    yield pa.RecordBatch.from_arrays([pa.array(C.signed(g))], names=["gram"])
                    continue
                row = owner[pos]
                p1, p2 = _prefixes(buf)
                left, right = np.maximum(pos + gram - length, first[row]), np.minimum(pos + length, last[row])
                c1 = C.mix(C.span_hash(p1, left, right, C.WORD_BASE_1) + (pos - left).astype(_U))
                c2 = C.span_hash(p2, left, right, C.WORD_BASE_2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(C.signed(g)), pa.array(C.signed(c1)), pa.array(C.signed(c2)), pa.array(doc[lo + row]), pa.array(th[lo + row]), pa.array(pos - first[row])],
                    names=["gram", "c1", "c2", "doc", "th", "pos"],
                )

    return rows


def _neighbourhoods(length: int, gram: int):
    """The text around each representative anchor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = C.text_bytes(batch.column("text"))
            doc, th, marks = batch.column("doc").to_pylist(), batch.column("th").to_pylist(), batch.column("at").to_pylist()
            out: list[tuple] = []
            size = 0
            for text, d, t, own in zip(texts, doc, th, marks, strict=True):
                for m in own:
                    left = max(0, m["pos"] + gram - length)
                    snip = text[left : m["pos"] + length]
                    out.append((m["gram"], d, t, left, snip, m["pos"] - left))
                    size += len(snip)
                    if size > 8 * C.CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["gram", "doc", "th", "left", "snip", "at"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["gram", "doc", "th", "left", "snip", "at"])

    return rows


def _piece_width(length: int, gram: int) -> int:
    """Starts in a piece: as many as there are pieces around an anchor."""
    return math.isqrt(length - gram) + 1


def _decided(keys: np.ndarray, pos: np.ndarray, span: int):
    """First and last start (clipped by nothing but the anchor's reach) of the strings whose first least gram stands at ``pos``."""
    padded = np.full(len(keys) + 2 * span, np.iinfo(np.uint32).max, np.uint32)
    padded[span : span + len(keys)] = keys
    own = keys[pos][:, None]
    before = padded[pos[:, None] + np.arange(span)[None, ::-1]] <= own  # from the anchor to the left
    behind = padded[pos[:, None] + np.arange(span + 1, 2 * span + 1)[None, :]] < own
    free_before = np.where(before.any(axis=1), before.argmax(axis=1), span)
    free_behind = np.where(behind.any(axis=1), behind.argmax(axis=1), span)
    return pos - free_before, pos + free_behind - span


def _piece_rows(length: int, gram: int):
    """The strings that the given anchors decide, in pieces: hashes of what a piece's strings have in common and of all they cover, and its starts."""
    width = _piece_width(length, gram)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = C.text_bytes(batch.column("text"))
            doc, th, marks = batch.column("doc").to_pylist(), batch.column("th").to_pylist(), batch.column("pos").to_pylist()
            for text, d, t, pos in zip(texts, doc, th, marks, strict=True):
                buf = np.frombuffer(text, np.uint8)
                p1, p2 = _prefixes(buf)
                keys = _order_keys(buf, gram)
                own = np.unique(np.asarray(pos, np.int64))
                for k in range(0, len(own), 4096):
                    after = np.arange(0, length - gram + 1, width)[None, :]  # from the last start to the anchor
                    part = own[k : k + 4096]
                    low, high = (np.repeat(x, after.shape[1]) for x in _decided(keys, part, length - gram))
                    last = (part[:, None] - after).ravel()
                    after = np.tile(after[0], len(part))
                    first = last - np.minimum(width - 1, length - gram - after)
                    start, stop = np.maximum(np.maximum(first, low), 0), np.minimum(np.minimum(last, high), len(text) - length) + 1
                    fits = start < stop
                    first, last, after, start, stop = (x[fits] for x in (first, last, after, start, stop))
                    side = (after * (length + 1) + last - start).astype(_U)  # where the anchor stands
                    common = C.mix(C.span_hash(p1, last, first + length, C.WORD_BASE_1) + after.astype(_U))
                    c1 = C.mix(C.span_hash(p1, start, stop - 1 + length, C.WORD_BASE_1) + side)
                    c2 = C.span_hash(p2, start, stop - 1 + length, C.WORD_BASE_2)
                    n = len(start)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(C.signed(x)) for x in (common, c1, c2)] + [pa.array(np.full(n, d, np.int64)), pa.array(np.full(n, t, np.int64)), pa.array(start), pa.array(stop)],
                        names=["common", "c1", "c2", "doc", "th", "start", "stop"],
                    )

    return rows


def _string_rows(length: int):
    """A 128-bit hash of every string of the given pieces, each place once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = C.text_bytes(batch.column("text"))
            doc, th, marks = batch.column("doc").to_pylist(), batch.column("th").to_pylist(), batch.column("pieces").to_pylist()
            for text, d, t, pieces in zip(texts, doc, th, marks, strict=True):
                p1, p2 = _prefixes(np.frombuffer(text, np.uint8))
                step = np.zeros(len(text) + 1, np.int64)
                np.add.at(step, [x["start"] for x in pieces], 1)
                np.add.at(step, [x["stop"] for x in pieces], -1)
                places = np.flatnonzero(np.cumsum(step))
                for k in range(0, len(places), 1 << 18):
                    at = places[k : k + (1 << 18)]
                    h1, h2 = C.span_hash(p1, at, at + length, C.WORD_BASE_1), C.span_hash(p2, at, at + length, C.WORD_BASE_2)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(C.signed(h1)), pa.array(C.signed(h2)), pa.array(np.full(n, d, np.int64)), pa.array(np.full(n, t, np.int64)), pa.array(at)],
                        names=["h1", "h2", "doc", "th", "pos"],
                    )

    return rows


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers (below 512) by prefix doubling on what is still tied."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    padded = np.append(symbols.astype(np.int64), np.zeros(7, np.int64))
    for k in range(7):
        key = (key << 9) | padded[k : k + n]
    order = np.argsort(key)
    rank = np.zeros(n + 1, np.int64)  # of the last suffix with the same key, plus 1; 0 behind the end
    k = 7
    sub, sub_key = order, key[order]
    slots = np.arange(n)
    while True:
        new = np.ones(len(sub), bool)
        new[1:] = sub_key[1:] != sub_key[:-1]
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(sub)))
        rank[sub] = slots[starts][group] + 1
        order[slots] = sub
        open_ = size[group] > 1
        if not open_.any():
            return order
        sub, slots = sub[open_], slots[open_]
        pair = rank[sub] * (n + 2) + rank[np.minimum(sub + k, n)]
        by = np.argsort(pair)
        sub, sub_key = sub[by], pair[by]
        k *= 2


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a text (symbols; 0 separates) with samples at run ends.

    ``heads``: for each run head, its text position, the suffix before it in
    suffix order and their common length; ``tails`` the same for run ends and
    the suffix after. ``runs`` is the transform itself as (symbol, length).
    """

    def __init__(self, symbols: np.ndarray, least: int, most: int):
        n = len(symbols)
        order = suffix_order(symbols)
        bwt = symbols[order - 1]
        bwt[order == 0] = -1  # nothing stands before the first symbol: always a run of its own
        head = np.ones(n, bool)
        head[1:] = bwt[1:] != bwt[:-1]
        at = np.flatnonzero(head)
        self.n, self.runs = n, (bwt[at], np.diff(np.append(at, n)))
        prefix = C.prefix_sums(symbols.astype(_U) + _U(1), C.WORD_BASE_1)
        self.heads = self._samples(order, at[at > 0], -1, prefix, least, most)
        ends = np.append(at[1:] - 1, n - 1)
        self.tails = self._samples(order, ends[ends < n - 1], 1, prefix, least, most)

    @staticmethod
    def _samples(order, at, step, prefix, least, most):
        def same(size):
            return C.span_hash(prefix, pos, pos + size, C.WORD_BASE_1) == C.span_hash(prefix, other, other + size, C.WORD_BASE_1)

        pos, other = order[at], order[at + step]
        fits = np.maximum(pos, other) + least < prefix.shape[1]
        pos, other = pos[fits], other[fits]
        long = same(np.full(len(pos), least))  # shorter matches are never streamed
        pos, other = pos[long], other[long]
        low, high = np.full(len(pos), least), np.minimum(most, prefix.shape[1] - 1 - np.maximum(pos, other))
        while (low < high).any():  # common length by bisection over prefix hashes
            mid = (low + high + 1) // 2
            ok = same(mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return pos, other, low

    def matches(self) -> np.ndarray:
        """Matching statistics (from ``least`` up) of every position against the rest, streamed from the samples."""
        reach = np.zeros(self.n, np.int64)
        for pos, _, length in (self.heads, self.tails):
            reach[pos] = np.maximum(reach[pos], pos + length)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(self.n), 0)


def _index_block(parts: list[tuple], length: int) -> list[tuple]:
    """Ranges of string starts that match another place of the block: ``(doc, th, start, stop)``."""
    pieces: list[list] = []  # overlapping parts of one text are one piece: each place stands once
    for d, t, left, snip in sorted(parts, key=lambda x: x[:3]):
        if pieces and pieces[-1][:2] == [d, t] and left <= pieces[-1][2] + len(pieces[-1][3]):
            own = pieces[-1]
            own[3] += snip[own[2] + len(own[3]) - left :]
        else:
            pieces.append([d, t, left, bytearray(snip)])
    if len(pieces) == 1 and len(pieces[0][3]) <= length:
        return []
    sizes = np.array([len(p[3]) + 1 for p in pieces])
    end = np.cumsum(sizes) - 1
    symbols = np.frombuffer(b"\0".join(bytes(p[3]) for p in pieces) + b"\0", np.uint8).astype(np.int32) + 1
    symbols[end] = 0
    room = np.repeat(end, sizes) - np.arange(len(symbols))
    hit = (RunIndex(symbols, length, len(symbols)).matches() >= length) & (room >= length)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    start, stop = edge[0::2], edge[1::2]
    piece = np.searchsorted(end, start)
    base = end - (sizes - 1)
    return [(pieces[k][0], pieces[k][1], int(a - base[k]) + pieces[k][2], int(b - base[k]) + pieces[k][2]) for k, a, b in zip(piece.tolist(), start, stop, strict=True)]


def _sharing(group: list[tuple], length: int, gram: int) -> list[tuple]:
    """``(doc, th, left, snip)`` of an anchor's neighbourhoods that can have a string in common with another of them.

    A common string reaches half of ``length - gram`` bytes beyond the anchor on one side at least.
    """
    half = (length - gram) // 2
    before = [snip[at - half : at] if at >= half else None for *_, snip, at in group]
    behind = [snip[at + gram : at + gram + half] if len(snip) - at - gram >= half else None for *_, snip, at in group]
    n_before, n_behind = Counter(before), Counter(behind)
    return [p[:4] for p, a, b in zip(group, before, behind, strict=True) if a is not None and n_before[a] > 1 or b is not None and n_behind[b] > 1]


def _indexed(length: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        group: list[tuple] = []
        size, now = 0, None

        def done():
            if not block:
                return
            found = _index_block(block, length)
            block.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["doc", "th", "start", "stop"])

        for batch in batches:
            for own, *part in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc", "th", "left", "snip", "at")), strict=True):
                if own != now:
                    group = _sharing(group, length, gram)
                    block += group
                    size += sum(len(p[3]) for p in group)
                    group, now = [], own
                    if size > BLOCK_BYTES:
                        yield from done()
                        size = 0
                group.append(part)
        block += _sharing(group, length, gram)
        yield from done()

    return rows


def _strip(length: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = C.text_bytes(batch.column("text"))
            whole, spans = batch.column("whole").to_pylist(), batch.column("spans").to_pylist()
            sizes, removed, runs, sha, kept = [], [], [], [], []
            for text, w, s in zip(texts, whole, spans, strict=True):
                n, out, gone, k = len(text), text, 0, 0
                if w or s:
                    w = np.asarray(w or [], np.int64)
                    s = np.array([(x["start"], x["stop"]) for x in s or []], np.int64).reshape(-1, 2)
                    step = np.zeros(n + 1, np.int32)
                    for at, to in ((np.maximum(w + gram - length, 0), np.minimum(w + length, n)), (s[:, 0], s[:, 1] - 1 + length)):
                        np.add.at(step, at, 1)
                        np.add.at(step, to, -1)
                    cut = np.cumsum(step[:-1]) > 0
                    gone = int(cut.sum())
                    k = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum())
                    out = np.frombuffer(text, np.uint8)[~cut].tobytes()
                sizes.append(n)
                removed.append(gone)
                runs.append(k)
                sha.append(hashlib.sha256(out).hexdigest())
                kept.append(out)
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), long(sizes), long(removed), long(runs), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"],
            )

    return rows


def suffix_dedup(docs: DataFrame, length: int = 200, gram: int = GRAM, most_in_block: int = MOST_IN_BLOCK) -> DataFrame:
    """Remove bytes covered by a ``length``-byte string that also starts anywhere else, same text included.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes``,
    one row per input row. ``gram`` must be less than ``length``.
    """
    if not 0 < gram < length:
        raise ValueError("gram must be positive and less than length")
    # a NULL doc_id still needs a key for its marks
    rows = C.keyed(docs).withColumn("doc", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long")))
    keys = ["doc", "th"]
    texts = rows.select("doc", "th", "text", "doc_id")
    grams = texts.select("doc", "th", "text").mapInArrow(C.task(_anchor_rows(length, gram, True)), "gram long")
    seen = texts.mapInArrow(C.task(_anchor_rows(length, gram, False)), "gram long, c1 long, c2 long, doc long, th long, pos long")

    # written, so that the join below stands on plain exchanges, which adaptive execution can split at a hot gram
    repeated = C.written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "repeated")
    near = C.written(seen.join(repeated, "gram", "left_semi"), "anchors")

    place = F.struct("doc", "th", "pos")
    classes = near.groupBy("gram", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("rep"))
    classes = C.written(classes, "classes")
    whole = near.join(classes.where("n > 1").select("gram", "c1", "c2"), ["gram", "c1", "c2"], "left_semi").select(*keys, "pos")

    mixed = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", F.when(F.col("n") > most_in_block, True).alias("wide"))
    reps = classes.select("gram", "rep.*").join(C.written(mixed, "mixed"), "gram")
    asked = reps.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("wide").isNull(), F.struct("gram", "pos"))).alias("at"), F.collect_list(F.when(F.col("wide"), F.col("pos"))).alias("pos")
    )
    asked = C.written(texts.dropDuplicates(keys).join(asked, keys).select("doc", "th", "text", "at", "pos"), "asked")
    snippets = asked.where(F.size("at") > 0).mapInArrow(C.task(_neighbourhoods(length, gram)), "gram long, doc long, th long, left long, snip binary, at long")
    indexed = snippets.repartition("gram").sortWithinPartitions("gram").mapInArrow(C.task(_indexed(length, gram)), "doc long, th long, start long, stop long")

    around = asked.where(F.size("pos") > 0)
    pieces = around.mapInArrow(C.task(_piece_rows(length, gram)), "common long, c1 long, c2 long, doc long, th long, start long, stop long")
    alike = pieces.groupBy("common", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*keys, "start", "stop")).alias("rep"))
    alike = C.written(alike, "alike")
    equal = pieces.join(alike.where("n > 1").select("common", "c1", "c2"), ["common", "c1", "c2"], "left_semi").select(*keys, "start", "stop")
    unlike = C.written(alike.groupBy("common").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("common"), "unlike")
    left = alike.join(unlike, "common", "left_semi").select("rep.*").groupBy(*keys).agg(F.collect_set(F.struct("start", "stop")).alias("pieces"))
    left = C.written(around.select(*keys, "text").join(left, keys), "left")
    strings = left.mapInArrow(C.task(_string_rows(length)), "h1 long, h2 long, doc long, th long, pos long")
    twice = C.written(strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), "twice")
    single = strings.join(twice, ["h1", "h2"], "left_semi").select(*keys, F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop")).unionByName(equal)

    no_pos, no_span = F.lit(None).cast("long").alias("pos"), F.lit(None).cast("struct<start:long,stop:long>").alias("span")
    span = F.struct("start", "stop").alias("span")
    marks = whole.select(*keys, "pos", no_span).unionByName(indexed.select(*keys, no_pos, span)).unionByName(single.select(*keys, no_pos, span))
    marks = marks.groupBy(*keys).agg(F.collect_set("pos").alias("whole"), F.collect_set("span").alias("spans"))
    return texts.join(marks, keys, "left").select("doc_id", "text", "whole", "spans").mapInArrow(C.task(
        _strip(length, gram)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"
    )
