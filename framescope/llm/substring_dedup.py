"""Substring dedup by level-wise doubling.

Level 1 looks for repeated windows of half the final length. Only anchors
(the least window hash of each final-length window, see ``common.anchors``)
are dealt out: equal final windows share their anchor, so no repeat is lost and
about 2 / (length / 2) of the positions move. Level 2 extends those, and only
those, whose half-length window also stands in another document: first by the
whole neighbourhood an anchor can decide (the final windows around it, as one
class by two hashes), which settles copies without one row per window; then window
by window for the first document of each neighbourhood. Candidates at twice
the final length would change nothing that is removed, so the doubling ends.

Hot keys: all groupings are minima with map-side combine; joins back are plain
equi-joins that adaptive execution splits when skewed.

Defined cases: NULL or empty text has no words. A NULL ``doc_id`` is neither
larger nor smaller than another: its row keeps all words and removes none. Rows
of one ``doc_id`` never remove each other's words; repeated rows get equal
results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm import common as C

_U = np.uint64


def _words(texts: list[bytes]):
    w = C.Words(texts)
    return w, C.prefix_sums(w.hash, C.WORD_BASE_1), C.prefix_sums(w.hashed(C.BYTE_BASE_2), C.WORD_BASE_2)


def _window_hash(p1, p2, start, end):
    return C.span_hash(p1, start, end, C.WORD_BASE_1), C.span_hash(p2, start, end, C.WORD_BASE_2)


def _anchor_rows(length: int):
    half = length // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = C.text_bytes(batch.column("text"))
            doc, th = batch.column("doc_id").to_numpy(), batch.column("th").to_numpy()
            for lo, hi in C.chunks(texts):
                w, p1, p2 = _words(texts[lo:hi])
                n = len(w.start)
                if n < length:
                    continue
                at = np.arange(n - half + 1)
                gram = C.span_hash(p1, at, at + half, C.WORD_BASE_1) | _U(1)
                pos = C.anchors(gram, w.row, half, length)
                row = w.row[pos]
                first, last = w.ptr[row], w.ptr[row + 1]
                left, right = np.maximum(pos + half - length, first), np.minimum(pos + length, last)
                c1, c2 = _window_hash(p1, p2, left, right)
                c1 = C.mix(c1 + (pos - left).astype(_U))  # the anchor's place in its neighbourhood takes part
                yield pa.RecordBatch.from_arrays(
                    [pa.array(C.signed(gram[pos])), pa.array(C.signed(c1)), pa.array(C.signed(c2)), pa.array(doc[lo + row]), pa.array(th[lo + row]), pa.array((pos - first).astype(np.int32))],
                    names=["gram", "c1", "c2", "doc_id", "th", "pos"],
                )

    return rows


def _window_rows(length: int):
    """Final-length windows around the given anchors of each text."""
    half = length // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = C.text_bytes(batch.column("text"))
            doc, th, marks = batch.column("doc_id").to_numpy(), batch.column("th").to_numpy(), batch.column("pos").to_pylist()
            for lo, hi in C.chunks(texts):
                w, p1, p2 = _words(texts[lo:hi])
                starts = []
                for i in range(lo, hi):
                    first, last = w.ptr[i - lo], w.ptr[i - lo + 1]
                    p = np.unique(np.asarray(marks[i], np.int64))[:, None] + np.arange(half - length, 1)[None, :]
                    p = np.unique(p[(p >= 0) & (p + length <= last - first)])
                    starts.append(p + first)
                at = np.concatenate(starts)
                row = w.row[at]
                h1, h2 = _window_hash(p1, p2, at, at + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(C.signed(h1)), pa.array(C.signed(h2)), pa.array(doc[lo + row]), pa.array(th[lo + row]), pa.array((at - w.ptr[row]).astype(np.int32))],
                    names=["h1", "h2", "doc_id", "th", "pos"],
                )

    return rows


def _strip(length: int):
    """Remove the marked words: ``whole`` holds anchors whose whole neighbourhood repeats, ``single`` window starts."""
    half = length // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = C.text_bytes(batch.column("text"))
            whole, single = batch.column("whole").to_pylist(), batch.column("single").to_pylist()
            n_words, n_removed, sha, kept_text = [], [], [], []
            for text, a, s in zip(texts, whole, single, strict=True):
                words = text.split()  # bytes.split() cuts at exactly 0x20 and 0x09-0x0D
                n = len(words)
                kept, removed = words, 0
                if a or s:
                    a, s = np.asarray(a or [], np.int64), np.asarray(s or [], np.int64)
                    step = np.zeros(n + 1, np.int32)
                    for at, to in ((np.maximum(a + half - length, 0), np.minimum(a + length, n)), (s, s + length)):
                        np.add.at(step, at, 1)
                        np.add.at(step, to, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    removed = int(gone.sum())
                    kept = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                out = b" ".join(kept)
                n_words.append(n)
                n_removed.append(removed)
                sha.append(hashlib.sha256(out).hexdigest())
                kept_text.append(out.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return rows


def substring_dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """Remove words covered by a ``length``-word window that also starts in a document of smaller ``doc_id``.

    Returns ``doc_id, n_words, n_removed, kept_sha256, kept_text`` (kept words
    joined by one space), one row per input row. ``length`` must be at least 2.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    rows = C.keyed(docs)
    known = rows.where(F.col("doc_id").isNotNull())
    seen = known.mapInArrow(C.task(_anchor_rows(length)), "gram long, c1 long, c2 long, doc_id long, th long, pos int")

    # level 1: half-length windows that stand in two documents
    repeated = seen.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("c1").alias("ca"), F.max("c1").alias("cb"))
    # aggregates are written before they are joined: both sides are then plain exchanges, which adaptive execution can split at a hot key
    repeated = C.written(repeated.where("lo < hi").select("gram", (F.col("ca") != F.col("cb")).alias("mixed")), "repeated")
    level1 = C.written(seen.join(repeated, "gram"), "halves")

    # level 2: neighbourhoods first, single windows where the neighbourhood is new
    classes = C.written(level1.groupBy("gram", "c1", "c2").agg(F.min("doc_id").alias("first")), "classes")
    judged = C.written(level1.join(classes, ["gram", "c1", "c2"]).select("doc_id", "th", "pos", "mixed", (F.col("first") < F.col("doc_id")).alias("old")).where("old or mixed"), "judged")
    keys = ["doc_id", "th"]
    fresh = judged.where("not old").groupBy(*keys).agg(F.collect_set("pos").alias("pos"))
    windows = known.join(fresh, keys).mapInArrow(C.task(_window_rows(length)), "h1 long, h2 long, doc_id long, th long, pos int")
    windows = C.written(windows, "windows")
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    first = C.written(first, "first")
    single = windows.join(first, ["h1", "h2"]).where("first < doc_id").select(*keys, F.lit(None).cast("int").alias("whole"), F.col("pos").alias("single"))
    whole = judged.where("old").select(*keys, F.col("pos").alias("whole"), F.lit(None).cast("int").alias("single"))
    marks = whole.unionByName(single).groupBy(*keys).agg(F.collect_set("whole").alias("whole"), F.collect_set("single").alias("single"))
    return rows.join(marks, keys, "left").select("doc_id", "text", "whole", "single").mapInArrow(C.task(
        _strip(length)), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
