"""Ranked lexical search by best-first document intervals over range-maximum tables.

1. One scan turns each document into counts of the items' terms; runs of
   documents of about ``block_postings`` postings are stored as one row, a block.
   Document frequencies, lengths and the number of documents are summed from the
   blocks, with one partial row a task.
2. In a block the documents are numbered by id and every term has a posting list
   (document, integer impact). One sparse table over the concatenated lists
   answers range-maximum queries for any stretch of any list in two look-ups.
3. For an item, the interval of all documents is bounded by the sum of its terms'
   maxima. The intervals of greatest bound are taken first (``BATCH`` at a time);
   each is split at the document of its greatest impact, that document is scored
   in full, and the two halves are bounded by their own range maxima. An interval
   that cannot beat the k-th best score so far (at equal score: the k-th best id)
   is dropped, and the search ends when none is left. The k best carry over from
   block to block of a task; ``seeds`` blocks are searched ahead of the others to
   give every task a first k-th score. Both only ever drop what cannot enter.

A task returns k rows an item; a ranked window merges them. Items are taken in
groups of at most ``group_terms`` (item, term) pairs, so what goes to every task
is bounded; each group is one search over the blocks of one scan.

Defined cases: a document with NULL or no text has no terms, is not counted and
never found; an item without terms has no rows. Documents repeated in the table
count and are found each; NULL ids come last among equal scores. The rows of one
``item_id`` are one item with all their terms, NULL being an id like others.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescope.llm import common as C

BLOCK_POSTINGS, GROUP_TERMS, SEEDS, BATCH, PIECE = 1 << 20, 2_000_000, 4, 32, 1 << 22
_BLOCK = "block long, documents long, length long, ids binary, known binary, lengths binary, postings binary, terms binary, counts binary"
_FOUND = "item int, doc_id long, score long"
#: term bytes stay (A-Z lower-cased), every other byte becomes a space
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and _TERM[text[end]] != 32:
            end += 1
        yield text[start:end].translate(_TERM).split()
        start = end


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), C.text_bytes(batch.column("text")), strict=True):
            for some in terms(text):
                own = list(set(some))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array(own, pa.binary())], names=["item_id", "term"])


def _scanned(vocabulary: list[bytes], block_postings: int):
    """Blocks of documents with the counts of the vocabulary's terms."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        place = {t: i for i, t in enumerate(vocabulary)}.get
        held: list[tuple] = []
        size = documents = length = 0

        def block():
            nonlocal number, size, documents, length
            ids = np.array([x[0] if x[0] is not None else 0 for x in held], np.int64)
            known = np.array([x[0] is not None for x in held], np.uint8)
            blobs = [ids, known, np.array([x[1] for x in held], np.int64), np.array([len(x[2]) for x in held], np.int64)]
            blobs += [np.concatenate([x[i] for x in held]) if held else np.zeros(0, np.int32) for i in (2, 3)]
            out = pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([documents]), pa.array([length]), *(pa.array([b.tobytes()]) for b in blobs)],
                names=["block", "documents", "length", "ids", "known", "lengths", "postings", "terms", "counts"],
            )
            number += 1
            held.clear()
            size = documents = length = 0
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), C.text_bytes(batch.column("text")), strict=True):
                n, count = 0, Counter()
                for some in terms(text):
                    n += len(some)
                    count.update(map(place, some))
                if not n:
                    continue
                count.pop(None, None)
                documents, length = documents + 1, length + n
                if count:
                    held.append((doc, n, np.fromiter(count.keys(), np.int32, len(count)), np.fromiter(count.values(), np.int64, len(count))))
                    size += len(count)
                if size >= block_postings:
                    yield block()
        if documents:
            yield block()

    return rows


def _frequencies(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for blob in batch.column("terms").to_pylist():
                df += np.bincount(np.frombuffer(blob, np.int32), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    return rows


def impacts(weight: np.ndarray, count: np.ndarray, length: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Integer impact of postings: term weight, occurrences and terms of the document."""
    m = 10 + 90 * length * documents // total
    return weight * (1_000_000_000 * count // (1000 * count + 8 * m))


class RangeMaximum:
    """Sparse table over concatenated posting lists: place of the (first) greatest value of any stretch."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        self.table = [np.arange(len(values), dtype=np.int32)]
        while 2 << (len(self.table) - 1) <= longest:
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            a, b = last[:-step], last[step:]
            self.table.append(np.where(values[b] > values[a], b, a))
        # one array, so that look-ups of different levels are one gather
        self.starts = np.cumsum([0] + [len(t) for t in self.table])
        self.table = np.concatenate(self.table)
        self.level = np.zeros(longest + 2, np.int64)
        for i in range(2, longest + 2):
            self.level[i] = self.level[i >> 1] + 1

    def places(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of the maximum of ``lo <= place < hi``; only meaningful where ``lo < hi``."""
        level = self.level[np.maximum(hi - lo, 1)]
        base = self.starts[level]
        a = self.table[np.minimum(base + lo, len(self.table) - 1)]
        b = self.table[np.minimum(base + np.maximum(hi - (1 << level), 0), len(self.table) - 1)]
        return np.where(self.values[b] > self.values[a], b, a)


class Postings:
    """A block: documents numbered by id, lists by term, and their range maxima."""

    def __init__(self, row: dict, weight: np.ndarray, documents: int, total: int):
        ids, known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8).astype(bool)
        own = np.repeat(np.arange(len(ids)), np.frombuffer(row["postings"], np.int64))
        term, count = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["counts"], np.int64)
        by_id = np.lexsort((ids, ~known))
        number = np.empty(len(ids), np.int64)
        number[by_id] = np.arange(len(ids))
        self.ids, self.known, self.size = ids[by_id], known[by_id], len(ids)
        impact = impacts(weight[term], count, np.frombuffer(row["lengths"], np.int64)[own], documents, total)
        key = term.astype(np.int64) * self.size + number[own]
        by = np.argsort(key)
        self.key, self.impact, self.doc = key[by], impact[by], number[own][by]
        edges = np.searchsorted(self.key, np.arange(len(weight) + 1) * self.size)
        self.start, self.end = edges[:-1], edges[1:]
        self.maximum = RangeMaximum(self.impact, int((self.end - self.start).max(initial=1)))

    def _bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the range maxima of every row of stretches, and the document of the greatest of them."""
        at = self.maximum.places(lo, hi)
        some = lo < hi
        at = np.where(some, at, 0)
        value = np.where(some, self.impact[at], 0)
        best = value.argmax(1)
        return value.sum(1), self.doc[at[np.arange(len(at)), best]]

    def search(self, own_terms: np.ndarray, k: int, best: list[tuple]) -> tuple[list[tuple], int]:
        """The k best ``(-score, unknown id, id)`` among ``best`` and this block's documents, and how many were scored."""
        t = own_terms[self.start[own_terms] < self.end[own_terms]]
        scored = 0
        if not len(t):
            return best, scored
        lo, hi = self.start[t][None], self.end[t][None]
        bound, split = self._bounds(lo, hi)
        first = np.zeros(1, np.int64)  # least document of the interval
        while len(bound):
            if len(best) == k:
                bar, unknown, last = -best[-1][0], best[-1][1], best[-1][2]
                # at equal score only a smaller id enters; documents are numbered by id, unknown ids last
                may = bound == bar
                if may.any():
                    may &= (self.known[first] & ((self.ids[first] < last) | bool(unknown))) if len(first) else may
                go = (bound > bar) | may
                bound, split, first, lo, hi = bound[go], split[go], first[go], lo[go], hi[go]
                if not len(bound):
                    break
            take = np.argpartition(-bound, BATCH)[:BATCH] if len(bound) > BATCH else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[take] = False
            a, z, doc = lo[take], hi[take], split[take]
            at = np.searchsorted(self.key, t[None] * self.size + doc[:, None])
            at = np.minimum(np.maximum(at, a), z)
            held = (at < z) & (self.doc[np.minimum(at, len(self.doc) - 1)] == doc[:, None])
            score = np.where(held, self.impact[np.minimum(at, len(self.doc) - 1)], 0).sum(1)
            scored += len(doc)
            new = [(-s, not self.known[d], int(self.ids[d])) for s, d in zip(score.tolist(), doc.tolist(), strict=True) if s > 0 and (len(best) < k or s >= -best[-1][0])]
            if new:
                best = sorted([*best, *new])[:k]
            lo2, hi2 = np.concatenate([a, at + held]), np.concatenate([at, z])
            bound2, split2 = self._bounds(lo2, hi2)
            first2 = np.concatenate([first[take], np.minimum(doc + 1, self.size - 1)])
            ok = bound2 > 0
            bound, split, first = (np.concatenate([x[rest], y[ok]]) for x, y in ((bound, bound2), (split, split2), (first, first2)))
            lo, hi = (np.concatenate([x[rest], y[ok]]) for x, y in ((lo, lo2), (hi, hi2)))
        return best, scored


def _searched(items: list[np.ndarray], weight: np.ndarray, documents: int, total: int, k: int, bars: dict[int, tuple]):
    """k rows an item, of all blocks of the task; ``bars`` holds k-th best rows known before."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a bar stands k times, so that only better rows replace it; what is left of it is not returned
        best = {i: [bars[i]] * k if i in bars else [] for i in range(len(items))}
        for batch in batches:
            for row in batch.to_pylist():
                block = Postings(row, weight, documents, total)
                for i, own in enumerate(items):
                    best[i] = block.search(own, k, best[i])[0]
        out = [(i, None if x[1] else x[2], -x[0]) for i, found in best.items() for x in found if x is not bars.get(i)]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    return rows


def interval_ranking(docs: DataFrame, items: DataFrame, k: int = 10, block_postings: int = BLOCK_POSTINGS, group_terms: int = GROUP_TERMS, seeds: int = SEEDS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents ``(doc_id, text)`` of greatest score for each item ``(item_id, text)``."""
    spark = docs.sparkSession
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    wanted = C.written(texts.mapInArrow(C.task(_item_terms), "item_id long, term binary").distinct(), "rank-items")
    groups = max(1, -(-wanted.count() // group_terms))
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for g in range(groups):
        own: dict = {}
        for r in wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect():  # about group_terms rows
            own.setdefault(r["item_id"], []).append(bytes(r["term"]))
        vocabulary = sorted({t for x in own.values() for t in x})
        if vocabulary:
            out = out.unionByName(_ranked(docs, own, vocabulary, k, block_postings, seeds))
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", nth).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _ranked(docs: DataFrame, own: dict, vocabulary: list[bytes], k: int, block_postings: int, seeds: int) -> DataFrame:
    """``item_id, doc_id, score`` of one group of items: at least its k best rows each."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    index = C.written(rows.mapInArrow(C.task(_scanned(vocabulary, block_postings)), _BLOCK), "rank-blocks")
    documents, total = index.agg(F.sum("documents"), F.sum("length")).first()
    if not documents:
        return spark.createDataFrame([], "item_id long, doc_id long, score long")
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select("terms").mapInArrow(C.task(_frequencies(len(vocabulary))), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the group's terms
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    place = {t: i for i, t in enumerate(vocabulary)}
    ids = list(own)
    lists = [np.array(sorted(place[t] for t in own[i]), np.int64) for i in ids]
    # any k rows give a lower bound of the k-th score: those of the first few blocks, k rows an item
    ahead = [r["block"] for r in index.select("block").orderBy("block").limit(seeds).collect()]
    early = F.col("block").isin(ahead)
    first = index.where(early).repartition(max(1, len(ahead)), "block").mapInArrow(C.task(_searched(lists, weight, documents, total, k, {})), _FOUND)
    first = C.written(first, "rank-first")
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    bars = {r["item"]: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in first.withColumn("nth", nth).where(F.col("nth") == k).collect()}  # one row an item
    others = index.where(~early).mapInArrow(C.task(_searched(lists, weight, documents, total, k, bars)), _FOUND)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "item int, item_id long")
    return first.unionByName(others).join(names, "item").select("item_id", "doc_id", "score")
