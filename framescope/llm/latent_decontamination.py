"""Benchmark decontamination by latent semantic retrieval.

1. The vocabulary is that of the benchmark items: other words cannot make a
   passage more like an item. Document frequencies are counted over all
   documents. A word weighs ``sqrt(1 + idf)`` on either side, so that a product
   counts the (smoothed) inverse frequency once: every word weighs something,
   and one rare word that a copy lacks does not outweigh all it has.
2. Passages are runs of ``STRIDE`` words and joins of two neighbours (so every
   item-sized stretch lies mostly in one). A randomised SVD of their TF-IDF
   matrix is distributed: each pass multiplies every passage row with the
   current basis and sums ``A' A Q`` (vocabulary x rank) over tasks; the driver
   only orthonormalises. Items are rows of the matrix too, weighted ``PULL``
   times the corpus: without that the leading directions are those of frequent
   words, and what tells items apart is cut off.
3. An item of more than ``PIECE`` words is searched as even pieces of at most so
   many, since a passage is too short to be like the whole; a piece that is a
   candidate makes its item one. A passage and a piece with latent cosine of
   ``COSINE`` or more are a candidate; there is no other source of candidates.
4. A candidate counts if the words of the item have a longest common
   subsequence with the text around the passage of ``LCS`` of the item's
   length; of ``LCS_ANSWER``, when the item's answer words, its most telling
   third by inverse frequency, are there in the share ``ANSWER`` too; or of
   ``LCS_ALIKE``, with as many answer words, when the cosine is ``ALIKE`` or more
   (words in another order).

Pieces are taken in blocks of about ``ITEMS``, fewer than the rank, each with a basis of its
own; one scan of the documents serves ``BLOCKS`` blocks, whose bases, vocabulary and
pieces are what goes to the tasks. Passages are multiplied some ``SLAB`` runs at
a time as a dense matrix over the words they hold.

Defined cases: NULL or empty texts match nothing, nor do items without words.
Rows with NULL ``doc_id`` are searched like others and reported with NULL. Rows
of one ``doc_id`` and text (its hash ``th``) are reported once for each item. An
item with more pieces than a block stands in one of its own. Of a long text,
what is held at once are a number for each word and the products of ``SEGMENT`` runs.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm import common as C

# a block has fewer items than the rank, so that the basis can hold every item's direction
STRIDE, PIECE, RANK, OVERSAMPLE, POWERS, ITEMS, BLOCKS, SLAB, SEGMENT = 32, 64, 240, 16, 1, 200, 4, 64, 4096
PULL = 10.0
COSINE, LCS, LCS_ANSWER, ANSWER, ALIKE, LCS_ALIKE = 0.4, 0.8, 0.6, 0.7, 0.75, 0.5


class Vocabulary:
    """Words of the items (ASCII letters lower-cased) and their weights."""

    def __init__(self, items: list[bytes]):
        self.words = sorted({w for x in items for w in x.lower().split()})
        self._place = None
        self.idf = self.weight = np.ones(len(self.words))

    def weigh(self, df: np.ndarray) -> None:
        """Weights from document counts (the last is the number of documents)."""
        self.idf = np.log((1 + df[-1]) / (1 + df[:-1]))
        self.weight = np.sqrt(1 + self.idf)

    def places(self, text: bytes) -> np.ndarray:
        """Place of every word of the text, -1 for words of no item. ``bytes.split`` cuts at 0x20 and 0x09-0x0D."""
        if self._place is None:
            self._place = {w: i for i, w in enumerate(self.words)}
        out = []
        for part in C.pieces(text):
            own = part.lower().split()
            out.append(np.fromiter(map(self._place.get, own, repeat(-1)), np.int32, len(own)))
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def __getstate__(self):
        return {**self.__dict__, "_place": None}


class Runs:
    """Runs of ``STRIDE`` words of some texts: ``at`` place of every word, ``ptr`` words of each text, ``row`` text of each run, ``first`` run of each text."""

    def __init__(self, places: list[np.ndarray]):
        self.at = np.concatenate(places) if places else np.zeros(0, np.int32)
        n = np.array([len(x) for x in places], np.int64)
        self.ptr = np.append(0, np.cumsum(n))
        runs = -(-n // STRIDE)
        self.first = np.cumsum(runs) - runs
        self.row = np.repeat(np.arange(len(n)), runs)
        held = np.flatnonzero(self.at >= 0)
        text = np.searchsorted(self.ptr, held, side="right") - 1
        self.of, self.word = self.first[text] + (held - self.ptr[text]) // STRIDE, self.at[held]

    def counts(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of the runs ``lo .. hi`` and their counts (runs x words)."""
        cut = slice(*np.searchsorted(self.of, [lo, hi]))
        words, place = np.unique(self.word[cut], return_inverse=True)
        n = np.bincount((self.of[cut] - lo) * len(words) + place, minlength=(hi - lo) * len(words))
        return words, n.reshape(hi - lo, len(words)).astype(np.float32)


def _texts(batch: pa.RecordBatch, vocabulary: Vocabulary) -> Iterator[tuple[int, Runs]]:
    """Runs of a batch's texts, some at a time, with the first row."""
    texts = C.text_bytes(batch.column("text"))
    for lo, hi in C.chunks(texts):
        yield lo, Runs([vocabulary.places(t) for t in texts[lo:hi]])


def _pieces(items: list[bytes]) -> tuple[list[bytes], list[int]]:
    """Even runs of at most ``PIECE`` words of each item, and the item each belongs to."""
    out, owner = [], []
    for i, text in enumerate(items):
        words = text.lower().split()
        for at in np.array_split(np.arange(len(words)), max(1, -(-len(words) // PIECE))):
            out.append(b" ".join(words[k] for k in at))
            owner.append(i)
    return out, owner


class Block:
    """Some items: their pieces, their part of the vocabulary and, after the SVD, the basis."""

    def __init__(self, items: list[int], texts: list[bytes], vocabulary: Vocabulary):
        self.items = items
        pieces, owner = _pieces([texts[i] for i in items])
        self.owner = [items[i] for i in owner]
        self.pieces = Runs([vocabulary.places(x) for x in pieces])
        self.words = np.unique(self.pieces.at[self.pieces.at >= 0])
        self.local = np.full(len(vocabulary.words), -1, np.int32)
        self.local[self.words] = np.arange(len(self.words))
        self.weight = vocabulary.weight[self.words].astype(np.float32)
        self.basis: np.ndarray | None = None

    def rows(self, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts over the block's own words: their places, weighted rows and squared norms."""
        at = self.local[words]
        own = np.flatnonzero(at >= 0)
        x = (n if len(own) == len(words) else n[:, own]) * self.weight[at[own]]
        return at[own], x, (x * x).sum(1)

    def gram(self, runs: Runs, q: np.ndarray, out: np.ndarray) -> None:
        """Add ``A' A Q`` of the runs, each scaled to length 1."""
        for lo in range(0, len(runs.row), SLAB):
            at, x, norm2 = self.rows(*runs.counts(lo, min(lo + SLAB, len(runs.row))))
            if len(at):
                x /= np.sqrt(np.maximum(norm2, 1e-12))[:, None]
                out[at] += x.T @ (x @ q[at])

    def finish(self, q: np.ndarray) -> None:
        """Take the basis: pieces in latent space, scaled by their norms, and what each word adds to every product."""
        self.basis = q.astype(np.float32)
        z = []
        for lo in range(len(self.pieces.ptr) - 1):
            own = self.pieces.at[self.pieces.ptr[lo] : self.pieces.ptr[lo + 1]]
            x = np.bincount(self.local[own[own >= 0]], minlength=len(self.words)) * self.weight
            z.append((x / max(np.sqrt((x * x).sum()), 1e-12)) @ self.basis)
        self.latent = np.array(z, np.float32).reshape(len(z), q.shape[1])

    def candidates(self, runs: Runs, cosine: float) -> Iterator[tuple[int, int, int, float]]:
        """``run, span, piece, cosine`` of every passage near enough to a piece."""
        n = len(runs.row)
        for start in range(0, n, SEGMENT):
            stop = min(start + SEGMENT, n)
            for lo in range(start, stop, SLAB):
                hi = min(lo + SLAB, stop)
                end = min(hi + 1, n)  # the next run too, for the join with it
                at, x, norm2 = self.rows(*runs.counts(lo, end))
                if not len(at):
                    continue
                z = x @ self.basis[at]
                yield from self._near(z[: hi - lo], norm2[: hi - lo], lo, 1, np.arange(hi - lo), cosine)
                two = np.flatnonzero(runs.row[lo : end - 1] == runs.row[lo + 1 : end])
                both = norm2[two] + norm2[two + 1] + 2 * (x[two] * x[two + 1]).sum(1)
                yield from self._near(z[two] + z[two + 1], both, lo, 2, two, cosine)

    def _near(self, z, norm2, lo, span, at, cosine):
        cos = (z @ self.latent.T) / np.sqrt(np.maximum(norm2, 1e-12))[:, None]
        for p, i in zip(*np.nonzero(cos >= cosine), strict=True):
            yield lo + int(at[p]), span, int(i), float(cos[p, i])


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    bits: dict[int, int] = {}
    for i, x in enumerate(a):
        bits[x] = bits.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & bits.get(x, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def _frequencies(vocabulary: Vocabulary):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary.words)
        df = np.zeros(size + 1, np.int64)
        for batch in batches:
            df[-1] += batch.num_rows
            for _, runs in _texts(batch, vocabulary):
                text = runs.row[runs.of].astype(np.int64)
                df[:-1] += np.bincount(np.unique(text * size + runs.word) % size, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], names=["at", "n"])

    return rows


def _products(vocabulary: Vocabulary, blocks: list[Block], qs: list[np.ndarray]):
    """A task's part of ``A' A Q`` of every block over its passages."""
    qs = [q.astype(np.float32) for q in qs]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [np.zeros(q.shape, np.float32) for q in qs]
        for batch in batches:
            for _, runs in _texts(batch, vocabulary):
                for block, q, own in zip(blocks, qs, out, strict=True):
                    block.gram(runs, q, own)
        for i, own in enumerate(out):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int32)), pa.array(np.arange(len(own))), pa.array([r.tobytes() for r in own])], names=["block", "at", "x"])

    return rows


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and place: sum the vectors of each."""

    def out(key, total):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([total.tobytes()])], names=["block", "at", "x"])

    now, total = None, None
    for batch in batches:
        for block, at, x in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "x")), strict=True):
            v = np.frombuffer(x, np.float32).astype(np.float64)
            if (block, at) == now:
                total = total + v
            else:
                if now is not None:
                    yield out(now, total)
                now, total = (block, at), v
    if now is not None:
        yield out(now, total)


def randomised_svd(rows: DataFrame, vocabulary: Vocabulary, blocks: list[Block], rank: int = RANK, powers: int = POWERS, seed: int = 7) -> None:
    """Give every block an orthonormal basis (its words x rank) of the leading right singular space of the passages' TF-IDF matrix."""
    rng = np.random.default_rng(seed)
    qs = [np.linalg.qr(rng.standard_normal((len(b.words), min(len(b.words), rank + OVERSAMPLE))))[0] for b in blocks]
    summed = "block int, at long, x binary"
    for _ in range(powers):
        parts = rows.select("text").mapInArrow(C.task(_products(vocabulary, blocks, qs)), summed)
        parts = parts.repartition("block", "at").sortWithinPartitions("block", "at").mapInArrow(C.task(_summed), summed)
        corpus = [np.zeros(q.shape) for q in qs]
        for r in parts.collect():  # words x rank numbers a block
            corpus[r["block"]][r["at"]] = np.frombuffer(r["x"])
        for i, (block, q) in enumerate(zip(blocks, qs, strict=True)):
            own = np.zeros(q.shape, np.float32)
            block.gram(block.pieces, q.astype(np.float32), own)
            total = corpus[i] + own * PULL * max(1.0, np.linalg.norm(corpus[i]) / max(np.linalg.norm(own), 1e-300))
            qs[i] = np.linalg.svd(total, full_matrices=False)[0]
    for block, q in zip(blocks, qs, strict=True):
        block.finish(q[:, :rank])


class Judge:
    """Step 4 for every item: subsequence and answer words against the text around a passage."""

    def __init__(self, vocabulary: Vocabulary, items: list[bytes]):
        self.words = [vocabulary.places(x).tolist() for x in items]
        self.telling = [set(sorted(set(x), key=lambda t: (-vocabulary.idf[t], t))[: max(1, len(set(x)) // 3)]) for x in self.words]
        # how many of the distinct words may be missing at all
        self.least = [len(set(x)) - (1 - LCS_ALIKE) * len(x) - 1e-9 for x in self.words]

    def near(self, item: int, around: list[int], cosine: float) -> tuple[float, float, float] | None:
        own = self.words[item]
        held = set(around)
        if len(held.intersection(own)) < self.least[item]:
            return None
        return lcs(own, around) / len(own), len(self.telling[item] & held) / max(1, len(self.telling[item])), cosine

    @staticmethod
    def holds(found: tuple[float, float, float]) -> bool:
        share, answer, cosine = found
        return share >= LCS or (answer >= ANSWER and (share >= LCS_ANSWER or (share >= LCS_ALIKE and cosine >= ALIKE)))


def _search(vocabulary: Vocabulary, blocks: list[Block], judge: Judge, item_ids: list[int], cosine: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
            found: dict[tuple[int, int], tuple] = {}
            for lo, runs in _texts(batch, vocabulary):
                pairs: dict[tuple[int, int], list] = {}
                for block in blocks:
                    for run, span, piece, cos in block.candidates(runs, cosine):
                        pairs.setdefault((int(runs.row[run]), block.owner[piece]), []).append((cos, run, span))
                for (r, i), places in pairs.items():
                    room = max(STRIDE, len(judge.words[i]))
                    tried = set()
                    for cos, run, span in sorted(places, reverse=True):
                        a = runs.ptr[r] + (run - runs.first[r]) * STRIDE
                        bounds = max(runs.ptr[r], a - room), min(runs.ptr[r + 1], a + span * STRIDE + room)
                        if bounds in tried:
                            continue
                        tried.add(bounds)
                        got = judge.near(i, runs.at[bounds[0] : bounds[1]].tolist(), cos)
                        if got and judge.holds(got):
                            best = found.get((lo + r, i), (0.0, 0.0, 0.0))
                            found[(lo + r, i)] = max(best, got)
                            if got[0] >= LCS:
                                break
            if found:
                keys = list(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[r] for r, _ in keys], pa.int64()) for x in (doc, th)]
                    + [pa.array([item_ids[i] for _, i in keys], pa.int64())]
                    + [pa.array([found[x][j] for x in keys]) for j in range(3)],
                    names=["doc_id", "th", "item_id", "lcs", "answer", "cosine"],
                )

    return rows


def latent_decontamination(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = COSINE, items_per_block: int = ITEMS) -> DataFrame:
    """``doc_id, th, item_id, lcs, answer, cosine`` for every document that holds a benchmark item, exactly or as a paraphrase."""
    spark = docs.sparkSession
    rows = C.keyed(docs)
    wanted = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    count = wanted.agg(F.sum(F.greatest(F.ceil(words / PIECE), F.lit(1)))).first()[0] or 0
    scans = max(1, -(-count // (items_per_block * BLOCKS)))
    found = "doc_id long, th long, item_id long, lcs double, answer double, cosine double"
    out = spark.createDataFrame([], found)
    for k in range(scans):
        part = wanted if scans == 1 else wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(scans)) == k)
        items = sorted((r["item_id"], r["text"]) for r in part.collect())  # one scan's items
        texts = [t.encode() for _, t in items]
        items, texts = zip(*((i, t) for (i, _), t in zip(items, texts, strict=True) if t.split()), strict=True) if any(t.split() for t in texts) else ((), ())
        if not texts:
            continue
        vocabulary = Vocabulary(list(texts))
        df = np.zeros(len(vocabulary.words) + 1, np.int64)
        for r in rows.select("text").mapInArrow(C.task(_frequencies(vocabulary)), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # the scan's words
            df[r["at"]] = r["n"]
        vocabulary.weigh(df)
        blocks, own, size = [], [], 0
        for i, text in enumerate(texts):
            n = -(-len(text.split()) // PIECE)
            if own and size + n > items_per_block:
                blocks.append(Block(own, texts, vocabulary))
                own, size = [], 0
            own, size = [*own, i], size + n
        blocks.append(Block(own, texts, vocabulary))
        randomised_svd(rows, vocabulary, blocks, rank)
        search = _search(vocabulary, blocks, Judge(vocabulary, list(texts)), list(items), cosine)
        out = out.unionByName(rows.select("doc_id", "th", "text").mapInArrow(C.task(search), found))
    return out.groupBy("doc_id", "th", "item_id").agg(F.max("lcs").alias("lcs"), F.max("answer").alias("answer"), F.max("cosine").alias("cosine"))
