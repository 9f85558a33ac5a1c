"""N-gram Jaccard join by T-occurrence search.

A document's set are its distinct lower-cased word 5-grams. Documents link when
``100 * |A & B| >= 80 * |A | B|``; the result is the links' components.

1. One scan gives each document's set size and 128-bit signature (equal sets are
   one from here on) and, as a mergeable summary of fixed size per task, the
   frequent grams ("long lists"): every gram above a share of 1 / ``LONG``. At
   most ``LONG`` go to the executors; which lists are long moves work, never results.
2. A linked document finds T = ceil(0.8 n) of its n grams in another. So one
   with more than n - T grams that stand nowhere else is out. Grams whose hash
   falls in one part of ``PARTS`` are counted over all documents, which already
   rules out most; the others go on with all their grams. (A fixed-size bit
   table keeps most of the rest out of the exchange; a join decides.)
3. Lists of the others' grams are streamed in sort order; a document keeps its
   lists of two or more. With those standing alone first, then by rising list
   length, two linked documents share one of each one's first n - T + 1 grams.
   Only these are dealt out, and every list links its documents to one of them,
   never pair by pair; components of these candidate links bound the true ones.
4. Inside, DivideSkip: an index over a bounded block; for each document the L
   longest lists are set aside, the others merged, documents with T - L
   occurrences kept, and their occurrences in the long lists added by binary
   search. The overlap is exact, and so is the test.
5. A candidate component beyond one block is split. All its documents are
   searched against a few leaders first; documents in the leaders' component
   need no test among each other, so only the others are searched, block by
   block, against all blocks. No pair of different components goes untested.

Defined cases: no words, empty or NULL text: an empty set, linked with nothing.
Rows of one ``doc_id`` are one document (linked by any of their texts). Rows
with NULL ``doc_id`` take no part and have NULL component. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm import common as C

_U = np.uint64
LONG = 1 << 16
PARTS = 4
TABLE_BITS = 24
#: a list is taken as this long when it is longer, so that one run of the stream fits in memory
MOST_IN_RUN = 1 << 20
BLOCK_GRAMS = 1 << 19
LEADERS = 32
#: DivideSkip's weight of a probe against a merge step
MU = 0.0085


def gram_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct gram hashes of each text and their offsets; fewer words than ``size`` make one gram."""
    w = C.Words(texts, lower=True)
    prefix = C.prefix_sums(w.hash, C.WORD_BASE_1)
    at = w.windows(size)
    owner, value = w.row[at], C.span_hash(prefix, at, at + size, C.WORD_BASE_1)
    words = np.diff(w.ptr)
    few = np.flatnonzero((words > 0) & (words < size))
    owner = np.concatenate([owner, few])
    value = np.concatenate([value, C.span_hash(prefix, w.ptr[few], w.ptr[few + 1], C.WORD_BASE_1)])
    by = np.argsort(value)
    by = by[np.argsort(owner[by].astype(np.uint16 if len(texts) <= 1 << 16 else np.int64), kind="stable")]
    owner, value = owner[by], value[by]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


_SETS = "doc_id long, th long, n long, s1 long, s2 long, gram long, times long"


def _describe(size: int, keep: int):
    """A row per document: set size and signature; and a task's Misra-Gries summary (``gram``, ``times``).

    The summary holds at most ``keep`` grams; what it drops occurs below a share of 1 / ``keep``.
    """

    def shrink(parts):
        key, slot = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        count = np.bincount(slot, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
        if len(key) > keep:
            bar = np.partition(count, len(count) - keep - 1)[len(count) - keep - 1]
            key, count = key[count > bar], count[count > bar] - bar
        return key, count

    names = [c.split()[0] for c in _SETS.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, pending = [], 0
        for batch in batches:
            texts = C.text_bytes(batch.column("text"))
            for lo, hi in C.chunks(texts):
                value, off = gram_sets(texts[lo:hi], size)
                parts.append((value, np.ones(len(value), np.int64)))
                pending += len(value)
                if pending > 1 << 20:
                    parts, pending = [shrink(parts)], 0
                s1, s2 = C.prefix_sums(value, C.WORD_BASE_1), C.prefix_sums(C.mix(value), C.WORD_BASE_2)
                s1, s2 = C.span_hash(s1, off[:-1], off[1:], C.WORD_BASE_1), C.span_hash(s2, off[:-1], off[1:], C.WORD_BASE_2)
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "th")), pa.array(np.diff(off)), pa.array(C.signed(s1)), pa.array(C.signed(s2)), none, none], names=names)
        if parts:
            key, count = shrink(parts)
            key, count = key[count > 1], count[count > 1]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(key), pa.int64())] * 5, pa.array(C.signed(key)), pa.array(count)], names=names)

    return rows


def _postings(size: int, parts: int = 1, long: np.ndarray | None = None):
    """``(doc_id, gram, rank)`` of every gram (of one part of them); ``rank`` is 0, or a long list's place from the shortest on."""
    by = np.argsort(long) if long is not None else None
    sorted_long = long[by] if long is not None else np.zeros(0, _U)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = C.text_bytes(batch.column("text"))
            doc = batch.column("doc_id").to_numpy()
            for lo, hi in C.chunks(texts):
                value, off = gram_sets(texts[lo:hi], size)
                owner = np.repeat(doc[lo:hi], np.diff(off))
                if parts > 1:
                    part = (value >> _U(40)) % _U(parts) == 0
                    value, owner = value[part], owner[part]
                rank = np.zeros(len(value), np.int64)
                if len(sorted_long) and len(value):
                    at = np.minimum(np.searchsorted(sorted_long, value), len(sorted_long) - 1)
                    hit = sorted_long[at] == value
                    rank[hit] = len(sorted_long) - by[at[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(C.signed(value)), pa.array(rank)], names=["doc_id", "gram", "rank"])

    return rows


def _passed(table: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("th").to_numpy().view(_U) & _U((1 << TABLE_BITS) - 1)
            yield batch.filter(pa.array((table[at >> _U(6)] >> (at & _U(63))) & _U(1) == 1))

    return rows


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram: each row of a list of two or more, with the list's length (``MOST_IN_RUN`` for longer ones)."""
    held: list[np.ndarray] = []
    size, now, flushed = 0, None, False

    def out(gram, doc, length):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(gram), pa.array(length)], names=["doc_id", "gram", "length"])

    def close():
        if now is not None and size and (flushed or size > 1):
            doc = np.concatenate(held)
            yield out(np.full(len(doc), now, np.int64), doc, np.full(len(doc), MOST_IN_RUN if flushed else size, np.int64))

    for batch in batches:
        gram, doc = batch.column("gram").to_numpy(), batch.column("doc_id").to_numpy()
        if not len(gram):
            continue
        at = np.append(np.flatnonzero(np.append(True, gram[1:] != gram[:-1])), len(gram))
        if gram[0] == now:  # the list goes on from the batch before
            held.append(doc[: at[1]])
            size += int(at[1])
            if size >= MOST_IN_RUN:
                flushed = True
                yield from close()
                held, size = [], 0
            at = at[1:]
            if len(at) == 1:
                continue
        yield from close()
        last = at[-2]  # the last list may go on
        n = np.diff(at[:-1])
        n_row = np.repeat(n, n)
        keep = n_row > 1
        if keep.any():
            body = slice(at[0], last)
            yield out(gram[body][keep], doc[body][keep], np.minimum(n_row[keep], MOST_IN_RUN))
        held, size, now, flushed = [doc[last:]], len(doc) - int(last), gram[last], False
    yield from close()


def least_overlap(n: np.ndarray | int, percent: int):
    """Grams of a set of ``n`` that any partner must share: ``ceil(percent / 100 * n)``."""
    return -(-n * percent // 100)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram: link each document of a list to the list's first."""
    gram_now = first = None
    for batch in batches:
        gram, doc = batch.column("gram").to_numpy(), batch.column("doc_id").to_numpy()
        if not len(gram):
            continue
        start = np.ones(len(gram), bool)
        start[1:] = gram[1:] != gram[:-1]
        start[0] = gram_now is None or gram[0] != gram_now
        head = np.where(start, np.arange(len(gram)), -1)
        head = np.maximum.accumulate(head)
        center = np.where(head >= 0, doc[np.maximum(head, 0)], 0 if first is None else first)
        gram_now, first = gram[-1], center[-1]
        a, b = doc[center != doc], center[center != doc]
        if len(a):
            pair = np.unique(np.stack([a, b], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


def _full_sets(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = C.text_bytes(batch.column("text"))
            for lo, hi in C.chunks(texts):
                value, off = gram_sets(texts[lo:hi], size)
                sets = [value[off[i] : off[i + 1]].tobytes() for i in range(hi - lo)]
                rest = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "component", "blocks")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(sets, pa.binary())], names=["doc_id", "component", "blocks", "grams"])

    return rows


def divide_skip(sets: list[np.ndarray], asks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, each link with at least one asking set (``asks``).

    Where all sets ask, those whose component already holds the most central
    one are passed over: pairs within that component cannot change the result.
    """
    n = np.array([len(s) for s in sets], np.int64)
    if len(sets) < 2:
        return []
    owner = np.repeat(np.arange(len(sets)), n)
    _, slot = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(slot, kind="stable")
    lists, length = owner[by], np.bincount(slot)  # documents of each list, ascending
    start = np.cumsum(length) - length
    off = np.append(0, np.cumsum(n))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    weight = np.bincount(owner, weights=length[slot], minlength=len(sets)) / np.maximum(n, 1)
    core = int(np.argmax(weight))
    every = bool(asks.all())  # else a set that does not ask may need the one that is passed over
    order = [core, *(i for i in range(len(sets)) if i != core)] if every else np.flatnonzero(asks).tolist()
    found = []
    for q in order:
        if not n[q] or (every and q != core and find(q) == find(core)):
            continue
        own = slot[off[q] : off[q + 1]]
        own = own[length[own] > 1]
        need = int(least_overlap(int(n[q]), percent))
        if len(own) < need:
            continue
        own = own[np.argsort(length[own], kind="stable")]
        n_long = min(need - 1, int(need / (MU * np.log2(max(2, length[own[-1]])) + 1)), len(own))
        short, long = own[: len(own) - n_long], own[len(own) - n_long :]
        sizes = length[short]
        at = np.arange(int(sizes.sum())) + np.repeat(start[short] - (np.cumsum(sizes) - sizes), sizes)
        seen = np.bincount(lists[at], minlength=0)  # the merge: occurrences in short lists
        cand = np.flatnonzero(seen >= need - n_long)
        cand = cand[(cand != q) & (100 * n[cand] >= percent * n[q]) & (100 * n[q] >= percent * n[cand])]
        mine = find(q)
        cand = np.array([c for c in cand.tolist() if find(c) != mine], np.int64)
        if not len(cand):
            continue
        overlap = seen[cand]
        for k, x in enumerate(long.tolist()):  # binary probes, dropping what can no longer reach it
            own_list = lists[start[x] : start[x] + length[x]]
            hit = np.minimum(np.searchsorted(own_list, cand), len(own_list) - 1)
            overlap = overlap + (own_list[hit] == cand)
            if not k % 32:
                alive = overlap + (len(long) - k - 1) >= need
                cand, overlap = cand[alive], overlap[alive]
                if not len(cand):
                    break
        for c in cand[100 * overlap >= percent * (n[q] + n[cand] - overlap)].tolist():
            if find(c) != find(q):
                root[find(c)] = find(q)
                found.append((q, c))
    return found


def _linked(percent: int, block_grams: int):
    """Links inside each ``unit``; rows come sorted by unit, several small units share an index block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        unit_rows: list[tuple] = []
        size, now = 0, None

        def done():
            found = divide_skip([np.frombuffer(g, _U) for _, _, g in block], np.array([a for _, a, _ in block], bool), percent)
            ids = [d for d, _, _ in block]
            block.clear()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for comp, u, v, *row in zip(*(batch.column(c).to_pylist() for c in ("component", "u", "v", "doc_id", "asks", "grams")), strict=True):
                if (comp, u, v) != now:
                    block += unit_rows
                    size += sum(len(g) // 8 for _, _, g in unit_rows)
                    unit_rows, now = [], (comp, u, v)
                    if size > block_grams // 8:
                        yield from done()
                        size = 0
                unit_rows.append(tuple(row))
        block += unit_rows
        if block:
            yield from done()

    return rows


def _search(units: DataFrame, percent: int, block_grams: int) -> DataFrame:
    dealt = units.select("component", "u", "v", "doc_id", "asks", "grams").repartition("component", "u", "v").sortWithinPartitions("component", "u", "v")
    return dealt.mapInArrow(C.task(_linked(percent, block_grams)), "a long, b long")


def _wide_links(full: DataFrame, percent: int, block_grams: int) -> DataFrame:
    """Links of the candidate components beyond one block: leaders first, then those outside the leaders' component."""
    zero = F.lit(0)
    wide = full.where("blocks > 1").withColumn("v", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    by_hash = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("doc_id"))
    heads = wide.groupBy("component", "v").agg(F.min(by_hash).alias("h")).groupBy("component").agg(F.slice(F.array_sort(F.collect_list("h")), 1, LEADERS).alias("h"))
    heads = heads.select("component", F.explode("h.doc_id").alias("doc_id"))  # one candidate of each block, LEADERS at most
    leaders = C.written(wide.join(heads, ["component", "doc_id"], "left_semi"), "leaders")
    own = wide.join(heads, ["component", "doc_id"], "left_anti").withColumn("asks", F.lit(False))
    copies = leaders.withColumn("v", F.explode(F.sequence(zero, F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    cols = ["component", "u", "v", "doc_id", "asks", "grams"]
    first = own.withColumn("u", zero).select(*cols).unionByName(copies.withColumn("u", zero).select(*cols))
    led = C.written(_search(first, percent, block_grams), "led")
    # the greatest component around the leaders is settled; the others ask
    around = C.components(led, "around")
    most = around.join(wide.select("component", F.col("doc_id").alias("node")).distinct(), "node", "inner").select(F.col("node").alias("doc_id"), around["component"].alias("core"), wide["component"])
    most = C.written(most, "most")
    chosen = most.groupBy("component", "core").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("core", F.struct("n", "core")).alias("core"))
    settled = most.join(chosen, ["component", "core"], "left_semi").select("doc_id")
    rest = C.written(wide.join(settled, "doc_id", "left_anti").select("doc_id", "component", "grams"), "rest")
    per = rest.groupBy("component").agg(F.ceil(F.sum(F.length("grams") / 8) / block_grams).cast("int").alias("asking"))
    per = C.written(per, "asking")
    asking = rest.join(per, "component").withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("asking")).cast("int"))
    asking = asking.join(C.written(wide.select("component", "blocks").distinct(), "wide"), "component").withColumn("v", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    asked = wide.join(rest.select("doc_id"), "doc_id", "left_anti").join(per, "component").withColumn("u", F.explode(F.sequence(zero, F.col("asking") - 1))).withColumn("asks", F.lit(False))
    # documents that ask meet each other where both parts are dealt together
    others = rest.join(per, "component").join(wide.select("doc_id", "v"), "doc_id").withColumn("u", F.explode(F.sequence(zero, F.col("asking") - 1)))
    others = others.join(asking.select("doc_id", F.col("u").alias("own_u")).distinct(), "doc_id").where("u <> own_u").withColumn("asks", F.lit(False))
    second = asking.withColumn("asks", F.lit(True)).select(*cols).unionByName(asked.select(*cols)).unionByName(others.select(*cols))
    return led.unionByName(_search(second, percent, block_grams))


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80, block_grams: int = BLOCK_GRAMS, long: int = LONG) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``."""
    rows = C.keyed(docs)
    described = C.written(rows.mapInArrow(C.task(_describe(size, long)), _SETS), "sets")
    sets = described.where("gram is null").drop("gram", "times")
    top = described.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("n")).where("n > 15").orderBy(F.desc("n"), "gram").limit(long)
    frequent = np.array([r["gram"] for r in top.select("gram").collect()], np.int64).view(_U)  # at most `long` numbers
    real = sets.where("doc_id is not null and n > 0")

    # equal sets: the least document stands for them
    sig = ["n", "s1", "s2"]
    reps = C.written(real.groupBy(*sig).agg(F.min(F.struct("doc_id", "th")).alias("rep")).select(*sig, "rep.*"), "reps")
    same = real.select(*sig, F.col("doc_id").alias("a")).join(reps.select(*sig, F.col("doc_id").alias("b")), sig).where("a <> b").select("a", "b")

    # grams that stand alone, counted in one part of all grams over all documents
    known = rows.where("doc_id is not null")
    alone = known.mapInArrow(C.task(_postings(size, PARTS)), "doc_id long, gram long, rank long").groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("doc_id")).where("k = 1")
    alone = alone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("alone"))
    spare = F.floor(F.col("n") * (100 - percent) / 100)  # n - T
    # counts are by doc_id, so a doc_id with several texts is not ruled out here
    several = reps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts"))
    left = reps.join(several, "doc_id").join(alone, "doc_id", "left").where((F.coalesce("alone", F.lit(0)) <= spare) | (F.col("texts") > 1))
    left = C.written(left.select("doc_id", "th", "n"), "left")

    table = np.zeros(1 << (TABLE_BITS - 6), _U)
    slot = F.col("th").bitwiseAND((1 << TABLE_BITS) - 1)
    bits = left.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((th & {(1 << TABLE_BITS) - 1}) & 63 as int))")).alias("bits"))
    for r in bits.collect():  # at most 2 ** (TABLE_BITS - 6) numbers
        table[r["at"]] = r["bits"] % (1 << 64)
    passed = known.select("doc_id", "th", "text").mapInArrow(C.task(_passed(table)), "doc_id long, th long, text string").dropDuplicates(["doc_id", "th"])
    asked = C.written(passed.join(left, ["doc_id", "th"]), "asked")

    # lists of what is left; each document's grams that do not stand alone, by rising list length
    lists = asked.mapInArrow(C.task(_postings(size, 1, frequent)), "doc_id long, gram long, rank long")
    short = lists.where("rank = 0").repartition("gram").sortWithinPartitions("gram").mapInArrow(C.task(_lengths), "doc_id long, gram long, length long")
    both = short.unionByName(lists.where("rank > 0").select("doc_id", "gram", (F.col("rank") + MOST_IN_RUN).alias("length")))
    own = both.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("length", "gram"))).alias("g")).join(left.groupBy("doc_id").agg(F.min("n").alias("n")), "doc_id")
    first = F.floor(F.col("n") * (100 - percent) / 100) + 1 - (F.col("n") - F.size("g"))
    own = own.withColumn("first", first.cast("int")).where("first > 0").select("doc_id", F.explode(F.expr("slice(g, 1, first)")).alias("g")).select("doc_id", "g.*")
    own = C.written(own, "first")
    stars = own.where(F.col("length") < MOST_IN_RUN).repartition("gram").sortWithinPartitions("gram", "doc_id").mapInArrow(C.task(_stars), "a long, b long")
    longest = own.where(F.col("length") >= MOST_IN_RUN)
    centers = C.written(longest.groupBy("gram").agg(F.min("doc_id").alias("b")), "centers")
    stars = stars.unionByName(longest.join(centers, "gram").select(F.col("doc_id").alias("a"), "b"))
    near = C.components(stars.where("a <> b").distinct(), "candidates").withColumnRenamed("node", "doc_id")

    # sets of the candidates, with the number of blocks their component needs
    near = left.join(near, "doc_id").select("doc_id", "th", "n", "component")
    blocks = near.groupBy("component").agg(F.ceil(F.sum("n") / block_grams).cast("int").alias("blocks"))
    near = C.written(near.join(C.written(blocks, "blocks"), "component"), "near")
    full = asked.drop("n").join(near.drop("n"), ["doc_id", "th"]).select("doc_id", "component", "blocks", "text")
    full = C.written(full.mapInArrow(C.task(_full_sets(size)), "doc_id long, component long, blocks int, grams binary"), "full")
    zero = F.lit(0)
    links = _search(full.where("blocks = 1").select("*", zero.alias("u"), zero.alias("v"), F.lit(True).alias("asks")), percent, block_grams)

    if not full.where("blocks > 1").isEmpty():
        links = links.unionByName(_wide_links(full, percent, block_grams))
    found = C.components(links.unionByName(same), "linked")
    return sets.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
