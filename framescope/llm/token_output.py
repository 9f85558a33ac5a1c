"""Token ids as Re-Pair compressed shards, written as files and read back with random access.

Documents are range-partitioned and sorted by ``doc_id``; a task encodes its
texts and writes shards of about ``SHARD_IDS`` ids. Encoding goes through the
tokenizers library once per distinct word of a batch (white space never joins
two words in these vocabularies; ``encode`` falls back to whole texts for a
tokenizer that is not of that kind), with a bounded cache.

Shard format (one row of the Parquet files under ``path``; all arrays little
endian): ``rules`` uint32 pairs, nonterminal ``base + r`` replaces the pair of
rule r, a pair may hold earlier nonterminals; ``lengths`` uint32, ids each rule
expands to; ``symbols``, the compressed sequence at ``width`` bits a symbol, the
greatest bit first; ``doc_symbols`` uint32, each document's end in it, so that document j
is decoded alone; ``doc_ids`` int64 and ``doc_null``, in ascending order.

Re-Pair goes on until no pair of the shard occurs ``least`` times. A round
replaces many frequent pairs at once, the most frequent first, leaving out
those that compete with one already taken for a symbol; the next round counts
only what can still be frequent: pairs that were, and pairs beside a
replacement (any other pair only loses occurrences). Pairs are first counted inside the
distinct words, weighted by frequency, which gives the same counts as over all ids
within words at a fraction of the work, then across words over the sequence.
Rules never span documents.

Defined cases: NULL or empty text has only the end id. NULL ``doc_id`` stands
first. Repeated ids are ordered by text. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framescope.llm import common as C

SHARD_IDS = 2 << 20
CACHE_WORDS = 1 << 18
END_ID = 1
_TAIL = ".,!?;:"


class WordEncoder:
    """Ids of texts, one library call per distinct word; equal to encoding the whole text.

    Holds for vocabularies with word ends that drop white space: words are cut
    at ASCII white space, and closing punctuation (its own piece there, as the
    pattern takes letters apart from other signs) is cut from words that end in it.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        probe = "Ab, cd's 12 e.\nf??"
        self.by_word = self._encode(["Ab", ",", "cd's", "12", "e", ".", "f", "??"], join=True) == self.tok.encode(probe, add_special_tokens=False).ids
        self.end = np.zeros(self.tok.get_vocab_size() + 1, bool)
        for piece, i in self.tok.get_vocab().items():
            self.end[i] = piece.endswith("</w>")
        self.known = pa.array([], pa.large_string())
        self.flat, self.off = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, texts: list[str], join: bool = False):
        own = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return [i for x in own for i in x] if join else own

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of distinct words. Runs of plain words are encoded together and cut at their word ends."""
        listed = words.to_pylist()
        plain = [w.isalpha() for w in listed]
        flat, sizes = [], np.zeros(len(listed), np.int64)
        order: list[int] = []
        alpha = [i for i, p in enumerate(plain) if p]
        for k in range(0, len(alpha), 1024):
            at = alpha[k : k + 1024]
            ids = np.array(self._encode([" ".join([listed[i] for i in at])], join=True), np.uint32)
            stop = np.flatnonzero(self.end[ids]) + 1
            if len(stop) == len(at) and stop[-1] == len(ids):
                sizes[at] = np.diff(np.append(0, stop))
                flat.append(ids)
            else:  # a letter that the library takes apart: word by word
                own = self._encode([listed[i] for i in at])
                sizes[at] = [len(x) for x in own]
                flat.append(np.array([i for x in own for i in x], np.uint32))
            order += at
        rest = [i for i, p in enumerate(plain) if not p]
        for k in range(0, len(rest), 4096):
            at = rest[k : k + 4096]
            own = self._encode([listed[i] for i in at])
            sizes[at] = [len(x) for x in own]
            flat.append(np.array([i for x in own for i in x], np.uint32))
            order += at
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        by = np.asarray(order, np.int64)
        off = np.zeros(len(listed) + 1, np.int64)
        np.cumsum(sizes, out=off[1:])
        return flat[gather(np.cumsum(sizes[by]) - sizes[by], sizes[by], np.argsort(by, kind="stable"))], off

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of distinct words, through the cache."""
        at = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy() if len(self.known) else np.full(len(words), -1)
        new = np.flatnonzero(at < 0)
        fresh = words.take(pa.array(new))
        flat, off = self._ids_of(fresh)
        if len(self.known) + len(fresh) <= CACHE_WORDS:
            start = len(self.known)
            self.known = pa.concat_arrays([self.known, fresh])
            self.off = np.concatenate([self.off, self.off[-1] + off[1:]])
            self.flat = np.concatenate([self.flat, flat])
            at = at.copy()
            at[new] = start + np.arange(len(new))
            return self.flat[gather(self.off[:-1], np.diff(self.off), at)], np.append(0, np.cumsum(np.diff(self.off)[at]))
        pool, pool_off = np.concatenate([self.flat, flat]), np.concatenate([self.off, self.off[-1] + off[1:]])
        at = at.copy()
        at[new] = len(self.known) + np.arange(len(new))
        sizes = np.diff(pool_off)
        return pool[gather(pool_off[:-1], sizes, at)], np.append(0, np.cumsum(sizes[at]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(types_flat, types_off, seq, seq_off)``: ids of each type (a word or a whole text) and the types of each text in order."""
        texts = texts.cast(pa.large_string())
        if not self.by_word:
            own = self._encode(texts.to_pylist())
            sizes = np.array([len(x) for x in own], np.int64)
            n = len(own)
            return np.array([i for x in own for i in x], np.uint32), np.append(0, np.cumsum(sizes)), np.arange(n), np.arange(n + 1)
        split = pc.ascii_split_whitespace(texts)
        off = split.offsets.to_numpy().astype(np.int64)
        flat = split.flatten()
        off = off - off[0]
        coded = flat.dictionary_encode()
        words = coded.dictionary
        # special tokens are matched in their own case
        lowered = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
        cores, tails = (x.dictionary_encode() for x in _cut_tails(lowered))
        c_flat, c_off = self.lookup(cores.dictionary)
        t_flat, t_off = self._ids_of(tails.dictionary)
        ci, ti = cores.indices.to_numpy(), tails.indices.to_numpy()
        c_size, t_size = np.diff(c_off)[ci], np.diff(t_off)[ti]
        pool = np.concatenate([c_flat, t_flat])
        starts, sizes = np.stack([c_off[ci], len(c_flat) + t_off[ti]], 1).ravel(), np.stack([c_size, t_size], 1).ravel()
        return pool[gather(starts, sizes)], np.append(0, np.cumsum(c_size + t_size)), coded.indices.to_numpy().astype(np.int64), off


def _cut_tails(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Closing punctuation apart, where it follows a letter or digit (after another sign it is one piece with that)."""
    cores = pc.ascii_rtrim(words, _TAIL)
    length, core = pc.binary_length(words).to_numpy().copy(), pc.binary_length(cores).to_numpy().copy()
    some = core < length
    if not some.any():
        return words, pa.nulls(len(words), pa.large_string()).fill_null("")
    at = np.flatnonzero(some)
    plain = pc.match_substring_regex(cores.take(pa.array(at)), "[0-9A-Za-z]$").to_numpy(zero_copy_only=False)
    for i, c in zip(at[~plain].tolist(), cores.take(pa.array(at[~plain])).to_pylist(), strict=True):
        if not c.lower()[-1:].isalnum():
            core[i] = length[i]
    _, offsets, data = words.buffers()
    starts = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words)]
    data = np.frombuffer(data, np.uint8)
    return _cut(data, starts, core), _cut(data, starts + core, length - core)


def _cut(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of the given byte ranges."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    own = np.ascontiguousarray(data[gather(starts, sizes)])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(own))


def gather(starts: np.ndarray, sizes: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Indices of the ranges ``starts[i] .. starts[i] + sizes[i]`` one after the other (of ``at``, in that order)."""
    if at is not None:
        starts, sizes = starts[at], sizes[at]
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


# ---- Re-Pair ---------------------------------------------------------------------


def _chosen(left: np.ndarray, right: np.ndarray, count: np.ndarray, most: int) -> list[int]:
    """Places of the most frequent pairs that cannot overlap with each other: no symbol is the end of one and the start of another."""
    first, last, out = set(), set(), []
    for k in np.argsort(-count, kind="stable")[: 4 * most].tolist():
        a, b = int(left[k]), int(right[k])
        if a in last or b in first or (a == b and (a in first or a in last)):
            continue
        first.add(a)
        last.add(b)
        out.append(k)
        if len(out) == most:
            break
    return out


def _by_pair(left: np.ndarray, right: np.ndarray, at: np.ndarray, symbols: int, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs in order and their places: ``left << wide | right``, ``at``, ``wide``, for symbols below ``symbols`` and places below ``n``.

    Pair and place are sorted as one number where they fit, much faster than by an index.
    """
    wide, places = symbols.bit_length(), n.bit_length()
    if 2 * wide + places > 63:
        key = left << 32 | right
        by = np.argsort(key, kind="stable")
        return key[by], at[by], 32
    both = (left << wide | right) << places | at
    both.sort()
    return both >> places, both & ((1 << places) - 1), wide


def _fold(symbols: np.ndarray, owner: np.ndarray, weight: np.ndarray | None, rules: list[tuple[int, int]], base: int, most: int, least: int):
    """Replace pairs inside runs of one owner until none reaches ``least``; the new rules are added to ``rules``.

    ``weight`` is what each position counts (None: 1). Positions stay where they
    are: ``after`` and ``before`` link those still alive.
    """
    n = len(symbols)
    symbols = symbols.copy()
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    edge = np.append(owner[1:] != owner[:-1], True) if n else np.zeros(0, bool)
    after[edge] = n
    before[1:][edge[:-1]] = -1
    alive = np.ones(n, bool)
    at = np.flatnonzero(after < n)
    while len(at):
        key, at, wide = _by_pair(symbols[at], symbols[after[at]], at, base + len(rules), n)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        count = size if weight is None else np.add.reduceat(weight[at], start)
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        key, low = key[start], (1 << wide) - 1
        took = often[_chosen(key[often] >> wide, key[often] & low, count[often], most)]
        rule = np.full(len(start), -1)
        rule[took] = len(rules) + np.arange(len(took))
        rules += zip((key[took] >> wide).tolist(), (key[took] & low).tolist(), strict=True)
        of = np.repeat(rule, size)
        hit, new = at[of >= 0], of[of >= 0]
        double = symbols[hit] == symbols[after[hit]]
        if double.any():  # in a run of one symbol every second place
            places = np.flatnonzero(double)
            places = places[np.lexsort((hit[places], new[places]))]
            run, own = hit[places], new[places]
            opens = np.append(True, (after[run[:-1]] != run[1:]) | (own[1:] != own[:-1]))
            nth = np.arange(len(run)) - np.maximum.accumulate(np.where(opens, np.arange(len(run)), 0))
            keep = np.ones(len(hit), bool)
            keep[places[nth % 2 == 1]] = False
            hit, new = hit[keep], new[keep]
        gone = after[hit]
        symbols[hit] = base + new
        alive[gone] = False
        after[hit] = beyond = after[gone]
        before[beyond[beyond < n]] = hit[beyond < n]
        again = np.zeros(n + 1, bool)  # the last place takes the -1 of what has nothing before it
        for some in (at[np.repeat((count >= least) & (rule < 0), size)], hit, before[hit]):
            again[some] = True
        at = np.flatnonzero(again[:n] & alive & (after < n))
    return symbols[alive], owner[alive]


def repair(flat: np.ndarray, off: np.ndarray, seq: np.ndarray, doc_off: np.ndarray, base: int, most: int = 4096, least: int = 8):
    """Grammar over types (``flat``/``off``) and the type sequence ``seq`` cut at ``doc_off``.

    Returns ``rules`` (n x 2), ``lengths``, the compressed symbols and each document's end.
    """
    rules: list[tuple[int, int]] = []
    used, slot = np.unique(seq, return_inverse=True)
    frequency = np.bincount(slot, minlength=len(used)).astype(np.int64)
    own = np.repeat(np.arange(len(used)), np.diff(off)[used])
    symbols, own = _fold(flat[gather(off[:-1], np.diff(off), used)].astype(np.int64), own, frequency[own], rules, base, most, least)
    sizes = np.bincount(own, minlength=len(used))
    starts = np.cumsum(sizes) - sizes
    out = symbols[gather(starts, sizes, slot)]
    ends = np.append(0, np.cumsum(sizes[slot]))[doc_off[1:]]
    doc = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    out, doc = _fold(out, doc, None, rules, base, most, least)
    ends = np.cumsum(np.bincount(doc, minlength=len(ends)))
    pairs = np.array(rules, np.int64).reshape(-1, 2)
    lengths = np.ones(base + len(rules), np.int64)
    for lo, hi in _layers(pairs, base):
        lengths[base + lo : base + hi] = lengths[pairs[lo:hi]].sum(1)
    return pairs.astype(np.uint32), lengths[base:].astype(np.uint32), out, ends


def _layers(rules: np.ndarray, base: int) -> Iterator[tuple[int, int]]:
    """Runs of rules that only hold symbols made before the run."""
    newest = rules.max(1, initial=0) - base if len(rules) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(rules):
        later = np.flatnonzero(newest[lo:] >= lo)
        hi = lo + int(later[0]) if len(later) else len(rules)
        yield lo, hi
        lo = hi


def expand(rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, base: int) -> np.ndarray:
    """Ids of a symbol sequence: each rule's expansion is built once, then copied."""
    rules = rules.astype(np.int64)
    size = np.append(np.ones(base, np.int64), lengths.astype(np.int64))
    start = np.cumsum(size) - size
    table = np.zeros(int(size.sum()), np.uint32)
    table[:base] = np.arange(base)
    for lo, hi in _layers(rules, base):
        parts = rules[lo:hi].ravel()
        stop = start[base + hi - 1] + size[base + hi - 1]
        table[start[base + lo] : stop] = table[gather(start, size, parts)]
    return table[gather(start, size, symbols)]


def packed(symbols: np.ndarray, width: int) -> bytes:
    """Symbols at ``width`` bits each, greatest bit first."""
    bits = np.unpackbits(symbols.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width :].reshape(-1)).tobytes()


def unpacked(blob: bytes, width: int, lo: int, hi: int) -> np.ndarray:
    """Symbols ``lo .. hi`` of what :func:`packed` gave."""
    first = lo * width // 8
    bits = np.unpackbits(np.frombuffer(blob, np.uint8)[first : -(-hi * width // 8)])[lo * width - first * 8 : hi * width - first * 8]
    out = np.zeros(hi - lo, np.int64)
    for column in bits.reshape(-1, width).T:
        out = out << 1 | column
    return out


# ---- write and read ----------------------------------------------------------------

_SHARD = (
    "part int, shard int, n_docs long, n_ids long, base int, width int, rules binary, lengths binary, symbols binary, doc_symbols binary, doc_ids binary, doc_null binary"
)


def _write(tokenizer_path: str, end_id: int, shard_ids: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = _encoder(tokenizer_path)
        base = max(enc.tok.get_vocab_size(), end_id + 1)
        part, shard = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text")
            doc_ids = batch.column("doc_id")
            sizes = pc.binary_length(texts).to_numpy()
            # a shard is cut by bytes (at least one byte an id for these vocabularies), so its arrays stay bounded
            cut = [0]
            size = 0
            for i, n in enumerate(sizes.tolist()):
                if size and size + n > 2 * shard_ids:
                    cut.append(i)
                    size = 0
                size += n + 1
            for lo, hi in zip(cut, [*cut[1:], len(sizes)], strict=True):
                if lo == hi:
                    continue
                flat, off, seq, seq_off = enc.encode(texts.slice(lo, hi - lo))
                # the end id is one more type, closing every document
                n_types = len(off) - 1
                flat, off = np.append(flat, np.uint32(end_id)), np.append(off, off[-1] + 1)
                seq = np.insert(seq, seq_off[1:], n_types)
                seq_off = seq_off + np.arange(len(seq_off))
                rules, lengths, symbols, ends = repair(flat, off, seq, seq_off, base)
                width = max(1, (base + len(rules) - 1).bit_length())
                ids = doc_ids.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in ((part, pa.int32()), (shard, pa.int32()), (hi - lo, pa.int64()), (int(np.diff(off)[seq].sum()), pa.int64()), (base, pa.int32()), (width, pa.int32()))]
                    + [
                        pa.array([x.tobytes()])
                        for x in (
                            rules.astype("<u4"),
                            lengths.astype("<u4"),
                            np.frombuffer(packed(symbols, width), np.uint8),
                            ends.astype("<u4"),
                            ids.fill_null(0).to_numpy().astype("<i8"),
                            ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8),
                        )
                    ],
                    names=[c.strip().split()[0] for c in _SHARD.split(",")],
                )
                shard += 1

    return rows


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode every text and write the shards to ``path`` (any store Spark writes)."""
    C.shared_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # NULL or often repeated ids are cut by text, equal rows by their place in the input
    rows = rows.withColumn("th", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "th", "place").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    rows.mapInArrow(C.task(_write(tokenizer_path, end_id, shard_ids)), _SHARD).write.option("compression", "zstd").parquet(path)


def decode_document(shard: dict, j: int) -> np.ndarray:
    """Ids of document ``j`` of a shard row, without expanding the others."""
    rules = np.frombuffer(shard["rules"], "<u4").reshape(-1, 2)
    ends = np.append(0, np.frombuffer(shard["doc_symbols"], "<u4")).tolist()
    out: list[int] = []
    stack = unpacked(shard["symbols"], shard["width"], ends[j], ends[j + 1])[::-1].tolist()
    while stack:
        s = stack.pop()
        if s < shard["base"]:
            out.append(s)
        else:
            stack += rules[s - shard["base"]][::-1].tolist()
    return np.array(out, np.uint32)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            doc_symbols = np.frombuffer(r["doc_symbols"], "<u4")
            symbols = unpacked(r["symbols"], r["width"], 0, int(doc_symbols[-1]))
            lengths = np.frombuffer(r["lengths"], "<u4")
            ids = expand(np.frombuffer(r["rules"], "<u4").reshape(-1, 2), lengths, symbols, r["base"])
            size = np.append(np.ones(r["base"], np.int64), lengths.astype(np.int64))[symbols]
            ends = np.append(0, np.cumsum(size))[doc_symbols]
            n = np.diff(np.append(0, ends))
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            null = np.frombuffer(r["doc_null"], np.uint8).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=null), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64()), pa.array(np.full(len(n), r["part"], np.int32)), pa.array(np.full(len(n), r["shard"], np.int32))],
                names=["doc_id", "own", "n_tokens", "ids_crc32", "part", "shard"],
            )


def read_tokens(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, part, shard`` per document, decoded from the files.

    ``start`` adds up shard totals (one small row a shard) in shard order.
    """
    shards = spark.read.schema(_SHARD).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    inner = Window.partitionBy("part").orderBy("shard")
    places = shards.select("part", "shard", "n_ids").withColumn("in_part", F.sum("n_ids").over(inner) - F.col("n_ids")).join(parts, "part")
    places = places.select("part", "shard", (F.col("in_part") + F.col("before_part")).alias("before"))
    read = shards.drop("n_docs", "n_ids").mapInArrow(C.task(_read), "doc_id long, own long, n_tokens long, ids_crc32 long, part int, shard int")
    return read.join(places, ["part", "shard"]).select("doc_id", (F.col("own") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")


def token_output(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids as shards (under the shared folder unless ``path`` is given) and read them back."""
    spark = docs.sparkSession
    path = path or f"{C.shared_dir(spark)}/llm-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(spark, path)
