"""Helpers shared by the operators: written intermediates, text chunks, vectorised hashing, components.

Hashes are polynomials over bytes or words modulo the prime 2**61 - 1, then
mixed. (Modulo 2**64 they would collide for any base on words built by the
Thue-Morse rule.) What is removed is decided on two such values from two
independent word or byte hashes, 122 bits; a link of two sets on the exact count of equal
64-bit gram hashes, so a wrong link takes as many collisions as the sets' overlap lacks.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19
_U = np.uint64
#: bases (fixed values): word characters, first and second, and windows, first and second
BYTE_BASE, BYTE_BASE_2, WORD_BASE_1, WORD_BASE_2 = 0x1E3779B97F4A7C15, 0x0B7E151628AED2A7, 0x11B54A32D192ED03, 0x0CB92BA72F3D8DD7
PRIME = (1 << 61) - 1


# ---- written intermediates ---------------------------------------------------

#: folders written by this driver, oldest first
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch one is set only where none is (local tests).

    Ships the package on the way: every operator comes by here before its tasks run.
    """
    from framescope.functions.shipping import ship_package
    from framescope.session import ensure_checkpoint_dir

    ship_package(spark)
    return ensure_checkpoint_dir(spark).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage is cut, lost executors lose nothing.

    The folder stays until :func:`clean_up`: results are lazy and may read it at any time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> int:
    """Delete what :func:`written` has written so far from this driver, once the results that read it are used; returns the folders."""
    n = 0
    while _written:
        where = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
    return n


# ---- rows and texts ------------------------------------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, text)`` with NULL text as empty; ``th`` tells rows of one doc_id with different texts apart."""
    shared_dir(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


class TextBytes:
    """UTF-8 bytes of the texts of an Arrow column (NULL is empty), copied out only where they are asked for."""

    def __init__(self, column: pa.Array):
        self._column = column.cast(pa.large_binary())
        self.sizes = pc.binary_length(self._column).fill_null(0).to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, at):
        if isinstance(at, slice):
            lo, hi, _ = at.indices(len(self))
            return [x or b"" for x in self._column.slice(lo, max(hi - lo, 0)).to_pylist()]
        return self._column[at].as_py() or b""

    def __iter__(self) -> Iterator[bytes]:
        for x in self._column:
            yield x.as_py() or b""


def text_bytes(column: pa.Array) -> TextBytes:
    """UTF-8 bytes of each text; NULL is empty."""
    return TextBytes(column)


def chunks(texts: TextBytes | list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes (a longer text stands alone), to bound the working memory."""
    start = size = 0
    sizes = texts.sizes.tolist() if isinstance(texts, TextBytes) else map(len, texts)
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(texts):
        yield start, len(texts)


def pieces(text: bytes, limit: int = 1 << 22) -> Iterator[bytes]:
    """A text in parts of about ``limit`` bytes, cut at white space (a longer word stays whole)."""
    start = 0
    while start < len(text):
        end = start + limit
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[start:end]
        start = end


# ---- tasks ---------------------------------------------------------------------


def task(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``rows`` for ``mapInArrow``, giving free memory back to the system at the end: workers live on between
    stages, and what they hold unused counts against the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            release()

    return run


def release() -> None:
    """Return freed memory of Arrow and the C library to the system, where they can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---- hashing ---------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo the prime."""
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.where(x >= _U(PRIME), x - _U(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of values below it, by halves of 31 bits (2**61 is 1 there)."""
    half = _U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> _U(31), a & half, b >> _U(31), b & half
    middle = a1 * b0 + a0 * b1
    return reduced(_U(2) * a1 * b1 + (middle >> _U(30)) + ((middle & _U((1 << 30) - 1)) << _U(31)) + a0 * b0)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo the prime for ``i <= n`` (kept for chunks of the usual size)."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        have = tuple(np.ones(size, _U) for _ in range(2))
        for table, factor in zip(have, (base, pow(base, -1, PRIME)), strict=True):
            done = 1
            while done < size:
                more = min(done, size - done)
                table[done : done + more] = times(table[:more], _U(pow(factor, done, PRIME)))
                done += more
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[0][: n + 1], have[1][: n + 1]


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of ``values[j] * base**j, j < i``, in two parts: what the low 31 bits of the terms add up to and what the others do."""
    n = len(values)
    out = np.zeros((2, n + 1), _U)
    power = powers(base, n)[0][:n]
    low = _U((1 << 31) - 1)
    if n < 1 << 22 and values.max(initial=0) < 1 << 10:  # bytes: no sum reaches 2**64 without a reduction
        np.cumsum(values * (power & low), dtype=_U, out=out[0, 1:])
        np.cumsum(values * (power >> _U(31)), dtype=_U, out=out[1, 1:])
    else:
        term = times(reduced(values), power)
        np.cumsum(term & low, dtype=_U, out=out[0, 1:])
        np.cumsum(term >> _U(31), dtype=_U, out=out[1, 1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Mixed hash of ``values[start:end]``; length takes part."""
    inv = powers(base, prefix.shape[1])[1]
    high = reduced(prefix[1][end] - prefix[1][start])
    high = ((high & _U((1 << 30) - 1)) << _U(31)) + (high >> _U(30))  # times 2**31
    total = reduced(reduced(prefix[0][end] - prefix[0][start]) + high)
    return mix(times(total, inv[start]) + (end - start).astype(_U) * _U(0xA24BAED4963EE407))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: value of each byte in a hash, as it is and lower-cased
_VALUE = np.arange(1, 257, dtype=_U)
_LOWER = _VALUE.copy()
_LOWER[65:91] += _U(32)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk of texts: byte spans, owning row and 64-bit hash."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts)
        self.buf = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.row_end = np.cumsum(sizes) - 1
        self.row_start = self.row_end - (sizes - 1)
        space = np.ones(len(self.buf) + 2, bool)
        space[1:-1] = _SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.ptr = np.append(np.searchsorted(self.start, self.row_start), len(self.start))
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.ptr))
        self._values = (_LOWER if lower else _VALUE)[self.buf]
        self.hash = self.hashed(BYTE_BASE)

    def hashed(self, base: int) -> np.ndarray:
        """Hash of every word with the given base."""
        return span_hash(prefix_sums(self._values, base), self.start, self.end, base)

    def windows(self, length: int) -> np.ndarray:
        """First word of every window of ``length`` words inside one row."""
        n = len(self.start) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.row[:n] == self.row[length - 1 :])


def sliding(op, values: np.ndarray, width: int) -> np.ndarray:
    """``op`` over every window of ``width`` values, by doubling."""
    out, span = values, 1
    while span * 2 <= width:
        out = op(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = op(out[: len(out) - (width - span)], out[width - span :])
    return out


def anchors(gram: np.ndarray, owner: np.ndarray, gram_len: int, window_len: int) -> np.ndarray:
    """Positions picked by winnowing: the least gram hash of every window of ``window_len`` symbols in one row.

    ``gram[i]`` hashes symbols ``i .. i+gram_len-1`` (non-zero); ``owner`` gives
    the row of each symbol. Equal windows pick grams at equal offsets, so what
    two texts share over ``window_len`` symbols, they share as an anchor.
    """
    width = window_len - gram_len + 1
    n = len(owner) - window_len + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = sliding(np.minimum, gram, width)[:n].copy()
    least[owner[:n] != owner[window_len - 1 :]] = 0
    padded = np.zeros(n + 2 * (width - 1), _U)
    padded[width - 1 : width - 1 + n] = least
    return np.flatnonzero(sliding(np.maximum, padded, width) == gram[: n + width - 1])


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return x.view(np.int64)


# ---- connected components -----------------------------------------------------------


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """``(node, component)``: the smallest node reachable over ``edges(a, b)``, for every node with an edge.

    Alternating large-star / small-star rounds (each a group by node with
    map-side combine), written to the shared folder after each round, until no
    edge changes. The least neighbours are written before they are joined: both
    sides of a join are then plain exchanges, so that a star's centre, where a
    whole group of copies meets, is split. The driver sees only a count and a
    checksum per round.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        n = both(edges)
        least = written(n.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        large = written(n.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), name)
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.where("a <> b").distinct(), name)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
