"""Vector code compression with equal-average nearest-neighbour search.

Vectors of integers are cut into ``parts`` equal consecutive parts; each part
position has a codebook of ``entries`` vectors, refined by ``rounds`` of
assignment and integer means and then used for the codes.

The search: entries are sorted by component sum. For a part x and an entry c of
dimension w, ``(sum x - sum c)^2 <= w |x - c|^2``, so entries are tried outward
from x's own sum, in both directions, until the squared gap of the sums over w
strictly exceeds the best distance (equal gaps may still hold a lower index).
All parts of a batch take one step outward at a time, those still open alone.

The first codebooks are the vectors of smallest id (one top-n query); each round
is one scan in which every task sums its parts by entry, merged by (part, entry)
before the driver sees them: entries x parts rows, whatever the table's size.

Defined cases: rows whose vector is NULL, empty or holds NULL or non-finite
components are dropped (their label's sum has no part of them). The dimension is
that of the smallest kept id; rows of another dimension keep NULL ``code`` and
``error``. A dimension that ``parts`` does not divide, or an integer component
beyond +-2^24, raises: distances would not be exact. NULL ids sort last, equal
ids by vector; repeated rows count each. Fewer rows than entries give a smaller
codebook. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm import common as C

PARTS, ENTRIES, ROUNDS, SLAB, LARGEST = 4, 256, 4, 8192, 1 << 24


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of and squared distance to the nearest row of ``book`` for every row of ``x``, ties to the lower index;
    also the number of distances computed."""
    sums = book.sum(1)
    by = np.argsort(sums, kind="stable")
    sums, n, width = sums[by], len(book), book.shape[1]
    own = x.sum(1)
    up = np.searchsorted(sums, own)
    down = up - 1
    best = np.full(len(x), np.iinfo(np.int64).max)
    at = np.full(len(x), n)
    tried = 0
    climbing, falling = up < n, down >= 0
    while True:
        for place, open_, step in ((up, climbing, 1), (down, falling, -1)):
            row = np.flatnonzero(open_)
            gap = sums[place[row]] - own[row]
            # gap^2 / width > best, in integers
            near = -(-gap * gap // width) <= best[row]
            open_[row[~near]] = False
            row = row[near]
            if not len(row):
                continue
            entry = by[place[row]]
            diff = x[row] - book[entry]
            far = np.einsum("ij,ij->i", diff, diff)
            tried += len(row)
            better = (far < best[row]) | ((far == best[row]) & (entry < at[row]))
            best[row[better]], at[row[better]] = far[better], entry[better]
            place[row] += step
            open_[row] = (place[row] >= 0) & (place[row] < n)
        if not (climbing.any() or falling.any()):
            return at, best, tried


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and matrix of the vectors of ``dim`` components."""
    v = batch.column("v")
    size = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    first = np.cumsum(size) - size
    m = flat[first[at][:, None] + np.arange(dim)[None, :]]
    if m.size and np.abs(m).max() > LARGEST:
        raise ValueError(f"an integer component lies beyond {LARGEST}: distances would not be exact")
    return at, m


def _summed(books: list[np.ndarray], dim: int):
    """A task's count and component sums of each (part, entry)."""
    width = dim // len(books)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(books), len(books[0])), np.int64)
        total = np.zeros((*count.shape, width), np.int64)
        for batch in batches:
            _, m = _matrix(batch, dim)
            for k in range(0, len(m), SLAB):
                for i, book in enumerate(books):
                    x = m[k : k + SLAB, i * width : (i + 1) * width]
                    at = nearest(x, book)[0]
                    count[i] += np.bincount(at, minlength=len(book))
                    by = np.argsort(at, kind="stable")
                    starts = np.flatnonzero(np.append(True, np.diff(at[by]) != 0))
                    total[i, at[by][starts]] += np.add.reduceat(x[by], starts, axis=0)
        part, entry = np.nonzero(count)
        yield _entry_rows(part, entry, count[part, entry], total[part, entry])

    return rows


def _entry_rows(part, entry, count, total) -> pa.RecordBatch:
    sums = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, max(1, total.shape[1]), dtype=np.int32)), pa.array(total.reshape(-1)))
    columns = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count), sums]
    return pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of an entry are in this task: one row each."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        for part, entry, n, sums in zip(*(batch.column(c).to_pylist() for c in ("part", "entry", "n", "sums")), strict=True):
            own = held.setdefault((part, entry), [0, 0])
            own[0] += n
            own[1] = own[1] + np.array(sums, np.int64)
    if held:
        keys = np.array(list(held))
        yield _entry_rows(keys[:, 0], keys[:, 1], np.array([x[0] for x in held.values()]), np.stack([x[1] for x in held.values()]))


def refined(rows: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """Codebooks after one round; an entry without parts stays."""
    sums = "part int, entry int, n long, sums array<long>"
    merged = rows.select("v").mapInArrow(C.task(_summed(books, dim)), sums).repartition("part", "entry").mapInArrow(C.task(_merged), sums)
    out = [b.copy() for b in books]
    for r in merged.collect():  # parts x entries rows
        out[r["part"]][r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return out


def _coded(books: list[np.ndarray], dim: int):
    width = dim // len(books)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, m = _matrix(batch, dim)
            codes = np.zeros((len(m), len(books)), np.uint8 if len(books[0]) <= 256 else np.dtype(">u2"))
            error = np.zeros(len(m), np.int64)
            for k in range(0, len(m), SLAB):
                for i, book in enumerate(books):
                    codes[k : k + SLAB, i], far, _ = nearest(m[k : k + SLAB, i * width : (i + 1) * width], book)
                    error[k : k + SLAB] += far
            code, errors = [None] * batch.num_rows, [None] * batch.num_rows
            for place, row, far in zip(at.tolist(), codes, error.tolist(), strict=True):
                code[place], errors[place] = row.tobytes().hex(), far
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """Codebooks of ``rows(vec_id, v)`` and the dimension."""
    by_id = [F.asc_nulls_last("vec_id"), F.asc("v")]
    dims = rows.orderBy(*by_id).select(F.size("v").alias("dim")).limit(1).collect()
    if not dims:
        return [], 0
    dim = dims[0]["dim"]
    if dim % parts:
        raise ValueError(f"{parts} parts do not divide {dim} components")
    start = np.array([r["v"] for r in rows.where(F.size("v") == dim).orderBy(*by_id).select("v").limit(entries).collect()], np.int64)  # entries rows
    if np.abs(start).max() > LARGEST:
        raise ValueError(f"an integer component lies beyond {LARGEST}: distances would not be exact")
    books = [np.ascontiguousarray(x) for x in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        books = refined(rows, books, dim)
    return books, dim


def equal_average_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept row of ``vectors(vec_id, v, label)``; ``v`` holds integers."""
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull())
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("v").cast("array<long>").alias("v"))
    rows = C.written(rows, "eq-vectors")
    books, dim = train(rows, parts, entries, rounds)
    label = rows.schema["label"].dataType.simpleString()
    if not dim:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = C.written(rows.mapInArrow(C.task(_coded(books, dim)), f"vec_id long, label {label}, code string, error long"), "eq-codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, coded["label"].eqNullSafe(sums["_label"]), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
