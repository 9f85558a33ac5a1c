"""Exact top-k inner-product search over norm buckets.

Candidates are sorted by length (one range exchange) and cut into buckets of
similar length, a few thousand vectors each, stored as one row per bucket;
queries into blocks. The longest bucket gives every query a first threshold
theta (its k-th best score there). A bucket is joined to a block only if the
product of their greatest lengths reaches the block's least theta. In a joined
pair each query has the local cosine threshold ``theta / (|q| * longest)``:
above 1 the whole bucket is skipped for it; near 1 the coordinate rule bounds
the query's strongest coordinate and keeps vectors inside that interval;
otherwise the length rule keeps the vectors with ``|c| >= theta / |q|``. What
is kept is verified by its exact integer product; theta rises on the way. Every
pair of block and bucket gives at most k rows a query, joined by a last group.

Defined cases: vectors that are NULL, empty, hold NULL or non-finite components
take no part, nor do rows with NULL id; a query meets candidates of its own
dimension. Repeated rows are separate candidates; a query leaves out one row
equal to itself. Ties go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm import common as C

BUCKET_ROWS, BLOCK_ROWS = 4096, 1024
_BUCKET = "part int, bucket int, dim int, shortest double, longest double, ids binary, copies binary, vectors binary"


def _packed(rows: int):
    """One row per run of at most ``rows`` vectors of one dimension, in the order they come."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        pending: dict[int, list] = {}

        def out(dim, own):
            nonlocal count
            ids, copies, vec = (np.concatenate(x) for x in zip(*own, strict=True))
            norm = np.sqrt((vec.astype(np.float64) ** 2).sum(1))
            by = np.argsort(-norm, kind="stable")
            for k in range(0, len(by), rows):
                at = by[k : k + rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([count], pa.int32()), pa.array([dim], pa.int32()), pa.array([norm[at].min()]), pa.array([norm[at].max()])]
                    + [pa.array([x[at].tobytes()]) for x in (ids, copies, vec)],
                    names=["part", "bucket", "dim", "shortest", "longest", "ids", "copies", "vectors"],
                )
                count += 1

        for batch in batches:
            vectors = batch.column("v")
            dims = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            first = np.cumsum(dims) - dims
            ids, copies = batch.column("vec_id").to_numpy(), batch.column("copies").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                own = pending.setdefault(dim, [])
                own.append((ids[at], copies[at], flat[first[at][:, None] + np.arange(dim)[None, :]]))
                if sum(len(x[0]) for x in own) >= rows:
                    yield from out(dim, pending.pop(dim))
        for dim, own in pending.items():
            yield from out(dim, own)

    return pack


def _unpacked(ids: bytes, copies: bytes, vectors: bytes, dim: int):
    v = np.frombuffer(vectors, np.int64).reshape(-1, dim)
    return np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64), v


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: through the float unit while every sum stays below 2**53."""
    if len(q) and len(c) and float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _best(scores: np.ndarray, ids: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Places of a query's best candidates: enough of them for k rows, by score, then id."""
    if len(scores) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bar)
    else:
        at = np.arange(len(scores))
    at = at[np.lexsort((ids[at], -scores[at]))]
    return at[: int(np.searchsorted(np.cumsum(copies[at]), k)) + 1]


def _search(k: int, first: bool):
    """Top k of every query of a block in one bucket; with ``first`` only the threshold each query gets there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                qid, _, q = _unpacked(r["q_ids"], r["q_copies"], r["q_vectors"], dim)
                cid, ccopies, c = _unpacked(r["ids"], r["copies"], r["vectors"], dim)
                theta = np.full(len(qid), -np.inf) if first else np.frombuffer(r["theta"], np.float64).copy()
                q_norm, c_norm = np.sqrt((q.astype(np.float64) ** 2).sum(1)), np.sqrt((c.astype(np.float64) ** 2).sum(1))
                found = []
                for lo in range(0, len(qid), 128):
                    rows_ = np.arange(lo, min(lo + 128, len(qid)))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        local = theta[rows_] / (q_norm[rows_] * max(c_norm.max(), 1e-300))
                    # margin of 1e-9 against rounding: pruning only ever drops what is surely below theta
                    rows_ = rows_[~(local > 1 + 1e-9)]
                    if not len(rows_):
                        continue
                    scores = None
                    for i in rows_.tolist():
                        keep = None
                        if np.isfinite(theta[i]) and theta[i] > 0 and q_norm[i] > 0:
                            cosine = theta[i] / (q_norm[i] * c_norm.max())
                            if cosine > 0.95:  # coordinate rule on the query's strongest coordinate
                                f = int(np.argmax(np.abs(q[i])))
                                x, y = q[i, f] / q_norm[i], np.sqrt(max(0.0, 1 - (q[i, f] / q_norm[i]) ** 2)) * np.sqrt(max(0.0, 1 - min(1.0, cosine) ** 2))
                                unit = c[:, f] / np.maximum(c_norm, 1e-300)
                                keep = np.flatnonzero(unit >= x * min(1.0, cosine) - y - 1e-9 if x >= 0 else unit <= x * min(1.0, cosine) + y + 1e-9)
                            elif c_norm[-1] * q_norm[i] < theta[i]:  # length rule: the bucket is sorted by length
                                keep = np.arange(int(np.searchsorted(-c_norm, -(theta[i] / q_norm[i]) * (1 - 1e-9), side="right")))
                        if keep is None:
                            if scores is None:
                                scores = dict(zip(rows_.tolist(), _products(q[rows_], c), strict=True))
                            own, ids, copies, vec = scores[i], cid, ccopies, c
                        else:
                            own, ids, copies, vec = _products(q[i : i + 1], c[keep])[0], cid[keep], ccopies[keep], c[keep]
                        same = (ids == qid[i]) & (vec == q[i]).all(1) if (ids == qid[i]).any() else None
                        if same is not None and same.any():  # leave out the query's own row
                            copies = copies - same
                            own, ids, copies = own[copies > 0], ids[copies > 0], copies[copies > 0]
                        if not len(ids):
                            continue
                        at = _best(own, ids, copies, k)
                        if first:
                            if copies[at].sum() >= k:
                                theta[i] = own[at[-1]]
                        else:
                            found += [(qid[i], i, ids[j], copies[j], own[j]) for j in at.tolist()]
                if first:
                    yield pa.RecordBatch.from_arrays([pa.array([r["q_part"]], pa.int32()), pa.array([r["q_bucket"]], pa.int32()), pa.array([theta.tobytes()])], names=["q_part", "q_bucket", "theta"])
                elif found:
                    a = np.array(found, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(a), r["q_part"], np.int32)), pa.array(np.full(len(a), r["q_bucket"], np.int32)), *(pa.array(a[:, j]) for j in range(5))],
                        names=["q_part", "q_bucket", "query_id", "place", "vec_id", "copies", "score"],
                    )

    return rows


def topk_search(vectors: DataFrame, queries: DataFrame, k: int = 5, bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each row of ``queries(vec_id, v)`` its ``k`` best rows of ``vectors(vec_id, v)``; ``v`` are integer vectors.

    Returns ``query_id, rank, vec_id, score``. ``queries`` are rows of
    ``vectors``, each leaving out its own.
    """

    def grouped(df: DataFrame) -> DataFrame:
        ok = df.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
        return ok.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))

    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    spread = grouped(vectors).withColumn("norm2", norm2).repartitionByRange(F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id")
    buckets = C.written(spread.select("vec_id", "copies", "v").mapInArrow(C.task(_packed(bucket_rows)), _BUCKET), "buckets")
    blocks = grouped(queries).select("vec_id", "copies", "v").mapInArrow(C.task(_packed(block_rows)), _BUCKET)
    blocks = C.written(blocks.select(*(F.col(c).alias(f"q_{c}") for c in ("part", "bucket", "longest", "ids", "copies", "vectors")), "dim"), "blocks")

    # thresholds from the longest bucket of each dimension: one row each, so this join cannot grow
    top = buckets.groupBy("dim").agg(F.max_by(F.struct("ids", "copies", "vectors"), F.struct("longest", F.length("ids"))).alias("b")).select("dim", "b.*")
    theta = C.written(blocks.join(top, "dim").mapInArrow(C.task(_search(k, True)), "q_part int, q_bucket int, theta binary"), "theta")
    blocks = blocks.join(theta, ["q_part", "q_bucket"])

    # block x bucket pairs by number, the lengths deciding which can meet; their vectors join after that
    head = blocks.select("q_part", "q_bucket", "dim", "q_longest")
    pairs = head.join(buckets.select("part", "bucket", "dim", "longest"), "dim")
    pairs = pairs.join(blocks.select("q_part", "q_bucket", "theta"), ["q_part", "q_bucket"])
    pairs = pairs.mapInArrow(C.task(_reachable), "q_part int, q_bucket int, part int, bucket int").repartition("part", "bucket", "q_part", "q_bucket")
    work = pairs.join(buckets.drop("shortest", "longest", "dim"), ["part", "bucket"]).join(blocks.drop("q_longest"), ["q_part", "q_bucket"])
    found = work.mapInArrow(C.task(_search(k, False)), "q_part int, q_bucket int, query_id long, place long, vec_id long, copies long, score long")

    # k best of each query over its buckets: partial lists merge, never more than k structs a list
    mine = ["q_part", "q_bucket", "query_id", "place"]
    best = found.groupBy(*mine).agg(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "copies")).alias("all"))
    ranked = best.select(*mine, F.slice(F.flatten(F.transform(F.slice(F.array_sort("all"), 1, k), lambda x: F.array_repeat(x, F.least(x["copies"], F.lit(k)).cast("int")))), 1, k).alias("all"))
    ranked = ranked.select(*mine, F.posexplode("all").alias("at", "x"))
    times = blocks.mapInArrow(C.task(_query_copies), "q_part int, q_bucket int, place long, times long")
    ranked = ranked.join(times, ["q_part", "q_bucket", "place"]).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))


def _reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least = np.array([np.frombuffer(t, np.float64).min() for t in batch.column("theta").to_pylist()])
        ok = least <= batch.column("q_longest").to_numpy() * batch.column("longest").to_numpy() * (1 + 1e-9)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("q_part", "q_bucket", "part", "bucket")], names=["q_part", "q_bucket", "part", "bucket"])


def _query_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, bucket, copies in zip(*(batch.column(c).to_pylist() for c in ("q_part", "q_bucket", "q_copies")), strict=True):
            times = np.frombuffer(copies, np.int64)
            n = len(times)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, bucket, np.int32)), pa.array(np.arange(n)), pa.array(times)], names=["q_part", "q_bucket", "place", "times"])
