"""Approximate nearest neighbours by inner product: stable projections, kd-tree, chi-square stopping test.

1. A vector x gets one more component ``sqrt(M^2 - |x|^2)`` (M the greatest
   length in the table), a query is scaled to length M and gets 0 there: the
   nearest point is then the one of the largest inner product.
2. Points are projected to ``dims`` numbers by a Gaussian (2-stable) matrix, so
   a projected squared distance over the true one follows chi-square with
   ``dims`` degrees of freedom. A kd-tree of at most ``MAX_CELLS`` cells is
   fitted on the projections of at most ``sample`` rows; every row is put in
   its cell. A cell is dealt to parts of about ``PART_ROWS`` rows by its counted
   size, each stored as blocks of ``block_rows`` vectors with the box of their projections.
3. A query first searches its own block, which gives its k-th distance d. The
   stopping test ``P(chi2 <= r^2 / d^2) >= confidence`` turns d into a projected
   radius r: cells, blocks and leaves of a block's own kd-tree whose boxes lie
   beyond r are not visited. Inside a block the leaves nearest to the queries (one
   block's, so near each other) come first; points within r are
   verified by true product, d (and with it r) falls on the way, and a leaf that
   fails the test for a query is not searched for it. A neighbour nearer than the
   final d is missed with probability at most ``1 - confidence``.

What a query found in its own block stays; each (query block, cell part) pair adds
at most k rows a query, and a last ranked window merges them: k rows, if there are so many. Data without contrast (true distances all alike) makes the
test hold late: then most rows are verified, and results stay right.

Defined cases: vectors that are NULL, empty, of length zero, or hold NULL or
non-finite components take no part, nor do rows with NULL id. A query meets
vectors of its own dimension. Repeated rows are candidates of their own; a query
leaves out its own row only. Equal scores go to the smaller id. The score is the
inner product added up left to right in doubles. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framescope.llm import common as C

DIMS, CONFIDENCE, SAMPLE, MAX_CELLS, BLOCK_ROWS, PART_ROWS, LEAF, QUERY_ROWS = 8, 0.95, 20_000, 4096, 4096, 1 << 16, 128, 256
_INDEX = "cell int, part int, block long, dim int, lo array<double>, hi array<double>, ids binary, query binary, vectors binary, points binary"
_ASKED = "cell int, block long, dim int, ids binary, place binary, vectors binary, points binary, best binary, found binary"
_FOUND = "q_block long, q_place long, query_id long, vec_id long, score double"
_PAIRS = "cell int, part int, dim int, q_block long, q_ids binary, q_place binary, q_vectors binary, q_points binary, best binary"


def chi2_cdf(x: float, k: int) -> float:
    """``P(chi-square with k degrees of freedom <= x)`` by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def chi2_bound(p: float, k: int) -> float:
    """Least x whose :func:`chi2_cdf` reaches ``p``."""
    lo, hi = 0.0, 1.0
    while chi2_cdf(hi, k) < p:
        lo, hi = hi, 2 * hi
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if chi2_cdf(mid, k) >= p else (mid, hi)
    return hi


class Projection:
    """The stable projection of vectors and queries of any dimension (one fixed Gaussian row a component)."""

    def __init__(self, longest: float, dims: int, seed: int):
        self.longest, self.dims, self.seed = longest, dims, seed
        self._rows = np.zeros((0, dims))

    def _matrix(self, dim: int) -> np.ndarray:
        if len(self._rows) < dim + 1:  # row 0 is that of the added component
            self._rows = np.random.default_rng(self.seed).standard_normal((dim + 1, self.dims))
        return self._rows[: dim + 1]

    def points(self, v: np.ndarray) -> np.ndarray:
        g = self._matrix(v.shape[1])
        rest = np.sqrt(np.maximum(self.longest**2 - (v * v).sum(1), 0.0))
        return v @ g[1:] + rest[:, None] * g[0]

    def asked(self, v: np.ndarray) -> np.ndarray:
        return (v * (self.longest / np.sqrt((v * v).sum(1)))[:, None]) @ self._matrix(v.shape[1])[1:]

    def __getstate__(self):
        return {**self.__dict__, "_rows": np.zeros((0, self.dims))}


class Cells:
    """A balanced kd-tree as arrays: at each level the widest coordinate of the sample is split at its median."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
        own = {1: points}
        for node in range(1, 1 << depth):
            p = own.pop(node)
            if len(p):
                axis = int(np.argmax(p.max(0) - p.min(0)))
                self.axis[node], self.at[node] = axis, np.median(p[:, axis])
                right = p[:, axis] > self.at[node]
                own[2 * node], own[2 * node + 1] = p[~right], p[right]
            else:
                own[2 * node] = own[2 * node + 1] = p

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        row = np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + (points[row, self.axis[node]] > self.at[node])
        return (node - (1 << self.depth)).astype(np.int32)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, places and matrix of the vectors of a batch, dimension by dimension."""
    v = batch.column("v")
    dims = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(dims) - dims
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, flat[first[at][:, None] + np.arange(dim)[None, :]].astype(np.float64)


def _projected(projection: Projection):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, m in _matrices(batch):
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in projection.points(m)])], names=["p"])

    return rows


def _sizes(projection: Projection, cells: Cells):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << cells.depth, np.int64)
        for batch in batches:
            for _, _, m in _matrices(batch):
                n += np.bincount(cells.of(projection.points(m)), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["cell", "n"])

    return rows


def _dealt(projection: Projection, cells: Cells, parts: np.ndarray):
    """Every row with its cell and part; the parts of a cell are dealt in turn, so equal vectors spread too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for _, at, m in _matrices(batch):
                cell[at] = cells.of(projection.points(m))
            part = ((turn + np.arange(len(cell))) % parts[cell]).astype(np.int32)
            turn += len(cell)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part), *(batch.column(c) for c in ("vec_id", "q", "v"))], names=["cell", "part", "vec_id", "q", "v"])

    return rows


def _blocks(projection: Projection, block_rows: int):
    """Rows sorted by cell and part, packed; a task holds at most one block a dimension."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, now = TaskContext.get().partitionId() << 32, None
        pending: dict[int, list] = {}

        def block(dim):
            nonlocal number
            ids, query, m = (np.concatenate(x) for x in zip(*pending.pop(dim), strict=True))
            for k in range(0, len(ids), block_rows):
                cut = slice(k, k + block_rows)
                p = projection.points(m[cut])
                blobs = [ids[cut], query[cut], m[cut], p]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([number]), pa.array([dim], pa.int32()), pa.array([p.min(0)]), pa.array([p.max(0)])]
                    + [pa.array([np.ascontiguousarray(b).tobytes()]) for b in blobs],
                    names=["cell", "part", "block", "dim", "lo", "hi", "ids", "query", "vectors", "points"],
                )
                number += 1

        for batch in batches:
            cell, part = batch.column("cell").to_numpy(), batch.column("part").to_numpy()
            ids, query = batch.column("vec_id").to_numpy(), batch.column("q").to_numpy(zero_copy_only=False).astype(np.uint8)
            edges = np.flatnonzero(np.append(True, (np.diff(cell) != 0) | (np.diff(part) != 0)))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(cell)], strict=True):
                if (cell[lo], part[lo]) != now:
                    for dim in list(pending):
                        yield from block(dim)
                    now = (cell[lo], part[lo])
                for dim, at, m in _matrices(batch.slice(lo, hi - lo)):
                    pending.setdefault(dim, []).append((ids[lo:hi][at], query[lo:hi][at], m))
                    if sum(len(x[0]) for x in pending[dim]) >= block_rows:
                        yield from block(dim)
        for dim in list(pending):
            yield from block(dim)

    return rows


def _leaves(p: np.ndarray) -> list[np.ndarray]:
    """Places of the points of each leaf of a block's kd-tree."""
    todo, out = [np.arange(len(p))], []
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        axis = int(np.argmax(p[at].max(0) - p[at].min(0)))
        by = at[np.argsort(p[at, axis], kind="stable")]
        todo += [by[len(by) // 2 :], by[: len(by) // 2]]
    return out


def _outside(lo: np.ndarray, hi: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared projected distance of every point to every box."""
    gap = np.maximum(np.maximum(lo[None] - p[:, None], p[:, None] - hi[None]), 0.0)
    return (gap * gap).sum(2)


class Search:
    """Queries of one dimension against one block."""

    def __init__(self, longest: float, bound: float, k: int):
        self.longest, self.bound, self.k = longest, bound, k

    def radius(self, best: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Squared projected radius at which the stopping test holds, from the k-th best product."""
        with np.errstate(invalid="ignore"):
            return self.bound * np.maximum(2 * self.longest**2 - 2 * best * (self.longest / length), 0.0) * (1 + 1e-9) + 1e-12

    @staticmethod
    def _floor(best: np.ndarray) -> np.ndarray:
        """A little under the k-th best product, so that rounding drops no tie; finite, so that unverified points stay out."""
        return np.maximum(best - 1e-9 * (1 + np.abs(best)), -1.7e308)

    def run(self, q, qp, best, own, v, p):
        """``(query, place, score)`` of all verified points that may be among the k best, and the k-th best products.

        ``best`` is the k-th best product known so far (-inf: none), ``own`` the
        query's own place in this block (-1: elsewhere).
        """
        leaves = _leaves(p)
        lo, hi = np.stack([p[x].min(0) for x in leaves]), np.stack([p[x].max(0) for x in leaves])
        gap = _outside(lo, hi, qp)
        length, q2, p2 = np.sqrt((q * q).sum(1)), (qp * qp).sum(1), (p * p).sum(1)
        best, top = best.copy(), np.full((len(q), self.k), -np.inf)
        found = []
        for leaf in np.argsort(gap.mean(0), kind="stable").tolist():
            radius = self.radius(best, length)
            who = np.flatnonzero(gap[:, leaf] <= radius)
            if not len(who):
                continue
            at = leaves[leaf]
            # squared projected distances by products; the margin takes their rounding
            near = q2[who][:, None] + p2[at][None] - 2 * (qp[who] @ p[at].T) <= (radius[who] + 1e-9 * (1 + q2[who]))[:, None]
            near &= at[None] != own[who][:, None]
            score = np.where(near, q[who] @ v[at].T, -np.inf)
            better = np.flatnonzero((score > best[who][:, None]).any(1))
            if len(better):
                some = who[better]
                top[some] = -np.partition(-np.concatenate([top[some], score[better]], 1), self.k - 1, axis=1)[:, : self.k]
                best[some] = np.maximum(best[some], top[some].min(1))
            i, j = np.nonzero(score >= self._floor(best[who])[:, None])
            found.append((who[i], at[j], score[i, j]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), best
        who, place, score = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = score >= self._floor(best)[who]
        return who[keep], place[keep], best

    def ranked(self, q, ids, v, who, place):
        """Query, id and score (its bits as a long) of the k best of every query among what :meth:`run` gives."""
        score = _exact(q[who], v[place])
        by = np.lexsort((ids[place], -score, who))
        by = by[np.arange(len(by)) - np.searchsorted(who[by], who[by]) < self.k]
        return who[by], ids[place[by]], score[by].view(np.int64)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products row by row, added left to right."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * v[:, j]
    return out


def _decoded(row: dict, dim: int, dims: int):
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(-1, dim), np.frombuffer(row["points"]).reshape(-1, dims)


def _first(search: Search, projection: Projection):
    """The queries of every block with the k-th best product found in that block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, v, p = _decoded(r, r["dim"], projection.dims)
                query = np.flatnonzero(np.frombuffer(r["query"], np.uint8))
                for k in range(0, len(query), QUERY_ROWS):
                    at = query[k : k + QUERY_ROWS]
                    qp = projection.asked(v[at])
                    who, place, best = search.run(v[at], qp, np.full(len(at), -np.inf), at, v, p)
                    found = np.stack(search.ranked(v[at], ids, v, who, place), 1)
                    blobs = [ids[at], at, v[at], qp, best, found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["cell"]], pa.int32()), pa.array([r["block"]]), pa.array([r["dim"]], pa.int32()), *(pa.array([np.ascontiguousarray(b).tobytes()]) for b in blobs)],
                        names=["cell", "block", "dim", "ids", "place", "vectors", "points", "best", "found"],
                    )

    return rows


def _reached(search: Search, dims: int, cell: np.ndarray, part: np.ndarray, lo: np.ndarray, hi: np.ndarray, cell_dim: np.ndarray):
    """For every block of queries the cell parts within their radius, with the queries that reach each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, v, qp = _decoded(r, r["dim"], dims)
                best, place = np.frombuffer(r["best"]), np.frombuffer(r["place"], np.int64)
                mine = np.flatnonzero(cell_dim == r["dim"])
                reach = _outside(lo[mine], hi[mine], qp) <= search.radius(best, np.sqrt((v * v).sum(1)))[:, None]
                for j in np.flatnonzero(reach.any(0)).tolist():
                    at = np.flatnonzero(reach[:, j])
                    blobs = [np.ascontiguousarray(x[at]).tobytes() for x in (ids, place, v, qp, best)]
                    n = int(part[mine[j]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, cell[mine[j]], np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array([r["dim"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int64())]
                        + [pa.array([b] * n, pa.binary()) for b in blobs],
                        names=["cell", "part", "dim", "q_block", "q_ids", "q_place", "q_vectors", "q_points", "best"],
                    )

    return rows


def _verified(search: Search, dims: int):
    """The k best of each query in each block that reaches its radius."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, v, p = _decoded(r, r["dim"], dims)
                asked = {c: r[f"q_{c}"] for c in ("ids", "vectors", "points")}
                if r["q_block"] == r["block"]:  # searched already
                    continue
                qid, q, qp = _decoded(asked, r["dim"], dims)
                place, best = np.frombuffer(r["q_place"], np.int64), np.frombuffer(r["best"])
                who, at, _ = search.run(q, qp, best, np.full(len(qid), -1), v, p)
                yield _found_rows(r["q_block"], place, qid, *search.ranked(q, ids, v, who, at))

    return rows


def _own_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best of each query in its own block."""
    for batch in batches:
        for block, place, qid, found in zip(*(batch.column(c).to_pylist() for c in ("block", "place", "ids", "found")), strict=True):
            who, ids, score = np.frombuffer(found, np.int64).reshape(-1, 3).T
            yield _found_rows(block, np.frombuffer(place, np.int64), np.frombuffer(qid, np.int64), who, ids, score)


def _found_rows(block: int, place, qid, who, ids, score) -> pa.RecordBatch:
    """``score`` holds the bits of doubles, as they are kept in ``found``."""
    columns = [np.full(len(who), block), place[who], qid[who], ids, np.ascontiguousarray(score).view(np.float64)]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["q_block", "q_place", "query_id", "vec_id", "score"])


def stable_knn(
    vectors: DataFrame, query: Column, k: int = 20, dims: int = DIMS, confidence: float = CONFIDENCE, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS, seed: int = 11
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of ``vectors(vec_id, v)`` for every row where ``query`` is true.

    ``v`` is an array of doubles, ``query`` a condition on the columns of
    ``vectors``. The kd-tree is fitted on at most ``sample`` rows, the ones of
    least hash; every row is indexed.
    """
    spark = vectors.sparkSession
    C.shared_dir(spark)
    v = F.col("v").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = vectors.where(F.col("vec_id").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(query, F.lit(False)).alias("q"), v.alias("v")).where(norm2 > 0)
    n, longest2 = rows.agg(F.count(F.lit(1)), F.max(norm2)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    projection, search = Projection(math.sqrt(longest2), dims, seed), Search(math.sqrt(longest2), chi2_bound(confidence, dims), k)
    fitted = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).select("v").mapInArrow(C.task(_projected(projection)), "p binary").collect()  # at most sample rows
    depth = max(0, math.ceil(math.log2(min(MAX_CELLS, max(1, n / block_rows)))))
    cells = Cells(np.stack([np.frombuffer(r["p"]) for r in fitted]), depth)
    parts = np.ones(1 << depth, np.int64)
    for r in rows.select("v").mapInArrow(C.task(_sizes(projection, cells)), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most MAX_CELLS rows
        parts[r["cell"]] = -(-r["n"] // PART_ROWS)
    dealt = rows.mapInArrow(C.task(_dealt(projection, cells, parts)), "cell int, part int, vec_id long, q boolean, v array<double>")
    packed = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(C.task(_blocks(projection, block_rows)), _INDEX)
    index = C.written(packed, "kd-index")

    asked = C.written(index.mapInArrow(C.task(_first(search, projection)), _ASKED), "kd-asked")
    sides = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(dims)]
    box = index.groupBy("cell", "dim").agg(*sides).collect()  # at most MAX_CELLS rows a dimension
    if not box:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cell, cell_dim = (np.array([r[c] for r in box], np.int32) for c in ("cell", "dim"))
    lo, hi = (np.array([[r[f"{c}{i}"] for i in range(dims)] for r in box]) for c in ("lo", "hi"))
    pairs = asked.mapInArrow(C.task(_reached(search, dims, cell, parts[cell], lo, hi, cell_dim)), _PAIRS)
    work = pairs.repartition("cell", "part", "dim").join(index.drop("lo", "hi", "query"), ["cell", "part", "dim"])
    found = work.mapInArrow(C.task(_verified(search, dims)), _FOUND).unionByName(asked.select("block", "place", "ids", "found").mapInArrow(C.task(_own_found), _FOUND))
    nth = F.row_number().over(Window.partitionBy("q_block", "q_place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
