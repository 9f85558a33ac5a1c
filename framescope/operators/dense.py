"""Dense-vector scoring: every sentence against every query, top-k per (document, query).

Plan (no cross join, no all-pairs output):

1. The query side (the framework) is size-checked and its L2-normalised
   matrix is broadcast once.
2. ``mapInArrow`` scores each Arrow batch of sentence vectors with one
   matrix product (numpy/BLAS; the batch's list column is reshaped into a
   matrix without a per-row loop) and keeps only a *partial* top-k per
   (document, query) inside the batch. A document whose sentences span many
   batches or partitions (a hot document) contributes at most k rows per
   batch, so what is shuffled is bounded by batches x k, never by the number
   of sentence/query pairs.
3. A final ``row_number`` window over (document, query), ordered by score
   desc then sentence index, keeps the global top-k. Exact: the global top-k
   is contained in the union of the per-batch top-k's.

When the framework is larger than the broadcast limit, the queries are split
into hash blocks, each block is scored as above, and the results are
unioned -- every (sentence, query) pair is still scored exactly once.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as _vectors
from ..functions.shipping import by_value
from ..functions.vectors import l2_normalise, round_scores, stack
from .guards import MAX_BROADCAST_QUERIES, key_partitions

# Bound on rows x queries materialised per scoring step inside one batch.
_MAX_CELLS = 4_000_000


def _query_blocks(queries: DataFrame, query_id: str, query_vector: str, limit: int):
    """Yield (ids, normalised matrix) blocks of the query side, each at most ``limit`` rows."""
    q = queries.select(query_id, query_vector).where(F.col(query_vector).isNotNull())
    pending = [(q, 0)]
    while pending:
        part, salt = pending.pop()
        rows = part.limit(limit + 1).collect()  # size check and fetch in one job
        if not rows:
            continue
        if len(rows) > limit:
            # split into hash blocks (a fresh salt each level); every query lands in exactly one block
            if salt > 8:
                raise ValueError("query side cannot be split under the broadcast limit (duplicate ids?)")
            m = 2 * -(-part.count() // limit)
            blk = F.pmod(F.xxhash64(F.col(query_id), F.lit(salt)), F.lit(m))
            pending.extend((part.where(blk == b), salt + 1) for b in range(m))
            continue
        ids = np.array([r[0] for r in rows])
        mat = l2_normalise(stack([r[1] for r in rows]))
        yield ids, mat


def _partial_topk(docs: np.ndarray, sidx: np.ndarray, scores: np.ndarray, k: int | None):
    """Indices (row, query) of the top-k per (doc, query) within one batch; all if k is None."""
    n, q = scores.shape
    if k is None or n <= k:
        rows = np.repeat(np.arange(n), q)
        cols = np.tile(np.arange(q), n)
        return rows, cols
    codes, _ = pd.factorize(docs, use_na_sentinel=False)
    flat = scores.ravel()
    rows = np.repeat(np.arange(n), q)
    cols = np.tile(np.arange(q), n)
    order = np.lexsort((sidx[rows], -flat, cols, codes[rows]))
    g_doc = codes[rows][order]
    g_col = cols[order]
    new_group = np.ones(len(order), dtype=bool)
    new_group[1:] = (g_doc[1:] != g_doc[:-1]) | (g_col[1:] != g_col[:-1])
    starts = np.maximum.accumulate(np.where(new_group, np.arange(len(order)), 0))
    keep = (np.arange(len(order)) - starts) < k
    sel = order[keep]
    return rows[sel], cols[sel]


def _matrix(col) -> np.ndarray:
    """(n, d) float64 matrix from an Arrow list column of equal-length vectors, without a per-row loop."""
    import pyarrow as pa

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    offsets = col.offsets.to_numpy()
    lengths = np.diff(offsets)
    if n and not (lengths == lengths[0]).all():
        raise ValueError("vectors of different lengths")
    d = int(lengths[0]) if n else 0
    values = col.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64, copy=False).reshape(n, d)


def _scorer(bc, doc: str, sentence_index: str, vector: str, k: int | None, carry, qtype):
    def run(batches):
        import pyarrow as pa

        ids, qmat = bc.value
        step = max(1, _MAX_CELLS // max(1, len(ids)))
        for rb in batches:
            for lo in range(0, rb.num_rows, step):
                part = rb.slice(lo, step)
                if part.num_rows == 0:
                    continue
                x = l2_normalise(_matrix(part.column(vector)))
                with np.errstate(invalid="ignore"):
                    scores = round_scores(x @ qmat.T)
                # a vector with a non-finite component is no match: NaN would sort first
                scores[~np.isfinite(scores)] = 0.0
                d = part.column(doc).to_numpy(zero_copy_only=False)
                s = part.column(sentence_index).to_numpy(zero_copy_only=False)
                r, c = _partial_topk(d, s, scores, k)
                take = pa.array(r, type=pa.int64())
                cols = [part.column(doc).take(take), pa.array(ids[c]).cast(qtype), pa.array(scores[r, c], type=pa.float64()),
                        part.column(sentence_index).take(take), *[part.column(col).take(take) for col in carry]]
                yield pa.RecordBatch.from_arrays(cols, names=[doc, "query_id", "score", sentence_index, *carry])

    return run


def _best_of(sidx: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """(min(k, n), queries) rows of the best scores of one document, best first, ties to the smaller index."""
    by = np.argsort(sidx, kind="stable")
    if (by[1:] > by[:-1]).all():
        by = None
    else:
        scores = scores[by]
    rows = scores.argmax(0)[None] if k == 1 else np.argsort(-scores, axis=0, kind="stable")[:k]
    return rows if by is None else by[rows]


def _document_scorer(bc, doc: str, sentence_index: str, vector: str, k: int, carry, qtype):
    """Task over rows clustered and sorted by document: the final top k of each (document, query), without a shuffle of them."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, qmat = bc.value
        names = [doc, "query_id", "rank", "score", sentence_index, *carry]
        step = max(1, _MAX_CELLS // max(1, len(ids)))

        def scored(part):
            with np.errstate(invalid="ignore"):
                scores = round_scores(l2_normalise(_matrix(part.column(vector))) @ qmat.T)
            # a vector with a non-finite component is no match: NaN would sort first
            scores[~np.isfinite(scores)] = 0.0
            return scores, part.column(sentence_index).to_numpy(zero_copy_only=False)

        def starts(part):
            key = part.column(doc)
            a, b = key.slice(0, len(key) - 1), key.slice(1)
            differ = pc.or_(pc.xor(a.is_null(), b.is_null()), pc.not_equal(a, b).fill_null(False))
            return np.append(0, np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1)

        def finished(part, start):
            """Result rows of whole documents."""
            for lo in range(0, len(start), 4096):
                own = np.append(start[lo : lo + 4097], part.num_rows)[: min(4096, len(start) - lo) + 1]
                first = 0
                while first < len(own) - 1:  # documents that are scored together
                    stop = max(first + 1, int(np.searchsorted(own, own[first] + step, side="right")) - 1)
                    piece = part.slice(int(own[first]), int(own[stop] - own[first]))
                    scores, sidx = scored(piece)
                    rows = [a - own[first] + _best_of(sidx[a - own[first] : b - own[first]], scores[a - own[first] : b - own[first]], k) for a, b in zip(own[first:stop], own[first + 1 : stop + 1], strict=True)]
                    rank = np.concatenate([np.repeat(np.arange(1, len(r) + 1, dtype=np.int32), r.shape[1]) for r in rows])
                    query = np.concatenate([np.tile(np.arange(r.shape[1]), len(r)) for r in rows])
                    at = np.concatenate([r.ravel() for r in rows])
                    for cut in range(0, len(at), 1 << 16):
                        r, q = at[cut : cut + (1 << 16)], query[cut : cut + (1 << 16)]
                        take = pa.array(r)
                        yield pa.RecordBatch.from_arrays(
                            [piece.column(doc).take(take), pa.array(ids[q]).cast(qtype), pa.array(rank[cut : cut + (1 << 16)]), pa.array(scores[r, q]),
                             *[piece.column(c).take(take) for c in (sentence_index, *carry)]], names=names)
                    first = stop

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if held is None else pa.concat_batches([held, batch])
            start = starts(batch)
            if start[-1]:
                yield from finished(batch.slice(0, int(start[-1])), start[:-1])
            held = batch.slice(int(start[-1]))
            if held.num_rows > step:  # of a large document only rows that are among the best for a query go on
                kept = []
                for lo in range(0, held.num_rows, step):
                    part = held.slice(lo, step)
                    scores, sidx = scored(part)
                    kept.append(part.take(pa.array(np.unique(_best_of(sidx, scores, k)))))
                held = pa.concat_batches(kept)
        if held is not None:
            yield from finished(held, np.zeros(1, np.int64))

    return run


def score_dense(
    sentences: DataFrame,
    queries: DataFrame,
    k: int | None = 5,
    *,
    doc: str = "doc",
    sentence_index: str = "sentence_index",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
    carry=(),
) -> DataFrame:
    """Cosine scores of sentences against queries.

    With ``k`` set: partial top-k per (doc, query) (call :func:`topk_dense`
    for the final ranking). With ``k=None``: every (row, query) score -- use
    only when the result itself is that matrix (e.g. documents x parameters).
    Output: (doc, query_id, score, sentence_index, *carry); ``carry`` columns
    (e.g. the sentence text) ride along with the rows that survive.
    """
    spark = sentences.sparkSession
    src = sentences.select(doc, sentence_index, vector, *carry).where(F.col(vector).isNotNull())
    fields = {f.name: f.dataType for f in src.schema.fields}
    qtype = queries.schema[query_id].dataType
    schema = T.StructType(
        [
            T.StructField(doc, fields[doc]),
            T.StructField("query_id", qtype),
            T.StructField("score", T.DoubleType()),
            T.StructField(sentence_index, fields[sentence_index]),
            *[T.StructField(c, fields[c]) for c in carry],
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_type

    qarrow = to_arrow_type(qtype)
    out = None
    for ids, mat in _query_blocks(queries, query_id, query_vector, max_broadcast_queries):
        bc = spark.sparkContext.broadcast((ids, mat))
        part = src.mapInArrow(_scorer(bc, doc, sentence_index, vector, k, tuple(carry), qarrow), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out


def rank_topk(partial: DataFrame, k: int, *, doc: str = "doc", sentence_index: str = "sentence_index") -> DataFrame:
    """Final top-k per (doc, query_id): rank 1..min(k, n) by score desc, sentence index asc."""
    w = Window.partitionBy(doc, "query_id").orderBy(F.desc("score"), F.asc(sentence_index))
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_dense(
    sentences: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    doc: str = "doc",
    sentence_index: str = "sentence_index",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "embedding",
) -> DataFrame:
    """Top-k sentences per (document, query) by cosine: (doc, query_id, rank, score, sentence_index)."""
    partial = score_dense(
        sentences, queries, k, doc=doc, sentence_index=sentence_index, vector=vector,
        query_id=query_id, query_vector=query_vector,
    )
    return rank_topk(partial, k, doc=doc, sentence_index=sentence_index).select(
        doc, "query_id", "rank", "score", sentence_index
    )


def best_dense(sentences: DataFrame, queries: DataFrame, **kw) -> DataFrame:
    """Best score per (doc, query) per Arrow batch: (doc, query_id, score, sentence_index).

    Enough for adherence (any(top-k >= t) is max >= t): no sort or window,
    the final max is a partial aggregation downstream.
    """
    return score_dense(sentences, queries, 1, **kw)


def mean_vectors(rows: DataFrame, *, key: str = "doc", vector: str = "embedding") -> DataFrame:
    """Element-wise mean vector per key: (key, embedding).

    ``posexplode`` + ``groupBy(key, pos).avg`` aggregates partially on the map
    side, so a hot key costs one row per (partition, dimension). Only the
    d averages of one key are collected into its array (d = vector length).
    """
    comp = rows.select(key, F.posexplode(vector).alias("pos", "v"))
    avg = comp.groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return avg.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias(vector)
    )


def topk_text(
    docs: DataFrame,
    queries: DataFrame,
    make_encoder,
    k: int = 5,
    *,
    key: str = "doc_id",
    text: str = "text",
    query_id: str = "query_id",
    query_text: str = "text",
    batch_size: int = 64,
    with_sentence: bool = True,
) -> DataFrame:
    """The reference's extraction end to end (E1): split documents into sentences, encode sentences
    and queries with the user's batch encoder, and keep the top-k sentences per (document, query).

    Output: (key, query_id, rank, score, sentence_index[, sentence]). Queries are
    encoded once (not once per document). Texts are clustered by key before they are split, so a task
    ranks whole documents: neither scores nor sentences are shuffled, and the sentence text rides along.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    from ..sources.sinks import encode_with
    from .terms import sentences as split_sentences

    spark = docs.sparkSession
    clustered = docs.select(key, text)
    clustered = clustered.repartition(key_partitions(clustered), key).sortWithinPartitions(key)
    sents = split_sentences(clustered, key=key, text=text)
    carry = ("sentence",) if with_sentence else ()
    sv = encode_with(sents, "sentence", make_encoder, batch_size=batch_size).select(key, "sentence_index", "embedding", *carry).where("embedding is not null")
    qv = encode_with(queries.select(query_id, query_text), query_text, make_encoder, batch_size=batch_size)
    qtype = queries.schema[query_id].dataType
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("query_id", qtype), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*fields, *[sv.schema[c] for c in ("sentence_index", *carry)]])
    out = None
    for ids, mat in _query_blocks(qv, query_id, "embedding", MAX_BROADCAST_QUERIES):
        task = _document_scorer(spark.sparkContext.broadcast((ids, mat)), key, "sentence_index", "embedding", k, carry, to_arrow_type(qtype))
        part = sv.mapInArrow(task, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


# the scorer's helpers travel with its closure to the Python workers
by_value(sys.modules[__name__], _vectors)
