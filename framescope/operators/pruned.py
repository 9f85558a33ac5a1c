"""Rank-safe pruned term-count search: the k best sentences of each (document, query) without scoring every pair.

The same result as the joins in :mod:`sparse`, computed inside Arrow tasks. The
documents are clustered by key once; a task reads the term arrays of some
documents' sentences at a time, and postings of both sides meet in numpy:

* sentences are taken by rising norm in layers (the first ``LAYER`` of each
  document, then twice as many, ...): a short sentence can score highest, so the
  running k-th score is high after the first layer;
* in later layers, or where ``min_score`` sets a bar from the start, runs of
  ``BLOCK`` sentences have their terms' greatest impacts (count over norm). The
  sum of a query's terms' impacts bounds every score in the run: where it stays
  below the bar, the pairs of that run and query are never summed.

Scores are rounded to 6 decimals half up, as Spark rounds, before they are
compared; ties go to the earlier sentence. Counts are whole numbers, so sums do
not depend on their order. Size, sentence text and the zero-score rows that
complete a top k come from the same pass: there is no second derivation of the
sentences, no window and no aggregation. A document that does not fit in
``CHUNK`` sentences is taken in chunks that hand on their k best.

The query side goes to every task behind a check of rows and bytes
(:func:`query_side`); beyond it the caller joins by shuffle instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import by_value
from ..functions.text import letter_tokens, sentence_array
from .guards import MAX_BROADCAST_QUERIES, MAX_BROADCAST_QUERY_TERMS, key_partitions

#: bytes of query terms that may go to every task
MAX_QUERY_BYTES = 64 << 20
LAYER, BLOCK, CHUNK = 64, 8, 1 << 15


class QuerySide:
    """Query keys in order and their term counts: ``term``, ``query`` and ``count`` of every entry, sorted by term."""

    def __init__(self, keys: list, entries: list[tuple[str, int, int]]):
        self.keys = keys
        entries = sorted(entries)
        self.words = pa.array(sorted({w for w, _, _ in entries}), pa.string())
        place = {w: i for i, w in enumerate(self.words.to_pylist())}
        self.term = np.array([place[w] for w, _, _ in entries], np.int64)
        self.query = np.array([q for _, q, _ in entries], np.int64)
        self.count = np.array([n for _, _, n in entries], np.float64)
        self.norm = np.sqrt(np.bincount(self.query, weights=self.count * self.count, minlength=len(keys)))

        self.ptr = np.searchsorted(self.term, np.arange(len(self.words) + 1))

    def meet(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For postings of the other side, places of their own and of this side's, one pair for each common term."""
        size = self.ptr[term + 1] - self.ptr[term]
        own = np.repeat(np.arange(len(term)), size)
        return own, np.arange(len(own)) + np.repeat(self.ptr[term] - (np.cumsum(size) - size), size)


def query_side(queries: DataFrame, qkeys: list[str], qterms: DataFrame) -> QuerySide | None:
    """The query side when it is small enough for every task, else None (two small counting jobs decide)."""
    keys = queries.select(*qkeys).distinct().limit(MAX_BROADCAST_QUERIES + 1).collect()
    size = qterms.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)).alias("b")).first()
    if len(keys) > MAX_BROADCAST_QUERIES or size["n"] > MAX_BROADCAST_QUERY_TERMS or size["b"] > MAX_QUERY_BYTES:
        return None
    keys = sorted((tuple(r) for r in keys), key=lambda r: tuple((x is not None, x) for x in r))
    at = {k: i for i, k in enumerate(keys)}
    return QuerySide(keys, [(r["term"], at[tuple(r[c] for c in qkeys)], r["qtf"]) for r in qterms.collect()])


def micro(x: np.ndarray) -> np.ndarray:
    """Non-negative doubles in whole millionths, half up on their shortest decimal form."""
    y = x * 1e6
    out = np.floor(y + 0.5)
    for i in zip(*np.nonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6), strict=True):
        out[i] = int(Decimal(repr(float(x[i]))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return out.astype(np.int64)


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(key)
    key = key[by]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(value[by], first) if len(first) else np.zeros(0)


class Found:
    """Best rows of documents: ``group`` (document x queries + query), ``score`` in millionths, ``place`` of the sentence; sorted, at most k a group."""

    def __init__(self, group=None, score=None, place=None):
        none = np.zeros(0, np.int64)
        self.group, self.score, self.place = (none if x is None else x for x in (group, score, place))

    def best(self, other: Found, k: int) -> Found:
        group, score, place = (np.concatenate(x) for x in zip((self.group, self.score, self.place), (other.group, other.score, other.place), strict=True))
        by = np.lexsort((place, (group << 20) - score))
        group = group[by]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        nth = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        by = by[nth < k]
        return Found(group[nth < k], score[by], place[by])

    def bars(self, wanted: np.ndarray, k: int, least: int) -> np.ndarray:
        """k-th best score of each group, ``least`` where there are fewer rows."""
        lo, hi = np.searchsorted(self.group, wanted), np.searchsorted(self.group, wanted, side="right")
        last = self.score[np.maximum(hi - 1, 0)] if len(self.group) else np.zeros(len(wanted), np.int64)
        return np.where(hi - lo >= k, np.maximum(last, least), least)

    def of(self, document: int, queries: int) -> Found:
        cut = slice(*np.searchsorted(self.group, [document * queries, (document + 1) * queries]))
        return Found(self.group[cut] - document * queries, self.score[cut], self.place[cut])

    def __len__(self):
        return len(self.group)


class Scorer:
    """Scores sentences of whole documents, or chunks of one; ``scored`` counts the pairs that were summed."""

    def __init__(self, side: QuerySide, k: int, least: int):
        self.side, self.k, self.least, self.scored = side, k, least, 0

    def run(self, row, term, count, norm, document, place, found: Found) -> Found:
        """Postings in the query vocabulary (``row``, ``term``, ``count``) of sentences with ``norm``, ``document`` and ``place``."""
        size = len(norm)
        by = np.lexsort((place, norm, document))
        first = np.flatnonzero(np.append(True, document[by][1:] != document[by][:-1])) if size else np.zeros(0, np.int64)
        nth = np.empty(size, np.int64)
        nth[by] = np.arange(size) - np.repeat(first, np.diff(np.append(first, size)))
        # layer 0 has the first LAYER sentences, layer j the next LAYER * 2**(j - 1)
        layer = np.ceil(np.log2(np.maximum((nth + 1) / LAYER, 1))).astype(np.int64)
        # runs of sentences of one document and layer, in order of norm
        run = np.empty(size, np.int64)
        opens = np.append(True, (nth[by][1:] % BLOCK == 0) | (layer[by][1:] != layer[by][:-1]) | (document[by][1:] != document[by][:-1])) if size else np.zeros(0, bool)
        run[by] = np.cumsum(opens) - 1
        of = layer[row]
        for j in np.unique(of).tolist():
            own = np.flatnonzero(of == j)
            found = found.best(self._layer(row[own], term[own], count[own], norm, document, place, run, found, bounded=bool(j or self.least or len(found))), self.k)
        return found

    def _layer(self, row, term, count, norm, document, place, run, found, bounded) -> Found:
        side, n = self.side, len(self.side.keys)
        here, there = side.meet(term)
        if bounded:
            cell, impact = self._impacts(run[row] * len(side.words) + term, count / norm[row])
            h, t = side.meet(cell % len(side.words))
            pair, bound = _summed(cell[h] // len(side.words) * n + side.query[t], impact[h] * side.count[t] / side.norm[side.query[t]])
            of_run = np.zeros(int(run.max()) + 1, np.int64)
            of_run[run] = document
            bar = found.bars(of_run[pair // n] * n + pair % n, self.k, self.least)
            # in millionths, with room for rounding
            live = pair[bound * (1e6 * (1 + 1e-9)) + 1 >= bar]
            mine = run[row[here]] * n + side.query[there]
            at = np.minimum(np.searchsorted(live, mine), max(len(live) - 1, 0))
            ok = live[at] == mine if len(live) else np.zeros(len(mine), bool)
            here, there = here[ok], there[ok]
        pair, dot = _summed(row[here] * n + side.query[there], count[here] * side.count[there])
        self.scored += len(pair)
        r, q = pair // n, pair % n
        score = micro(dot / (norm[r] * side.norm[q]))
        some = score > 0
        return Found((document[r] * n + q)[some], score[some], place[r][some])

    @staticmethod
    def _impacts(cell, impact):
        by = np.argsort(cell)
        cell = cell[by]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        return cell[first], np.maximum.reduceat(impact[by], first) if len(first) else np.zeros(0)


def completed(found: Found, sizes: np.ndarray, queries: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``group, rank, score, place`` with zero-score rows of the first unused places up to ``min(k, size)`` rows a group."""
    kk = np.repeat(np.minimum(sizes, k), queries)
    n = np.bincount(found.group, minlength=len(kk))
    first = np.cumsum(n) - n
    rank = np.arange(len(found)) - first[found.group]
    used = np.zeros((len(kk), k), bool)
    low = found.place < k
    used[found.group[low], found.place[low]] = True
    free = np.argsort(used, axis=1, kind="stable")
    lack = kk - n
    group = np.repeat(np.arange(len(kk)), lack)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(lack) - lack, lack)
    out = [np.concatenate(x) for x in ((found.group, group), (rank, n[group] + nth), (found.score, np.zeros(len(group), np.int64)), (found.place, free[group, nth]))]
    by = np.argsort(out[0] * (k + 1) + out[1])
    group, rank, score, place = (x[by] for x in out)
    return group, rank + 1, score, place


def _runs(key: pa.Array) -> np.ndarray:
    """First rows of the runs of equal keys."""
    a, b = key.slice(0, len(key) - 1), key.slice(1)
    differ = pc.or_(pc.xor(a.is_null(), b.is_null()), pc.not_equal(a, b).fill_null(False))
    return np.append(0, np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool]]:
    """Rows sorted by document: whole documents of a batch with their first rows; a large one in chunks, not ``last`` until its end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            batch = pa.concat_batches([*held, batch])
        start = _runs(batch.column(0))
        if start[-1]:
            yield batch.slice(0, int(start[-1])), start[:-1], True
        rest = batch.slice(int(start[-1]))
        while rest.num_rows > CHUNK:
            yield rest.slice(0, CHUNK), np.zeros(1, np.int64), False
            rest = rest.slice(CHUNK)
        held = [rest]
    if held and held[0].num_rows:
        yield held[0], np.zeros(1, np.int64), True


def _scorer(side: QuerySide, k: int, min_score: float, emit, stopwords):
    """Task over sorted rows (key, sentence_index, terms, ...): ``emit`` makes the output of the finished documents of a batch."""
    scorer = Scorer(side, k, int(min_score * 1e6))
    stop = pa.array(sorted(stopwords or ()), pa.string())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, before, carried = Found(), 0, []  # of a document that goes on in the next chunk
        for batch, start, last in _documents(batches):
            terms = batch.column(2)
            size = np.diff(terms.offsets.to_numpy())
            coded = terms.flatten().dictionary_encode()
            words = coded.dictionary.cast(pa.string())
            word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n_words = max(1, len(words))
            known = pc.index_in(words, value_set=side.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            kept = ~pc.is_in(words, value_set=stop).to_numpy(zero_copy_only=False)[word] if len(word) else np.zeros(0, bool)
            cell, count = np.unique(np.repeat(np.arange(len(size)), size)[kept] * n_words + word[kept], return_counts=True)
            row, term = cell // n_words, known[cell % n_words] if len(cell) else cell
            norm = np.sqrt(np.bincount(row, weights=count.astype(np.float64) ** 2, minlength=len(size)))
            own = term >= 0
            sizes = np.diff(np.append(start, batch.num_rows))
            document = np.repeat(np.arange(len(start)), sizes)
            place = np.arange(len(size)) - start[document] + before
            found = scorer.run(row[own], term[own], count[own].astype(np.float64), np.maximum(norm, 1.0), document, place, found)
            if last:
                yield from emit(batch, start, sizes + before, found, before, carried)
                found, before, carried = Found(), 0, []
            else:
                carried = _carry(carried, batch, before, found, k)
                before += batch.num_rows

    return rows


def _carry(carried: list, batch: pa.RecordBatch, first: int, found: Found, k: int) -> list:
    """``(place, row)`` of a large document's sentences that its result may name: the best of each query, and the first k."""
    wanted = set(found.place.tolist()) | set(range(k))
    mine = sorted(p for p in wanted if first <= p < first + batch.num_rows)
    return [(p, r) for p, r in carried if p in wanted] + [(p, batch.slice(p - first, 1)) for p in mine]


def _emit_rows(side_keys: list[pa.Array], queries: int, k: int, min_score: float, with_sentence: bool, with_size: bool):
    def emit(batch, start, sizes, found, before, carried) -> Iterator[pa.RecordBatch]:
        if min_score:
            high = found.score / 1e6 >= min_score
            found = Found(found.group[high], found.score[high], found.place[high])
            first = np.searchsorted(found.group, found.group)
            group, rank, score, place = found.group, np.arange(len(found)) - first + 1, found.score, found.place
        else:
            group, rank, score, place = completed(found, sizes, queries, k)
        document, query = group // queries if queries else group, group % queries if queries else group
        # rows of the batch, or of chunks before it (then the batch is one document)
        source, at = batch, start[document] + place - before
        if before:
            source = pa.concat_batches([batch, *(r for _, r in carried)])
            held = np.array([p for p, _ in carried], np.int64)
            by = np.argsort(held)
            at = np.where(place >= before, at, batch.num_rows + by[np.minimum(np.searchsorted(held[by], place), len(by) - 1)])
        for lo in range(0, len(at), 1 << 16):
            cut = slice(lo, lo + (1 << 16))
            row, q = pa.array(at[cut]), pa.array(query[cut])
            columns = [source.column(0).take(row), *(x.take(q) for x in side_keys), pa.array(rank[cut]), pa.array(score[cut] / 1e6), source.column(1).take(row)]
            if with_sentence:
                columns.append(source.column(3).take(row))
            if with_size:
                columns.append(pa.array(sizes[document[cut]]))
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])

    return emit


def sentence_terms(docs: DataFrame, key: str, text: str, partitions: int | None = None, with_sentence: bool = False) -> DataFrame:
    """(key, sentence_index, terms[, sentence]) sorted by document inside partitions clustered by it (one shuffle of raw text)."""
    d = docs.select(key, text)
    # an explicit count: AQE would coalesce the CPU-bound text work to a few tasks
    d = d.repartition(key_partitions(d, partitions), key).sortWithinPartitions(key)
    # outer: of an inner explode Spark makes a filter on the array's size, and splits every text before the shuffle too
    sents = d.select(key, F.posexplode_outer(sentence_array(F.col(text))).alias("sentence_index", "sentence")).where("sentence is not null")
    terms = letter_tokens(F.col("sentence"))
    return sents.select(key, F.col("sentence_index").cast("long").alias("sentence_index"), terms.alias("terms"), *(["sentence"] if with_sentence else []))


def topk_terms(
    docs: DataFrame, side: QuerySide, k: int, *, key: str, text: str, query_types: list[T.StructField], stopwords,
    partitions: int | None = None, with_sentence: bool = False, min_score: float | None = None, with_corpus_size: bool = False,
) -> DataFrame:
    """(key, qkeys..., rank, score, sentence_index[, sentence][, corpus_size]) of the k best sentences of each (document, query)."""
    least = float(min_score) if min_score is not None and min_score > 0 else 0.0
    sents = sentence_terms(docs, key, text, partitions, with_sentence)
    fields = [
        T.StructField(key, docs.schema[key].dataType), *query_types, T.StructField("rank", T.LongType()),
        T.StructField("score", T.DoubleType()), T.StructField("sentence_index", T.LongType()),
    ]
    if with_sentence:
        fields.append(T.StructField("sentence", T.StringType()))
    if with_corpus_size:
        fields.append(T.StructField("corpus_size", T.LongType()))
    from pyspark.sql.pandas.types import to_arrow_type

    keys = [pa.array([r[i] for r in side.keys], to_arrow_type(f.dataType)) for i, f in enumerate(query_types)]
    task = _scorer(side, k, least, _emit_rows(keys, len(side.keys), k, least, with_sentence, with_corpus_size), stopwords)
    return sents.mapInArrow(task, T.StructType(fields))


def _emit_sums(groups: np.ndarray, n_groups: int, k: int):
    """Per document and group of queries the sum of the k best scores in millionths."""

    def emit(batch, start, sizes, found, before, carried) -> Iterator[pa.RecordBatch]:
        n = len(groups)
        cell = found.group // n * n_groups + groups[found.group % n]
        total = np.bincount(cell, weights=found.score, minlength=len(start) * n_groups).astype(np.int64)
        key = batch.column(0).take(pa.array(np.repeat(start, n_groups)))
        columns = [key, pa.array(np.tile(np.arange(n_groups), len(start))), pa.array(total), pa.array(np.repeat(np.minimum(sizes, k), n_groups))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "group", "score_micro", "k_used"])

    return emit


def topk_sums(docs: DataFrame, side: QuerySide, k: int, groups: list[int], *, key: str, text: str, stopwords) -> DataFrame:
    """(key, group, score_micro, k_used): per document the top-k scores summed over each group of queries; ``groups`` numbers them in order."""
    of = np.array(groups, np.int64)
    fields = [T.StructField(key, docs.schema[key].dataType)] + [T.StructField(c, T.LongType()) for c in ("group", "score_micro", "k_used")]
    task = _scorer(side, k, 0.0, _emit_sums(of, int(of.max(initial=-1)) + 1, k), stopwords)
    return sentence_terms(docs, key, text).mapInArrow(task, T.StructType(fields))


def _register() -> None:
    import sys

    by_value(sys.modules[__name__])


_register()
