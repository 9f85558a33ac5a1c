"""Term-count cosine search: the scorer used when no vectors are given (SIM2, ENC1 stand-in).

score(sentence, query) = sum_t tf_s(t) * tf_q(t) / (|tf_s| * |tf_q|) over the
alphabetic, lower-cased, non-stopword terms; rounded to 6 decimals.

:func:`topk_sparse` and :func:`compare_strategies` run the pruned search of
:mod:`pruned` (document blocks, running k-th score) while the framework's terms
are small enough to go to every task; beyond that check, the joins below.

Plan of the joins (one shuffle of the raw documents, then none):

1. ``repartition(doc key)``: every later stage -- sentence and term
   explosion, term counts, sentence norms (a window, not a join), the
   broadcast join to the query terms, the per (sentence, query) sum and the
   top-k window -- is clustered by the document key, so Catalyst plans them
   without another exchange. Raw text is the smallest thing to shuffle.
2. The query side (framework terms) is size-checked and broadcast; a hot
   term therefore never meets a shuffle. Beyond the limit it is a shuffle
   join on the term, with AQE's skew-join split as the backstop.
3. Pairs that share no term score 0 and are never materialised. Because
   torch.topk returns min(k, n) sentences even when they score 0, a
   (document, query) with m < min(k, n) nonzero rows is completed with the
   lowest unused sentence indexes at score 0 (G9); see ``_complete_topk``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import letter_tokens, sentence_array
from ..functions.vectors import ROUND_DIGITS
from ..functions.wordlists import ENGLISH_STOPWORDS
from . import pruned
from .guards import MAX_BROADCAST_QUERIES, MAX_BROADCAST_QUERY_TERMS, checked_broadcast, fetched_if_small, key_partitions, spread


def _not_stop(term: Column, stopwords) -> Column:
    return F.lit(True) if not stopwords else ~term.isin(list(stopwords))


def term_counts(df: DataFrame, keys: list[str], text: str, stopwords=ENGLISH_STOPWORDS) -> DataFrame:
    """(keys..., term, tf): term counts of each row's text."""
    toks = df.select(*keys, F.explode(letter_tokens(F.col(text))).alias("term"))
    return toks.where(_not_stop(F.col("term"), stopwords)).groupBy(*keys, "term").agg(F.count("*").cast("long").alias("tf"))


def query_terms(queries: DataFrame, qkeys: list[str], text: str, stopwords=ENGLISH_STOPWORDS) -> DataFrame:
    """(qkeys..., term, qtf, qnorm) for the query side."""
    qt = term_counts(queries, qkeys, text, stopwords)
    qn = qt.groupBy(*qkeys).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("qnorm"))
    return qt.join(qn, qkeys).select(*qkeys, "term", F.col("tf").alias("qtf"), "qnorm")


def document_sentences(docs: DataFrame, key: str, text: str, partitions: int | None = None) -> DataFrame:
    """(key, sentence_index, sentence), clustered by the document key (one shuffle of raw text)."""
    d = docs.select(key, text)
    # an explicit count: AQE would coalesce a by-column repartition to a few
    # tasks, but the text work after it is CPU-bound
    d = d.repartition(key_partitions(d, partitions), key)
    return d.select(key, F.posexplode(sentence_array(F.col(text))).alias("sentence_index", "sentence")).select(
        key, F.col("sentence_index").cast("long").alias("sentence_index"), "sentence"
    )


def sparse_scores(sents: DataFrame, qterms: DataFrame, qkeys: list[str], *, key: str, stopwords=ENGLISH_STOPWORDS) -> DataFrame:
    """(key, sentence_index, qkeys..., score) for pairs sharing at least one term."""
    tf = term_counts(sents, [key, "sentence_index"], "sentence", stopwords)
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(key, "sentence_index")))
    tf = tf.withColumn("norm", norm)
    side = checked_broadcast(qterms, MAX_BROADCAST_QUERY_TERMS, "query terms").df
    dots = tf.join(side, "term").groupBy(key, "sentence_index", *qkeys).agg(
        F.sum(F.col("tf") * F.col("qtf")).alias("dot"), F.max("norm").alias("norm"), F.max("qnorm").alias("qnorm")
    )
    score = F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), ROUND_DIGITS) + F.lit(0.0)
    return dots.select(key, "sentence_index", *qkeys, score.alias("score"))


def _query_keys(queries: DataFrame, qkeys: list[str]):
    """The framework's distinct keys with their count, broadcast only behind the size check."""
    return checked_broadcast(queries.select(*qkeys).distinct(), MAX_BROADCAST_QUERIES, "framework")


def _rank(scored: DataFrame, k: int, key: str, qkeys: list[str]) -> DataFrame:
    w = Window.partitionBy(key, *qkeys).orderBy(F.desc("score"), F.asc("sentence_index"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def attach_sentences(rows: DataFrame, sents: DataFrame, *, key: str = "doc_id", corpus_size: bool = False) -> DataFrame:
    """Adds the sentence text (and optionally the document's sentence count) to (key, sentence_index, ...) rows.

    Both inputs are clustered by the document key, so instead of a join
    (which at scale re-shuffles every sentence by (key, sentence_index)) the
    rows and the sentences are unioned and the text is spread with a window
    over (key, sentence_index): a local sort, no exchange. The sentence count
    is a second window over the key on the same sorted rows.
    """
    cols = [c for c in rows.columns if c not in (key, "sentence_index")]
    left = rows.select(key, "sentence_index", *cols, F.lit(None).cast("string").alias("sentence"), F.lit(True).alias("_row"))
    right = sents.select(
        key, "sentence_index", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in cols], "sentence",
        F.lit(False).alias("_row"),
    )
    both = left.unionByName(right).withColumn("sentence", F.max("sentence").over(Window.partitionBy(key, "sentence_index")))
    if corpus_size:
        both = both.withColumn("corpus_size", F.count_if(~F.col("_row")).over(Window.partitionBy(key)).cast("long"))
    return both.where(F.col("_row")).drop("_row")


def _complete_topk(sents: DataFrame, top: DataFrame, query_keys: DataFrame, k: int, key: str, qkeys: list[str]) -> DataFrame:
    """The ranked nonzero rows plus score-0 rows completing each (document, query) to min(k, n) rows.

    With m nonzero rows ranked, the fill is the lowest sentence indexes not
    among them, ranked m+1.. (ties at 0 go by sentence index); they all lie
    in [0, min(k, n)), so no pair outside the top-k is materialised. The
    per-document grid (the joined framework keys) and the ranked rows meet in one ``groupBy`` on
    (document, query) that collects at most k rows per group: both inputs
    are clustered by the document key, so it runs without an exchange, and
    the ranked rows are computed once.
    """
    row_t = "struct<rank:long,score:double,sentence_index:long>"
    sizes = sents.groupBy(key).agg(F.least(F.count("*"), F.lit(k)).cast("long").alias("kk"))
    grid = sizes.join(query_keys).select(key, *qkeys, "kk", F.lit(None).cast(row_t).alias("row"))
    ranked = top.select(
        key, *qkeys, F.lit(None).cast("long").alias("kk"),
        F.struct(F.col("rank").cast("long").alias("rank"), "score", "sentence_index").alias("row"),
    )
    g = grid.unionByName(ranked).groupBy(key, *qkeys).agg(F.max("kk").alias("kk"), F.collect_list("row").alias("rows"))
    g = g.where(F.col("kk").isNotNull())
    m = F.size("rows")
    taken = F.transform("rows", lambda r: r["sentence_index"])
    free = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("kk") - 1, F.lit(0))), lambda i: ~F.array_contains(taken, i))
    fill = F.transform(
        F.slice(free, 1, F.greatest(F.col("kk") - m, F.lit(0)).cast("int")),
        lambda i, j: F.struct((m + j + 1).cast("long").alias("rank"), F.lit(0.0).alias("score"), i.alias("sentence_index")),
    )
    out = g.select(key, *qkeys, F.explode(F.concat("rows", fill)).alias("r"))
    return out.select(key, *qkeys, "r.rank", "r.score", "r.sentence_index")


def topk_sparse(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    key: str = "doc_id",
    text: str = "text",
    query_keys=("query_id",),
    query_text: str = "text",
    stopwords=ENGLISH_STOPWORDS,
    partitions: int | None = None,
    with_sentence: bool = False,
    min_score: float | None = None,
    with_corpus_size: bool = False,
) -> DataFrame:
    """Top-k sentences per (document, query) by term-count cosine.

    Output: (key, qkeys..., rank, score, sentence_index[, sentence][, corpus_size]).

    ``min_score`` > 0 returns only the top-k rows scoring at least that much
    (the review candidates). It is exact: every row ranked above a row that
    reaches ``min_score`` reaches it too, so the filter runs *before* the
    window and the zero-score fill is not needed.
    """
    qkeys = list(query_keys)
    qterms = query_terms(queries.select(*qkeys, query_text), qkeys, query_text, stopwords)
    side = pruned.query_side(queries, qkeys, qterms)
    if side is not None:
        return pruned.topk_terms(
            docs, side, k, key=key, text=text, query_types=[queries.schema[c] for c in qkeys], stopwords=stopwords, partitions=partitions,
            with_sentence=with_sentence, min_score=min_score, with_corpus_size=with_corpus_size,
        )
    sents = document_sentences(docs, key, text, partitions)
    scored = sparse_scores(sents, qterms, qkeys, key=key, stopwords=stopwords)
    if min_score is not None and min_score > 0:
        top = _rank(scored.where(F.col("score") >= F.lit(float(min_score))), k, key, qkeys)
        out = top.select(key, *qkeys, F.col("rank").cast("long").alias("rank"), "score", "sentence_index")
    else:
        top = _rank(scored, k, key, qkeys)
        out = _complete_topk(sents, top, _query_keys(queries, qkeys).df, k, key, qkeys)
    if with_sentence or with_corpus_size:
        out = attach_sentences(out, sents, key=key, corpus_size=with_corpus_size)
    extra = ["sentence"] * with_sentence + ["corpus_size"] * with_corpus_size
    return out.select(key, *qkeys, F.col("rank").cast("long").alias("rank"), "score", "sentence_index", *extra)


def rarest_terms(
    docs: DataFrame, queries: DataFrame, n: int = 3, *, key: str = "doc_id", text: str = "text",
    query_keys=("query_id",), query_text: str = "text", stopwords=ENGLISH_STOPWORDS,
) -> DataFrame:
    """(qkeys..., keywords): each query's ``n`` terms with the lowest corpus document frequency.

    The corpus side is reduced to the query vocabulary by a (checked)
    broadcast semi join before the distinct count, so only query terms are
    counted; terms absent from the corpus have frequency 0. Ties by term.
    """
    qkeys = list(query_keys)
    qt = term_counts(queries.select(*qkeys, query_text), qkeys, query_text, stopwords).select(*qkeys, "term")
    vocab = checked_broadcast(qt.select("term").distinct(), MAX_BROADCAST_QUERY_TERMS, "query vocabulary").df
    dt = spread(docs.select(key, text)).select(key, F.explode(letter_tokens(F.col(text))).alias("term")).join(vocab, "term", "left_semi")
    df = dt.groupBy("term").agg(F.countDistinct(key).alias("df"))
    ranked = qt.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    w = Window.partitionBy(*qkeys).orderBy("df", "term")
    top = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return top.groupBy(*qkeys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda s: s["term"]).alias("keywords")
    )


def keyword_query(definition: Column, keywords: Column, sep: str = ". Related terms: ") -> Column:
    """The definition + keywords phrasing: ``"{definition}. Related terms: a, b"``."""
    return F.concat(definition, F.lit(sep), F.coalesce(F.array_join(keywords, ", "), F.lit("")))


def compare_strategies(
    docs: DataFrame, queries: DataFrame, k: int = 5, *, key: str = "doc_id", text: str = "text",
    query_id: str = "query_id", query_text: str = "text", keywords: DataFrame | None = None,
    stopwords=ENGLISH_STOPWORDS,
) -> DataFrame:
    """Both query phrasings scored in one pass (CMP1): per (document, strategy) the exact top-k sum.

    Output (key, strategy, score_micro, k_used, n_queries): ``score_micro`` is
    the sum of the top-k scores over all queries in units of 1e-6, ``k_used``
    = min(k, sentences). The mean top-k score of a (document, query) is its
    sum / k_used, and the document's mean over queries is
    score_micro / (k_used * n_queries). Zero-score rows add nothing to a sum,
    so only pairs sharing a term are ranked -- no zero fill is needed.

    The two phrasings share their terms, so the query side carries both term
    counts on one row per (query, term): one join and one aggregation give
    both dot products of every (sentence, query) pair.
    ``keywords``: (query_id, keywords array); derived with :func:`rarest_terms` when omitted.
    """
    if keywords is None:
        kw_plan = rarest_terms(docs, queries, key=key, text=text, query_keys=[query_id], query_text=query_text, stopwords=stopwords)
        # one row per query: fetched once where small, so that the branches reading it do not recompute it
        keywords = fetched_if_small(kw_plan, MAX_BROADCAST_QUERIES)
    defs = queries.select(query_id, F.col(query_text).alias("qtext"))
    kw = queries.join(keywords, query_id, "left").select(
        query_id, keyword_query(F.col(query_text), F.col("keywords")).alias("qtext")
    )
    phrased = defs.withColumn("_s", F.lit(0)).unionByName(kw.withColumn("_s", F.lit(1)))
    side = pruned.query_side(phrased, ["_s", query_id], query_terms(phrased, ["_s", query_id], "qtext", stopwords))
    if side is not None and side.keys:
        sums = pruned.topk_sums(docs, side, k, [r[0] for r in side.keys], key=key, text=text, stopwords=stopwords)
        name = F.when(F.col("group") == 0, "definition").otherwise("keywords")
        return sums.select(key, name.alias("strategy"), "score_micro", "k_used", F.lit(len(side.keys) // 2).cast("long").alias("n_queries"))
    qd = query_terms(defs, [query_id], "qtext", stopwords).select(query_id, "term", F.col("qtf").alias("qtf_d"), F.col("qnorm").alias("qn_d"))
    qk = query_terms(kw, [query_id], "qtext", stopwords).select(query_id, "term", F.col("qtf").alias("qtf_k"), F.col("qnorm").alias("qn_k"))
    both = qd.join(qk, [query_id, "term"], "full").select(
        query_id, "term", F.coalesce("qtf_d", F.lit(0)).alias("qtf_d"), F.coalesce("qtf_k", F.lit(0)).alias("qtf_k")
    )
    norms = qd.select(query_id, "qn_d").distinct().join(qk.select(query_id, "qn_k").distinct(), query_id, "full")
    side = checked_broadcast(both.join(norms, query_id, "left"), MAX_BROADCAST_QUERY_TERMS, "query terms").df
    n_queries = _query_keys(queries, [query_id]).rows
    if n_queries == 0:  # an empty framework has no means to compare
        return docs.sparkSession.createDataFrame(
            [], f"{key} {docs.schema[key].dataType.simpleString()}, strategy string, score_micro long, k_used long, n_queries long"
        )

    sents = document_sentences(docs, key, text)
    tf = term_counts(sents, [key, "sentence_index"], "sentence", stopwords)
    tf = tf.withColumn("norm", F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(key, "sentence_index"))))
    dots = tf.join(side, "term").groupBy(key, "sentence_index", query_id).agg(
        F.sum(F.col("tf") * F.col("qtf_d")).alias("dot_d"), F.sum(F.col("tf") * F.col("qtf_k")).alias("dot_k"),
        F.max("norm").alias("norm"), F.max("qn_d").alias("qn_d"), F.max("qn_k").alias("qn_k"),
    )

    def score(dot, qn):
        return F.round(F.col(dot) / (F.col("norm") * F.col(qn)), ROUND_DIGITS) + F.lit(0.0)

    pairs = dots.select(
        key, "sentence_index", query_id,
        F.explode(F.array(
            F.struct(F.lit("definition").alias("strategy"), score("dot_d", "qn_d").alias("score")),
            F.struct(F.lit("keywords").alias("strategy"), score("dot_k", "qn_k").alias("score")),
        )).alias("p"),
    ).select(key, "sentence_index", query_id, "p.strategy", "p.score").where(F.col("score") > 0)
    top = _rank(pairs, k, key, [query_id, "strategy"])
    micro = F.round(F.col("score") * F.lit(1e6)).cast("long")
    sums = top.groupBy(key, "strategy").agg(F.sum(micro).alias("score_micro"))
    sizes = sents.groupBy(key).agg(F.least(F.count("*"), F.lit(k)).cast("long").alias("k_used"))
    grid = sizes.select(key, "k_used", F.explode(F.array(F.lit("definition"), F.lit("keywords"))).alias("strategy"))
    return grid.join(sums, [key, "strategy"], "left").select(
        key, "strategy", F.coalesce("score_micro", F.lit(0)).cast("long").alias("score_micro"), "k_used",
        F.lit(n_queries).cast("long").alias("n_queries"),
    )


def document_strategy_means(sums: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, strategy, mean_micro, mean): a document's mean over queries of the mean top-k score.

    Rounded half-up to whole micro-units in integer arithmetic: such means
    often sit exactly on a rounding tie, and integer rounding resolves it the
    same way on every engine.
    """
    mean_micro = F.expr("(2 * score_micro + k_used * n_queries) div (2 * k_used * n_queries)")
    return sums.select(key, "strategy", mean_micro.alias("mean_micro"), (mean_micro / F.lit(1e6)).alias("mean"))
