"""Sentences, cleaned tokens, word and phrase frequencies (CMP7, CMP16, CMP17, STR1-9).

Plans:

* ``sentences`` / ``corpus_size`` work inside each document row
  (``posexplode`` / ``size``): no shuffle.
* ``word_counts`` explodes tokens and aggregates by (group, term); the
  partial aggregation collapses hot terms on the map side.
* ``phrase_counts`` pairs adjacent tokens inside each sentence row: the
  token array zipped with itself shifted by one, exploded and filtered with
  ordinary (codegen'd) expressions. With a lemma table of any size, equal
  pairs are counted first and both tokens are then joined to it.
* ``top_terms`` ranks with ``row_number`` over the group; Catalyst puts a
  partial ``WindowGroupLimit`` before the shuffle, so a hot group sends at
  most n rows per partition.

Lemmas and part-of-speech tags come from a user table (surface, pos, lemma)
standing in for the reference's language model; a token absent from it
keeps its surface form and counts as content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, is_alpha, letter_tokens, sentence_array, split_words, word_tokens
from ..functions.wordlists import ANALYSIS_STOPWORDS, CONTENT_POS, ENGLISH_STOPWORDS
from .guards import checked_broadcast, spread

# Lemma tables up to this size are broadcast, larger ones are joined by a shuffle; the rows are the same.
MAX_INLINE_LEMMAS = 20_000


def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def sentences(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep=(), abbreviations=()) -> DataFrame:
    """(key, *keep, sentence_index, sentence): one row per sentence, index from 0 in document order.

    ``abbreviations`` lists forms such as "e.g." that do not end a sentence.
    """
    arr = sentence_array(F.col(text), abbreviations)
    # outer: of an inner explode Spark makes a filter on the array's size, and splits every text twice
    rows = docs.select(key, *keep, F.posexplode_outer(arr).alias("sentence_index", "sentence")).where("sentence is not null")
    return rows.select(
        key, *keep, F.col("sentence_index").cast("long").alias("sentence_index"), "sentence"
    )


def corpus_size(docs: DataFrame, *, key: str = "doc_id", text: str = "text", abbreviations=()) -> DataFrame:
    """(key, corpus_size): sentences per document; 0 when the text is missing."""
    return docs.select(key, F.size(sentence_array(F.col(text), abbreviations)).cast("long").alias("corpus_size"))


def _dedupe_lemmas(lemmas: DataFrame) -> DataFrame:
    """One (pos, lemma) per surface form, chosen deterministically (smallest lemma, then tag)."""
    best = F.min(F.struct("lemma", "pos"))
    return lemmas.groupBy("surface").agg(best.alias("b")).select("surface", F.col("b.pos").alias("pos"), F.col("b.lemma").alias("lemma"))


def _lemma_side(lemmas: DataFrame) -> DataFrame:
    """(surface, tag, lemma), broadcast only behind the size check."""
    table = _dedupe_lemmas(lemmas).select("surface", F.col("pos").alias("tag"), "lemma")
    return checked_broadcast(table, MAX_INLINE_LEMMAS, "lemma table").df


def _not_stop(term: Column, stopwords) -> Column:
    if stopwords is None:
        return F.lit(True)
    return ~term.isin(list(stopwords))


def clean_tokens(
    df: DataFrame, *, text: str = "text", stopwords=ENGLISH_STOPWORDS, lemmas: DataFrame | None = None
) -> DataFrame:
    """Archive cleaning (CMP7): adds ``clean_text_list`` (tokens without stopwords, lemmatised when a
    table is given) and ``clean_text_str`` (the tokens joined by spaces)."""
    toks = F.filter(split_words(clean_text(F.col(text))), lambda w: _not_stop(w, stopwords))
    if lemmas is not None:
        # tokens depend on the text alone: each distinct text is exploded, joined to the table and put together once
        key = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
        once = df.select(key.alias("_text_key"), toks.alias("_toks")).groupBy("_text_key").agg(F.first("_toks", ignorenulls=True).alias("_toks"))
        words = _apply_lemmas(once.select("_text_key", F.posexplode("_toks").alias("position", "surface")), lemmas)
        lists = words.groupBy("_text_key").agg(F.array_sort(F.collect_list(F.struct("position", "term"))).alias("_words"))
        df = df.withColumn("_text_key", key).join(lists, "_text_key", "left")
        none = F.array().cast("array<string>")
        toks = F.when(F.col(text).isNotNull(), F.coalesce(F.transform("_words", lambda w: w["term"]), none))
    out = df.withColumn("clean_text_list", toks).withColumn("clean_text_str", F.array_join("clean_text_list", " "))
    return out if lemmas is None else out.drop("_text_key", "_words")


def tokens_long(df: DataFrame, *, text: str = "text", keys=(), whole: bool = False) -> DataFrame:
    """(keys..., position, surface): alphabetic tokens of each row, lower-cased; ``whole``: tokens that are letters throughout, no runs of letters inside others."""
    if whole:
        toks = df.select(*keys, F.posexplode(word_tokens(F.col(text))).alias("position", "surface")).where(is_alpha(F.col("surface")))
        return toks.withColumn("surface", F.lower("surface"))
    return df.select(*keys, F.posexplode(letter_tokens(F.col(text))).alias("position", "surface"))


def _apply_lemmas(tokens: DataFrame, lemmas: DataFrame | None) -> DataFrame:
    """Adds ``term`` (lemma or surface) and ``tag`` (NULL when unknown) by a checked broadcast join."""
    if lemmas is None:
        return tokens.withColumn("term", F.col("surface")).withColumn("tag", F.lit(None).cast("string"))
    return tokens.join(_lemma_side(lemmas), "surface", "left").withColumn("term", F.coalesce(F.col("lemma"), F.col("surface")))


def word_counts(
    df: DataFrame,
    *,
    text: str = "text",
    by=None,
    stopwords=ANALYSIS_STOPWORDS,
    lemmas: DataFrame | None = None,
    min_length: int = 4,
    keep_pos=CONTENT_POS,
    whole: bool = False,
    surface_stopwords=None,
) -> DataFrame:
    """(by..., term, n): alphabetic words longer than ``min_length - 1`` on the surface,
    lemmatised, stopwords removed on the lemma, part of speech in ``keep_pos`` when known (G24).

    ``whole`` takes only tokens that are letters throughout ("don't" and "covid19"
    are dropped, not cut); ``surface_stopwords`` are removed before lemmas are looked up.
    """
    keys = _keys(by)
    toks = tokens_long(spread(df.select(*keys, text)), text=text, keys=keys, whole=whole).where(F.length("surface") >= min_length)
    toks = _apply_lemmas(toks.where(_not_stop(F.col("surface"), surface_stopwords)), lemmas)
    cond = _not_stop(F.col("term"), stopwords)
    if keep_pos is not None and lemmas is not None:
        cond = cond & (F.col("tag").isNull() | F.col("tag").isin(list(keep_pos)))
    return toks.where(cond).groupBy(*keys, "term").agg(F.count("*").cast("long").alias("n"))


def phrase_counts(
    df: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    by=None,
    stopwords=ANALYSIS_STOPWORDS,
    lemmas: DataFrame | None = None,
    min_length: int = 3,
) -> DataFrame:
    """(by..., phrase, n): two adjacent kept tokens of one sentence, joined by a space (re-aimed noun chunks).

    A token is kept when its surface has at least ``min_length`` letters and its
    lemma is not a stopword.
    """
    keys = _keys(by)
    keep = [k for k in keys if k != key]
    sents = sentences(spread(df.select(key, *keep, text)), key=key, text=text, keep=keep)
    # adjacent pairs as rows: the token array zipped with itself shifted by one (built-in array
    # functions, no lambdas), then an ordinary filter on both tokens
    toks = sents.select(*keys, letter_tokens(F.col("sentence")).alias("toks"))
    m = F.greatest(F.size("toks") - 1, F.lit(0))
    pairs = toks.select(
        *keys, F.explode(F.arrays_zip(F.slice("toks", 1, m).alias("a"), F.slice("toks", 2, m).alias("b"))).alias("_p")
    ).select(*keys, F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b"))
    pairs = pairs.where((F.length("_a") >= min_length) & (F.length("_b") >= min_length))
    if lemmas is None:
        phrases = pairs.where(_not_stop(F.col("_a"), stopwords) & _not_stop(F.col("_b"), stopwords))
        return phrases.groupBy(*keys, F.concat_ws(" ", "_a", "_b").alias("phrase")).agg(F.count("*").cast("long").alias("n"))
    # equal pairs are counted first, so the two joins see one row per distinct pair
    pairs = pairs.groupBy(*keys, "_a", "_b").agg(F.count("*").cast("long").alias("_n"))
    side = _lemma_side(lemmas)
    for c in ("_a", "_b"):
        lemma = side.select(F.col("surface").alias(c), F.col("lemma").alias("_lemma"))
        pairs = pairs.join(lemma, c, "left").withColumn(f"_t{c}", F.coalesce("_lemma", c)).drop("_lemma")
    phrases = pairs.where(_not_stop(F.col("_t_a"), stopwords) & _not_stop(F.col("_t_b"), stopwords))
    return phrases.groupBy(*keys, F.concat_ws(" ", "_t_a", "_t_b").alias("phrase")).agg(F.sum("_n").cast("long").alias("n"))


def top_terms(counts: DataFrame, n: int, *, by=None, term: str = "term") -> DataFrame:
    """(by..., rank, term, n, weight): the n most frequent terms per group, ties by term;
    ``weight`` = count / the group's largest count (word-cloud weight, MTH4)."""
    keys = _keys(by)
    order = [F.desc("n"), F.asc(term)]
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order)
        ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    else:
        # global top-n: TakeOrderedAndProject (partial top-n per partition), then rank the n rows
        top = counts.orderBy(*order).limit(n)
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    mx = F.max("n").over(Window.partitionBy(*keys))
    return ranked.select(
        *keys, F.col("rank").cast("long").alias("rank"), term, "n", (F.round(F.col("n") / mx, 6) + F.lit(0.0)).alias("weight")
    )
