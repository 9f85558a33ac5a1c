"""Sentence boundaries learned from the corpus (STR1): abbreviations, collocations and sentence starters.

No list and no tagged text is needed. After Kiss and Strunk, "Unsupervised
multilingual sentence boundary detection" (2006), everything is a
log-likelihood ratio over counts of the corpus itself:

* an **abbreviation** is a type that (nearly) always has a period, corrected for
  its length, inner periods and the times it stands without one;
* a **sentence starter** stands after certain sentence ends more often than chance;
* a **collocation** is a pair around a period (of an abbreviation, number or
  initial) that belongs together, so no sentence ends between.

Plans: equal tokens are counted before one of each is described, and pairs (token
arrays zipped with themselves shifted by one: no window, no shuffle of text) are
only described where a sentence may end or a capital follows, since no other pair
counts for anything. Scores are Column expressions over the counts, so the model is four
small tables, none of which comes to the driver. Splitting a text first cuts it
at every candidate (the rule of :mod:`functions.text`), then joins each
candidate's two tokens to the tables (broadcast only behind the size check) and
puts together the pieces no boundary stands between.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NON_WS, SENTENCE_END, WS, split_words, trim_ws
from .guards import MAX_BROADCAST_LOOKUP, checked_broadcast, kept, spread

# Thresholds of the published method.
ABBREVIATION, COLLOCATION, STARTER, ALWAYS = 0.3, 7.88, 30.0, 0.99

OPENERS = "[\"“”‘’'(\\[{]+"
CLOSERS = "[,;:\"“”‘’')\\]}]+"
EDGES = f"^{OPENERS}|{CLOSERS}$"
NUMBER = "^[-+]?[0-9][0-9.,]*$"
#: the type all numbers share
NUMBERS = "##number##"
SURE_END = "[!?][\"”’)\\]]*$"
_MARK = "\u0001"


def core(token: Column) -> Column:
    """The token without quotes, brackets and commas around it."""
    return F.regexp_replace(token, EDGES, "")


def has_period(token: Column) -> Column:
    """One period at the end (not dots of an ellipsis)."""
    return core(token).rlike(r"[^.]\.$")


def type_of(token: Column) -> Column:
    """Lower-cased, without its final period; all numbers are one type."""
    bare = F.regexp_replace(core(token), r"\.$", "")
    return F.when(bare.rlike(NUMBER), F.lit(NUMBERS)).otherwise(F.lower(bare))


def _shape(token: Column) -> Column:
    c = core(token)
    return F.when(c.rlike(r"^\p{Lu}"), "upper").when(c.rlike(r"^\p{Ll}"), "lower").otherwise("none")


def _described(df: DataFrame, a: str, b: str, *keep: str) -> DataFrame:
    """The two tokens around a place, described; ``sure`` marks an exclamation or question mark."""
    t, n = F.col(a), F.col(b)
    return df.select(
        *keep, type_of(t).alias("type"), has_period(t).alias("period"), t.rlike(SURE_END).alias("sure"), _shape(t).alias("shape"),
        type_of(n).alias("next"), _shape(n).alias("next_shape"),
    )


def _tokens(docs: DataFrame, text: str) -> DataFrame:
    return spread(docs.select(text)).select(split_words(F.col(text)).alias("t"))


def _raw_pairs(docs: DataFrame, text: str) -> DataFrame:
    pairs = _tokens(docs, text).select(F.explode_outer(F.arrays_zip(F.col("t").alias("a"), F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))).alias("b"))).alias("p"))
    return pairs.where("p is not null").select("p.a", "p.b")


def token_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every token with the next one of its text (NULL for the last)."""
    return _described(_raw_pairs(docs, text), "a", "b")


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(type, n_with, n_without, n_lower): tokens of each type with and without a period, and lower-cased; equal tokens are described once."""
    equal = _tokens(docs, text).select(F.explode_outer("t").alias("a")).where("a is not null").groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    each = equal.select("n", type_of(F.col("a")).alias("type"), has_period(F.col("a")).alias("period"), _shape(F.col("a")).alias("shape"))
    of = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    return each.groupBy("type").agg(of(F.col("period")).alias("n_with"), of(~F.col("period")).alias("n_without"), of(F.col("shape") == "lower").alias("n_lower"))


def telling_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """:func:`token_pairs` of those that can count: the first may end a sentence, or the next has a capital. Other pairs have no period, no sure end and no capital."""
    a, b = F.col("a"), F.col("b")
    may_end = F.contains(a, F.lit(".")) | F.contains(a, F.lit("!")) | F.contains(a, F.lit("?"))
    pairs = _raw_pairs(docs, text).where(b.isNotNull()).where(may_end | b.rlike(f"^(?:{OPENERS})?\\p{{Lu}}"))
    return _described(pairs, "a", "b")


def _times_log(n: Column, p: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(n * F.ln(F.greatest(p, F.lit(1e-300))))


def likelihood_ratio(n_a: Column, n_b: Column, n_ab: Column, n: Column) -> Column:
    """Dunning's -2 log lambda: is ``b`` as likely after ``a`` as elsewhere?"""
    p, p1, p2 = n_b / n, n_ab / n_a, (n_b - n_ab) / (n - n_a)
    only_a, only_b, neither = n_a - n_ab, n_b - n_ab, n - n_a - n_b + n_ab
    same = _times_log(n_ab, p) + _times_log(only_a, 1 - p) + _times_log(only_b, p) + _times_log(neither, 1 - p)
    apart = _times_log(n_ab, p1) + _times_log(only_a, 1 - p1) + _times_log(only_b, p2) + _times_log(neither, 1 - p2)
    return -2 * (same - apart)


@dataclass
class Boundaries:
    """The model: ``abbreviations(type, n, score)``, ``starters(type, n, score)``, ``collocations(type, next, n, score)``
    and ``spelling(type, n_lower, n_upper)`` (lower-cased anywhere; capitalised after no period)."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    spelling: DataFrame

    def table(self) -> DataFrame:
        """All learned entries: (kind, type, next, n, score)."""
        none = F.lit(None).cast("string").alias("next")
        rows = self.abbreviations.select(F.lit("abbreviation").alias("kind"), "type", none, "n", "score")
        rows = rows.unionByName(self.starters.select(F.lit("starter").alias("kind"), "type", none, "n", "score"))
        return rows.unionByName(self.collocations.select(F.lit("collocation").alias("kind"), "type", "next", "n", "score"))


def _side(df: DataFrame, what: str) -> DataFrame:
    return checked_broadcast(df, MAX_BROADCAST_LOOKUP, what).df


def _letter(column: str) -> Column:
    return F.col(column).rlike(r"\p{L}")


def learn(docs: DataFrame, *, text: str = "text") -> Boundaries:
    """Counts over the whole corpus, scored; two scans of the text."""
    counts = kept(token_counts(docs, text))
    total = F.broadcast(counts.agg(F.sum(F.col("n_with") + F.col("n_without")).alias("n_tokens"), F.sum("n_with").alias("n_period")))

    a, ab, p = F.col("n_with") + F.col("n_without"), F.col("n_with"), F.col("n_period") / F.col("n_tokens")
    ratio = -2 * (_times_log(ab, p) + _times_log(a - ab, 1 - p) - _times_log(ab, F.lit(ALWAYS)) - _times_log(a - ab, F.lit(1 - ALWAYS)))
    bare = F.char_length(F.replace("type", F.lit("."), F.lit("")))
    dots = F.char_length("type") - bare + 1
    score = ratio * F.exp(-bare.cast("double")) * dots * F.pow(bare.cast("double"), -F.col("n_without").cast("double"))
    abbreviations = (
        counts.where((F.col("n_with") > 0) & _letter("type") & (F.col("type") != NUMBERS)).crossJoin(total)
        .select("type", F.col("n_with").alias("n"), score.alias("score")).where(F.col("score") >= ABBREVIATION)
    )

    known = _side(abbreviations.select("type", F.lit(True).alias("abbreviation")), "abbreviations")
    seen = telling_pairs(docs, text).join(known, "type", "left").withColumn("abbreviation", F.coalesce("abbreviation", F.lit(False)))
    initial = F.col("period") & F.col("type").rlike(r"^\p{L}$")
    number = F.col("period") & (F.col("type") == NUMBERS)
    end = F.col("sure") | (F.col("period") & ~F.col("abbreviation") & ~initial & ~number)
    weak = F.col("period") & (F.col("abbreviation") | initial | number)
    after = seen.groupBy("type", "next").agg(
        F.count_if(end).alias("n_end"), F.count_if(weak).alias("n_weak"),
        F.count_if((F.col("next_shape") == "upper") & ~F.col("period") & ~F.col("sure")).alias("n_upper"),
    )
    after = kept(after)
    nexts = after.groupBy("next").agg(F.sum("n_end").alias("n_end"), F.sum("n_upper").alias("n_upper"))
    ends = F.broadcast(nexts.agg(F.sum("n_end").alias("n_ends")))

    size = counts.select("type", (F.col("n_with") + F.col("n_without")).alias("n_type"), "n_lower")
    n, n_type = F.col("n_tokens"), F.col("n_type")
    candidates = nexts.where("n_end > 0").withColumnRenamed("next", "type").where(_letter("type")).join(size, "type").crossJoin(total).crossJoin(ends)
    starters = candidates.select(
        "type", F.col("n_end").alias("n"), likelihood_ratio(F.col("n_ends"), n_type, F.col("n_end"), n).alias("score"),
        (F.col("n_end") * n > n_type * F.col("n_ends")).alias("more"),
    ).where((F.col("score") >= STARTER) & F.col("more")).drop("more")

    other = size.select(F.col("type").alias("next"), F.col("n_type").alias("n_next"))
    pairs2 = after.where("n_weak > 1").where(_letter("next")).select("type", "next", "n_weak").join(size.select("type", "n_type"), "type").join(other, "next").crossJoin(total)
    collocations = pairs2.select(
        "type", "next", F.col("n_weak").alias("n"), likelihood_ratio(n_type, F.col("n_next"), F.col("n_weak"), n).alias("score"),
        (F.col("n_weak") * n > n_type * F.col("n_next")).alias("more"),
    ).where((F.col("score") >= COLLOCATION) & F.col("more")).drop("more")

    spelling = size.select("type", "n_lower").join(nexts.select(F.col("next").alias("type"), "n_upper"), "type", "left").select("type", "n_lower", F.coalesce("n_upper", F.lit(0)).alias("n_upper"))
    return Boundaries(abbreviations, starters, collocations, spelling)


def _is_boundary() -> Column:
    """Does a sentence end at a candidate? Columns as :func:`split` joins them."""
    upper = F.col("next_shape") == "upper"
    starts = upper & (F.col("starter") | ((F.col("n_lower") > 0) & (F.col("n_upper") == 0)))
    return (
        F.when(F.col("sure") | ~F.col("period"), True)
        .when(F.col("collocation"), False)
        .when(F.col("abbreviation"), starts)
        .when(F.col("type").rlike(r"^\p{L}$"), ~(upper & (F.col("n_lower") == 0)))
        .when(F.col("type") == NUMBERS, F.col("next_shape") != "lower")
        .otherwise(True)
    )


def split(docs: DataFrame, model: Boundaries, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence_index, sentence): every text split at the candidates that the model takes for boundaries.

    Text inside a sentence stays as it is, line ends included; sentences are
    trimmed. NULL or empty text has none. Repeated keys keep their rows apart.
    """
    mark = F.regexp_replace(trim_ws(F.coalesce(F.col(text), F.lit(""))), SENTENCE_END[:-1].removesuffix(WS) + f"({WS}+)", "$1" + _MARK + "$2")
    rows = spread(docs.select(key, text)).select(F.monotonically_increasing_id().alias("_row"), key, F.split(mark, _MARK).alias("p"))
    rows = rows.select("_row", key, F.posexplode_outer(F.arrays_zip(F.col("p").alias("a"), F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))).alias("b"))).alias("_at", "_p")).where("_p is not null")
    first = lambda s: F.regexp_extract(s, f"^{WS}*({NON_WS}+)", 1)
    a, b = F.reverse(first(F.reverse("_p.a"))), first(F.col("_p.b"))
    rows = rows.select("_row", key, "_at", F.col("_p.a").alias("_piece"), F.nullif(a, F.lit("")).alias("_a"), F.nullif(b, F.lit("")).alias("_b"))
    d = _described(rows, "_a", "_b", "_row", key, "_at", "_piece")
    flag = F.lit(True)
    d = d.join(_side(model.abbreviations.select("type", flag.alias("abbreviation")), "abbreviations"), "type", "left")
    d = d.join(_side(model.collocations.select("type", "next", flag.alias("collocation")), "collocations"), ["type", "next"], "left")
    nexts = model.spelling.join(model.starters.select("type", flag.alias("starter")), "type", "left").withColumnRenamed("type", "next")
    d = d.join(_side(nexts, "spelling"), "next", "left")
    d = d.fillna({"abbreviation": False, "collocation": False, "starter": False, "n_lower": 0, "n_upper": 0})
    before = Window.partitionBy("_row").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("_row", key, "_at", "_piece", F.coalesce(F.sum(_is_boundary().cast("long")).over(before), F.lit(0)).alias("sentence_index"))
    whole = d.groupBy("_row", key, "sentence_index").agg(F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_all"))
    sentence = trim_ws(F.array_join(F.transform("_all", lambda x: x["_piece"]), ""))
    return whole.select(key, "sentence_index", sentence.alias("sentence")).where(F.col("sentence") != "")
