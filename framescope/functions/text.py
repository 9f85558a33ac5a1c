"""Text as Column expressions: sentences, word counts, cleaning, tokens.

Every regular expression here is written so that it means the same in Java
(Spark) and RE2 (DuckDB, the oracle): no look-around, no ``(?U)`` flag (RE2
reads it as "ungreedy"), and an explicit whitespace class instead of ``\\s``
(whose meaning differs between the two engines).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split() whitespace: ASCII controls \t \n \v \f \r, \x1c-\x1f,
# NEL, and the Unicode separators (Zs, Zl, Zp), e.g. U+00A0 and U+202F.
WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
NON_WS = r"[^\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"

# Sentence rule [ours] (Punkt is a trained model): a run of . ! or ?,
# optionally closed by quotes or brackets, followed by whitespace, ends a
# sentence. Sentences are trimmed and empty ones dropped.
SENTENCE_END = "([.!?]+[\"”’)\\]]*)" + WS + "+"
_MARK = "\u0001"
TRIM = "^" + WS + "+|" + WS + "+$"

# Characters that are not Python-``\w`` and not whitespace (the archive's
# punctuation removal ``[^\w\s]``, with Unicode letters and digits).
PUNCT = r"[^\p{L}\p{N}_\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
LETTERS = r"\p{L}+"


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words, like ``len(text.split())``; NULL for NULL."""
    return F.regexp_count(text, F.lit(NON_WS + "+")).cast("long")


def trim_ws(s: Column) -> Column:
    return F.regexp_replace(s, TRIM, "")


_DOT = "\ue000"  # private-use stand-in for a period that does not end a sentence


def sentence_array(text: Column, abbreviations=()) -> Column:
    """The document's sentences in order, as an array (empty for NULL text).

    ``abbreviations`` (e.g. ``["e.g.", "i.e.", "et al."]``, matched without
    case on a word boundary) do not end a sentence: their periods are masked
    before the split and restored after it.
    """
    t = F.coalesce(text, F.lit(""))
    if abbreviations:
        alts = "|".join(re.escape(a.rstrip(".")) for a in sorted(abbreviations, key=len, reverse=True))
        # mask the final period of a listed abbreviation (inner periods are followed by a
        # letter and never end a sentence)
        t = F.regexp_replace(t, r"(?i)\b(" + alts + r")\.", "$1" + _DOT)
    # The break consumes all whitespace after the punctuation, so only the
    # document's own leading/trailing whitespace needs trimming: trim once,
    # split, drop empty pieces -- built-in array functions, no lambdas.
    marked = F.regexp_replace(trim_ws(t), SENTENCE_END, "$1" + _MARK)
    parts = F.array_remove(F.split(marked, _MARK), "")
    if abbreviations:
        parts = F.transform(parts, lambda x: F.replace(x, F.lit(_DOT), F.lit(".")))
    return parts


def strip_bom(text: Column) -> Column:
    """Drop a leading U+FEFF (files keep it by default, as the reference does)."""
    return F.regexp_replace(text, "^﻿", "")


def clean_text(text: Column) -> Column:
    """Archive cleaning: remove punctuation, trim, lower-case."""
    return F.lower(trim_ws(F.regexp_replace(text, PUNCT, "")))


def split_words(s: Column) -> Column:
    """Whitespace tokens of a string, empty pieces dropped."""
    return F.array_remove(F.split(s, WS + "+"), "")


def letter_tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters: the alphabetic tokens of a text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(LETTERS), 0)


#: a word with inner apostrophes, or one other sign that is no white space
TOKEN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*|[^\p{L}\p{N}\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"


def word_tokens(text: Column) -> Column:
    """Whole tokens in order: words (digits and inner apostrophes included) and single signs."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)


def is_alpha(token: Column) -> Column:
    """Is the whole token letters? ("don't" and "covid19" are not)"""
    return token.rlike(r"^\p{L}+$")


def file_slug(name: Column) -> Column:
    """Lower-case, spaces to underscores, '&' to 'and' (output file names)."""
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("&"), F.lit("and"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
