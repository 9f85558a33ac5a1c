"""Text functions: sentence rule, word count (G19), cleaning (G20), BOM (G18), tokens, phrases."""

from pyspark.sql import functions as F

from framescope.functions import text as tx
from framescope.operators import terms


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


def test_sentence_split_rule(spark):
    s = 'First one. Second? "Quoted!" Then (bracketed.) last\nno end'
    assert one(spark, tx.sentence_array, s) == ["First one.", "Second?", '"Quoted!"', "Then (bracketed.)", "last\nno end"]


def test_sentence_split_keeps_decimals_and_drops_blank(spark):
    assert one(spark, tx.sentence_array, "Pay 3.5 units.   \n\n  Next.") == ["Pay 3.5 units.", "Next."]
    assert one(spark, tx.sentence_array, None) == []
    assert one(spark, tx.sentence_array, "   ") == []


def test_word_count_matches_python_split(spark):
    samples = ["a b\tc\nd", "x y z", "﻿bom start", "  lead and trail  ", "", "nbsp sep", "vt\x0bff\x0c"]
    for s in samples:
        assert one(spark, tx.word_count, s) == len(s.split()), s
    assert one(spark, tx.word_count, None) is None


def test_clean_text_unicode_word_chars(spark):
    # Python's \w is Unicode: accented letters and digits stay, punctuation goes
    import re

    s = "Équité, pay-rates (2024) & naïve_user!"
    expected = re.sub(r"[^\w\s]", "", s).strip().lower()
    assert one(spark, tx.clean_text, s) == expected


def test_bom_kept_by_default_and_stripped_on_request(spark):
    s = "﻿Hello world."
    assert one(spark, tx.sentence_array, s)[0].startswith("﻿")
    assert one(spark, tx.strip_bom, s) == "Hello world."


def test_sentences_and_corpus_size(spark):
    docs = spark.createDataFrame([(1, "A b. C d! E"), (2, None), (3, "One.")], "doc_id long, text string")
    rows = terms.sentences(docs).orderBy("doc_id", "sentence_index").collect()
    assert [(r.doc_id, r.sentence_index, r.sentence) for r in rows] == [(1, 0, "A b."), (1, 1, "C d!"), (1, 2, "E"), (3, 0, "One.")]
    sizes = {r.doc_id: r.corpus_size for r in terms.corpus_size(docs).collect()}
    assert sizes == {1: 3, 2: 0, 3: 1}


def test_clean_tokens_stopwords_and_lemmas(spark):
    docs = spark.createDataFrame([(1, "The Workers' rights, and the wages!")], "doc_id long, text string")
    out = terms.clean_tokens(docs).first()
    assert out.clean_text_list == ["workers", "rights", "wages"]
    assert out.clean_text_str == "workers rights wages"
    lem = spark.createDataFrame([("workers", "NOUN", "worker"), ("wages", "NOUN", "wage")], "surface string, pos string, lemma string")
    assert terms.clean_tokens(docs, lemmas=lem).first().clean_text_list == ["worker", "rights", "wage"]


def test_word_counts_length_stopwords_pos(spark):
    docs = spark.createDataFrame(
        [(1, "Fair wages matter. Workers need fair wages and safety; the union runs."), (2, "Wages wages")],
        "doc_id long, text string",
    )
    counts = {r.term: r.n for r in terms.word_counts(docs).collect()}
    # > 3 letters; 'workers'/'need' are custom stopwords; 'the'/'and' too short anyway
    assert counts == {"fair": 2, "wages": 4, "matter": 1, "safety": 1, "union": 1, "runs": 1}
    lem = spark.createDataFrame(
        [("wages", "NOUN", "wage"), ("runs", "VERB", "run"), ("fair", "ADJ", "fair"), ("matter", "AUX", "matter")],
        "surface string, pos string, lemma string",
    )
    counts = {r.term: r.n for r in terms.word_counts(docs, lemmas=lem).collect()}
    # stopwords are tested on the lemma, length on the surface; AUX is not a content tag; unknown tags kept
    assert counts == {"fair": 2, "wage": 4, "safety": 1, "union": 1, "run": 1}


def test_phrase_counts_adjacent_kept_pairs(spark):
    docs = spark.createDataFrame([(1, "Fair wages for all. Fair wages now! Safe work. Health and safety rules")], "doc_id long, text string")
    counts = {r.phrase: r.n for r in terms.phrase_counts(docs).collect()}
    # 'for', 'all', 'and', 'work' are stopwords -> no pair across them; pairs never cross sentences
    assert counts == {"fair wages": 2, "safety rules": 1}


def test_phrase_counts_join_path_equals_inline_path(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Fair wages matter. Safe jobs matter"), (2, "Fair pay and fair wages")], "doc_id long, text string")
    lem = spark.createDataFrame([("wages", "NOUN", "wage"), ("jobs", "NOUN", "job")], "surface string, pos string, lemma string")
    inline = sorted(tuple(r) for r in terms.phrase_counts(docs, lemmas=lem).collect())
    monkeypatch.setattr(terms, "MAX_INLINE_LEMMAS", 0)
    joined = sorted(tuple(r) for r in terms.phrase_counts(docs, lemmas=lem).collect())
    assert inline == joined
    assert inline == sorted([("fair wage", 2), ("wage matter", 1), ("safe job", 1), ("job matter", 1), ("fair pay", 1)])


def test_phrases_of_rows_sharing_a_key_stay_apart(spark):
    docs = spark.createDataFrame([("t", "alpha beta gamma"), ("t", "delta omega sigma")], "title string, text string")
    lem = spark.createDataFrame([("beta", "NOUN", "bet")], "surface string, pos string, lemma string")
    counts = {r.phrase: r.n for r in terms.phrase_counts(docs, key="title", lemmas=lem).collect()}
    assert counts == {"alpha bet": 1, "bet gamma": 1, "delta omega": 1, "omega sigma": 1}


def test_clean_tokens_lemmas_of_any_table_size(spark, monkeypatch):
    rows = [(1, "Wages, wages rise"), (2, None), (3, ""), (4, "Wages, wages rise")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lem = spark.createDataFrame([("wages", "NOUN", "wage")], "surface string, pos string, lemma string")
    want = [(1, ["wage", "wage", "rise"]), (2, None), (3, []), (4, ["wage", "wage", "rise"])]
    for limit in (terms.MAX_INLINE_LEMMAS, 0):
        monkeypatch.setattr(terms, "MAX_INLINE_LEMMAS", limit)
        out = terms.clean_tokens(docs, lemmas=lem)
        assert out.columns == ["doc_id", "text", "clean_text_list", "clean_text_str"]
        assert sorted((r.doc_id, r.clean_text_list) for r in out.collect()) == want


def test_top_terms_ties_and_weights(spark):
    counts = spark.createDataFrame([("b", 5), ("a", 5), ("c", 2), ("d", 1)], "term string, n long")
    rows = terms.top_terms(counts, 3).orderBy("rank").collect()
    assert [(r.rank, r.term, r.n, r.weight) for r in rows] == [(1, "a", 5, 1.0), (2, "b", 5, 1.0), (3, "c", 2, 0.4)]
    g = spark.createDataFrame([("x", "a", 4), ("x", "b", 2), ("y", "c", 1)], "g string, term string, n long")
    rows = terms.top_terms(g, 1, by="g").orderBy("g").collect()
    assert [(r.g, r.term, r.weight) for r in rows] == [("x", "a", 1.0), ("y", "c", 1.0)]


def test_file_slug_and_base_name(spark):
    assert one(spark, tx.file_slug, "Health & Safety Risks") == "health_and_safety_risks"
    assert one(spark, tx.base_name, "/a/b/c.txt") == "c.txt"


def test_phrase_counts_grouped_by_the_document_key(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Fair wages matter."), (2, "Fair wages now. Fair pay.")], "doc_id long, text string")
    lem = spark.createDataFrame([("wages", "NOUN", "wage")], "surface string, pos string, lemma string")
    inline = sorted(tuple(r) for r in terms.phrase_counts(docs, by="doc_id", lemmas=lem).collect())
    monkeypatch.setattr(terms, "MAX_INLINE_LEMMAS", 0)
    joined = sorted(tuple(r) for r in terms.phrase_counts(docs, by="doc_id", lemmas=lem).collect())
    assert inline == joined == [(1, "fair wage", 1), (1, "wage matter", 1), (2, "fair pay", 1), (2, "fair wage", 1)]


def test_sentence_split_with_abbreviations(spark):
    docs = spark.createDataFrame([(1, "See e.g. the note by Smith et al. on pay. Next one. I.e. done.")], "doc_id long, text string")
    plain = [r.sentence for r in terms.sentences(docs).orderBy("sentence_index").collect()]
    assert len(plain) == 6
    kept = [r.sentence for r in terms.sentences(docs, abbreviations=["e.g.", "i.e.", "et al."]).orderBy("sentence_index").collect()]
    assert kept == ["See e.g. the note by Smith et al. on pay.", "Next one.", "I.e. done."]
    assert terms.corpus_size(docs, abbreviations=["e.g.", "i.e.", "et al."]).first().corpus_size == 3


def test_stopwords_are_an_argument(spark):
    # The stopword list is a parameter of the operator, not a global defined later
    docs = spark.createDataFrame([(1, "Workers need fair wages; workers want safety.")], "doc_id long, text string")
    default = {r.term for r in terms.word_counts(docs).collect()}
    assert "workers" not in default and "need" not in default
    custom = {r.term: r.n for r in terms.word_counts(docs, stopwords=["fair"]).collect()}
    assert custom == {"workers": 2, "need": 1, "wages": 1, "want": 1, "safety": 1}
    assert {r.term for r in terms.word_counts(docs, stopwords=None).collect()} == {"workers", "need", "fair", "wages", "want", "safety"}
