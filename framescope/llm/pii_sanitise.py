"""PII: information-theoretic sanitisation, with DataFrame functions only.

Protected entities are the e-mail addresses, IP addresses, card and phone
numbers found by fixed patterns: each value, and each kind as a class. Terms are
runs of letters and digits of any length, outside the entities. Over all distinct texts, a
term reveals an entity as far as the corpus makes it likely given the term
anywhere in the text: ``P(e | t) = (texts with both + PRIOR * P(e)) / (texts with
t + PRIOR)`` (the prior keeps a word of one text from being evidence) and
the information ``log2(P(e | t) / P(e))``. Terms with positive information whose
greatest ``P(e | t)`` reaches ``GENERALISE`` are replaced by a general mark,
those reaching ``REMOVE`` are removed, wherever they stand, in texts without the
entity too; both become spans of kind ``term``.

Counting terms is a group with map-side combine; a frequent term or entity is
one row per task in the exchange. Values that stand in too few texts to reach
``GENERALISE`` with any term meet no terms. Positions are folded in runs, so a
text of many spans costs its length, not its square.

Defined cases: NULL text is empty. Rows of one ``doc_id`` with different texts
are kept apart; rows with NULL ``doc_id`` take part. Copies of one text count
once. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm import common as C
from framescope.llm import spans as S

KINDS = ["email", "ip", "card", "phone"]
PRIOR, GENERALISE, REMOVE = 1.5, 0.5, 0.9
_TERM = r"[\p{L}\p{N}]++"
# possessive forms and the run-start test change no match; they keep long runs linear
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"[0-9](?:[ -]?[0-9]){11,}+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_MARK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "gone": ""}


def _digits(x):
    return F.regexp_replace(x["value"], "[^0-9]", "")


def _luhn(x):
    """Digits doubled at every second place from the right; the sum is a multiple of 10."""
    d = F.reverse(_digits(x))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise(
        F.substr(d, i, F.lit(1)).cast("int") * 2 - F.when(F.substr(d, i, F.lit(1)) >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Columns ``email, ip, card, phone`` with the base spans of ``text``."""
    t = F.col(text)
    df = S.add_spans(df, text, "email", _EMAIL, gate=F.contains(t, F.lit("@")))
    df = S.add_spans(df, text, "ip", _IP, lambda x: F.forall(F.split(x["value"], r"\."), lambda n: F.length(F.regexp_replace(n, "^0+(?=.)", "")).between(1, 3) & (F.regexp_replace(n, "^0+(?=.)", "").try_cast("long") <= 255)))
    df = S.add_spans(df, text, "card", _CARD, lambda x: F.length(_digits(x)).between(12, 19) & _luhn(x))
    return S.add_spans(df, text, "phone", _PHONE, lambda x: F.length(_digits(x)).between(9, 15), gate=F.contains(t, F.lit("+")))


def _terms(text):
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)))


def pii_sanitise(docs: DataFrame) -> DataFrame:
    """``doc_id, th, text, sanitised, base, all_spans`` per row; ``base`` and ``all_spans`` are arrays of ``(start, rank, end, kind, value)``."""
    # a NULL doc_id still needs a key for its spans
    rows = C.keyed(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    keys = ["key", "th"]
    found = C.written(base_spans(rows).withColumn("base", S.merged(KINDS)).where(F.size("base") > 0).select(*keys, "text", "base").dropDuplicates(keys), "base")
    # texts with entities, these blanked out: places stay as they are
    blank = S.replaced("text", "blocks", "base", lambda x, n: F.repeat(F.lit(" "), n))
    plain = C.written(found.withColumn("blocks", S.blocks(F.col("text"))).withColumn("plain", blank).drop("blocks"), "plain")

    n = rows.agg(F.countDistinct("th")).first()[0]
    once = plain.dropDuplicates(["th"])
    name = F.transform("base", lambda x: F.concat_ws(":", x["kind"], F.lower(x["value"])))
    entities = once.select("th", F.explode(F.array_distinct(F.concat(name, F.transform("base", lambda x: x["kind"])))).alias("entity"))
    share = lambda both, texts_t, texts_e: (both + PRIOR * texts_e / n) / (texts_t + PRIOR)
    sizes = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("texts"))
    # with any term, at best all the entity's texts and no other hold it
    sizes = C.written(sizes.where(share(F.col("texts"), F.col("texts"), F.col("texts")) >= GENERALISE), "entities")
    near = once.select("th", F.explode(_terms(F.col("plain"))).alias("term")).join(entities.join(sizes, "entity"), "th")
    together = C.written(near.groupBy("entity", "term", "texts").agg(F.count(F.lit(1)).alias("both")), "together")

    # texts that hold a term: all rows, less the rows that repeat a text; where entities stand, by the text without them
    again = rows.groupBy("th").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    repeats = rows.dropDuplicates(["th"]).join(again, "th").select(F.explode(_terms(F.col("text"))).alias("term"), (1 - F.col("k")).alias("n"))
    whole, bare = _terms(F.col("text")), _terms(F.col("plain"))
    inside = once.select(F.explode(F.array_except(whole, bare)).alias("term"), F.lit(-1).cast("long").alias("n"))
    freed = once.select(F.explode(F.array_except(bare, whole)).alias("term"), F.lit(1).cast("long").alias("n"))
    held = rows.select(F.explode(whole).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    held = held.unionByName(repeats).unionByName(inside).unionByName(freed).groupBy("term").agg(F.sum("n").alias("holds"))
    judged = together.join(held, "term").withColumn("share", share(F.col("both"), F.col("holds"), F.col("texts")))
    judged = judged.where((F.col("share") >= GENERALISE) & (F.log2(F.col("share") * n / F.col("texts")) > 0))
    judged = C.written(judged.groupBy("term").agg(F.max("share").alias("share")), "judged")

    # the texts that hold a judged term, and its places there outside the entities
    standing = rows.select(*keys, F.explode(whole).alias("term")).unionByName(plain.select(*keys, F.explode(bare).alias("term")))
    hit = standing.join(judged.select("term"), "term", "left_semi").select(*keys).distinct()
    texts = rows.dropDuplicates(keys).join(C.written(hit, "hit"), keys).join(plain.select(*keys, "plain"), keys, "left").select(*keys, F.coalesce("plain", "text").alias("plain"))
    words = S.add_spans(texts, "plain", "words", _TERM).select(*keys, F.explode("words").alias("w")).select(*keys, "w.start", "w.end", F.lower("w.value").alias("term"))
    own = words.join(judged, "term").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "start", F.lit(len(KINDS)).alias("rank"), "end", F.when(F.col("share") >= REMOVE, "gone").otherwise("term").alias("kind"), F.col("term").alias("value")))).alias("terms"))
    out = rows.join(found.select(*keys, "base"), keys, "left").join(C.written(own, "terms"), keys, "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    out = out.withColumn("base", F.coalesce("base", none)).withColumn("marks", F.array_sort(F.concat("base", F.coalesce("terms", none))))
    out = out.withColumn("blocks", F.when(F.size("marks") > 0, S.blocks(F.col("text"))))
    mark = F.create_map(*[F.lit(x) for kv in _MARK.items() for x in kv])
    clean = S.replaced("text", "blocks", "marks", lambda x, _: F.element_at(mark, x["kind"]))
    all_spans = F.transform("marks", lambda x: x.withField("kind", F.when(x["kind"] == "gone", "term").otherwise(x["kind"])))
    return out.select("doc_id", "th", "text", clean.alias("sanitised"), "base", all_spans.alias("all_spans"))


def digest(found: DataFrame, kinds: list[str] = KINDS) -> DataFrame:
    """The contract's columns: counts by kind, hash of the base spans, all spans written out."""

    def of(kind: str):
        return lambda x: x["kind"] == kind

    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(S.written_out(F.col("base")), 256).alias("base_sha256"), S.written_out(F.col("all_spans")).alias("spans"))
