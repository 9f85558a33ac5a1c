"""Secret scan by character Markov models, with DataFrame functions only.

Base spans come from fixed patterns (assignments, access keys, long hex runs).
Two first-order character models are trained from labelled samples of the
corpus itself: strings of values that the base patterns found (random), and
ordinary identifiers, words of the same alphabet outside those spans that stand in two texts or more. A token is
a further secret when the sum of its transitions' log-likelihood ratios (random
against ordinary) reaches ``THRESHOLD`` and ``PER_CHAR`` on average: the ratio
decides, for every token of ``MIN_LENGTH`` or more characters, which is less
than any token that can reach the threshold has in practice. Tokens that hold or
touch a base span are judged too; only those inside one add nothing.

Samples are bounded: the documents of least hash, about ``SAMPLE_DOCS``, and of
them the ``SAMPLES`` values of least hash of each kind; the tables have one cell
for each pair of ASCII characters. Scanning covers every whole text
in its own row, with no exchange.

Defined cases: NULL text is empty. Without samples of both kinds no span is
added to the base ones. Tokens of digits alone are numbers, not secrets. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescope.llm import spans as S

KINDS = ["assign", "access", "hex"]
MIN_LENGTH, THRESHOLD, PER_CHAR, SAMPLES, SAMPLE_DOCS, BACK_OFF = 8, 12.0, 0.6, 20_000, 50_000, 8.0
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
_ACCESS = r"AKIA[A-Z0-9]{16,}+"
_HEX = r"(?:\G|(?<![0-9a-f]))[0-9a-f]{24,}+"
_TOKEN = rf"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}+"
_WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_]{5,}+"
_SIDE = 128
#: characters of tokens
_ALPHABET = [*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_=-")]


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Columns ``assign, access, hex`` with the base spans of ``text``."""
    gate = F.col(text).rlike(r"(?i:passw|secret|token|api_?key)")
    df = S.add_spans(df, text, "assign", _ASSIGN, lambda x: F.length(x["part"]) >= 6, gate=gate, group=1)
    df = S.add_spans(df, text, "access", _ACCESS, gate=F.contains(F.col(text), F.lit("AKIA")))
    return S.add_spans(df, text, "hex", _HEX)


def _steps(token, each):
    """``each(cell)`` for every pair of neighbouring characters; tokens are ASCII."""
    code = lambda i: F.ascii(F.substr(token, i, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: each(code(i) * _SIDE + code(i + 1)))


def train(docs: DataFrame, samples: int = SAMPLES, sample_docs: int = SAMPLE_DOCS) -> list[float] | None:
    """Log-likelihood ratio of every transition, or None without samples of both kinds."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    share = min(1.0, sample_docs / max(texts.count(), 1))
    texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = base_spans(texts)
    secret = F.concat(F.transform("assign", lambda x: x["part"]), F.transform("access", lambda x: x["value"]), F.transform("hex", lambda x: x["value"]))
    marked = rows.select("text", secret.alias("secret"))
    take = lambda df: df.select("s").where(F.col("s").rlike(r"^[\x21-\x7E]{2,}$")).distinct().orderBy(F.xxhash64("s"), "s").limit(samples)
    random = take(marked.select(F.explode("secret").alias("s")).where(F.length("s") >= 8)).withColumn("kind", F.lit(1))
    # ordinary words come again: those of two or more of the texts
    words = F.array_except(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(_WORD), F.lit(0))), F.col("secret"))
    again = marked.select(F.explode(words).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    plain = take(again).withColumn("kind", F.lit(0))
    counts = random.unionByName(plain).select("kind", F.explode(_steps(F.col("s"), lambda c: c)).alias("cell")).groupBy("kind", "cell").agg(F.count(F.lit(1)).alias("n")).collect()
    if len({r["kind"] for r in counts}) < 2:
        return None
    n = {k: {} for k in (0, 1)}
    for r in counts:
        n[r["kind"]].setdefault(r["cell"] // _SIDE, {})[r["cell"] % _SIDE] = r["n"]
    into = {k: {b: sum(row.get(b, 0) for row in rows.values()) for b in range(_SIDE)} for k, rows in n.items()}
    total = {k: sum(x.values()) for k, x in into.items()}

    def share(k: int, a: int, b: int) -> float:
        """P(b | a), backed off to how often b is reached at all: a first character never seen says nothing by itself."""
        any_ = (into[k][b] + 0.5) / (total[k] + 0.5 * len(_ALPHABET))
        row = n[k].get(a, {})
        return (row.get(b, 0) + BACK_OFF * any_) / (sum(row.values()) + BACK_OFF)

    return [math.log(share(1, a, b) / share(0, a, b)) if a in _ALPHABET and b in _ALPHABET else 0.0 for a in range(_SIDE) for b in range(_SIDE)]


def secret_scan(docs: DataFrame, model: list[float] | None, threshold: float = THRESHOLD, per_char: float = PER_CHAR) -> DataFrame:
    """``doc_id, text, base, all_spans`` per row of ``docs``; spans are arrays of ``(start, rank, end, kind, value)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = base_spans(rows).withColumn("base", S.merged(KINDS))
    if model is None:
        return found.select("doc_id", "text", "base", F.col("base").alias("all_spans"))
    table = F.array(*[F.lit(float(x)) for x in model])

    found = S.add_spans(found, "text", "markov", _TOKEN)
    outside = F.filter("markov", lambda x: x["value"].rlike("[A-Za-z]") & ~F.exists("base", lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"])))
    ratio = lambda x: F.aggregate(_steps(x["value"], lambda c: F.element_at(table, c + 1)), F.lit(0.0), lambda a, b: a + b)
    judged = F.filter(F.transform(outside, lambda x: x.withField("ratio", ratio(x))), lambda x: (x["ratio"] >= threshold) & (x["ratio"] >= per_char * F.length(x["value"])))
    found = found.withColumn("markov", judged)
    return found.select("doc_id", "text", "base", S.merged([*KINDS, "markov"]).alias("all_spans"))
