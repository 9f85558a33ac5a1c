"""Part-of-speech tags, noun chunks and lemmas learned from tagged words (STR6-STR8).

* **Tags** (:func:`train`, :func:`tag`): a second-order hidden Markov tagger
  after Brants, "TnT" (2000). Tag trigrams, word and suffix counts are
  aggregations over the tagged corpus; trigram weights come from deleted
  interpolation. A word that was never tagged takes the tag distribution of its
  longest suffixes among rare words, smoothed from short to long. Emissions are a
  table by distinct word and join the tokens (broadcast only behind the size
  check), so the lexicon may be of any size; a task decodes one sentence at a
  time (Viterbi) and holds only the transitions, at most ``MAX_TAGS`` cubed.
* **Noun chunks** (:func:`noun_chunks`, :func:`chunk_phrases`): the pattern
  ``modifier* noun+`` run over each sentence's tag sequence, written as one
  character a token; tokens are filtered inside a chunk, and exactly two must be left.
* **Lemmas** (:func:`learn_lemmas`, :func:`lemmatise`): each (surface, lemma) is
  an edit script, letters to cut and letters to add; every suffix keeps its most
  frequent script, and a word takes that of its longest known suffix.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import by_value
from ..functions.text import is_alpha
from ..functions.wordlists import ANALYSIS_STOPWORDS, ENGLISH_STOPWORDS
from .guards import MAX_BROADCAST_LOOKUP, checked_broadcast, kept

START, END = "<s>", "</s>"
#: words tagged at most this often teach the suffixes, of up to this many letters
RARE, SUFFIX = 10, 10
MAX_TAGS = 64
MODIFIERS, NOUNS = ("DET", "ADJ", "NUM"), ("NOUN", "PROPN")


# ---- tagger ----------------------------------------------------------------------


@dataclass
class TagModel:
    """Counts of a tagged corpus: ``trigrams(t1, t2, t3, n)``, ``words(word, tag, n)``, ``suffixes(suffix, tag, n)``."""

    trigrams: DataFrame
    words: DataFrame
    suffixes: DataFrame


def train(tagged: DataFrame, sentence: list[str], *, position: str = "position", token: str = "token", tag: str = "tag") -> TagModel:
    """Counts of ``tagged``, one row a token; ``sentence`` names the key columns of a sentence. Rows without token or tag are left out."""
    known = tagged.where(F.col(token).isNotNull() & F.col(tag).isNotNull()).select(*sentence, F.col(position).alias("_p"), F.lower(token).alias("_w"), F.col(tag).alias("_t"))
    return _counted(_gathered(known, sentence))


def train_sentences(sentences: DataFrame, keys: list[str], repeated: DataFrame, *, tokens: str = "tokens", tags: str = "tags") -> TagModel:
    """:func:`train` of sentences that stand as arrays, without NULLs; rows with the same ``keys`` are one sentence.

    ``repeated`` has the values of some of ``keys`` that more than one row may share: only these rows
    are brought together token by token, the others are counted where they are.
    """
    side = checked_broadcast(repeated.distinct(), MAX_BROADCAST_LOOKUP, "repeated keys").df
    side = side.select(*[F.col(c).alias(f"_{c}") for c in side.columns], F.lit(True).alias("_again"))
    same = [sentences[c].eqNullSafe(side[f"_{c}"]) for c in repeated.columns]
    rows = sentences.select(*keys, tokens, tags).join(side, same, "left")
    again = rows.where("_again").select(*keys, F.posexplode(F.arrays_zip(F.col(tokens).alias("w"), F.col(tags).alias("t"))).alias("_p", "_x"))
    again = _gathered(again.select(*keys, "_p", F.lower("_x.w").alias("_w"), F.col("_x.t").alias("_t")), keys)
    own = rows.where("_again is null").select(F.col(tokens).alias("w"), F.col(tags).alias("t"))
    return _counted(own.unionByName(again))


def _gathered(known: DataFrame, sentence: list[str]) -> DataFrame:
    """(w, t): words and tags of each sentence in order of position."""
    whole = known.groupBy(*sentence).agg(F.array_sort(F.collect_list(F.struct("_p", "_w", "_t"))).alias("_all"))
    return whole.select(F.col("_all._w").alias("w"), F.col("_all._t").alias("t"))


def _counted(sentences: DataFrame) -> TagModel:
    """The model from one pass over (w, t): trigrams and words are counted together, a word as a triple without third."""
    padded = F.concat(F.array(F.lit(START), F.lit(START)), F.col("t"), F.array(F.lit(END)))
    n = F.size("t") + 1
    three = F.arrays_zip(F.slice("p", 1, n).alias("t1"), F.slice("p", 2, n).alias("t2"), F.slice("p", 3, n).alias("t3"))
    one = F.arrays_zip(F.col("w").alias("t1"), F.col("t").alias("t2"), F.array_repeat(F.lit(None).cast("string"), F.size("t")).alias("t3"))
    both = sentences.where(F.size("t") > 0).withColumn("p", padded).select(F.explode_outer(F.concat(three, one)).alias("x")).where("x is not null")
    counts = kept(both.groupBy("x.t1", "x.t2", "x.t3").agg(F.count(F.lit(1)).alias("n")))
    trigrams = counts.where("t3 is not null")
    words = counts.where("t3 is null").groupBy(F.lower("t1").alias("word"), F.col("t2").alias("tag")).agg(F.sum("n").alias("n"))
    rare = words.withColumn("_total", F.sum("n").over(Window.partitionBy("word"))).where(F.col("_total") <= RARE)
    suffixes = rare.select(F.explode(_suffixes("word")).alias("suffix"), "tag", "n").groupBy("suffix", "tag").agg(F.sum("n").alias("n"))
    return TagModel(trigrams, words, suffixes)


def _suffixes(word: str, least: int = 1) -> Column:
    length = F.char_length(word)
    sizes = F.when(length >= least, F.sequence(F.lit(least), F.least(length, F.lit(SUFFIX)))).otherwise(F.array().cast("array<int>"))
    return F.transform(sizes, lambda i: F.right(F.col(word), i))


class Transitions:
    """Interpolated log probabilities ``log p(t3 | t1, t2)`` over ``tags``; the last two places are start and end."""

    def __init__(self, counts: list[tuple[str, str, str, int]]):
        seen = sorted({t for *three, _ in counts for t in three} - {START, END})
        if len(seen) > MAX_TAGS:
            raise ValueError(f"{len(seen)} tags; the transitions of at most {MAX_TAGS} go to a task")
        self.tags = [*seen, START, END]
        place = {t: i for i, t in enumerate(self.tags)}
        n3 = np.zeros((len(self.tags),) * 3)
        for a, b, c, n in counts:
            n3[place[a], place[b], place[c]] += n
        n2 = n3.sum(0)  # (t2, t3), each token once
        n1 = n2.sum(0)
        before2, before1, total = n3.sum(2), n2.sum(1), n1.sum()

        def share(a, b):
            return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=np.asarray(b) > 0)

        # deleted interpolation: each trigram votes for the estimate that predicts it best without itself
        votes = np.zeros(3)
        for a, b, c in zip(*np.nonzero(n3), strict=True):
            n = n3[a, b, c]
            own = [float(share(n1[c] - 1, total - 1)), float(share(n2[b, c] - 1, before1[b] - 1)), float(share(n - 1, before2[a, b] - 1))]
            votes[2 - int(np.argmax(own[::-1]))] += n
        self.weights = votes / max(votes.sum(), 1)
        p = self.weights[0] * share(n1, total)[None, None] + self.weights[1] * share(n2, before1[:, None])[None] + self.weights[2] * share(n3, before2[:, :, None])
        with np.errstate(divide="ignore"):
            self.log = np.log(np.maximum(p, 1e-12))
        self.prior = n1[: len(seen)] / max(n1[: len(seen)].sum(), 1)
        mean = self.prior.mean() if len(seen) else 0.0
        #: smoothing weight of the shorter suffix: the spread of the tag probabilities
        self.theta = float(np.sqrt(((self.prior - mean) ** 2).sum() / (len(seen) - 1))) if len(seen) > 1 else 0.0


def viterbi(places: list[np.ndarray], scores: list[np.ndarray], log: np.ndarray) -> list[int]:
    """Best tag path; ``places[i]`` are the possible tags of token i, ``scores[i]`` their log emissions; ties to the earlier tag."""
    start, end = len(log) - 2, len(log) - 1
    c0 = c1 = np.array([start])
    best, back = np.zeros((1, 1)), []
    for c, e in zip(places, scores, strict=True):
        step = best[:, :, None] + log[np.ix_(c0, c1, c)]
        back.append(step.argmax(0))
        best = step.max(0) + e[None, :]
        c0, c1 = c1, c
    best = best + log[np.ix_(c0, c1, [end])][:, :, 0]
    i, j = np.unravel_index(int(best.argmax()), best.shape)
    path = []
    for k in range(len(places) - 1, -1, -1):
        path.append(int(places[k][j]))
        i, j = int(back[k][i, j]), int(i)
    return path[::-1]


def emissions(types: DataFrame, model: TagModel, t: Transitions) -> DataFrame:
    """(word, tags, scores): for each distinct ``word`` its possible tags (places in ``t.tags``) and their log emissions."""
    n_tags = len(t.tags) - 2
    place = F.array_position(F.array(*[F.lit(x) for x in t.tags[:n_tags]]), F.col("tag")) - 1
    total = model.words.groupBy("tag").agg(F.sum("n").alias("n_tag"))
    lexicon = model.words.join(F.broadcast(total), "tag").select("word", place.cast("int").alias("at"), F.ln(F.col("n") / F.col("n_tag")).alias("e"))
    lexicon = lexicon.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "e"))).alias("known"))
    seen = types.join(lexicon, "word", "left")

    # share of each tag among a suffix's rare words, added up with the closed form of the recursion short to long
    shares = model.suffixes.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("suffix"))).select("suffix", place.cast("int").alias("at"), "share")
    new = seen.where("known is null").select("word").select("word", F.explode(_suffixes("word")).alias("suffix")).join(shares, "suffix")
    new = new.withColumn("i", F.char_length("suffix")).withColumn("longest", F.max("i").over(Window.partitionBy("word")))
    theta = F.lit(t.theta)
    part = F.col("share") * F.pow(theta, F.col("longest") - F.col("i")) / F.pow(1 + theta, F.col("longest") - F.col("i") + 1)
    new = new.groupBy("word", "at", "longest").agg(F.sum(part).alias("p"))
    new = new.groupBy("word", "longest").agg(F.map_from_entries(F.collect_list(F.struct("at", "p"))).alias("by"))
    out = seen.join(new, "word", "left")
    prior = F.array(*[F.lit(float(max(x, 1e-12))) for x in t.prior])
    left = F.coalesce(F.pow(theta / (1 + theta), F.col("longest")), F.lit(1.0))
    score = lambda i: F.ln(F.greatest(F.coalesce(F.element_at("by", i), F.lit(0.0)) + left * F.element_at(prior, i + 1), F.lit(1e-12)) / F.element_at(prior, i + 1))
    guessed = F.transform(F.sequence(F.lit(0), F.lit(n_tags - 1)), lambda i: F.struct(i.alias("at"), score(i).alias("e")))
    both = out.select("word", F.coalesce("known", guessed).alias("all"))
    return both.select("word", F.transform("all", lambda x: x["at"]).alias("tags"), F.transform("all", lambda x: x["e"]).alias("scores"))


def _decoder(tags: list[str], log: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sentence in batch.column(batch.num_columns - 1).to_pylist():
                places = [np.array(x["tags"]) for x in sentence]
                out.append([tags[i] for i in viterbi(places, [np.array(x["scores"]) for x in sentence], log)])
            words = [[x["token"] for x in s] for s in batch.column(batch.num_columns - 1).to_pylist()]
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words, kind), pa.array(out, kind)], names=[*batch.schema.names[:-1], "tokens", "tags"])

    return rows


def tag(sentences: DataFrame, model: TagModel, keys: list[str], *, tokens: str = "tokens") -> DataFrame:
    """(keys..., tokens, tags): the most likely tags of every sentence's ``tokens``; sentences without tokens have none.

    Rows are sentences of their own, whatever their keys. A model without tags gives no rows.
    """
    t = Transitions([tuple(r) for r in model.trigrams.select("t1", "t2", "t3", "n").limit((MAX_TAGS + 2) ** 3 + 1).collect()])
    schema = T.StructType([*[sentences.schema[k] for k in keys], T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType()))])
    if len(t.tags) == 2:
        return sentences.sparkSession.createDataFrame([], schema)
    rows = sentences.where(F.size(tokens) > 0).select(F.monotonically_increasing_id().alias("_row"), *keys, tokens)
    rows = rows.select("_row", *keys, F.posexplode(tokens).alias("position", "token"))
    rows = rows.withColumn("word", F.lower("token"))
    side = checked_broadcast(emissions(rows.select("word").distinct(), model, t), MAX_BROADCAST_LOOKUP, "emissions").df
    whole = rows.join(side, "word").groupBy("_row", *keys).agg(F.array_sort(F.collect_list(F.struct("position", "token", "tags", "scores"))).alias("_all"))
    return whole.drop("_row").mapInArrow(_decoder(t.tags, t.log), schema)


# ---- noun chunks --------------------------------------------------------------------


def noun_chunks(tokens: Column, tags: Column, modifiers=MODIFIERS, nouns=NOUNS) -> Column:
    """Array of chunks, each an array of its tokens: maximal runs of modifiers and then at least one noun."""
    sign = F.transform(tags, lambda t: F.when(t.isin(list(nouns)), F.lit(2)).when(t.isin(list(modifiers)), F.lit(1)).otherwise(F.lit(0)))
    # each sign with the one before and after it: a run opens behind another tag, or where a modifier follows a noun
    n = F.size(tokens)
    before, after = F.concat(F.array(F.lit(0)), sign), F.concat(F.slice(sign, F.lit(2), F.greatest(n, F.lit(1))), F.array(F.lit(0)))
    beside = F.arrays_zip(sign.alias("s"), F.slice(before, F.lit(1), n).alias("b"), after.alias("a"), F.sequence(F.lit(1), n).alias("i"))
    opens = F.filter(beside, lambda x: (x["s"] > 0) & ((x["b"] == 0) | ((x["s"] == 1) & (x["b"] == 2))))
    ends = F.filter(beside, lambda x: (x["s"] > 0) & ((x["a"] == 0) | ((x["s"] == 2) & (x["a"] == 1))))
    # modifiers without a noun are no chunk: a run with one ends in it
    runs = F.zip_with(opens, ends, lambda o, e: F.struct(o["i"].alias("i"), e["i"].alias("j"), e["s"].alias("s")))
    chunks = F.transform(F.filter(runs, lambda r: r["s"] == 2), lambda r: F.slice(tokens, r["i"], r["j"] - r["i"] + 1))
    return F.when(n > 0, chunks).otherwise(F.array().cast("array<array<string>>"))


def chunk_phrases(sentences: DataFrame, *, tokens: str = "tokens", tags: str = "tags", by=(), lemmas: DataFrame | None = None, stopwords=ENGLISH_STOPWORDS, custom=ANALYSIS_STOPWORDS, min_length: int = 3) -> DataFrame:
    """(by..., phrase, n): chunks that are left with exactly two words, as lower-cased lemmas.

    A token of a chunk is kept when it is all letters, no stopword on its
    surface, its lemma no custom stopword, and at least ``min_length`` long. ``lemmas``: (surface, lemma); a word it
    lacks is its own lemma.
    """
    by = list(by)
    # the array of chunks is exploded before its tokens are looked at: the tag string is made once a sentence
    chunks = sentences.select(*by, F.explode_outer(noun_chunks(F.col(tokens), F.col(tags))).alias("chunk")).where("chunk is not null")
    kept = F.filter("chunk", lambda w: is_alpha(w) & ~F.lower(w).isin(list(stopwords)) & (F.char_length(w) >= min_length))
    # without a lemma table the custom stopwords are those of the surface
    if lemmas is None:
        kept = F.filter(kept, lambda w: ~F.lower(w).isin(list(custom)))
        pairs = chunks.select(*by, kept.alias("w")).where(F.size("w") == 2).select(*by, F.lower(F.array_join("w", " ")).alias("phrase"))
        return pairs.groupBy(*by, "phrase").agg(F.count(F.lit(1)).alias("n"))
    # equal chunks are counted first; the lemma of every word decides whether it stays, so all kept words are looked up
    chunks = chunks.select(*by, F.transform(kept, lambda w: F.lower(w)).alias("w")).where(F.size("w") >= 2).groupBy(*by, "w").agg(F.count(F.lit(1)).alias("_n"))
    side = checked_broadcast(lemmas.groupBy("surface").agg(F.min("lemma").alias("lemma")), MAX_BROADCAST_LOOKUP, "lemmas").df
    words = chunks.select(*by, "w", "_n", F.posexplode("w").alias("position", "surface")).join(side, "surface", "left")
    words = words.select(*by, "w", "_n", "position", F.lower(F.coalesce("lemma", "surface")).alias("term")).where(~F.col("term").isin(list(custom)))
    left = words.groupBy(*by, "w").agg(F.array_sort(F.collect_list(F.struct("position", "term"))).alias("t"), F.max("_n").alias("_n")).where(F.size("t") == 2)
    phrase = F.array_join(F.transform("t", lambda x: x["term"]), " ")
    return left.groupBy(*by, phrase.alias("phrase")).agg(F.sum("_n").alias("n"))


# ---- lemmas -------------------------------------------------------------------------


def learn_lemmas(pairs: DataFrame, *, longest: int = SUFFIX) -> DataFrame:
    """(suffix, cut, added, n): the most frequent edit script of every suffix of the surfaces in ``pairs(surface, lemma)``.

    Suffixes go from the empty one to ``longest`` letters, and each whole surface
    is one (``^`` before it), so the table's own words come out exactly. Ties:
    fewer letters cut, then the earlier added letters.
    """
    p = pairs.where("surface is not null and lemma is not null").select(F.lower("surface").alias("surface"), F.lower("lemma").alias("lemma"))
    n = F.least(F.char_length("surface"), F.char_length("lemma"))
    # common letters from the left: as many as the first place that differs leaves
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr("surface", i, F.lit(1)) != F.substr("lemma", i, F.lit(1)))
    common = F.when(n == 0, 0).when(F.size(differ) > 0, F.element_at(differ, 1) - 1).otherwise(n)
    p = p.withColumn("common", common)
    cut, added = F.char_length("surface") - F.col("common"), F.substr("lemma", F.col("common") + 1, F.char_length("lemma"))
    own = F.concat(F.array(F.lit(""), F.concat(F.lit("^"), "surface")), F.slice(_suffixes("surface"), 1, longest))
    scripts = p.select(F.explode(F.array_distinct(own)).alias("suffix"), cut.alias("cut"), added.alias("added"))
    # a script that cuts more than a shorter word has is no rule for its suffix alone
    counts = scripts.groupBy("suffix", "cut", "added").agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy("suffix").orderBy(F.desc("n"), "cut", "added"))
    return counts.withColumn("_r", best).where("_r = 1").drop("_r")


def lemmatise(words: DataFrame, rules: DataFrame, *, column: str = "word") -> DataFrame:
    """(word, lemma) of every distinct word: the script of its longest suffix with a rule that cuts no more letters than it has."""
    types = words.where(F.col(column).isNotNull()).select(F.lower(column).alias("word")).distinct()
    own = F.concat(F.array(F.lit(""), F.concat(F.lit("^"), "word")), _suffixes("word"))
    tried = types.select("word", F.explode(F.array_distinct(own)).alias("suffix"))
    side = checked_broadcast(rules, MAX_BROADCAST_LOOKUP, "lemma rules").df
    found = tried.join(side, "suffix").where(F.col("cut") <= F.char_length("word"))
    best = found.groupBy("word").agg(F.max(F.struct(F.char_length("suffix").alias("l"), "suffix", "cut", "added")).alias("b"))
    lemma = F.concat(F.left("word", F.char_length("word") - F.col("b.cut")), "b.added")
    return types.join(best, "word", "left").select("word", F.coalesce(lemma, F.col("word")).alias("lemma"))


by_value(sys.modules[__name__])
