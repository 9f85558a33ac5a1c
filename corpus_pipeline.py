"""The corpus pipeline: each stage works on what the one before kept and wrote.

Quality (documents the line model rejects go), near duplicates (one document of
each group stays), decontamination (documents holding benchmark items go),
mixing (documents of scarce languages are repeated; none is dropped), token ids.
All stages but the last return the columns of ``documents``, whatever their names.

A document is a row's ``doc_id`` and text. Rows equal in both are copies of one
document: the near-duplicate stage keeps the one whose other columns come first
as JSON. A NULL ``doc_id`` is an id like others, larger than all; of rows with one
id and different texts, the text of least hash has the id, the others come after all ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.llm import quality_crf
from framescope.llm.common import written
from framescope.llm.jaccard_join import jaccard_join
from framescope.llm.latent_decontamination import latent_decontamination
from framescope.llm.soft_mixing import soft_mixing
from framescope.llm.token_output import token_output

THRESHOLD = 0.3
#: exponent on the languages' present shares
TEMPERATURE = 0.5


def _named(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` does not have."""
    out = []
    for name in names:
        while name in docs.columns:
            name = f"_{name}"
        out.append(name)
    return out


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _same(a: DataFrame, b: DataFrame, id_name: str, th: str) -> Column:
    return a["doc_id"].eqNullSafe(b[id_name]) & (a[th] == b[f"{th}_b"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    # columns of the scorer's own names are put aside
    aside = {c: name for c in ("held_out", "score", "predicted") if c in docs.columns for name in _named(docs, f"_{c}")}
    scored = quality_crf.quality_crf(docs.withColumnsRenamed(aside), quality_crf.train(docs, labels), THRESHOLD)
    kept = scored.where("predicted = 1").drop("held_out", "score", "predicted")
    return kept.withColumnsRenamed({name: c for c, name in aside.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, th, times = _named(docs, "key", "th", "times")
    rows = docs.withColumn(th, _text_hash())
    # one row a document: how often it stands, and whether its text is the one that has the id
    each = rows.groupBy("doc_id", th).agg(F.count(F.lit(1)).alias(times))
    least = written(each.groupBy("doc_id").agg(F.min(th).alias("least")), "ids")
    each = written(each, "documents")
    other = F.xxhash64("doc_id", th).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    owner = (F.col(th) == F.col("least")) & F.col("doc_id").isNotNull()
    each = each.join(least.withColumnRenamed("doc_id", "id_b"), each["doc_id"].eqNullSafe(F.col("id_b"))).select(
        F.col("doc_id").alias("id_b"), F.col(th).alias(f"{th}_b"), times, F.when(owner, F.col("doc_id").cast("long")).otherwise(other).alias(key)
    )
    special = written(each.where((F.col(times) > 1) | ~F.col("id_b").eqNullSafe(F.col(key))), "special")
    # most rows are the only one of their id: their key is the id, and only the others are looked up
    rows = rows.join(special, _same(rows, special, "id_b", th), "left").withColumn(key, F.coalesce(key, F.col("doc_id").cast("long"))).drop("id_b", f"{th}_b", th)
    rows = written(rows, "keyed")
    classes = jaccard_join(rows.select(F.col(key).alias("doc_id"), "text"))
    copies = classes.where("component_id < doc_id").select(F.col("doc_id").alias(key)).distinct()
    kept = rows.join(written(copies, "copies").hint("merge"), key, "left_anti")  # copies grow with the input: never broadcast
    whole = F.struct(*docs.columns)
    first = kept.where(F.col(times) > 1).groupBy(key).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return kept.where(F.col(times).isNull() | (F.col(times) == 1)).select(*docs.columns).unionByName(first.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (th,) = _named(docs, "th")
    found = latent_decontamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("id_b"), F.col("th").alias(f"{th}_b")).distinct()
    rows, found = docs.withColumn(th, _text_hash()), written(found, "leaks")
    return rows.join(found, _same(rows, found, "id_b", th), "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    th, copies, again = _named(docs, "th", "copies", "again")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(labels, "doc_id")
    found = soft_mixing(docs, labelled, TEMPERATURE).where("copies > 1")
    found = found.select(F.col("doc_id").alias("id_b"), F.col("th").alias(f"{th}_b"), F.col("copies").alias(copies)).distinct()
    rows, found = docs.withColumn(th, _text_hash()), written(found, "copies")
    # the repeated documents grow with the input: never broadcast
    joined = rows.join(found.hint("merge"), _same(rows, found, "id_b", th), "left")
    return joined.withColumn(again, F.explode(F.sequence(F.lit(1), F.coalesce(copies, F.lit(1))))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: no stage is SQL: trained models, an iterative fit and a tokenizer; tests/llm/test_pipeline.py holds them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
