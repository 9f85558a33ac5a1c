"""How the driver's test tables play the roles of the reference's inputs.

| role                         | test table                                          |
|------------------------------|-----------------------------------------------------|
| framework query vectors      | ``embeddings`` with ``vec_id < 41`` (41 parameters) |
| sentence vectors             | ``embeddings`` with ``vec_id >= 41``; ``label`` = document, ``vec_id`` = sentence index |
| policy documents + metadata  | ``documents`` (doc_id, text; dimensions lang, source) |
| framework query texts        | ``benchmark`` (item_id, text)                        |
| reviewed codes               | ``labels`` (quality, toxic: two 0/1 codes per document) |
| text per group               | ``conversations`` (role, text)                       |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The reference's framework has 41 parameters; the first 41
# embedding rows play their definitions.
N_PARAMETERS = 41


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") < N_PARAMETERS).select(
        F.col("vec_id").alias("query_id"), "embedding", "label"
    )


def sentence_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") >= N_PARAMETERS).select(
        F.col("label").alias("doc"), F.col("vec_id").alias("sentence_index"), "embedding"
    )


def vector_framework(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, parameter, category) for the vector queries: names p00.., categories c<label>."""
    return query_vectors(spark, sf_dir).select(
        "query_id",
        F.format_string("p%02d", F.col("query_id")).alias("parameter"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"),
    )


def parameter_names(n: int = N_PARAMETERS) -> list[str]:
    return [f"p{i:02d}" for i in range(n)]
