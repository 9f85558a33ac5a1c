"""Readers for the reference's inputs, with explicit schemas (SRC1, SRC2, SRC4).

* metadata and review tables: CSV with header, quoted values with commas
  and line breaks, explicit schema (no inference pass);
* the framework: nested JSON ``{"framework": [{parameter, category,
  subcategory, definition, keywords[]}]}`` or the flat CSV with a
  comma-separated ``Related keywords`` column; both get a ``pos``
  (framework order) from ``posexplode`` / the file order;
* folders of ``.txt`` files: one row per file with its base name, raw text
  and word count. Each file is read whole by one task (``binaryFile``); a
  file that cannot be read or decoded is skipped, as the reference skips it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_bom, word_count

METADATA_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in
     ["title", "org", "link", "doc_type", "org_type", "worker_focus", "geography", "date", "file_name"]]
)

FRAMEWORK_CSV_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ["Parameter", "Category", "Subcategory", "Definition", "Related keywords"]]
)

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("policy_title", T.StringType()),
        T.StructField("sentence", T.StringType()),
        T.StructField("corpus_size", T.IntegerType()),
        T.StructField("primary_paramater", T.StringType()),
        T.StructField("alt_parameter_1", T.StringType()),
        T.StructField("alt_parameter_2", T.StringType()),
        T.StructField("alt_parameter_3", T.StringType()),
        T.StructField("alt_parameter_4", T.StringType()),
    ]
)

FRAMEWORK_JSON_SCHEMA = T.StructType(
    [
        T.StructField(
            "framework",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("parameter", T.StringType()),
                        T.StructField("category", T.StringType()),
                        T.StructField("subcategory", T.StringType()),
                        T.StructField("definition", T.StringType()),
                        T.StructField("keywords", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        )
    ]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header row, RFC 4180 quoting (commas and line breaks inside quotes), explicit schema."""
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .schema(schema)
        .csv(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, METADATA_SCHEMA)


def read_review(spark: SparkSession, path: str, schema: T.StructType = REVIEW_SCHEMA) -> DataFrame:
    return read_csv(spark, path, schema)


def read_framework_json(spark: SparkSession, path: str) -> DataFrame:
    """(pos, parameter, category, subcategory, definition, keywords) in file order."""
    raw = spark.read.option("multiLine", True).schema(FRAMEWORK_JSON_SCHEMA).json(path)
    return raw.select(F.posexplode("framework").alias("pos", "f")).select(
        F.col("pos").cast("long").alias("pos"), "f.parameter", "f.category", "f.subcategory", "f.definition",
        F.coalesce(F.col("f.keywords"), F.array().cast("array<string>")).alias("keywords"),
    )


def read_framework_csv(spark: SparkSession, path: str) -> DataFrame:
    """(pos, parameter, category, subcategory, definition, keywords) from the flat CSV, in file order.

    The framework is a small dictionary (41 rows in the reference): it is
    fetched once behind a size check, in file order (``monotonically_increasing_id``
    follows the file within and across the partitions of one read), and
    numbered 0.. as it is turned back into a frame -- no global window.
    """
    from ..operators.guards import MAX_BROADCAST_LOOKUP, collect_small

    kw = F.filter(
        F.transform(F.split(F.coalesce(F.col("Related keywords"), F.lit("")), ","), lambda s: F.trim(s)),
        lambda s: s != "",
    )
    raw = read_csv(spark, path, FRAMEWORK_CSV_SCHEMA).select(
        F.monotonically_increasing_id().alias("_id"),
        F.col("Parameter").alias("parameter"),
        F.col("Category").alias("category"),
        F.col("Subcategory").alias("subcategory"),
        F.col("Definition").alias("definition"),
        kw.alias("keywords"),
    )
    rows = sorted(collect_small(raw, MAX_BROADCAST_LOOKUP, "framework"), key=lambda r: r["_id"])
    schema = "pos long, parameter string, category string, subcategory string, definition string, keywords array<string>"
    return spark.createDataFrame([(i, *tuple(r)[1:]) for i, r in enumerate(rows)], schema)


def read_text_folder(spark: SparkSession, path: str, *, strip_bom_char: bool = False) -> DataFrame:
    """(filename, raw_text, word_count): one row per ``*.txt`` file in ``path`` (SRC4, FLT4, STR11).

    The byte order mark stays in the text unless ``strip_bom_char`` (G18);
    the word count splits on Unicode whitespace like ``str.split()`` (G19).
    """
    # binaryFile + cast keeps the bytes as written (Spark's text reader drops a BOM);
    # a file that is not valid UTF-8 is skipped, as the reference skips a file it cannot decode
    df = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.txt")
        .option("ignoreCorruptFiles", True)
        .load(path)
        .select(F.col("_metadata.file_name").alias("filename"), F.col("content").cast("string").alias("raw_text"))
        .where(F.expr("is_valid_utf8(raw_text)"))
    )
    empty = _empty_files(spark, path, "*.txt")
    if empty:
        # Spark's file scans skip zero-length files; the reference keeps them as empty texts
        df = df.unionByName(spark.createDataFrame([(n, "") for n in empty], "filename string, raw_text string"))
    # text mode: every line end reads as a line feed
    df = df.withColumn("raw_text", F.regexp_replace("raw_text", "\r\n?", "\n"))
    if strip_bom_char:
        df = df.withColumn("raw_text", strip_bom(F.col("raw_text")))
    return df.withColumn("word_count", word_count(F.col("raw_text")))


def _empty_files(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Base names of zero-length files matching ``pattern`` in ``path`` (file-system metadata only)."""
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/" + pattern)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    statuses = fs.globStatus(hpath) or []
    return sorted(st.getPath().getName() for st in statuses if st.isFile() and st.getLen() == 0)


def attach_text(metadata: DataFrame, texts: DataFrame) -> DataFrame:
    """Metadata left-joined to the texts on the file name (JN2): documents without a file keep NULL text."""
    t = texts.withColumnRenamed("filename", "_fn")
    return metadata.join(t, metadata["file_name"] == t["_fn"], "left").drop("_fn")


def unmatched_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(side, key): keys present on one side of an exact-key join but not the other."""
    a = left.select(F.col(left_key).alias("key")).distinct()
    b = right.select(F.col(right_key).alias("key")).distinct()
    return a.join(b, "key", "left_anti").select(F.lit("left_only").alias("side"), "key").unionByName(
        b.join(a, "key", "left_anti").select(F.lit("right_only").alias("side"), "key")
    )


def parse_date(col, fmt: str = "MM-dd-yyyy"):
    """Date from text; malformed or missing values become NULL (DAT1, G22)."""
    return F.to_date(F.try_to_timestamp(col, F.lit(fmt)))
