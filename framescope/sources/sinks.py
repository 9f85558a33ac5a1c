"""Writers (SNK1-SNK3) and the batch encoder hook (UDF2).

Results are written by the executors, never collected: CSV with a header
and no index column (keys are ordinary columns), Parquet by default for
anything with arrays. Matrices are pivoted just before the sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite", single_file: bool = False) -> None:
    """CSV with a header row; arrays are joined with '; ' (CSV cannot hold them).

    ``single_file`` coalesces to one task -- only for small reports such as
    a top-10 table or a matrix of a few hundred rows.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.array_join(F.col(f.name).cast("array<string>"), "; ").alias(f.name))
        else:
            cols.append(F.col(f.name))
    out = df.select(*cols)
    if single_file:
        out = out.coalesce(1)
    out.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, *, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_text_files(df: DataFrame, path: str, name_col: str, text_col: str) -> None:
    """One file per row, named by ``name_col``, holding the text as UTF-8 bytes; written by the executors.

    ``path`` is a folder every executor can write: a local or mounted one
    (``file:`` or no scheme). Names must be distinct base names. A retried task writes the same files again.
    """
    import os

    folder = path.removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        raise ValueError("write_text_files needs a mounted folder; use write_parquet for object stores")

    def write(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(os.path.join(folder, os.path.basename(name)), "wb") as out:
                    out.write((text or "").encode())
            yield batch.slice(0, 0)

    df.select(name_col, text_col).mapInArrow(write, df.select(name_col, text_col).schema).count()


def preview(df: DataFrame, n: int = 5) -> None:
    """Schema and first rows (``print(df.head())`` / ``df.columns``)."""
    df.printSchema()
    df.show(n, truncate=80)


def encode_with(
    df: DataFrame,
    text_col: str,
    make_encoder: Callable[[], Callable],
    *,
    out: str = "embedding",
    batch_size: int = 64,
) -> DataFrame:
    """Adds a vector column from a user-supplied batch encoder (UDF2, ENC1 extension point).

    ``make_encoder()`` runs once per Python worker and returns
    ``fn(texts: numpy array of str) -> 2-D float array``; batches of
    ``batch_size`` rows arrive through Arrow (``predict_batch_udf``). No model
    ships with this library.
    """
    from pyspark.ml.functions import predict_batch_udf

    def make_predict_fn():
        fn = make_encoder()

        def predict(texts):
            import numpy as np

            return np.asarray(fn(texts), dtype=np.float32)

        return predict

    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out, udf(F.col(text_col)))
