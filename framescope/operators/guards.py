"""Guards for the few places where a side is broadcast or brought to the driver.

A framework (the query side) is small by nature -- 41 parameters in the
reference -- but it is still data, so its size is *checked* before it is
broadcast. Callers get the row count back and choose the other path (a
shuffle join, or query blocks) when the limit is exceeded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Row limits for sides that are broadcast or collected. A query vector of
# 768 floats is ~3 KiB, so 20,000 queries are ~60 MiB: a safe broadcast.
MAX_BROADCAST_QUERIES = 20_000
# Query terms (query, term, count) rows; one row is ~50 bytes.
MAX_BROADCAST_QUERY_TERMS = 2_000_000
# Small lookup tables: stopwords, lemmas, parameter dictionaries, metadata.
MAX_BROADCAST_LOOKUP = 1_000_000


class TooLargeToBroadcast(ValueError):
    pass


@dataclass(frozen=True)
class Checked:
    df: DataFrame
    rows: int
    broadcast: bool


def checked_broadcast(df: DataFrame, max_rows: int, what: str = "side") -> Checked:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows.

    Returns the (possibly broadcast-hinted) frame, its row count and whether
    the hint was applied. The count is one small job over the small side.
    """
    n = df.count()
    if n <= max_rows:
        return Checked(F.broadcast(df), n, True)
    return Checked(df, n, False)


def collect_small(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a side that must be small (it is brought to the driver), checked and fetched in one job."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise TooLargeToBroadcast(f"{what}: more than {max_rows} rows; use the block path")
    return rows


def fetched_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` as local rows when it has at most ``max_rows`` (several branches then share one run), else ``df`` itself."""
    rows = df.limit(max_rows + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= max_rows else df


def kept(df: DataFrame) -> DataFrame:
    """Counts that several tables are made from, computed once (in the folder of ``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when ``df`` has fewer partitions than the cluster has cores.

    A few large input files (e.g. one Parquet file with four row groups) would
    otherwise leave the CPU-heavy text stages on a handful of tasks. At scale
    the input already has many more splits than cores and nothing happens.
    Spark sorts before a round-robin repartition, so a retried task
    reproduces the same assignment. A frame with a shuffle of its own is left
    to AQE: asking an adaptive plan for its partitions would run its stages.
    """
    try:
        if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
            return df
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()  # no exchange in the plan: planning only, no job
    except Exception:  # noqa: BLE001 -- no RDD view (e.g. Spark Connect): leave the input as it is
        return df
    return df.repartition(target) if n < target else df


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` (file sizes for a scan), or None when unavailable."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001
        return None


def key_partitions(df: DataFrame, partitions: int | None = None) -> int:
    """Partition count for an explicit repartition by key.

    At least the session's ``spark.sql.shuffle.partitions``, the core count,
    and as many partitions as the input has splits of
    ``spark.sql.files.maxPartitionBytes`` -- so a 100 TB input is not squeezed
    into a default of 200 partitions.
    """
    if partitions:
        return partitions
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    size = estimated_bytes(df)
    try:
        split_bytes = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    except Exception:  # noqa: BLE001
        split_bytes = 128 * 1024 * 1024
    if size and size < (1 << 60):  # Spark reports about Long.MaxValue when it cannot estimate
        n = max(n, -(-size // split_bytes))
    return int(min(n, 1_000_000))
