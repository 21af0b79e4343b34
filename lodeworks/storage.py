"""Shared storage and the helpers that keep plans small: written intermediates, size-checked broadcasts, global numbers."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 50_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders written by the operators that run now, innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's spark.checkpoint.dir names it; only a local master may leave it unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodeworks-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def track(path: str) -> str:
    """path, to be deleted with what the operator that runs now has written."""
    if _open:
        _open[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage is cut and a lost executor loses nothing.

    Nothing else reads the shuffles of this write; the session is set to delete them as a query ends.
    """
    spark = df.sparkSession
    path = track(new_path(spark, name))
    if spark.conf.get(CLEANUP, "false") != "true":
        spark.conf.set(CLEANUP, "true")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders wherever they are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose written tables are deleted as it returns, but for those its result reads."""

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        _open.append([])
        try:
            out = operator(*args, **kwargs)
        finally:
            written = _open.pop()
        read = out.inputFiles() if written else []
        used = {path for path in written if any(path.rsplit("/", 1)[1] in f for f in read)}
        delete(out.sparkSession, [path for path in written if path not in used])
        if _open:
            _open[-1] += used
        return out

    return run


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (of narrow rows) with a broadcast hint if a count finds it small; else as it is, for a shuffled join that AQE may split."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, column: str, megabytes: int = 64) -> int:
    """Partitions to deal out what is made of a string column: by its counted bytes, and at least as many as the session shuffles to."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(shuffle_partitions(df.sparkSession), -(-total // (megabytes << 20)))


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def global_row_number(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """df with long column _lw_row, 0.. in the order of the given columns, and the number of rows.

    Rows are range-partitioned, numbered inside each partition and shifted by the counts of the
    partitions before; no task sees more than its range. Ties are between interchangeable rows.
    """
    spark = df.sparkSession
    dealt = materialize(df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_lw_pid", F.spark_partition_id()), name)
    before = Window.orderBy("_lw_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_lw_pid").agg(F.count("*").alias("_lw_n"))
    n = counts.agg(F.sum("_lw_n")).first()[0] or 0
    shifts = counts.select("_lw_pid", F.coalesce(F.sum("_lw_n").over(before), F.lit(0)).alias("_lw_shift"))
    inside = F.row_number().over(Window.partitionBy("_lw_pid").orderBy(*order))
    out = dealt.withColumn("_lw_at", inside).join(broadcast_if_small(shifts), "_lw_pid")
    return out.withColumn("_lw_row", F.col("_lw_at") - 1 + F.col("_lw_shift")).drop("_lw_pid", "_lw_at", "_lw_shift"), n
