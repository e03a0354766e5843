"""Helpers shared by the operators: shared scratch tables, joins whose hot
keys Spark can split, and a distributed running position."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Maps the bytes A-Z to a-z and leaves every other byte as it is.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows a broadcast side may have; the sides marked below hold a few numbers a row.
BROADCAST_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only
    where none is set and the session is local."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d and d.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir is {d}: on a cluster it must name a folder on shared storage")
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile
    d = tempfile.mkdtemp(prefix="llm-scratch-")
    spark.sparkContext.setCheckpointDir(d)
    return d


def few_files(spark: SparkSession) -> int:
    """Files that a table of a few numbers a row is written in: one a core at
    least, and more with the shuffle width, so that they grow with the input."""
    return max(spark.sparkContext.defaultParallelism, shuffle_width(spark) // 32)


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back: a lost executor
    later costs a re-read, not the work before this point. ``narrow`` rows (a
    few numbers each, just shuffled) go to :func:`few_files`, not to one a partition."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    if narrow:
        df = df.coalesce(few_files(spark))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go as soon as it is done, not when the
    driver happens to collect its garbage. For steps whose result is :func:`stored`."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which both sides are dealt out by the join itself.

    A side that was just aggregated by ``keys`` would otherwise keep the
    aggregate's partitioning, and Spark only splits a hot key's partition when
    both sides come from exchanges of the join. The extra hash key forces that.
    """
    h = F.xxhash64(*keys).alias("_jk")
    joined = left.select("*", h).join(right.select("*", h), [*keys, "_jk"], how)
    return joined.drop("_jk")


def small_or_plain(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most ``max_rows`` rows, else unmarked.
    ``df`` should be a stored table: the check counts at most that many rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_hash(text_col: str) -> Column:
    """64 bits of a text as it stands; NULL counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, h: Column) -> DataFrame:
    """``docs`` without the rows of the stored ``id, h`` table; ``h`` is the hash
    of the text, so ids that clash only lose the texts named there."""
    a, b = unused(docs, "gone_id"), unused(docs, "gone_h")
    named = small_or_plain(gone).select(F.col("id").alias(a), F.col("h").alias(b))
    return docs.join(named, (F.col(id_col) == F.col(a)) & (h == F.col(b)), "left_anti")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: Sequence[str], sums: dict[str, Column], name: str,
            narrow: bool = False) -> DataFrame:
    """Running totals over a global order, without a single-task window.

    Range partitions of the order are stored, their totals (one row per
    partition) give each partition its start, and a window inside each
    partition does the rest. ``sums`` maps output names to the summed columns;
    the totals include the row itself. Ties in ``order`` are ordered freely.
    ``narrow`` is that of :func:`stored`.
    """
    spark = df.sparkSession
    n = 4 * shuffle_width(spark)
    laid = stored(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), name, narrow)
    totals = laid.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # at most n rows
    starts = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}")
                                     for k in sums])
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = laid.join(F.broadcast(starts), "_pid")  # n rows: a fixed multiple of the shuffle width
    return out.select(*df.columns, *[(F.col(f"_s_{k}") + F.sum(c).over(inside)).alias(k) for k, c in sums.items()])
