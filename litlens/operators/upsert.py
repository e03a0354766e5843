"""Keyed write-back of labels: updates replace target rows with the same key,
new keys are inserted, untouched rows stay.

The latest update of each key is chosen first (a window over the updates
only), then one full outer join on the key sets the changed fields. Target
rows pass through the join as they are; nothing is aggregated over them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.joins import sized_broadcast
from ..session import scratch_dir
from ..sources.tables import read_if_exists

PRUNE_MAX_PARTITIONS = 256     # partitions that a filter names; more are joined, with the same rows
BUCKET_COLUMN = "bucket_of_"   # partition column of a bucketed table, followed by the number


def latest(updates: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One update per key: the one with the largest ``order`` value, compared in
    its own type (NULL is below every value). Equal order values, and updates
    without an order column, are decided by a hash of the row."""
    rest = [c for c in updates.columns if c not in keys and c != order]
    tie = F.xxhash64(*rest) if rest else F.lit(0)
    by = ([F.col(order).desc_nulls_last()] if order else []) + [tie]
    w = Window.partitionBy(*keys).orderBy(*by)
    return updates.withColumn("_rk", F.row_number().over(w)).filter("_rk = 1").drop("_rk")


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str],
           order: str | None = None) -> DataFrame:
    """Rows of ``updates`` replace rows of ``target`` with equal ``keys``
    (NULL keys are equal to each other).

    ``updates`` may carry a subset of the target columns (like setting one
    field): the others keep their target values, and are NULL for new keys.
    Columns the target lacks are added after its own, NULL where no update set
    them. A column present in ``updates`` overwrites even with NULL. Of several
    updates of a key, :func:`latest` decides. Target rows that share a key are
    all kept, and all updated.
    """
    keys = list(keys)
    last = latest(updates, keys, order)
    if order and order not in target.columns:
        last = last.drop(order)
    fields = [c for c in last.columns if c not in keys]
    u = last.select(*[F.col(c).alias(f"_u_{c}") for c in [*keys, *fields]], F.lit(True).alias("_is_update"))
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_u_{k}"))
        on = c if on is None else on & c
    j = target.withColumn("_is_target", F.lit(True)).join(u, on, "full_outer")
    hit = F.col("_is_update").isNotNull()
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.when(F.col("_is_target").isNotNull(), F.col(c)).otherwise(F.col(f"_u_{c}")).alias(c))
        elif c in fields:
            out.append(F.when(hit, F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    out += [F.col(f"_u_{c}").alias(c) for c in fields if c not in target.columns]
    return j.select(*out)


def write_labels(spark: SparkSession, df: DataFrame, path: str,
                 partition_by: Sequence[str] = ("category", "run")) -> None:
    """Write labels, replacing only the partitions present in ``df``
    (dynamic partition overwrite). The result is checkpointed into the shared
    scratch folder first, so ``df`` may read from ``path`` itself."""
    scratch_dir(spark)
    stable = df.checkpoint(eager=True)
    (stable.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def key_bucket(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a key, the same for every type its numbers may have."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def touched(target: DataFrame, updates: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """The rows of ``target`` in the partitions that ``updates`` have rows for. Up
    to ``PRUNE_MAX_PARTITIONS`` of them are named in the filter, so that only their
    folders are listed and read; more are joined."""
    parts = updates.select(*partition_by).distinct()
    named = parts.limit(PRUNE_MAX_PARTITIONS + 1).collect()
    if not named:
        return target.limit(0)
    if len(named) <= PRUNE_MAX_PARTITIONS:
        ways = [reduce(and_, [F.col(k).eqNullSafe(F.lit(r[k])) for k in partition_by]) for r in named]
        while len(ways) > 1:  # as a balanced tree
            ways = [reduce(or_, ways[i:i + 2]) for i in range(0, len(ways), 2)]
        return target.filter(ways[0])
    parts = sized_broadcast(parts)
    return target.join(parts, reduce(and_, [target[k].eqNullSafe(parts[k]) for k in partition_by]), "left_semi")


def upsert_table(spark: SparkSession, path: str, updates: DataFrame,
                 keys: Sequence[str] = ("paper_id", "category", "run"),
                 partition_by: Sequence[str] = ("category", "run"),
                 order: str | None = None, buckets: int | None = None) -> None:
    """Upsert ``updates`` into the partitioned parquet table at ``path``.

    Only the partitions the updates touch are read and rewritten (dynamic
    partition overwrite). A missing table is created by the same merge; any other
    reading error is raised. A field that is new to the table is added to the
    rewritten partitions: read the table with ``mergeSchema``.

    ``buckets`` divides every partition of a new table further by a hash of the
    key, in a partition column ``bucket_of_<buckets>``, so that an update of a few
    keys rewrites a few buckets. A table keeps the number it was made with; another
    one is refused."""
    target = read_if_exists(spark, path, merge=True)
    made = [] if target is None else [c for c in target.columns if c.startswith(BUCKET_COLUMN)]
    column = made[0] if made else f"{BUCKET_COLUMN}{buckets}" if buckets else None
    if target is not None and buckets and made != [f"{BUCKET_COLUMN}{buckets}"]:
        raise ValueError(f"the table at {path} was made with {made[0] if made else 'no buckets'}")
    parts = list(partition_by)
    if column:
        count = int(column.removeprefix(BUCKET_COLUMN))
        updates = updates.withColumn(column, key_bucket(keys, count))
        keys, parts = [*keys, column], [*parts, column]
    if target is None:
        target = updates.drop(order).limit(0) if order else updates.limit(0)
    write_labels(spark, upsert(touched(target, updates, parts), updates, keys, order), path, parts)
