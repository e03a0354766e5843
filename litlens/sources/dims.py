"""Small fixed dimensions (configuration tables) built inside the JVM.

``spark.createDataFrame`` on a Python list yields an RDD of pickled rows, so
every job touching it starts Python workers. A literal array of structs
exploded with ``inline`` stays in the JVM and is planned like any table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_dim(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """A DataFrame of ``rows`` with ``columns`` given as (name, SQL type) pairs."""
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in columns])
    arr = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, columns)])
                    for r in rows])
    return spark.range(1).select(F.inline(arr))
