"""Session helpers: a local session for tests and the bench, and the shared
scratch folder every lineage cut and streaming checkpoint goes to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import SparkSession

# Settings that matter at scale as much as locally: AQE re-plans joins and
# coalesces small shuffle partitions, skew-join splits hot partitions, and
# UTC keeps timestamp-derived years identical to the SQL oracle.
DEFAULT_CONF = {
    # No broadcast from plan-time size estimates: an estimate does not see the
    # fan-out of explode/inline and can be far too small. Broadcasts happen
    # only on explicit, size-checked hints (plans/joins.sized_broadcast) or
    # when AQE has measured a materialised side below its own threshold.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # prompts carry whole texts: 1,000 rows per Arrow batch keeps a Python
    # worker's batch in the tens of MB even for long papers
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.ui.enabled": "false",
}


def _driver_memory() -> str:
    """Half of the machine's memory, 16 GiB at most."""
    total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    return f"{max(1, min(16 << 10, total // 2 >> 20))}m"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "litlens") -> SparkSession:
    """A local session as used by tests and ``bench.py``."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("LITLENS_DRIVER_MEMORY", _driver_memory())))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_dir(spark)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and points at shared storage;
    if it is unset there, or names a machine-local ``file:`` folder, this
    fails. Only in local mode (tests, the bench) a folder of our own is made
    where none is set, so ``DataFrame.checkpoint()`` and streaming checkpoints
    work.
    """
    local = spark.sparkContext.master.startswith("local")
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d and d.startswith("file:") and not local:
        raise RuntimeError(f"spark.checkpoint.dir is {d}: on a cluster it must name a folder on shared storage")
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not local:
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a "
                               "folder on shared storage (a machine-local folder would be lost "
                               "with its executor)")
        d = tempfile.mkdtemp(prefix="litlens-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared scratch folder for one job. Only Spark
    opens it, so it may be on any file system."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def _setting(spark: SparkSession, key: str, value: int) -> Iterator[None]:
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def arrow_batches_below(spark: SparkSession, most: int) -> AbstractContextManager[None]:
    """Arrow batches of at most ``most`` bytes (or one row) for the jobs started
    inside, whatever number of rows the session allows."""
    return _setting(spark, ARROW_BYTES, most)


def shuffle_partitions_at_most(spark: SparkSession, most: int) -> AbstractContextManager[None]:
    """At most ``most`` shuffle partitions for what is started inside. A stream
    keeps the number in its checkpoint, whatever is set when it goes on."""
    return _setting(spark, SHUFFLE_PARTITIONS, min(most, int(spark.conf.get(SHUFFLE_PARTITIONS))))
