"""Resolve labels while answers arrive (Structured Streaming).

Retries of one task can land in different micro-batches and out of order, so
the stream keeps state per task: ``best = min(attempt, label id)`` over allowed
answers, packed into one long, and ``seen = max(attempt)``. It is a streaming
aggregation in update mode: Spark's state store holds it, the checkpoint
restores it after a restart, and every micro-batch puts out the tasks that it
touched, each with all that is known of it. Both aggregates only ever improve,
so the label of a task is that of its last row, in any order of reading, and a
replayed batch changes nothing.

Layout: ``<labels_dir>/batch_id=N`` holds the rows of batch N, ``<labels_dir>-labels``
the label behind each id. The state has one row of two longs a task, as labels
may be corrected by a better attempt at any time; a session with many tasks
keeps it in RocksDB (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import py_strip
from ..operators.batch import answer_log_schema
from ..operators.labels import INVALID_RESULT, TASK_KEYS
from ..plans.joins import sized_broadcast
from ..sources.tables import read_if_exists

ID_BITS = 40


def label_ids(spark: SparkSession, labels_dir: str, vocab: DataFrame) -> DataFrame:
    """``(category, answer, label_id)``: labels numbered by name. The numbers are
    kept beside the labels, since the state refers to them: a restart finds the
    old ones and numbers only labels that are new."""
    path = f"{labels_dir}-labels"
    v = vocab.select("category", F.col("label").alias("answer")).distinct()
    old = read_if_exists(spark, path)
    last = 0
    if old is not None:
        v = v.join(old, ["category", "answer"], "left_anti")
        last = old.agg(F.max("label_id")).first()[0] or 0
    number = F.row_number().over(Window.orderBy("category", "answer")).cast("long") + last
    v.withColumn("label_id", number).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def resolve_state(answers: DataFrame, ids: DataFrame, max_attempts: int = 3) -> DataFrame:
    """``best`` and ``seen`` of each task, of a stream or a table of answers.
    Failed calls have no answer to look up; each gets a key of its own, so that
    they do not meet under one NULL key when the join shuffles."""
    a = answers.filter(F.col("attempt").between(1, max_attempts)).withColumn("answer", F.coalesce(
        py_strip(F.col("response")),
        F.concat(F.lit("\x00"), F.xxhash64(*TASK_KEYS, "attempt").cast("string"))))
    best = F.shiftleft(F.col("attempt").cast("long"), ID_BITS) + F.col("label_id")
    return (a.join(ids, ["category", "answer"], "left").groupBy(*TASK_KEYS)
             .agg(F.min(best).alias("best"), F.max("attempt").alias("seen")))


def start_resolve_stream(spark: SparkSession, answers_dir: str, vocab: DataFrame,
                         labels_dir: str, checkpoint_dir: str, max_attempts: int = 3,
                         files_per_batch: int | None = None, available_now: bool = True,
                         id_type: str = "bigint") -> StreamingQuery:
    """Stream parquet answer files from ``answers_dir`` into the label rows that
    :func:`read_labels` reads; state and progress are in ``checkpoint_dir``."""
    reader = spark.readStream.schema(answer_log_schema(id_type))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    ids = sized_broadcast(label_ids(spark, labels_dir, vocab))
    state = resolve_state(reader.parquet(answers_dir), ids, max_attempts)

    def write(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch replaces its own rows
        batch.write.mode("overwrite").parquet(f"{labels_dir}/batch_id={batch_id}")

    w = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_labels(spark: SparkSession, labels_dir: str, sentinel: str = INVALID_RESULT) -> DataFrame:
    """The current labels: ``(paper_id, category, run, label, attempts_used)``
    plus ``seen`` (highest attempt that arrived)."""
    names = spark.read.parquet(f"{labels_dir}-labels").select("label_id", F.col("answer").alias("label"))
    last = spark.read.parquet(labels_dir).groupBy(*TASK_KEYS).agg(F.min("best").alias("best"), F.max("seen").alias("seen"))
    last = last.withColumn("label_id", F.col("best").bitwiseAND(F.lit((1 << ID_BITS) - 1)))
    return last.join(sized_broadcast(names), "label_id", "left").select(
        *TASK_KEYS, F.coalesce("label", F.lit(sentinel)).alias("label"),
        F.shiftright("best", ID_BITS).cast("int").alias("attempts_used"), "seen")
