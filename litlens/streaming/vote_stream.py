"""Tasks closed one by one while their answers arrive, and live counters of them.

The tasks are dealt to buckets by a hash of their keys. A bucket has one row in
Spark's state store, with its tasks side by side, and one timer, that of the task
due first: Python is called once per bucket and micro-batch, however many tasks
there are. A task closes as soon as its draw plan is met (``first_valid``: an
allowed answer and all attempts before it; ``exactly``: all its votes), else when
the watermark passes the time at which it was asked. It is put out once, when it
closes.

All answers of a task carry the time at which the task was asked, so one
watermark bounds everything: answers that come when it has passed are late and
Spark drops them; the mark that a closed task leaves against answers still under
way is dropped at the same moment. State is held for the tasks of the last
``patience`` only, however many there were before.

The closed tasks are a Parquet folder written by the first stream (each row once,
by the sink's own log). The second stream counts them: a few rows of state per
category and run.

NULL answers (failed calls) count as arrived and cast no vote. Answers with an
attempt outside 1 to the plan's number are ignored, repeated attempts of a task
keep the one that came first (the smallest choice, if together), and rows without
``asked_at`` are left out, since no timer could close their task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import py_strip
from ..operators.batch import answer_log_schema, with_draw_plan
from ..operators.labels import INVALID_RESULT, TASK_KEYS
from ..plans.joins import sized_broadcast
from ..session import shuffle_partitions_at_most
from .resolve_stream import label_ids

NO_ANSWER = 0  # choice of a failed call; labels count from 1, other texts are negative
# Buckets of tasks, unless a stream names another number. A bucket holds its share
# of the tasks of the last ``patience``.
BUCKETS = 1024
# Buckets that a state partition holds at least, as long as all cores have two partitions:
# each partition starts Python and commits its state in every micro-batch, due tasks or not.
BUCKETS_A_PARTITION = 64
# A bucket's tasks, one array per column: keys (as strings, which may be NULL), time
# asked, draw plan, timer, and whether closed; then the answers of the open ones, end
# to end.
TASK = {**{f"_{i}": "string" for i in range(len(TASK_KEYS))}, "asked_ms": "bigint", "stop": "string", "attempts": "int"}
STATE = ", ".join(f"{c} array<{kind}>" for c, kind in {
    **TASK, "due_ms": "bigint", "closed": "boolean", "n_seen": "int", "seen": "int", "choices": "bigint"}.items())
CLOSED = ", ".join(f"_{i} string" for i in range(len(TASK_KEYS))) + \
    ", choice bigint, votes bigint, attempts_used int, n_answers int, complete boolean"


def timed_log_schema(id_type: str = "bigint") -> str:
    """The answer log with the time at which each task was asked."""
    return answer_log_schema(id_type) + ", asked_at timestamp"


def outcome(got: dict[int, int], stop: str, attempts: int) -> tuple[int, int, int, bool]:
    """``(choice, votes, attempts_used, complete)`` of the answers so far; 0
    attempts used stands for no allowed answer, and for a vote."""
    everything = len(got) == attempts
    if stop == "first_valid":
        valid = [a for a in sorted(got) if got[a] > 0]
        if not valid:
            return NO_ANSWER, 0, 0, everything
        first = valid[0]
        return got[first], 1, first, all(a in got for a in range(1, first))
    tally: dict[int, int] = {}
    for a in sorted(got):
        if got[a] != NO_ANSWER:
            tally[got[a]] = tally.get(got[a], 0) + 1
    best = max(tally, key=tally.get, default=NO_ANSWER)  # the first of equals was seen first
    return best, tally.get(best, 0), 0, everything


def held_tasks(value: tuple) -> dict[tuple, tuple[dict[int, int], int, bool]]:
    """The tasks of a state row, each with its answers, its timer and whether it is closed."""
    *task, due, closed, n_seen, seen, choices = value
    answers = zip(seen, choices)
    return {t: (dict(islice(answers, n)), d, c) for t, d, c, n in zip(zip(*task), due, closed, n_seen)}


def state_row(tasks: dict[tuple, tuple[dict[int, int], int, bool]]) -> tuple:
    """The state row of :func:`held_tasks`."""
    got, due, closed = zip(*tasks.values())
    return (*map(list, zip(*tasks)), list(due), list(closed), [len(g) for g in got],
            [a for g in got for a in g], [c for g in got for c in g.values()])


def close_tasks(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One call per bucket and micro-batch, and one when the bucket's timer fires."""
    now = state.getCurrentWatermarkMs()
    tasks = held_tasks(state.get) if state.exists else {}
    came: dict[tuple, dict[int, int]] = {}
    if not state.hasTimedOut:
        for frame in frames:
            keys = zip(*(frame[name].tolist() for name in TASK))
            for task, a, c in zip(keys, frame["attempt"].tolist(), frame["choice"].tolist()):
                answers = came.setdefault(task, {})
                answers[a] = min(c, answers.get(a, c))
    for task, answers in came.items():
        got, _, closed = tasks.get(task, ({}, 0, False))
        tasks[task] = ({} if closed else answers | got), max(task[-3], now + 1), closed
    out, left = [], {}
    for task, (got, due, closed) in tasks.items():
        *keys, _, stop, attempts = task
        if not closed and (task in came or due < now):
            choice, votes, used, complete = outcome(got, stop, attempts)
            if complete or due < now:
                out.append((*keys, choice, votes, used, len(got), complete))
                got, closed = {}, True
        if due >= now:
            left[task] = got, due, closed
    if left:
        state.update(state_row(left))
        state.setTimeoutTimestamp(min(due for _, due, _ in left.values()))
    else:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CLOSED.split(", ")])


def closed_tasks(answers: DataFrame, ids: DataFrame, plan: DataFrame, patience: str,
                 sentinel: str = INVALID_RESULT, buckets: int = BUCKETS) -> DataFrame:
    """Stream of closed tasks: ``(paper_id, category, run, label, votes,
    attempts_used, n_answers, complete)``; ``complete`` is false for a task that
    the timer closed. Answers outside the vocabulary vote under a hash of their text."""
    kinds = dict(answers.dtypes)
    a = answers.filter(F.col("asked_at").isNotNull()).withWatermark("asked_at", patience)
    # a condition on both columns stays above the watermark, which counts every row
    a = with_draw_plan(a, plan).filter(F.when(F.col("asked_at").isNotNull(), F.col("attempt").between(1, F.col("attempts"))))
    a = a.withColumn("answer", F.coalesce(py_strip(F.col("response")), F.concat(
        F.lit("\x00"), F.xxhash64(*TASK_KEYS, "attempt").cast("string"))))  # no hot NULL key in the join
    other = -1 - F.xxhash64("answer").bitwiseAND(F.lit((1 << 62) - 1))
    bucket = F.pmod(F.xxhash64(*TASK_KEYS), F.lit(buckets)).cast("int")
    a = a.join(ids, ["category", "answer"], "left").select(
        bucket.alias("bucket"), *[F.col(k).cast("string").alias(f"_{i}") for i, k in enumerate(TASK_KEYS)],
        "asked_at", F.unix_millis("asked_at").alias("asked_ms"), "stop", "attempts", "attempt",
        F.when(F.col("response").isNull(), F.lit(NO_ANSWER).cast("long"))
         .otherwise(F.coalesce("label_id", other)).alias("choice"))
    done = a.groupBy("bucket").applyInPandasWithState(close_tasks, CLOSED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    names = ids.select(F.col("label_id").alias("choice"), F.col("answer").alias("label"))
    return done.join(names, "choice", "left").select(
        *[F.col(f"_{i}").cast(kinds[k]).alias(k) for i, k in enumerate(TASK_KEYS)],
        F.coalesce("label", F.lit(sentinel)).alias("label"), "votes", F.nullif("attempts_used", F.lit(0)).alias("attempts_used"),
        "n_answers", "complete")


def state_partitions(spark: SparkSession, buckets: int) -> int:
    return max(1, buckets // BUCKETS_A_PARTITION, min(buckets, 2 * spark.sparkContext.defaultParallelism))


def start_vote_stream(spark: SparkSession, answers_dir: str, vocab: DataFrame, plan: DataFrame,
                      closed_dir: str, checkpoint_dir: str, patience: str = "30 minutes",
                      available_now: bool = True, id_type: str = "bigint",
                      files_per_batch: int | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Stream Parquet answers (:func:`timed_log_schema`) into closed tasks. ``plan`` has
    ``stop`` and ``attempts`` by category. ``buckets`` stays the same for a checkpoint,
    whose state has them as keys."""
    reader = spark.readStream.schema(timed_log_schema(id_type))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    ids = sized_broadcast(label_ids(spark, closed_dir, vocab))
    done = closed_tasks(reader.parquet(answers_dir), ids, plan, patience, buckets=buckets)
    w = (done.writeStream.format("parquet").outputMode("append").option("path", closed_dir)
         .option("checkpointLocation", checkpoint_dir))
    with shuffle_partitions_at_most(spark, state_partitions(spark, buckets)):
        return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def counters(closed: DataFrame, sentinel: str = INVALID_RESULT) -> DataFrame:
    """Closed tasks per category and run: all, labelled, invalid, closed by the
    timer, and attempts spent until an allowed answer."""
    return closed.groupBy("category", "run").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.col("label") != sentinel).alias("n_valid"),
        F.count_if(F.col("label") == sentinel).alias("n_invalid"),
        F.count_if(~F.col("complete")).alias("n_timed_out"),
        F.sum(F.col("attempts_used").cast("long")).alias("attempts"))


def start_counter_stream(spark: SparkSession, closed_dir: str, counters_dir: str, checkpoint_dir: str,
                         available_now: bool = True) -> StreamingQuery:
    """Count the closed tasks of :func:`start_vote_stream` while they come. Each
    micro-batch writes all counters under its number; a replayed one writes the
    same again."""
    schema = spark.read.parquet(closed_dir).schema

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{counters_dir}/batch_id={batch_id}")

    w = (counters(spark.readStream.schema(schema).parquet(closed_dir)).writeStream.outputMode("complete")
         .foreachBatch(write).option("checkpointLocation", checkpoint_dir))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def read_counters(spark: SparkSession, counters_dir: str) -> DataFrame:
    """The counters of the last micro-batch: a row per category and run."""
    rows = spark.read.parquet(counters_dir)
    last = rows.groupBy("category", "run").agg(F.max_by(F.struct(*rows.columns), "batch_id").alias("r"))
    return last.select("r.*").drop("batch_id")
