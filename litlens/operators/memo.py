"""Answers kept by prompt, so that no prompt is paid for twice.

Tasks with the same prompt (of one category, run and technique) share one set of
answers: the prompt is called once, under the task of the smallest paper, and the
answers are joined back to all of them. The memo is a table of answers by prompt
digest, written in buckets of digests, each one commit. A run that died, or a
later run over a grown collection with the same memo, only calls the prompts that
no commit has. A Spark task that is retried calls again what it called in its
bucket; no finished bucket is ever called again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_batches_below, scratch_path
from ..sources.tables import read_if_exists
from .batch import KEYS, PROMPT_BATCH_BYTES, AnswerFn, answer_log_schema, label_batch


def prompt_digest(prompt_col: str = "prompt"):
    return F.sha2(F.col(prompt_col), 256)


def answer_once(tasks: DataFrame, vocab: DataFrame, fn: AnswerFn, memo_path: str, buckets: int = 16,
                max_attempts: int = 3, partitions: int | None = None, rows_per_call: int = 64,
                skip_col: str | None = None) -> DataFrame:
    """The answer log of :func:`label_batch` for all ``tasks``, with one call per
    distinct prompt, category, run and technique that ``memo_path`` has no answer
    for. Another run of a paper is another draw, so it is called anew. Tasks over
    the budget (``skip_col``) have no prompt and are only logged."""
    spark = tasks.sparkSession
    technique = ["technique"] if "technique" in tasks.columns else []
    by = ["digest", "category", "run", *technique]
    skip = F.coalesce(F.col(skip_col), F.lit(False)) if skip_col else F.lit(False)
    sent = tasks.filter(~skip).withColumn("digest", prompt_digest())
    # the task that stands for its prompt; only small columns are shuffled
    first = sent.groupBy(*by).agg(F.min("paper_id").alias("paper_id"))
    known = read_if_exists(spark, memo_path)
    if known is not None:
        first = first.join(known.select(*by).distinct(), by, "left_anti")
    todo = f"{scratch_path(spark, 'prompts')}/todo"
    sent.join(first, [*by, "paper_id"], "left_semi").dropDuplicates([*by, "paper_id"]).withColumn(
        "bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")).write.partitionBy("bucket").parquet(todo)
    open_prompts = spark.read.schema(sent.withColumn("bucket", F.lit(0)).schema).parquet(todo)
    # rows of the folder listing: at most ``buckets``
    for (bucket,) in open_prompts.select("bucket").distinct().orderBy("bucket").collect():
        mine = open_prompts.filter(F.col("bucket") == bucket)  # one folder, no other is read
        log = label_batch(mine, vocab, fn, max_attempts, partitions, rows_per_call)
        with arrow_batches_below(spark, PROMPT_BATCH_BYTES):
            log.join(mine.select(*KEYS, *technique, "digest"), [*KEYS, *technique]).select(
                *by, "attempt", "response", "error").write.mode("append").parquet(memo_path)
    kind = tasks.schema["paper_id"].dataType.simpleString()
    schema = answer_log_schema(kind, bool(technique))
    names = [c.split()[0] for c in schema.split(", ")]
    memo = read_if_exists(spark, memo_path)
    if memo is None:  # nothing was ever sent
        answered = spark.createDataFrame([], schema)
    else:
        answered = sent.select(*KEYS, *technique, "digest").join(memo, by).select(*names)
    unsent = tasks.filter(skip).select(*KEYS, *technique, F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("response"),
                                       F.lit(None).cast("string").alias("error")).select(*names)
    return answered.unionByName(unsent)
