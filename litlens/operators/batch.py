"""Producing answers: send each task's prompt to an answer function and log
every attempt, until the task's stop rule holds.

Each task carries its draw plan as columns: how many ``attempts`` it may make,
and whether it stops at the first allowed answer (``first_valid``) or draws all
of them for a vote (``exactly``). Runs as ``mapInArrow`` over tasks spread
evenly across partitions (the only place where Python touches rows: the answer
function is user code, e.g. a model client). The number of partitions bounds the
number of concurrent calls. The output is the answer log that
:func:`resolve_answers` and :func:`majority_vote` read, so labels come out the
same whether the log was produced here or loaded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import sized_broadcast
from ..session import scratch_path

# A vocabulary up to this many labels is shipped to the tasks, which check their
# answers themselves; beyond it each round of attempts is checked by a join. The
# answer log is the same.
VOCAB_MAX_ROWS = 100_000
# The stop rules of a draw plan.
FIRST_VALID, EXACTLY = "first_valid", "exactly"
# Bytes of the Arrow batches in which prompts reach Python, where this package runs
# the job itself: a worker's memory then does not grow with rows or length of prompts.
PROMPT_BATCH_BYTES = 8 << 20
KEYS = ["paper_id", "category", "run"]


def answer_log_schema(id_type: str = "bigint", technique: bool = False) -> str:
    """Columns of the answer log; ids have the type of the papers' ids."""
    return (f"paper_id {id_type}, category string, run int, " + ("technique string, " if technique else "")
            + "attempt int, response string, error string")


def with_draw_plan(tasks: DataFrame, plan: DataFrame) -> DataFrame:
    """Tasks with ``stop`` and ``attempts`` from a small plan, joined by those of
    ``category`` and ``technique`` that the plan has. Tasks without a plan are
    left out."""
    keys = [c for c in ("category", "technique") if c in plan.columns]
    return tasks.join(sized_broadcast(plan.select(*keys, "stop", "attempts")), keys)


# fn(batch) -> responses: ``batch`` has columns paper_id, category, run,
# attempt, prompt; return one response (str or None = failed call) per row.
AnswerFn = Callable[[pd.DataFrame], "pd.Series | list"]


def label_batch(tasks: DataFrame, vocab: DataFrame, fn: AnswerFn, max_attempts: int = 3,
                partitions: int | None = None, rows_per_call: int = 64,
                skip_col: str | None = None, error_chars: int | None = None) -> DataFrame:
    """Answer log ``(paper_id, category, run[, technique], attempt, response,
    error)`` for tasks carrying a ``prompt``.

    A task makes at most ``attempts`` calls (a column; ``max_attempts`` without
    it) and stops at the first allowed answer, unless its ``stop`` is
    ``exactly``: then it makes all of them. A ``technique`` column is a further
    key of tasks and log. An exception in ``fn``, or an answer list of another
    length than the call, counts as a failed attempt for the rows of that call
    and is logged as ``error`` (cut to ``error_chars`` if given). Ids may be of
    any type. Tasks where ``skip_col`` is true (over the prompt budget) are not
    sent: they are logged once with ``attempt = 0`` and no response."""
    # the vocabulary is a small dimension: size-checked, then shipped to the tasks
    got = vocab.select("category", "label").distinct().limit(VOCAB_MAX_ROWS + 1).collect()
    keys = KEYS + (["technique"] if "technique" in tasks.columns else [])
    attempts = F.col("attempts").cast("int") if "attempts" in tasks.columns else F.lit(max_attempts)
    stop = F.col("stop") if "stop" in tasks.columns else F.lit(FIRST_VALID)
    t = tasks.select(*keys, "prompt", attempts.alias("_attempts"), stop.alias("_stop"),
                     (F.col(skip_col) if skip_col else F.lit(False)).alias("_skip"))
    schema = answer_log_schema(tasks.schema["paper_id"].dataType.simpleString(), len(keys) > len(KEYS))
    if len(got) <= VOCAB_MAX_ROWS:
        return _calls(t, keys, schema, fn, {tuple(r) for r in got}, None, partitions, rows_per_call, error_chars)
    return _rounds(t, vocab, keys, schema, fn, partitions, rows_per_call, error_chars)


def _calls(tasks: DataFrame, keys: list[str], schema: str, fn: AnswerFn, pairs: set | None, only: int | None,
           partitions: int | None, rows_per_call: int, error_chars: int | None) -> DataFrame:
    """The answers of all attempts, or of attempt ``only``."""
    cols = [*keys, "attempt", "response", "error"]
    if partitions:
        # round-robin: tasks are independent, and copies of one task must not
        # pile up in one Python worker
        tasks = tasks.repartition(partitions)

    def logged(todo: pa.RecordBatch, attempt: int, resp: list, error: str | None) -> pa.RecordBatch:
        n = todo.num_rows
        return pa.RecordBatch.from_arrays([*(todo.column(k) for k in keys), pa.array([attempt] * n, pa.int32()), pa.array(
            resp, pa.string(), from_pandas=True), pa.array([error] * n, pa.string())], names=cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            skipped = pc.fill_null(b.column("_skip"), False)
            if pc.any(skipped).as_py():
                if only in (None, 1):
                    none = b.filter(skipped)
                    out.append(logged(none, 0, [None] * none.num_rows, None))
                b = b.filter(pc.invert(skipped))
            for start in range(0, b.num_rows, rows_per_call):
                todo = b.slice(start, rows_per_call)
                attempt = only or 1
                while (todo := todo.filter(pc.greater_equal(todo.column("_attempts"), attempt))).num_rows:
                    # only the prompts of one call become Python strings
                    call = todo.select([*keys, "prompt"]).to_pandas().assign(attempt=attempt)
                    error = None
                    try:
                        resp = list(fn(call))
                        if len(resp) != len(call):
                            raise ValueError(f"{len(resp)} answers for {len(call)} prompts")
                    except Exception as e:  # a failed call: every row of it failed
                        resp, error = [None] * len(call), f"{type(e).__name__}: {e}"[:error_chars]
                    out.append(logged(todo, attempt, resp, error))
                    if only:
                        break
                    ok = [isinstance(r, str) and (c, r.strip()) in pairs for r, c in zip(resp, todo.column("category").to_pylist())]
                    todo = todo.filter(pa.array([not x or s == EXACTLY for x, s in zip(ok, todo.column("_stop").to_pylist())]))
                    attempt += 1
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return tasks.mapInArrow(run, schema)


def _rounds(tasks: DataFrame, vocab: DataFrame, keys: list[str], schema: str, fn: AnswerFn, partitions: int | None,
            rows_per_call: int, error_chars: int | None) -> DataFrame:
    """One round of calls per attempt, each stored, with a join between them that
    takes out the tasks whose answer the vocabulary has."""
    from .labels import valid_answers
    spark = tasks.sparkSession
    path = scratch_path(spark, "answer-rounds")
    most = tasks.agg(F.max("_attempts")).first()[0] or 0
    for attempt in range(1, most + 1):
        _calls(tasks, keys, schema, fn, None, attempt, partitions, rows_per_call, error_chars) \
            .write.parquet(f"{path}/round={attempt}")
        done = valid_answers(spark.read.schema(schema).parquet(f"{path}/round={attempt}"), vocab).select(*keys).distinct()
        left = tasks.join(done, keys, "left_anti")
        tasks = left.unionByName(tasks.filter(F.col("_stop") == EXACTLY).join(done, keys, "left_semi"))
        tasks = tasks.filter(F.col("_attempts") > attempt)
    return spark.read.schema(schema).parquet(*[f"{path}/round={k}" for k in range(1, most + 1)]) if most \
        else spark.createDataFrame([], schema)
