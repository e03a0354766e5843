import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from litlens.operators.batch import PROMPT_BATCH_BYTES
from litlens.operators.labelling import label_collection
from litlens.operators.memo import answer_once
from litlens.session import ARROW_BYTES

TASKS = "paper_id long, category string, run int, prompt string, over boolean"


def counting(folder, alive=""):
    """Answers by the prompt; each call leaves a line. Without the file
    ``alive``, a prompt that holds ``bad`` ends the job before it is called."""

    def fn(batch):
        import os
        if alive and not os.path.exists(alive) and batch["prompt"].str.contains("bad").any():
            raise KeyboardInterrupt  # not an Exception: it ends the Spark task
        with open(os.path.join(folder, f"calls-{os.getpid()}"), "a") as f:
            f.writelines(f"{p}/{r}/{a}\n" for p, r, a in zip(batch["prompt"], batch["run"], batch["attempt"]))
        return ["A" if a == 2 else "?" for a in batch["attempt"]]

    return fn


def calls(folder):
    return Counter(line for n in os.listdir(folder) if n.startswith("calls-") for line in open(os.path.join(folder, n)))


def test_one_call_per_prompt_across_a_killed_run(spark, tmp_dir):
    vocab = spark.createDataFrame([("topic", "A")], "category string, label string")
    rows = [(i, "topic", r, f"prompt {i % 12}" + (" bad" if i % 12 == 5 else ""), False) for i in range(60) for r in (1, 2)]
    tasks = spark.createDataFrame(rows + [(99, "topic", 1, None, True)], TASKS)
    memo, alive, seen = (os.path.join(tmp_dir, n) for n in ("memo", "alive", "seen"))
    os.mkdir(seen)
    fn = counting(seen, alive)
    with pytest.raises(Exception):
        answer_once(tasks, vocab, fn, memo, buckets=5, skip_col="over")
    before = calls(seen)
    assert not any("bad" in c for c in before)
    open(alive, "w").close()
    log = answer_once(tasks, vocab, fn, memo, buckets=5, skip_col="over").collect()
    assert len(calls(seen)) == 12 * 2 * 2
    committed = {(r.digest, r.run, r.attempt) for r in spark.read.parquet(memo).collect()}
    assert len(committed) == spark.read.parquet(memo).count() == 48
    # only prompts of the bucket that was under way may have been called twice
    again = {c.rsplit("/", 2)[0] for c, n in calls(seen).items() if n > 1}
    bucket = {r.prompt: r.b for r in tasks.filter("not over").select(
        "prompt", F.pmod(F.xxhash64(F.sha2("prompt", 256)), F.lit(5)).alias("b")).distinct().collect()}
    assert {bucket[p] for p in again} <= {bucket["prompt 5 bad"]}
    assert Counter((r.paper_id, r.run) for r in log if r.attempt) == {(i, r): 2 for i in range(60) for r in (1, 2)}
    assert [r.attempt for r in log if r.paper_id == 99] == [0]
    # a grown collection only calls what is new
    total = sum(calls(seen).values())
    more = tasks.unionByName(spark.createDataFrame([(200, "topic", 1, "prompt 3", False), (201, "topic", 1, "new", False)], TASKS))
    log = answer_once(more, vocab, fn, memo, buckets=5, skip_col="over").collect()
    assert sum(calls(seen).values()) == total + 2 and sum(r.paper_id in (200, 201) for r in log) == 4


def test_nothing_to_send(spark, tmp_dir):
    vocab = spark.createDataFrame([("topic", "A")], "category string, label string")
    tasks = spark.createDataFrame([(1, "topic", 1, None, True)], TASKS)
    log = answer_once(tasks, vocab, lambda b: [], os.path.join(tmp_dir, "memo"), skip_col="over").collect()
    assert [(r.paper_id, r.attempt, r.response) for r in log] == [(1, 0, None)]


def holding():
    """Answers: the most prompts in a frame of the worker, and the bytes that Arrow holds there."""

    def fn(batch):
        import gc

        import pandas as pd
        import pyarrow as pa
        rows = max(len(o) for o in gc.get_objects() if isinstance(o, pd.DataFrame) and "prompt" in o.columns)
        return [f"{rows} {pa.total_allocated_bytes()}"] * len(batch)

    return fn


@pytest.mark.parametrize("memo", [True, False])
def test_memory_of_a_worker_is_bounded_by_bytes_and_calls(spark, tmp_dir, memo):
    papers = spark.range(0, 1000, 1, 1).select(F.col("id").alias("paper_id"), F.concat(
        F.col("id").cast("string"), F.repeat(F.lit("x"), 40_000)).alias("abstract"))
    vocab = spark.createDataFrame([("topic", "A")], "category string, label string")
    was = spark.conf.get(ARROW_BYTES, None)
    label_collection(spark, papers, vocab, holding(), ["topic"], fields=("abstract",), max_attempts=1, buckets=1, rows_per_call=32,
                     memo_path=os.path.join(tmp_dir, "memo") if memo else None, answers_path=os.path.join(tmp_dir, "log")).count()
    assert spark.conf.get(ARROW_BYTES, None) == was
    got = [tuple(map(int, r.response.split())) for r in spark.read.parquet(os.path.join(tmp_dir, "log")).collect()]
    assert len(got) == 1000
    assert max(rows for rows, _ in got) <= 32
    assert max(size for _, size in got) <= 3 * PROMPT_BATCH_BYTES
