import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pandas as pd

from litlens.streaming.vote_stream import (
    NO_ANSWER, TASK, close_tasks, counters, outcome, read_counters, start_counter_stream, start_vote_stream,
    state_partitions, timed_log_schema,
)

HOUR = datetime(2024, 1, 1, 12)


def test_outcome_matches_plain_rules():
    rng = random.Random(3)
    for _ in range(2000):
        k = rng.randint(1, 5)
        got = {a: rng.choice([NO_ANSWER, 1, 2, -7]) for a in rng.sample(range(1, k + 1), rng.randint(0, k))}
        choice, votes, used, complete = outcome(got, "exactly", k)
        cast = [got[a] for a in sorted(got) if got[a] != NO_ANSWER]
        assert (choice, votes) == (Counter(cast).most_common(1)[0] if cast else (NO_ANSWER, 0))
        assert used == 0 and complete == (len(got) == k)
        choice, votes, used, complete = outcome(got, "first_valid", k)
        valid = [a for a in sorted(got) if got[a] > 0]
        assert (choice, used) == ((got[valid[0]], valid[0]) if valid else (NO_ANSWER, 0))
        before = range(1, (valid[0] if valid else k) + 1)
        assert complete == all(a in got for a in before)


def _run(spark, base, rows, vocab, plan):
    log = [(p, c, 1, a, r, None, t) for p, c, a, r, t in rows]
    spark.createDataFrame(log, timed_log_schema()).coalesce(1).write.mode("append").parquet(f"{base}/answers")
    start_vote_stream(spark, f"{base}/answers", vocab, plan, f"{base}/closed", f"{base}/votes").awaitTermination()
    start_counter_stream(spark, f"{base}/closed", f"{base}/counters", f"{base}/counts").awaitTermination()
    return {(r.paper_id, r.category): (r.label, r.votes, r.attempts_used, r.n_answers, r.complete)
            for r in spark.read.parquet(f"{base}/closed").collect()}


def test_tasks_close_once_and_late_answers_are_dropped(spark, tmp_dir):
    base = os.path.join(tmp_dir, "s")
    vocab = spark.createDataFrame([("v", "a"), ("v", "b"), ("f", "a")], "category string, label string")
    plan = spark.createDataFrame([("v", "exactly", 3), ("f", "first_valid", 2)],
                                 "category string, stop string, attempts int")
    t, later = HOUR, HOUR + timedelta(hours=2)
    got = _run(spark, base, [
        (1, "v", 3, " a\n", t), (1, "v", 1, "b", t), (1, "v", 2, "a", t),   # complete at once
        (2, "v", 1, "b", t), (2, "v", 2, None, t),                          # waits for its third vote
        (3, "f", 2, "a", t),                                                # waits for attempt 1
        (4, "f", 1, "a", t), (5, "f", 1, "no", t), (6, "v", 1, "x", None),  # no time: left out
        (7, "x", 1, "a", t), (8, "v", 9, "a", t)], vocab, plan)             # no plan; no such attempt
    assert got == {(1, "v"): ("a", 2, None, 3, True), (4, "f"): ("a", 1, 1, 1, True)}
    got = _run(spark, base, [
        (1, "v", 1, "b", t), (4, "f", 1, None, t),            # repeated answers of closed tasks
        (3, "f", 1, "nothing", t), (3, "f", 2, "no", t),      # closes; its second attempt came before
        (9, "v", 1, "b", later)], vocab, plan)                # moves the watermark past the first tasks
    assert got[(3, "f")] == ("a", 1, 2, 2, True)
    assert got[(2, "v")] == ("b", 1, None, 2, False)          # closed by its timer
    assert got[(5, "f")] == ("invalid result", 0, None, 1, False) and len(got) == 5
    again = _run(spark, base, [(2, "v", 3, "a", t), (5, "f", 2, "a", t), (9, "v", 2, "b", later),
                               (10, "f", 0, None, later + timedelta(days=1))], vocab, plan)
    assert {k: v for k, v in again.items() if k != (9, "v")} == got
    assert again[(9, "v")] == ("b", 2, None, 2, False) and len(again) == 6
    live = read_counters(spark, f"{base}/counters")
    batch = counters(spark.read.parquet(f"{base}/closed"))
    assert sorted(map(tuple, live.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))


class State:
    """What ``close_tasks`` uses of Spark's state of a bucket."""

    def __init__(self):
        self.get, self.timer, self.exists = None, None, False

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.exists, self.timer = False, None

    def getCurrentWatermarkMs(self):
        return self.now

    def setTimeoutTimestamp(self, ms):
        assert ms >= self.now
        self.timer = ms


def _closed(batches, bucket_of):
    """The rows put out per micro-batch, with data before timers, as Spark calls."""
    states, out = {}, []
    for now, rows in batches:
        by = {}
        for r in rows:
            by.setdefault(bucket_of(r[0]), []).append(r)
        got = []
        for timed_out in (False, True):
            calls = [b for b, s in states.items() if s.exists and s.timer < now] if timed_out else list(by)
            for b in calls:
                s = states.setdefault(b, State())
                s.now, s.hasTimedOut = now, timed_out
                frames = [pd.DataFrame(by[b][k:k + 3], columns=[*TASK, "attempt", "choice"])
                          for k in range(0, len(by[b]), 3)] if not timed_out else [pd.DataFrame(columns=[*TASK, "attempt", "choice"])]
                for frame in close_tasks((b,), iter(frames), s):
                    got += frame.astype(object).values.tolist()
        out.append(sorted(got, key=repr))
    assert not any(s.exists for s in states.values())  # no task and no mark is left behind
    return out


def _one_by_one(batches):
    """The same by plain rules, task by task."""
    held, out = {}, []
    for now, rows in batches:
        came, got = {}, []
        for *task, a, c in rows:
            came.setdefault(tuple(task), []).append((a, c))
        for task, answers in came.items():
            seen, _, closed = held.get(task, ({}, 0, False))
            seen = dict(seen)
            for a, c in sorted(answers):
                seen.setdefault(a, c)
            choice, votes, used, complete = outcome(seen, *task[-2:])
            if complete and not closed:
                got.append([*task[:3], choice, votes, used, len(seen), True])
            held[task] = seen, max(task[3], now + 1), closed or complete
        for task, (seen, due, closed) in list(held.items()):
            if due < now:
                choice, votes, used, _ = outcome(seen, *task[-2:])
                if not closed:
                    got.append([*task[:3], choice, votes, used, len(seen), False])
                del held[task]
        out.append(sorted(got, key=repr))
    return out


def test_buckets_close_each_task_as_if_it_were_alone():
    rng = random.Random(7)
    for _ in range(40):
        tasks = [(str(i) if i % 9 else None, rng.choice("tv"), rng.choice(["1", None]), 1000 * rng.randint(1, 6),
                  *rng.choice([("exactly", 3), ("exactly", 2), ("first_valid", 3), (None, 2)])) for i in range(25)]
        now, batches = 0, []
        for _ in range(8):
            open_tasks = [t for t in tasks if t[3] > now - 500]
            batches.append((now, [(*t, rng.randint(1, t[-1]), rng.choice([NO_ANSWER, 1, 2, -7]))
                                  for t in rng.choices(open_tasks, k=rng.randint(0, 40))] if open_tasks else []))
            now += rng.choice([0, 1, 999, 1000, 1500])
        batches += [(now + 10_000, []), (now + 20_000, [])]
        want = _one_by_one(batches)
        assert _closed(batches, lambda key: 0) == want
        assert _closed(batches, lambda key: hash(key) % 5) == want


def test_state_rows_are_buckets_not_tasks(spark, tmp_dir):
    base = os.path.join(tmp_dir, "s")
    vocab = spark.createDataFrame([("v", "a")], "category string, label string")
    plan = spark.createDataFrame([("v", "exactly", 2)], "category string, stop string, attempts int")
    big = (1 << 60) + 1  # not a double
    log = [(big + i if i else None, "v", 1 if i % 2 else None, a, "a", None, HOUR) for i in range(1300) for a in (1, 2)
           if a == 1 or i < 4]
    log += [(1, "v", 1, 0, None, None, HOUR + timedelta(days=1))]

    def wave(rows):
        spark.createDataFrame(rows, timed_log_schema()).coalesce(1).write.mode("append").parquet(f"{base}/answers")
        q = start_vote_stream(spark, f"{base}/answers", vocab, plan, f"{base}/closed", f"{base}/votes")
        q.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        return held, {(r.paper_id, r.run): (r.label, r.votes, r.n_answers, r.complete)
                      for r in spark.read.parquet(f"{base}/closed").collect()}

    held, got = wave(log[:-1])
    assert max(held) <= 1024
    ids = [(big + i if i else None, 1 if i % 2 else None) for i in range(1300)]
    assert got == {k: ("a", 2, 2, True) for k in ids[:4]}
    held, got = wave(log[-1:])
    assert held[-1] == 0
    assert got == {k: ("a", 2, 2, True) for k in ids[:4]} | {k: ("a", 1, 1, False) for k in ids[4:]}


def test_state_partitions_follow_buckets_and_cores_not_the_session(spark, tmp_dir):
    base, key = os.path.join(tmp_dir, "s"), "spark.sql.shuffle.partitions"
    vocab = spark.createDataFrame([("v", "a")], "category string, label string")
    plan = spark.createDataFrame([("v", "exactly", 2)], "category string, stop string, attempts int")
    log = [(i, "v", 1, a, "a", None, HOUR) for i in range(300) for a in (1, 2)]
    spark.createDataFrame(log, timed_log_schema()).coalesce(1).write.parquet(f"{base}/answers")
    old = spark.conf.get(key)
    spark.conf.set(key, "200")
    try:
        q = start_vote_stream(spark, f"{base}/answers", vocab, plan, f"{base}/closed", f"{base}/votes", buckets=10)
        assert spark.conf.get(key) == "200"
        q.awaitTermination()
    finally:
        spark.conf.set(key, old)
    used = {p["stateOperators"][0]["numShufflePartitions"] for p in q.recentProgress if p["stateOperators"]}
    assert used == {state_partitions(spark, 10)} and max(used) <= 10
    assert spark.read.parquet(f"{base}/closed").filter("votes = 2 and complete").count() == 300
    assert state_partitions(spark, 1 << 20) == (1 << 20) // 64
