import json
import os

from pyspark.sql import functions as F

from litlens.operators import labels as L
from litlens.operators.batch import label_batch
from litlens.operators.upsert import upsert, write_labels
from litlens.sources import fixtures as X
from litlens.sources.papers import load_papers_json, write_share_csv
from litlens.streaming.resolve_stream import read_labels, start_resolve_stream

SF = "/root/testdata/sf0.001"


def test_upsert_sets_one_field_and_inserts(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, s string, other string")
    u = spark.createDataFrame([(2, "B", 0), (2, "BB", 5), (3, "c", 1)], "id long, s string, v int")
    got = sorted(tuple(r) for r in upsert(t, u.drop("v"), ["id"]).collect())
    assert got[0] == (1, "a", "x") and got[2] == (3, "c", None)
    latest = {r.id: r.s for r in upsert(t, u, ["id"], order="v").collect()}
    assert latest == {1: "a", 2: "BB", 3: "c"}


def test_write_labels_replaces_only_touched_partitions(spark, tmp_dir):
    path = os.path.join(tmp_dir, "labels")
    schema = "paper_id long, label string, category string, run int"
    spark.createDataFrame([(1, "A", "topic", 1), (1, "X", "ethics", 1)], schema) \
        .write.partitionBy("category", "run").parquet(path)
    cur = spark.read.parquet(path)
    upd = spark.createDataFrame([(1, "B", "topic", 1), (2, "C", "topic", 1)], schema)
    merged = upsert(cur.filter("category = 'topic'"), upd, ["paper_id", "category", "run"])
    write_labels(spark, merged, path)
    got = sorted((r.paper_id, r.category, r.label) for r in spark.read.parquet(path).collect())
    assert got == [(1, "ethics", "X"), (1, "topic", "B"), (2, "topic", "C")]


def test_json_array_source(spark, tmp_dir):
    path = os.path.join(tmp_dir, "papers.json")
    papers = [{"_id": "a1", "title": "Ünïcode ✓", "abstract": None, "fulltext": "x"},
              {"_id": "a2", "title": "t", "abstract": "ab", "url": "u"}]
    with open(path, "w", encoding="utf-8") as f:
        json.dump(papers, f, ensure_ascii=False)
    rows = load_papers_json(spark, path).orderBy("paper_id").collect()
    assert [(r.paper_id, r.title, r.abstract, r.url) for r in rows] == [
        ("a1", "Ünïcode ✓", None, None), ("a2", "t", "ab", "u")]


def test_share_csv_round_trip(spark, tmp_dir):
    s = spark.createDataFrame([("topic", 1990, "A", 60.0), ("topic", 2000, "B", 100.0),
                               ("ethics", 1990, "C", 100.0)],
                              "category string, decade int, label string, pct double")
    write_share_csv(s, tmp_dir, {"topic": ["A", "B"], "ethics": ["C"]})
    back = spark.read.option("header", True).csv(os.path.join(tmp_dir, "category=topic")).collect()
    assert [(r.decade, float(r.A), float(r.B)) for r in back] == [("1990", 60.0, 0.0), ("2000", 0.0, 100.0)]


def test_stream_equals_batch_out_of_order(spark, tmp_dir):
    resp = X.responses(spark, SF)
    src = os.path.join(tmp_dir, "answers")
    for wave in (3, 1, 2):
        resp.filter(F.col("attempt") == wave).coalesce(2).write.mode("append").parquet(src)
    vocab = X.vocabulary(spark)
    parts, ckpt = os.path.join(tmp_dir, "partials"), os.path.join(tmp_dir, "ckpt")
    q = start_resolve_stream(spark, src, vocab, parts, ckpt, files_per_batch=1)
    q.awaitTermination()
    streamed = read_labels(spark, parts).drop("seen")
    batch = L.resolve_answers(resp, vocab)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_label_batch_retries_and_failures(spark):
    vocab = spark.createDataFrame([("topic", "A"), ("topic", "B")], "category string, label string")
    tasks = spark.createDataFrame([(1, "topic", 1, "p1"), (2, "topic", 1, "p2"), (3, "topic", 1, "p3")],
                                  "paper_id long, category string, run int, prompt string")

    def fn(batch):
        if (batch["paper_id"] == 3).any() and (batch["attempt"] == 1).all():
            raise RuntimeError("service down")
        return [" A\n" if (pid == 1 or a == 3) else "nonsense"
                for pid, a in zip(batch["paper_id"], batch["attempt"])]

    log = label_batch(tasks, vocab, fn, max_attempts=3, rows_per_call=1)
    rows = sorted((r.paper_id, r.attempt, r.response) for r in log.collect())
    assert rows[0] == (1, 1, " A\n") and len([r for r in rows if r[0] == 1]) == 1
    assert [r[2] for r in rows if r[0] == 3][0] is None
    res = {r.paper_id: (r.label, r.attempts_used) for r in L.resolve_answers(log, vocab).collect()}
    assert res == {1: ("A", 1), 2: ("A", 3), 3: ("A", 3)}


def test_label_collection_budget_and_log(spark, tmp_dir):
    from litlens.operators.labelling import label_collection
    papers = spark.createDataFrame([(1, "short", "t", "x"), (2, "long", "t", "y" * 4000)],
                                   "paper_id long, abstract string, title string, fulltext string")
    vocab = spark.createDataFrame([("topic", "A")], "category string, label string")

    def fn(batch):
        return ["A" if a == 2 else "no" for a in batch["attempt"]]

    log_path = os.path.join(tmp_dir, "log")
    got = label_collection(spark, papers, vocab, fn, ["topic"], limit=500, answers_path=log_path)
    res = {r.paper_id: (r.label, r.attempts_used) for r in got.collect()}
    assert res == {1: ("A", 2), 2: ("invalid entry", None)}
    log = spark.read.parquet(log_path)
    # paper 2 was never sent: only its "not sent" marker (attempt 0) is logged
    assert sorted((r.paper_id, r.attempt) for r in log.collect()) == [(1, 1), (1, 2), (2, 0)]


def _wave(resp, src, k):
    resp.filter(F.col("attempt") == k).coalesce(1).write.mode("append").parquet(src)


def _same(labels, batch):
    got = labels.drop("seen")
    return got.exceptAll(batch).count() == 0 and got.count() == batch.count()


def test_stream_state_survives_restart_and_replay(spark, tmp_dir):
    resp, vocab = X.responses(spark, SF), X.vocabulary(spark)
    batch = L.resolve_answers(resp, vocab)
    src, out, ckpt = (os.path.join(tmp_dir, n) for n in ("answers", "labels", "ckpt"))

    def go(words):
        q = start_resolve_stream(spark, src, words, out, ckpt, files_per_batch=1)
        q.awaitTermination()
        return q

    first = vocab.filter("label != 'label 2'")
    for k in (3, 1):
        _wave(resp, src, k)
    q = go(first)
    assert any(op["numRowsTotal"] > 0 for p in q.recentProgress for op in p["stateOperators"])
    # a label more in the vocabulary: the old ones keep their numbers
    before = {(r.category, r.answer): r.label_id for r in spark.read.parquet(out + "-labels").collect()}
    _wave(resp, src, 2)
    q = go(first)
    assert sum(p["numInputRows"] for p in q.recentProgress) == resp.filter("attempt = 2").count()
    known = {(r.category, r.label) for r in first.collect()}
    want = L.resolve_answers(resp, first)
    assert _same(read_labels(spark, out), want)
    # replayed rows of an old batch change nothing
    old = spark.read.parquet(f"{out}/batch_id=0")
    old.write.parquet(f"{out}/batch_id=99")
    assert _same(read_labels(spark, out), want)
    from litlens.streaming.resolve_stream import label_ids
    after = {(r.category, r.answer): r.label_id for r in label_ids(spark, out, vocab).collect()}
    assert set(before) == known and all(after[k] == i for k, i in before.items())
    assert len(set(after.values())) == len(after) == vocab.count() and batch.count() == want.count()


def test_upsert_table_rewrites_only_touched_partitions(spark, tmp_dir):
    from litlens.operators.upsert import upsert_table
    path = os.path.join(tmp_dir, "labels")
    schema = "paper_id long, label string, category string, run int"
    upsert_table(spark, path, spark.createDataFrame(
        [(1, "A", "topic", 1), (1, "X", "ethics", 1), (2, "Y", "ethics", 2)], schema))
    ethics_files = sorted(os.listdir(os.path.join(path, "category=ethics", "run=1")))
    upsert_table(spark, path, spark.createDataFrame([(1, "B", "topic", 1), (3, "C", "topic", 1)], schema))
    got = sorted((r.paper_id, r.category, r.run, r.label) for r in spark.read.parquet(path).collect())
    assert got == [(1, "ethics", 1, "X"), (1, "topic", 1, "B"), (2, "ethics", 2, "Y"), (3, "topic", 1, "C")]
    # the untouched partition was not rewritten
    assert sorted(os.listdir(os.path.join(path, "category=ethics", "run=1"))) == ethics_files


def test_load_papers_absent_field_is_null(spark, tmp_dir):
    from litlens.sources.papers import load_papers
    path = os.path.join(tmp_dir, "papers")
    spark.createDataFrame([(1, "t", "yes")], "paper_id long, title string, screen string") \
        .write.parquet(path)
    r = load_papers(spark, path).collect()[0]
    assert (r.paper_id, r.title, r.screen, r.abstract, r.screen_alt) == (1, "t", "yes", None, None)


def test_sample_is_deterministic_and_whole_when_small(spark):
    from litlens.operators.sample import sample_papers, sample_report
    p = X.papers(spark, SF)
    a = [r.paper_id for r in sample_papers(p, 10, seed=3).collect()]
    b = [r.paper_id for r in sample_papers(p, 10, seed=3).collect()]
    c = [r.paper_id for r in sample_papers(p, 10, seed=4).collect()]
    assert a == b and a != c and len(set(a)) == 10
    small = p.limit(5)
    rep = sample_report(small, 10, seed=3, show_col="url").collect()
    assert len(rep) == 5 and [r.pos for r in rep] == [1, 2, 3, 4, 5]
    assert {r.url for r in rep} == {"No URL"}


def test_label_collection_rerun_with_larger_budget(spark, tmp_dir):
    from litlens.operators.labelling import label_collection
    papers = spark.createDataFrame([(2, "long", "t", "y" * 4000)],
                                   "paper_id long, abstract string, title string, fulltext string")
    vocab = spark.createDataFrame([("topic", "A")], "category string, label string")
    log_path = os.path.join(tmp_dir, "log")
    first = label_collection(spark, papers, vocab, lambda b: ["A"] * len(b), ["topic"], limit=500,
                             answers_path=log_path).collect()
    assert [(r.label, r.attempts_used) for r in first] == [("invalid entry", None)]
    again = label_collection(spark, papers, vocab, lambda b: ["A"] * len(b), ["topic"],
                             answers_path=log_path).collect()
    assert [(r.label, r.attempts_used) for r in again] == [("A", 1)]


def test_entries_projection(spark):
    from litlens.sources.papers import entries
    p = spark.createDataFrame([(5, "abs", "t")], "paper_id long, abstract string, title string")
    r = entries(p).collect()[0]
    assert (r._id, r.abstract, r.title, r.fulltext) == ("5", "abs", "t", None)


KEYS = "paper_id long, category string, run int"


def test_upsert_order_in_its_own_type(spark):
    t = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (3, "b")], "id long, s string")
    u = spark.createDataFrame([(1, "new", -5), (2, "old", None), (2, "new", -9), (3, "new", None), (4, None, 0)],
                              "id long, s string, v int")
    got = sorted((r.id, r.s) for r in upsert(t, u, ["id"], order="v").collect())
    assert got == [(1, "new"), (2, "new"), (3, "new"), (3, "new"), (4, None)]
    times = spark.sql("SELECT 1L AS id, 'late' AS s, timestamp'2024-01-01 00:00:00.9' AS at UNION ALL "
                      "SELECT 1L, 'early', timestamp'2024-01-01 00:00:00.1'")
    assert [r.s for r in upsert(t.filter("id = 1"), times, ["id"], order="at").collect()] == ["late"]


def test_upsert_adds_a_new_field_and_null_keys(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n")], "id long, s string")
    u = spark.createDataFrame([(1, "yes"), (None, "no"), (5, "new")], "id long, screen string")
    got = sorted(((r.id, r.s, r.screen) for r in upsert(t, u, ["id"]).collect()), key=str)
    assert got == [(1, "a", "yes"), (5, None, "new"), (None, "n", "no")]


def test_first_write_merges_and_errors_are_raised(spark, tmp_dir):
    import pytest

    from litlens.operators.upsert import upsert_table
    path = os.path.join(tmp_dir, "labels")
    u = spark.createDataFrame([(1, "topic", 1, "A", 1), (1, "topic", 1, "B", 2)], KEYS + ", label string, v int")
    upsert_table(spark, path, u, order="v")
    assert [r.label for r in spark.read.parquet(path).collect()] == ["B"]
    upsert_table(spark, path, spark.createDataFrame([(1, "topic", 1, "x")], KEYS + ", note string"))
    r = spark.read.option("mergeSchema", True).parquet(path).collect()[0]
    assert (r.label, r.note) == ("B", "x")
    bad = os.path.join(tmp_dir, "bad")
    os.makedirs(bad)
    with open(os.path.join(bad, "x.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        upsert_table(spark, bad, u, order="v")


def test_string_ids_from_json_to_labels(spark, tmp_dir):
    from litlens.operators.labelling import label_collection
    path = os.path.join(tmp_dir, "papers.json")
    with open(path, "w") as f:
        json.dump([{"_id": f"{k:024x}", "title": "t", "abstract": "a", "fulltext": "x"} for k in range(5)], f)
    vocab = spark.createDataFrame([("topic", "A")], "category string, label string")
    got = label_collection(spark, load_papers_json(spark, path), vocab, lambda b: ["A"] * len(b), ["topic"])
    assert {r.paper_id: r.label for r in got.collect()} == {f"{k:024x}": "A" for k in range(5)}


def test_errors_are_logged(spark):
    vocab = spark.createDataFrame([("topic", "A")], "category string, label string")
    tasks = spark.createDataFrame([(1, "topic", 1, "p"), (2, "topic", 1, "p")], KEYS + ", prompt string")

    def fn(batch):
        if (batch["attempt"] == 1).all():
            raise KeyError("bug")
        return ["A"] if (batch["attempt"] == 2).all() else []

    log = label_batch(tasks, vocab, fn, max_attempts=3, rows_per_call=1).orderBy("paper_id", "attempt").collect()
    assert [(r.attempt, r.response, r.error) for r in log if r.paper_id == 1] == [
        (1, None, "KeyError: 'bug'"), (2, "A", None)]
    short = label_batch(tasks, vocab, lambda b: [], max_attempts=1, rows_per_call=1).collect()
    assert {r.error for r in short} == {"ValueError: 0 answers for 1 prompts"}


def test_stop_rules_and_large_vocabularies_give_one_log(spark, monkeypatch):
    from litlens.operators import batch as B
    vocab = spark.createDataFrame([("topic", f"L{k}") for k in range(20)], "category string, label string")
    rows = [(k, "topic", 1, "p", t, s, n) for k in range(4) for t, s, n in
            (("retry", "first_valid", 5), ("once", "first_valid", 1), ("vote", "exactly", 3))]
    tasks = spark.createDataFrame(rows, KEYS + ", prompt string, technique string, stop string, attempts int")
    tasks = tasks.withColumn("over", (F.col("paper_id") == 3) & (F.col("technique") == "once"))
    fn = lambda b: [f" L{p}" if a > 1 else "?" for p, a in zip(b["paper_id"], b["attempt"])]
    log = sorted(map(tuple, label_batch(tasks, vocab, fn, skip_col="over").collect()))
    made = {(k, t): [r[4] for r in log if (r[0], r[3]) == (k, t)] for k in range(4) for t in ("retry", "once", "vote")}
    assert made == {(k, t): [0] if (k, t) == (3, "once") else n for k in range(4)
                    for t, n in (("retry", [1, 2]), ("once", [1]), ("vote", [1, 2, 3]))}
    monkeypatch.setattr(B, "VOCAB_MAX_ROWS", 3)
    assert sorted(map(tuple, label_batch(tasks, vocab, fn, skip_col="over").collect())) == log
    assert label_batch(tasks.limit(0), vocab, fn).collect() == []


def test_error_texts_are_whole_unless_cut(spark):
    vocab = spark.createDataFrame([("topic", "A")], "category string, label string")
    tasks = spark.createDataFrame([(1, "topic", 1, "p")], KEYS + ", prompt string")

    def fn(batch):
        raise ValueError("x" * 2000)

    assert len(label_batch(tasks, vocab, fn, max_attempts=1).first().error) == 2012
    assert len(label_batch(tasks, vocab, fn, max_attempts=1, error_chars=10).first().error) == 10


def test_resolve_by_settings(spark):
    vocab = spark.createDataFrame([("a", "yes"), ("b", "yes")], "category string, label string")
    log = spark.createDataFrame([(1, c, 1, n, "yes" if n == 3 else None) for c in "ab" for n in (1, 2, 3)],
                                KEYS + ", attempt int, response string")
    settings = spark.createDataFrame([("a", 2, "none"), ("b", 3, "x")], "category string, attempts int, sentinel string")
    got = sorted(map(tuple, L.resolve_answers(log, vocab, settings=settings).collect()))
    assert got == [(1, "a", 1, "none", None), (1, "b", 1, "yes", 3)]


def test_vocabulary_joined_by_shuffle_gives_the_same(spark, monkeypatch):
    resp, vocab = X.responses(spark, SF), X.vocabulary(spark)
    want = sorted(map(tuple, L.resolve_answers(resp, vocab).collect()), key=str)
    votes = sorted(map(tuple, L.majority_vote(resp, vocab).collect()), key=str)
    monkeypatch.setattr(L, "sized_broadcast", lambda df: df)
    assert sorted(map(tuple, L.resolve_answers(resp, vocab).collect()), key=str) == want
    assert sorted(map(tuple, L.majority_vote(resp, vocab).collect()), key=str) == votes


def test_a_run_that_died_goes_on(spark, tmp_dir):
    from litlens.operators.labelling import label_collection
    papers = spark.createDataFrame([(k, "a", "t", "x") for k in range(40)],
                                   "paper_id long, abstract string, title string, fulltext string")
    vocab = spark.createDataFrame([("topic", "A"), ("topic", "B")], "category string, label string")
    log, seen = os.path.join(tmp_dir, "log"), os.path.join(tmp_dir, "seen")
    os.makedirs(seen)

    def fn(batch, die=False):
        if die and len(os.listdir(seen)) > 15:
            raise SystemExit("killed")
        for p in batch["paper_id"]:
            with open(os.path.join(seen, f"{p}-{len(os.listdir(seen))}"), "w"):
                pass
        return ["A"] * len(batch)

    run = lambda f, call: label_collection(spark, papers, vocab, f, ["topic"], answers_path=log, call_id=call,
                                           slices=5, rows_per_call=1)
    try:
        run(lambda b: fn(b, die=True), "one")
    except Exception:
        pass
    logged = {r.paper_id for r in spark.read.parquet(f"{log}/call=one").collect()}
    assert 0 < len(logged) < 40
    for f in os.listdir(seen):
        os.rename(os.path.join(seen, f), os.path.join(tmp_dir, f"before-{f}"))
    assert {(r.paper_id, r.label) for r in run(fn, "one").collect()} == {(k, "A") for k in range(40)}
    assert {int(f.split("-")[0]) for f in os.listdir(seen)} == set(range(40)) - logged
    again = run(lambda b: ["B"] * len(b), "two")
    assert {(r.paper_id, r.label) for r in again.collect()} == {(k, "B") for k in range(40)}


class _Session:
    """As much of a session as the scratch folder needs."""
    def __init__(self, master, conf):
        self.sparkContext, self.master, self._dir, self.conf = self, master, None, conf

    def getCheckpointDir(self):
        return self._dir

    def setCheckpointDir(self, d):
        self._dir = d


def test_scratch_folder_on_any_file_system():
    import pytest

    from litlens.session import scratch_path
    for d in ("hdfs:/x", "/x", "s3a://bucket/x", "dbfs:/x/"):
        got = scratch_path(_Session("spark://h:7077", {"spark.checkpoint.dir": d}), "job")
        assert got.startswith(d.rstrip("/") + "/job-")
    for conf in ({}, {"spark.checkpoint.dir": "file:/x"}):
        with pytest.raises(RuntimeError):
            scratch_path(_Session("yarn", conf), "job")
    own = _Session("local[2]", {})  # none preset: a folder of our own
    assert scratch_path(own, "job").startswith(own._dir)
