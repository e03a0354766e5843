from pyspark.sql import functions as F

from litlens.operators import labels as L

VOCAB = [("topic", "HCI"), ("topic", "ML"), ("topic", "Other"), ("topic", "Other")]
SCHEMA = "paper_id long, category string, run int, attempt int, response string"


def _vocab(spark):
    return spark.createDataFrame(VOCAB, "category string, label string")


def test_resolve_first_valid_within_attempts(spark):
    rows = [
        (1, "topic", 1, 1, " HCI\n"),                 # padded, valid at once
        (2, "topic", 1, 1, "hci"), (2, "topic", 1, 2, None), (2, "topic", 1, 3, " ML\t"),
        (3, "topic", 1, 1, "This is HCI"), (3, "topic", 1, 2, ""), (3, "topic", 1, 3, None),
        (4, "topic", 1, 1, None), (4, "topic", 1, 2, None), (4, "topic", 1, 3, None),
        (4, "topic", 1, 4, "HCI"),                    # beyond max_attempts: ignored
        (5, "topic", 1, 2, "ML"), (5, "topic", 1, 1, "Other"),  # out of order
    ]
    a = spark.createDataFrame(rows, SCHEMA)
    got = {r.paper_id: (r.label, r.attempts_used)
           for r in L.resolve_answers(a, _vocab(spark), max_attempts=3).collect()}
    assert got == {1: ("HCI", 1), 2: ("ML", 3), 3: ("invalid result", None),
                   4: ("invalid result", None), 5: ("Other", 1)}


def test_resolve_is_idempotent_on_duplicates(spark):
    rows = [(1, "topic", 1, 1, "x"), (1, "topic", 1, 2, "ML")] * 3
    a = spark.createDataFrame(rows, SCHEMA)
    r = L.resolve_answers(a, _vocab(spark)).collect()
    assert [(x.label, x.attempts_used) for x in r] == [("ML", 2)]


def test_majority_vote_ties_go_to_first_seen(spark):
    rows = [
        (1, "topic", 1, 1, "ML"), (1, "topic", 1, 2, "HCI"), (1, "topic", 1, 3, "HCI"),
        (2, "topic", 1, 1, "Foo"), (2, "topic", 1, 2, "ML"), (2, "topic", 1, 3, "HCI"),
        (3, "topic", 1, 1, "Foo"), (3, "topic", 1, 2, "Foo "), (3, "topic", 1, 3, "ML"),
        (4, "topic", 1, 1, None), (4, "topic", 1, 2, None), (4, "topic", 1, 3, None),
        (5, "topic", 1, 1, None), (5, "topic", 1, 2, "ML"), (5, "topic", 1, 3, None),
    ]
    a = spark.createDataFrame(rows, SCHEMA)
    got = {r.paper_id: (r.label, r.votes) for r in L.majority_vote(a, _vocab(spark)).collect()}
    assert got == {1: ("HCI", 2), 2: ("invalid result", 1), 3: ("invalid result", 2),
                   4: ("invalid result", 0), 5: ("ML", 1)}


def test_validity_semi_anti_partition_the_answers(spark):
    rows = [(1, "topic", 1, 1, "HCI"), (1, "topic", 1, 2, None), (1, "topic", 1, 3, "nope"),
            (1, "other", 1, 1, "HCI")]
    a = spark.createDataFrame(rows, SCHEMA)
    v = _vocab(spark)
    ok = L.valid_answers(a, v).count()
    bad = L.rejected_answers(a, v).count()
    assert (ok, bad) == (1, 3)
    flags = L.answer_validity(a, v).filter(F.col("valid")).count()
    assert flags == ok


def test_pending_and_outcomes(spark):
    papers = spark.createDataFrame([(1,), (2,)], "paper_id long")
    tasks = L.label_tasks(papers, ["topic", "ethics"], runs=2)
    assert tasks.count() == 8
    lab = spark.createDataFrame(
        [(1, "topic", 1, "HCI", 1), (1, "ethics", 1, "invalid result", None),
         (2, "topic", 2, "invalid entry", None)],
        "paper_id long, category string, run int, label string, attempts_used int")
    assert L.pending_tasks(tasks, lab).count() == 6
    assert L.pending_tasks(tasks, lab, retry_invalid=False).count() == 5
    oc = {(r.category, r.run): (r.n_tasks, r.n_valid, r.n_invalid, r.n_over_budget)
          for r in L.outcome_counts(lab).collect()}
    assert oc == {("topic", 1): (1, 1, 0, 0), ("ethics", 1): (1, 0, 1, 0),
                  ("topic", 2): (1, 0, 0, 1)}


def test_screen_outcomes(spark):
    p = spark.createDataFrame([("yes",), ("no",), ("no",), ("invalid entry",), (None,)], "screen string")
    r = L.screen_outcomes(p).collect()[0]
    assert (r.n_invalid, r.n_related, r.n_unrelated) == (1, 1, 2)


def test_resolve_ignores_not_sent_markers(spark):
    rows = [(1, "topic", 1, 0, None), (2, "topic", 1, 0, "HCI"), (2, "topic", 1, 1, "x"),
            (2, "topic", 1, 2, "ML")]
    got = {r.paper_id: (r.label, r.attempts_used)
           for r in L.resolve_answers(spark.createDataFrame(rows, SCHEMA), _vocab(spark)).collect()}
    assert got == {2: ("ML", 2)}


def test_runs_must_be_positive(spark):
    import pytest
    with pytest.raises(ValueError):
        L.label_tasks(spark.createDataFrame([(1,)], "paper_id long"), ["topic"], runs=0)


def test_one_sentinel_counts_once(spark):
    df = spark.createDataFrame([(1, "topic", 1, "invalid entry"), (2, "topic", 1, "A")],
                               "paper_id long, category string, run int, label string")
    r = L.outcome_counts(df, sentinel="invalid entry").collect()[0]
    assert (r.n_tasks, r.n_valid, r.n_invalid, r.n_over_budget) == (2, 1, 1, 0)


def test_unsent_tasks_do_not_vote(spark):
    a = spark.createDataFrame([(1, "topic", 1, 0, None)], "paper_id long, category string, run int, attempt int, response string")
    assert L.majority_vote(a, _vocab(spark)).collect() == []
