import numpy as np

from litlens.operators import agree as A

LAB = "paper_id long, category string, run int, label string"


def test_consistency_cases(spark):
    rows = ([(1, "t", r, "A") for r in range(1, 6)]                       # all equal -> 1.0
            + [(2, "t", r, f"L{r}") for r in range(1, 5)]                 # all different -> 1/4
            + [(3, "t", 1, "A"), (3, "t", 2, None), (3, "t", 3, "A"), (3, "t", 4, "B")]
            + [(4, "t", 1, None), (4, "t", 2, None)]                      # no labels -> no row
            + [(5, "single", 1, "A")])                                    # one run only -> not scored
    s = {(r.paper_id, r.category): r.consistency
         for r in A.consistency(spark.createDataFrame(rows, LAB)).collect()}
    assert s == {(1, "t"): 1.0, (2, "t"): 0.25, (3, "t"): 2 / 3}


def test_consistency_max_run(spark):
    rows = [(1, "t", 1, "A"), (1, "t", 2, "A"), (1, "t", 3, "B")]
    s = A.consistency(spark.createDataFrame(rows, LAB), max_run=2).collect()
    assert s[0].consistency == 1.0


def test_box_matches_numpy(spark):
    vals = [1.0, 1.0, 0.6, 0.6, 0.8, 0.4, 1.0, 0.2, 0.6, 1.0, 0.8]
    df = spark.createDataFrame([(i, "t", v) for i, v in enumerate(vals)],
                               "paper_id long, category string, consistency double")
    r = A.consistency_box(df).collect()[0]
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    iqr = q3 - q1
    inside = [v for v in vals if q1 - 1.5 * iqr <= v <= q3 + 1.5 * iqr]
    assert (r.q1, r.median, r.q3) == (round(q1, 6), round(med, 6), round(q3, 6))
    assert (r.whisker_low, r.whisker_high) == (min(inside), max(inside))
    assert r.n_outliers == len(vals) - len(inside)
    assert r.n == len(vals)


def test_box_of_a_million_distinct_scores(spark):
    df = spark.range(1_000_000).selectExpr("id as paper_id", "if(id % 3 = 0, 'b', 'a') as category",
                                           "pow(id * 7919 % 1000003 / 1000003D, 8) as consistency")
    df = df.unionByName(spark.createDataFrame([(1, "one", 0.5), (2, None, 0.25), (3, "a", None)],
                                                 "paper_id long, category string, consistency double"))
    rows = A.consistency_box(df)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "windowspecdefinition(category" not in plan
    got = {r.category: r for r in rows.collect()}
    ids = np.arange(1_000_000)
    x = (ids * 7919 % 1000003 / 1000003) ** 8
    assert got[None].n == 1 and got[None].median == 0.25
    for c, v in (("a", x[ids % 3 != 0]), ("b", x[ids % 3 == 0]), ("one", np.array([0.5]))):
        q1, med, q3 = np.percentile(v, [25, 50, 75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        r = got[c]
        assert (r.n, r.n_outliers) == (len(v), len(v) - len(inside))
        assert np.allclose((r.q1, r.median, r.q3, r.whisker_low, r.whisker_high),
                           (round(q1, 6), round(med, 6), round(q3, 6), inside.min(), inside.max()), atol=1.1e-6)


def test_wide_long_round_trip(spark):
    rows = [(1, "topic", 1, "A"), (1, "topic", 2, "B"), (2, "ethics", 3, "C"), (2, "topic", 1, "A")]
    lab = spark.createDataFrame(rows, LAB)
    wide = A.labels_wide(lab, ["topic", "ethics"], [1, 2, 3])
    assert "como-tax-topic2-2" in wide.columns and "como-tax-ethics2" in wide.columns
    back = sorted(tuple(r) for r in A.labels_long(wide).collect())
    assert back == sorted(rows)


def test_assigned_labels_in_run_order(spark):
    rows = [(1, "t", 3, "C"), (1, "t", 1, "A"), (1, "t", 2, None), (1, "t", 4, "A")]
    r = A.assigned_labels(spark.createDataFrame(rows, LAB)).collect()[0]
    assert (r.labels, r.n_runs) == ("A, C, A", 3)


def test_contingency_missing_and_domain(spark):
    df = spark.createDataFrame([("yes", None), ("yes", "no"), ("maybe", "no"), (None, None)],
                               "a string, b string")
    got = {(r.a, r.b): r.n for r in A.contingency(df, "a", "b").collect()}
    assert got == {("yes", "missing"): 1, ("yes", "no"): 1, ("missing", "missing"): 1}
    assert sum(got.values()) == 3


def test_ordered_labels_are_long_rows(spark):
    rows = [(1, "role", t, "user" if t % 2 == 0 else "assistant") for t in range(2500)]
    rows += [(2, "role", 7, "user"), (2, "role", 3, None), (2, "role", 1, "x")]
    df = spark.createDataFrame(rows, "conv_id long, category string, turn long, label string")
    got = A.ordered_labels(df, id_col="conv_id", order_col="turn").orderBy("conv_id", "position").collect()
    assert [(r.position, r.label) for r in got if r.conv_id == 1] == [(t + 1, r[3]) for t, r in enumerate(rows[:2500])]
    assert [(r.position, r.label) for r in got if r.conv_id == 2] == [(1, "x"), (2, "user")]


LABELS = "paper_id long, category string, run int, label string"


def test_consistency_of_any_run_numbers(spark):
    df = spark.createDataFrame([(1, "topic", 64, "A"), (1, "topic", 65, "B"), (2, "topic", 64, "A"), (2, "topic", 65, "A"),
                                (1, "ethics", 9, "C"), (1, "openness", 0, "D"), (1, "openness", -1, "D")], LABELS)
    got = {(r.paper_id, r.category): r.consistency for r in A.consistency(df).collect()}
    assert got == {(1, "topic"): 0.5, (2, "topic"): 1.0, (1, "openness"): 1.0}
    assert {r.category for r in A.consistency(df, min_runs=1).collect()} == {"topic", "ethics", "openness"}
    means = A.consistency_by_category(A.consistency(df), exclude=["openness"]).collect()
    assert [(r.category, r.mean_consistency, r.n_papers) for r in means] == [("topic", 0.75, 2)]


def test_reports_are_sorted(spark):
    df = spark.createDataFrame([(1, "b", 1, "x"), (1, "b", 2, "y"), (1, "a", 1, "x"), (1, "a", 2, "y"),
                                (1, "c", 1, "x"), (1, "c", 2, "x")], LABELS)
    assert [r.category for r in A.consistency_by_category(A.consistency(df)).collect()] == ["a", "b", "c"]


def test_wide_columns_need_the_whole_key(spark):
    wide = spark.createDataFrame([(1, "A", "B", "C", "D")], "paper_id long, `como-tax-topic` string, "
                                 "`como-tax-topic2` string, `como-tax-openess2-3` string, `como-tax-x2-y` string")
    got = sorted((r.category, r.run, r.label) for r in A.labels_long(wide).collect())
    assert got == [("openness", 3, "C"), ("topic", 1, "B")]


def test_repeat_study(spark):
    from litlens.operators.reports import repeat_study
    papers = spark.createDataFrame([(i, f"abstract {i}", "t", "x") for i in range(20)],
                                   "paper_id long, abstract string, title string, fulltext string")
    vocab = spark.createDataFrame([("topic", "A"), ("topic", "B")], "category string, label string")
    labelled = spark.createDataFrame([(i, "topic", 1, "A", 1) for i in range(20)],
                                     "paper_id long, category string, run int, label string, "
                                     "attempts_used int")

    def fn(batch):  # papers with an even id keep answering A, odd ids flip to B on run 3
        return ["B" if (pid % 2 and run == 3) else "A"
                for pid, run in zip(batch["paper_id"], batch["run"])]

    out = repeat_study(spark, papers, labelled, vocab, fn, ["topic"], n=6, seed=1, extra_runs=2)
    lab = out["labels"].collect()
    assert len(lab) == 18 and {r.run for r in lab} == {1, 2, 3}
    scores = {r.paper_id: r.consistency for r in out["scores"].collect()}
    assert len(scores) == 6
    assert all(v == (2 / 3 if pid % 2 else 1.0) for pid, v in scores.items())
    mean = out["by_category"].collect()[0]
    assert mean.n_papers == 6
    assert out["matrix"].count() == 6 and out["box"].count() == 1
