import pandas as pd
from pyspark.sql import functions as F

from litlens.operators import trends as T


def _counts(spark, rows):
    return spark.createDataFrame(rows, "category string, decade int, label string, cnt long")


def test_share_rounds_half_even(spark):
    # 49/400 = 12.25 %, 75/400 = 18.75 %, 25/400 = 6.25 %
    c = _counts(spark, [("t", 1990, "a", 49), ("t", 1990, "b", 75), ("t", 1990, "c", 25),
                        ("t", 1990, "d", 251)])
    got = {r.label: r.pct for r in T.with_share(c).collect()}
    assert got == {"a": 12.2, "b": 18.8, "c": 6.2, "d": 62.7}
    # the reference rounds (count / total) * 100 with pandas
    exp = pd.Series([49, 75, 25, 251], index=list("abcd")) / 400 * 100
    assert got == exp.round(1).to_dict()


def test_window_share_equals_join_share(spark):
    rows = [("t", 1990 + 10 * (i % 3), f"l{i % 5}", 1 + i * 7 % 13) for i in range(40)]
    c = _counts(spark, rows).groupBy("category", "decade", "label").agg(F.sum("cnt").alias("cnt"))
    a = sorted(tuple(r) for r in T.with_share(c).select("category", "decade", "label", "pct").collect())
    b = sorted(tuple(r) for r in T.with_share_join(c).select("category", "decade", "label", "pct").collect())
    assert a == b


def test_top_label_ties_go_to_alphabetically_first(spark):
    c = _counts(spark, [("t", 1990, "b", 3), ("t", 1990, "a", 3), ("t", 1990, "c", 1),
                        ("t", 2000, "z", 2), ("e", 2000, "y", 5)])
    top = {(r.category, r.decade): r.label for r in T.top_labels(T.with_share(c), 1).collect()}
    assert top == {("t", 1990): "a", ("t", 2000): "z", ("e", 2000): "y"}


def test_cumulative_ends_at_100(spark):
    y = spark.createDataFrame([(2001, 3), (1999, 1), (2000, 4)], "year int, papers_in_year long")
    rows = T.cumulative(y).orderBy("year").collect()
    assert [r.cumulative_papers for r in rows] == [1, 5, 8]
    assert rows[-1].cumulative_pct == 100.0
    assert [c for c in T.year_table(T.cumulative(y)).columns] == [
        "Year", "Papers in Year", "Cumulative Papers", "Cumulative Percentage"]


def test_pivot_fills_missing_cells(spark):
    c = _counts(spark, [("t", 1990, "a", 2), ("t", 2000, "b", 1)])
    p = {r.decade: (r.a, r.b, r.c) for r in T.pivot_counts(c, ["a", "b", "c"]).collect()}
    assert p == {1990: (2, 0, 0), 2000: (0, 1, 0)}


def test_label_span_and_dated(spark):
    papers = spark.createDataFrame(
        [(1, "01-01-1990", "yes"), (2, "05-06-2005", "yes"), (3, "bad", "yes"), (4, "01-01-1980", "no")],
        "paper_id long, date_publication string, screen string")
    lab = spark.createDataFrame([(1, "topic", 1, "A"), (2, "topic", 1, "A"), (3, "topic", 1, "B"),
                                 (4, "topic", 1, "A"), (2, "topic", 2, "C")],
                                "paper_id long, category string, run int, label string")
    lp = T.labelled_papers(papers, lab)
    assert sorted(r.paper_id for r in lp.collect()) == [1, 2]
    s = T.label_span(lp).collect()
    assert [(r.label, r.first_year, r.last_year, r.span_years) for r in s] == [("A", 1990, 2005, 15)]


def test_decade_report_writes_csvs_and_returns_top(spark, tmp_dir):
    import os

    from litlens.operators.reports import decade_report
    papers = spark.createDataFrame(
        [(1, "01-01-1990", "yes"), (2, "05-06-1995", "yes"), (3, "01-01-2001", "yes")],
        "paper_id long, date_publication string, screen string")
    lab = spark.createDataFrame([(1, "topic", 1, "A"), (2, "topic", 1, "B"), (3, "topic", 1, "B"),
                                 (1, "ethics", 1, "Yes")],
                                "paper_id long, category string, run int, label string")
    top = decade_report(papers, lab, tmp_dir, {"topic": ["A", "B"], "ethics": ["Yes", "No"]})
    assert sorted((r.category, r.decade, r.label) for r in top.collect()) == [
        ("ethics", 1990, "Yes"), ("topic", 1990, "A"), ("topic", 2000, "B")]
    back = spark.read.option("header", True).csv(os.path.join(tmp_dir, "category=topic")).collect()
    assert [(r.decade, float(r.A), float(r.B)) for r in back] == [("1990", 50.0, 50.0), ("2000", 0.0, 100.0)]
