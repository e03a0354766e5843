"""Trend reports over labelled papers: yearly counts and cumulative curve,
per-decade label counts, shares, top labels, pivots and first/last appearance.

Plan shape: one partial hash aggregation over the papers (few groups: years,
decades x labels), then windows and pivots over the *aggregated* rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import decade, pub_year


def screened(papers: DataFrame, value: str = "yes", col: str = "screen") -> DataFrame:
    """Papers whose screening result equals ``value`` (pushed into the scan)."""
    return papers.filter(F.col(col) == value)


def dated(papers: DataFrame, date_col: str = "date_publication", width: int = 10) -> DataFrame:
    """Papers with a parsable publication year, plus ``year`` and ``decade``;
    papers without one are dropped (they have no place on a time axis)."""
    return (papers.withColumn("year", pub_year(date_col))
            .filter(F.col("year").isNotNull())
            .withColumn("decade", decade("year", width)))


def labelled_papers(papers: DataFrame, labelled: DataFrame, run: int = 1,
                    screen_value: str = "yes", width: int = 10,
                    drop_invalid: bool = False,
                    sentinels: Sequence[str] = ("invalid result", "invalid entry")) -> DataFrame:
    """(paper_id, year, decade, category, label) for screened, dated papers
    and the non-null labels of one run. Sentinel labels count like labels
    unless ``drop_invalid``. Copies of a paper (same id) count once, with
    the earliest year."""
    p = dated(screened(papers, screen_value).select("paper_id", "date_publication"),
              width=width)
    # one row per paper even if the collection holds copies of a paper: the
    # join below is then many-to-one (no pairs multiply), and this
    # aggregation's hash partitioning on paper_id is reused by the join
    p = p.groupBy("paper_id").agg(F.min("year").alias("year"), F.min("decade").alias("decade"))
    lab = labelled.filter((F.col("run") == run) & F.col("label").isNotNull())
    if drop_invalid:
        lab = lab.filter(~F.col("label").isin(list(sentinels)))
    lab = lab.select("paper_id", "category", "label")
    return lab.join(p, "paper_id")


def papers_per_year(papers: DataFrame, count_col: str = "papers_in_year") -> DataFrame:
    """Rows per year, by year (input: :func:`dated` papers, or any frame with ``year``)."""
    return papers.groupBy("year").agg(F.count(F.lit(1)).alias(count_col)).orderBy("year")


def cumulative(year_counts: DataFrame, count_col: str = "papers_in_year",
               cum_col: str = "cumulative_papers") -> DataFrame:
    """Cumulative papers and cumulative % of all papers, by year.

    The window has no partition key, so it runs in one task: call it only on
    the per-year counts (one row per year), never on papers."""
    upto = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = F.sum(count_col).over(upto)
    total = F.sum(count_col).over(Window.partitionBy())
    return year_counts.select(
        "year", count_col, cum.alias(cum_col), (cum / total * 100).alias("cumulative_pct"))


def decade_label_counts(df: DataFrame, bucket: str = "decade") -> DataFrame:
    """Count per (category, time bucket, label), all categories in one pass."""
    return df.groupBy("category", bucket, "label").agg(F.count(F.lit(1)).alias("cnt"))


def decade_totals(counts: DataFrame, bucket: str = "decade") -> DataFrame:
    """Labels counted per (category, time bucket)."""
    return counts.groupBy("category", bucket).agg(F.sum("cnt").alias("total"))


def with_share(counts: DataFrame, digits: int = 1, bucket: str = "decade") -> DataFrame:
    """Add the (category, bucket) total and the share in percent, rounded half-even."""
    total = F.sum("cnt").over(Window.partitionBy("category", bucket))
    return (counts.withColumn("total", total)
            .withColumn("pct", F.bround(F.col("cnt") / F.col("total") * 100, digits)))


def with_share_join(counts: DataFrame, digits: int = 1, bucket: str = "decade") -> DataFrame:
    """:func:`with_share` written as a join with :func:`decade_totals`."""
    return (counts.join(decade_totals(counts, bucket), ["category", bucket])
            .withColumn("pct", F.bround(F.col("cnt") / F.col("total") * 100, digits)))


def top_labels(shares: DataFrame, n: int = 1, bucket: str = "decade") -> DataFrame:
    """The ``n`` most frequent labels per (category, bucket); ties go to the
    alphabetically first label."""
    w = Window.partitionBy("category", bucket).orderBy(F.col("cnt").desc(), F.col("label"))
    return (shares.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= n))


def top_label_per_decade(papers: DataFrame, labelled: DataFrame, n: int = 1) -> DataFrame:
    """Most frequent label per category and decade, with its count and share."""
    counts = decade_label_counts(labelled_papers(papers, labelled))
    return top_labels(with_share(counts), n)


def pivot_counts(counts: DataFrame, labels: Sequence[str], value: str = "cnt") -> DataFrame:
    """decade x label matrix of one category's counts; a missing cell is 0.
    The label list is passed, so the output schema is fixed and no extra job
    runs to find the distinct labels."""
    return (counts.groupBy("decade").pivot("label", list(labels)).agg(F.sum(value))
            .na.fill(0, subset=list(labels)))


def pivot_share(shares: DataFrame, labels: Sequence[str], by: Sequence[str] = ("decade",)) -> DataFrame:
    """decade x label matrix of one category's shares (percent); missing = 0.0.
    With ``by=("category", "decade")`` the matrices of all categories, stacked."""
    return (shares.groupBy(*by).pivot("label", list(labels)).agg(F.first("pct"))
            .na.fill(0.0, subset=list(labels)))


def label_span(df: DataFrame) -> DataFrame:
    """First and last year each label appears, and the span between them; by
    category, first appearance, then label."""
    return (df.groupBy("category", "label")
            .agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
            .withColumn("span_years", F.col("last_year") - F.col("first_year"))
            .orderBy("category", "first_year", "label"))


def year_table(cum: DataFrame) -> DataFrame:
    """The yearly report with display column names."""
    return cum.select(F.col("year").alias("Year"),
                      F.col("papers_in_year").alias("Papers in Year"),
                      F.col("cumulative_papers").alias("Cumulative Papers"),
                      F.col("cumulative_pct").alias("Cumulative Percentage"))
