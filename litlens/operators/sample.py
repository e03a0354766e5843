"""Deterministic uniform sample of n papers without replacement.

Each paper gets a pseudo-random sort key ``md5(seed:id)``; the n smallest
keys form the sample. ``orderBy(...).limit(n)`` plans as a distributed
top-k (TakeOrderedAndProject): every task keeps n rows, so nothing but n
rows per task reaches the final merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_VALUE = "No URL"  # fixed value: shown for a sampled paper without the field


def sample_key(id_col: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def sample_papers(df: DataFrame, n: int, seed: int = 0, id_col: str = "paper_id") -> DataFrame:
    """``n`` papers chosen uniformly at random (fewer if there are fewer)."""
    k = sample_key(id_col, seed)
    return df.orderBy(k, F.col(id_col)).limit(n)


def sample_report(df: DataFrame, n: int, seed: int = 0, id_col: str = "paper_id",
                  show_col: str = "url", default: str = NO_VALUE) -> DataFrame:
    """The sample numbered 1..n with one field shown (default when absent)."""
    s = sample_papers(df, n, seed, id_col).withColumn("_k", sample_key(id_col, seed))
    w = Window.orderBy("_k", id_col)  # n rows only
    shown = F.coalesce(F.col(show_col), F.lit(default)) if show_col in df.columns else F.lit(default)
    return s.select(F.row_number().over(w).alias("pos"), id_col, shown.alias(show_col))
