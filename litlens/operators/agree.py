"""Agreement between label sources and between repeated runs.

Consistency of a (paper, category) over runs = count of its most frequent
label / number of non-null labels. It is a two-level hash aggregation
(per label, then per task) with map-side combine; the box statistics rank the
(value, frequency) table by range partitions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import WIDE_KEY, WIDE_PREFIX, key_category, key_run, wide_key
from ..plans.joins import sized_broadcast
from ..plans.ranks import running_total
from ..session import scratch_dir

# The default value domain of the screening contingency and the
# label an absent field is counted as.
MISSING = "missing"
SCREEN_DOMAIN = ("yes", "no", "invalid entry", MISSING)


def contingency(df: DataFrame, a: str, b: str, domain: Sequence[str] = SCREEN_DOMAIN,
                a_name: str | None = None, b_name: str | None = None) -> DataFrame:
    """Counts of (a, b) value pairs; NULL counts as ``missing``; pairs with a
    value outside ``domain`` are left out. By pair."""
    x = F.coalesce(F.col(a), F.lit(MISSING)).alias(a_name or a)
    y = F.coalesce(F.col(b), F.lit(MISSING)).alias(b_name or b)
    p = df.select(x, y)
    dom = list(domain)
    return (p.filter(F.col(a_name or a).isin(dom) & F.col(b_name or b).isin(dom))
             .groupBy(a_name or a, b_name or b).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(a_name or a, b_name or b))


def labels_wide(labelled: DataFrame, categories: Sequence[str], runs: Sequence[int],
                id_col: str = "paper_id") -> DataFrame:
    """Long labels -> one row per paper, one ``como-tax-<category>2[-run]``
    column per (category, run). The key list is passed, so the pivot needs
    no extra job and the schema is fixed."""
    keys = [f"{WIDE_PREFIX}{c}2" + (f"-{r}" if r > 1 else "") for c in categories for r in runs]
    return (labelled.withColumn("key", wide_key("category", "run"))
            .groupBy(id_col).pivot("key", keys).agg(F.first("label")))


def labels_long(wide: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """Wide label columns -> ``(paper_id, category, run, label)``; the base
    column is run 1, ``-n`` is run n; absent (NULL) labels are dropped.
    Columns not shaped like a label column are ignored."""
    cols = [c for c in wide.columns if c != id_col and re.match(WIDE_KEY, c)]
    if not cols:
        return wide.select(id_col, F.lit(None).cast("string").alias("category"),
                           F.lit(None).cast("int").alias("run"),
                           F.lit(None).cast("string").alias("label")).limit(0)
    u = wide.select(id_col, *cols).unpivot(id_col, cols, "key", "label")
    return (u.filter(F.col("label").isNotNull())
             .select(id_col, key_category("key").alias("category"), key_run("key").alias("run"),
                     "label"))


def present(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """The subset of ``keys`` that are columns of ``df`` (a wide frame only
    has label columns some paper was given)."""
    return [k for k in keys if k in df.columns]


def consistency(labelled: DataFrame, min_runs: int = 2, max_run: int | None = None,
                id_col: str = "paper_id", drop_invalid: bool = False,
                sentinels: Sequence[str] = ("invalid result", "invalid entry")) -> DataFrame:
    """Per (paper, category): share of runs agreeing with the modal label.

    Only categories with at least ``min_runs`` distinct runs are scored;
    ``max_run`` keeps runs up to that number (to reproduce a study that read
    fewer runs than it wrote). Sentinel labels count as labels unless
    ``drop_invalid``.

    Plan: labels -> per (paper, category, label) counts -> per (paper,
    category) max/sum. The categories with enough runs come from the distinct
    (category, run) pairs, which collapse map-side to one row per pair and
    task; they are joined back under a size check."""
    lab = labelled.filter(F.col("label").isNotNull())
    if drop_invalid:
        lab = lab.filter(~F.col("label").isin(list(sentinels)))
    if max_run is not None:
        lab = lab.filter(F.col("run") <= max_run)
    per_label = lab.groupBy(id_col, "category", "label").agg(F.count(F.lit(1)).alias("n"))
    per_task = per_label.groupBy(id_col, "category").agg(
        F.max("n").alias("modal"), F.sum("n").alias("n_labels"))
    scored = per_task.select(id_col, "category",
                             (F.col("modal") / F.col("n_labels")).alias("consistency"), "n_labels")
    if min_runs <= 1:
        return scored
    cats = (lab.select("category", "run").distinct().groupBy("category").agg(F.count("run").alias("n"))
               .filter(F.col("n") >= min_runs).select("category"))
    scratch_dir(labelled.sparkSession)
    cats = cats.checkpoint(eager=True)  # computed once for the size check and the join
    return scored.join(sized_broadcast(cats), "category", "left_semi")


def consistency_by_category(scores: DataFrame, exclude: Sequence[str] = (),
                            digits: int = 6) -> DataFrame:
    """Mean consistency per category (NULL scores skipped), rounded for display,
    by ascending mean, then category. ``scores`` from :func:`consistency`."""
    s = scores.filter(~F.col("category").isin(list(exclude))) if exclude else scores
    mean = F.avg("consistency")
    return (s.groupBy("category").agg(F.round(mean, digits).alias("mean_consistency"),
                                      F.count("consistency").alias("n_papers"))
             .orderBy("mean_consistency", "category"))


def _with_category(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """``rows`` with the columns of their category's row, the NULL category's too."""
    dim = sized_broadcast(dim.withColumnRenamed("category", "_category"))
    return rows.join(dim, F.col("category").eqNullSafe(F.col("_category"))).drop("_category")


def consistency_box(scores: DataFrame, digits: int = 6) -> DataFrame:
    """Box-plot numbers per category: quartiles (linear interpolation),
    whiskers at the most extreme scores within 1.5 IQR, outlier count.

    Works on the (category, score, frequency) table. Its rows get their ranks by
    range partitions, so the two neighbours of every quartile are picked, and
    all else is counted, by map-side combined aggregations: no task holds a
    category, however many distinct scores there are."""
    freq = (scores.filter(F.col("consistency").isNotNull())
            .groupBy("category", "consistency").agg(F.count(F.lit(1)).alias("w")))
    scratch_dir(scores.sparkSession)
    freq = freq.checkpoint(eager=True)  # a range partitioning reads its input twice
    ranked = running_total(freq, ["category", "consistency"], "w", "upto")
    sizes = ranked.groupBy("category").agg(F.sum("w").alias("n"), F.min(F.col("upto") - F.col("w")).alias("start"))
    placed = _with_category(ranked, sizes)
    stop = F.col("upto") - F.col("start")  # ranks of the row: from stop - w to before stop
    x, picks = F.col("consistency"), []
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    for name, q in quartiles.items():
        at = F.lit(q) * (F.col("n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((rank < stop) & (rank >= stop - F.col("w")), x)).alias(f"{name}_{side}"))
    near = placed.groupBy("category").agg(F.max("n").alias("n"), *picks)

    def between(name: str) -> Column:
        at, lo, hi = F.lit(quartiles[name]) * (F.col("n") - 1), F.col(f"{name}_lo"), F.col(f"{name}_hi")
        whole = F.floor(at)
        return F.when(lo == hi, lo).otherwise((whole + 1 - at) * lo + (at - whole) * hi)

    box = near.select("category", "n", *[between(name).alias(name) for name in quartiles])
    iqr = F.col("q3") - F.col("q1")
    inside = (x >= F.col("q1") - 1.5 * iqr) & (x <= F.col("q3") + 1.5 * iqr)
    return _with_category(ranked, box).groupBy("category").agg(
        F.max("n").alias("n"), *[F.round(F.max(name), digits).alias(name) for name in quartiles],
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("w")).otherwise(F.lit(0))).alias("n_outliers"))


def consistency_matrix(scores: DataFrame, categories: Sequence[str],
                       id_col: str = "paper_id") -> DataFrame:
    """paper x category matrix of consistency scores (heat-map data)."""
    return (scores.groupBy(id_col).pivot("category", list(categories))
            .agg(F.first("consistency")))


def assigned_labels(labelled: DataFrame, sep: str = ", ", id_col: str = "paper_id",
                    order_col: str = "run") -> DataFrame:
    """Labels of each (paper, category) over the runs, in run order, as text.
    A list is bounded by the number of runs; lists that can grow with the data
    stay long rows, see :func:`ordered_labels`."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("run"), "label")))
    df = labelled.filter(F.col("label").isNotNull())
    return (df.groupBy(id_col, "category")
            .agg(F.array_join(F.transform(ordered, lambda s: s["label"]), sep).alias("labels"),
                 F.count(F.lit(1)).alias("n_runs")))


def ordered_labels(labelled: DataFrame, id_col: str = "paper_id", order_col: str = "run") -> DataFrame:
    """``(id, category, position, label)``: the non-null labels of each key
    numbered from 1 in order. A key's rows are sorted by Spark (which spills),
    never gathered into one list."""
    w = Window.partitionBy(id_col, "category").orderBy(order_col)
    return (labelled.filter(F.col("label").isNotNull())
            .select(id_col, "category", F.row_number().over(w).cast("long").alias("position"), "label"))


def categories_present(labelled: DataFrame) -> DataFrame:
    """Distinct categories that have labels."""
    return labelled.select("category").distinct()


def short_names(keys: DataFrame, key_col: str = "key") -> DataFrame:
    """Category and run parsed from wide label column names."""
    return keys.select(key_col, key_category(key_col).alias("category"),
                       key_run(key_col).alias("run"))
