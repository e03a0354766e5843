"""Category tree source: a nested JSON file of categories -> labels (or
groups -> labels), plus one taxonomy of topic -> keyword stems.

The file is parsed by Spark into two small dimensions:
``label_dim(category, grp, label, ord)`` and ``stem_dim(topic, stem)``.
Schema inference would drop the empty-object leaves, so the file is read as
text and parsed with an explicit map-of-map schema that keeps every key and
its raw JSON value in file order.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prompts import LABEL_FIELDS, SCREEN_FIELDS, TOKEN_LIMIT
from ..operators.labels import INVALID_ENTRY, INVALID_RESULT
from .dims import local_dim

TAXONOMY = "Taxonomy"  # fixed value: the tree entry holding topic -> stems


def _entries(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    tree = raw.select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    cats = tree.select(F.posexplode("m").alias("cpos", "category", "inner"))
    return cats.select("cpos", "category",
                       F.posexplode("inner").alias("pos", "key", "raw"))


def load_categories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(label_dim, stem_dim)`` of a category-tree JSON file."""
    e = _entries(spark, path)
    groups = F.from_json("raw", "map<string,string>")
    flat = (e.filter(F.col("category") != TAXONOMY)
             .select("cpos", "category", "pos", "key", groups.alias("g")))
    grouped = (flat.filter(F.size("g") > 0)
               .select("cpos", "category", "pos", F.col("key").alias("grp"),
                       F.posexplode(F.map_keys("g")).alias("ipos", "label")))
    plain = (flat.filter(F.coalesce(F.size("g"), F.lit(0)) <= 0)
             .select("cpos", "category", "pos", F.lit(None).cast("string").alias("grp"),
                     F.lit(0).alias("ipos"), F.col("key").alias("label")))
    topics = (e.filter(F.col("category") == TAXONOMY)
              .select("cpos", "category", "pos", F.lit(None).cast("string").alias("grp"),
                      F.lit(0).alias("ipos"), F.col("key").alias("label")))
    allrows = grouped.unionByName(plain).unionByName(topics)
    w = Window.partitionBy("category").orderBy("pos", "ipos")  # one small file
    label_dim = allrows.select("category", "grp", "label",
                               F.row_number().over(w).cast("int").alias("ord"))
    stems = (e.filter(F.col("category") == TAXONOMY)
              .select(F.col("key").alias("topic"),
                      F.explode(F.from_json("raw", "array<string>")).alias("stem")))
    return label_dim, stems


# The labelling tasks. Each task reads its vocabulary from a tree
# category, or (where the task fixes it in code) from the list given here;
# retries and the sentinel for exhausted retries per task.
TASKS = [
    # task, tree category, fixed vocabulary, max attempts, sentinel
    ("screen", None, ["yes", "no"], 2, INVALID_ENTRY),
    ("topic", TAXONOMY, None, 3, INVALID_RESULT),
    ("type_of_evaluation", "Type of Evaluation", None, 3, INVALID_RESULT),
    ("target_user_group", "Target User Group", None, 3, INVALID_RESULT),
    ("research_problem", "Research Problem", None, 3, INVALID_RESULT),
    ("openness", "Openness", None, 3, INVALID_RESULT),
    ("modelling_approach", "Modelling Approach", None, 3, INVALID_RESULT),
    ("improvement_proposal", None, ["Yes", "No"], 3, INVALID_RESULT),
    ("ethics", None, ["Ignored", "Discussed", "Discussed and Addressed"], 3, INVALID_RESULT),
    ("data_used", "Data Used", None, 3, INVALID_RESULT),
    ("contribution", "Contribution", None, 3, INVALID_RESULT),
]


def category_json(spark: SparkSession, path: str) -> DataFrame:
    """``(category, categories_json)`` per labelling task: the task's part of
    the tree as it stands there (groups, stems and file order kept), or its
    fixed list; two-space indent. The tree is one small configuration file,
    read whole."""
    tree = json.loads(spark.read.text(path, wholetext=True).first()[0])
    rows = [(task, json.dumps(tree[category] if category else {v: {} for v in fixed}, indent=2, ensure_ascii=False))
            for task, category, fixed, _, _ in TASKS if category is None or category in tree]
    return local_dim(spark, rows, [("category", "string"), ("categories_json", "string")])


def settings_dim(spark: SparkSession, rows: Sequence[tuple[str, int, str, int, Sequence[str]]]) -> DataFrame:
    """``(category, attempts, sentinel, token_limit, fields)`` of labelling tasks."""
    flat = [(c, n, s, limit, ",".join(fields)) for c, n, s, limit, fields in rows]
    dim = local_dim(spark, flat, [("category", "string"), ("attempts", "int"), ("sentinel", "string"),
                                  ("token_limit", "int"), ("fields", "string")])
    return dim.withColumn("fields", F.split("fields", ","))


def task_settings(spark: SparkSession) -> DataFrame:
    """The settings of every labelling task, for ``label_collection``: screening
    shows the abstract only and gives up after two attempts."""
    return settings_dim(spark, [(t, n, s, TOKEN_LIMIT, SCREEN_FIELDS if t == "screen" else LABEL_FIELDS)
                                for t, _, _, n, s in TASKS])


def task_vocabulary(spark: SparkSession, label_dim: DataFrame) -> DataFrame:
    """``(category, label, ord)`` allowed per labelling task, in file order;
    labels present in two groups of a category (``Other``) appear once."""
    tree_map = [(t, c) for t, c, fixed, _, _ in TASKS if c is not None]
    fixed = [(t, lab, k) for t, c, vals, _, _ in TASKS if vals for k, lab in enumerate(vals, 1)]
    m = local_dim(spark, tree_map, [("task", "string"), ("category", "string")])
    from_tree = (label_dim.join(F.broadcast(m), "category")
                 .groupBy(F.col("task").alias("category"), "label").agg(F.min("ord").alias("ord")))
    return from_tree.unionByName(
        local_dim(spark, fixed, [("category", "string"), ("label", "string"), ("ord", "int")]))
