"""Deterministic paper-collection views over the ``documents`` table.

The labelling workflow works on a paper collection, an allowed-label
vocabulary and a log of raw answers. The test tables carry none of these, so
they are derived from ``documents`` row by row (no row is dropped): every
document is one paper; each paper gets 3 categories x 5 runs x 3 attempts of
answers. The same definitions exist as SQL in :mod:`litlens.plans.oracle`.
Rows are produced with ``explode`` (a generator), not with a join.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import prompt_dim
from .dims import local_dim
from .tables import read_table

# Fixed values of the derived views: categories with their number of labels,
# runs per task and attempts per run.
FIXTURE_CATEGORIES = [("topic", 7), ("ethics", 3), ("openness", 4)]
FIXTURE_RUNS = 5
FIXTURE_ATTEMPTS = 3
WORDY_ANSWER = "This paper belongs to label 1"


def _pad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One paper per document: null / unparsable / impossible dates, null
    abstracts and two screening sources (``screen``, ``screen_alt``)."""
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    date = (F.when(i % 37 == 0, F.lit(None).cast("string"))
            .when(i % 41 == 0, F.lit("n.d."))
            .when(i % 43 == 0, F.lit("31-02-2001"))
            .otherwise(F.concat(_pad2(1 + i * 11 % 28), F.lit("-"),
                                _pad2(1 + i * 7 % 12), F.lit("-"),
                                (1965 + i * 31 % 60).cast("string"))))
    screen = (F.when(i % 3 == 0, F.lit("no")).when(i % 97 == 1, F.lit("invalid entry"))
              .otherwise(F.lit("yes")))
    screen_alt = (F.when(i % 5 == 0, F.lit(None).cast("string")).when(i % 4 == 0, F.lit("no"))
                  .when(i % 89 == 2, F.lit("invalid entry")).otherwise(F.lit("yes")))
    return d.select(
        i.alias("paper_id"), F.col("source").alias("venue"), "lang",
        F.concat(F.lit("paper "), i.cast("string")).alias("title"),
        F.when(i % 53 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("text")).alias("abstract"),
        F.col("text").alias("fulltext"),
        date.alias("date_publication"), screen.alias("screen"), screen_alt.alias("screen_alt"))


def vocabulary(spark: SparkSession) -> DataFrame:
    """Allowed labels per category (``label 0`` .. ``label n-1``)."""
    rows = [(c, f"label {k}") for c, n in FIXTURE_CATEGORIES for k in range(n)]
    return local_dim(spark, rows, [("category", "string"), ("label", "string")])


def responses(spark: SparkSession, sf_dir: str, runs: int = FIXTURE_RUNS) -> DataFrame:
    """Raw answer log ``(paper_id, category, run, attempt, response)``.

    NULL = failed call; a wordy sentence outside the vocabulary; otherwise a
    valid label padded with white space. Some (paper, run) pairs never succeed.
    """
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"))
    cats = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(n).alias("n"))
                     for c, n in FIXTURE_CATEGORIES])
    t = (d.select("paper_id", F.inline(cats))
          .select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
          .select("*", F.explode(F.sequence(F.lit(1), F.lit(FIXTURE_ATTEMPTS))).alias("attempt")))
    i, r, a = F.col("paper_id"), F.col("run"), F.col("attempt")
    failed = ((i + r) % 29 == 0) | ((i * 13 + r * 7 + a * 3) % 11 == 0)
    wordy = ((i * 5 + r) % 31 == 0) | ((i * 5 + r * 3 + a) % 7 == 0)
    k = (i + F.when((i + r) % 4 == 0, r).otherwise(F.lit(0))) % F.col("n")
    resp = (F.when(failed, F.lit(None).cast("string")).when(wordy, F.lit(WORDY_ANSWER))
            .otherwise(F.concat(F.lit(" label "), k.cast("string"), F.lit("\n"))))
    return t.select("paper_id", "category", "run", "attempt", resp.alias("response"))


# Volume stems for the keyword taxonomy: four topics whose stems hit the
# invented corpus often (a real tree is loaded with ``load_categories``).
VOLUME_STEMS = [("A", ["th", "an", "he"]), ("B", ["on", "er", "re"]),
                ("C", ["de", "le", "ou"]), ("D", ["or", "the", "in"])]


def volume_stems(spark: SparkSession) -> DataFrame:
    rows = [(t, s) for t, ss in VOLUME_STEMS for s in ss]
    return local_dim(spark, rows, [("topic", "string"), ("stem", "string")])


# Templates per category and technique, and the categories as a
# nested tree (groups of labels; stems of a topic), as the prompts show them.
PROMPT_ROWS = [
    ("topic", "plain", "Name the topic of this paper.\n{entry}\nTopics and their stems:\n{categories}\n"),
    ("topic", "steps", "Think step by step. Paper: {entry}\nWhich one of {categories} fits? Label only."),
    ("ethics", "plain", "Does this paper treat ethics?\n{entry}\nOne of:\n{categories}"),
    ("ethics", "steps", "Quote what the paper says on ethics, then decide.\n{entry}\n{categories}\n"),
    ("openness", "plain", "Paper:\n{entry}\nWhat does it publish? {categories}"),
    ("openness", "steps", "List what the paper publishes.\n{entry}\nThen choose from {categories}."),
]
CATEGORY_TREE = {
    "topic": {f"label {k}": [f"stem{k}*", f"word{k}*"] for k in range(7)},
    "ethics": {"silent": {"label 0": {}}, "spoken": {"label 1": {}, "label 2": {}}},
    "openness": {f"label {k}": {} for k in range(4)},
}


def prompt_templates(spark: SparkSession) -> DataFrame:
    return prompt_dim(spark, PROMPT_ROWS)


def tree_json(spark: SparkSession) -> DataFrame:
    rows = [(c, json.dumps(t, indent=2)) for c, t in CATEGORY_TREE.items()]
    return local_dim(spark, rows, [("category", "string"), ("categories_json", "string")])
