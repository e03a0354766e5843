"""Prompt text and the prompt budget.

A prompt is a template with two slots, ``{entry}`` (the paper as JSON text)
and ``{categories}`` (the allowed labels as JSON text), filled per task with
``concat`` (no UDF). The budget check counts approximate tokens
(characters // 4) and marks a task over the limit as ``invalid entry``
*before* any answer is requested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.labels import INVALID_ENTRY
from ..plans.joins import sized_broadcast
from .scalars import CHARS_PER_TOKEN, entry_json, json_string, json_text_length

TOKEN_LIMIT = 131_000  # fixed value: prompts above this many approximate tokens are not sent

# Paper fields put into the prompt, in this key order.
LABEL_FIELDS = ("_id", "abstract", "title", "fulltext")
SCREEN_FIELDS = ("_id", "abstract")

DEFAULT_TEMPLATE = (
    "Classify the research paper below into exactly one of the allowed labels.\n"
    "Paper (JSON):\n{entry}\n"
    "Allowed labels (JSON keys):\n{categories}\n"
    "Answer with the label only.\n")


def _field(name: str) -> Column:
    return F.col("paper_id").cast("string") if name == "_id" else F.col(name)


def entry_text(fields: Sequence[str] = LABEL_FIELDS) -> Column:
    """The paper record as indented JSON text (``_id`` as a string)."""
    return entry_json([(f, _field(f)) for f in fields])


def entry_text_length(fields: Sequence[str] = LABEL_FIELDS) -> Column:
    """Length of :func:`entry_text`, computed without building the text."""
    fixed = len("{\n") + len("\n}") + sum(len(f'  "{f}": ') for f in fields) + 2 * (len(fields) - 1)
    total = F.lit(fixed)
    for f in fields:
        total = total + json_text_length(_field(f))
    return total


def vocabulary_json(vocab: DataFrame) -> DataFrame:
    """``(category, categories_json)``: each category's labels as a JSON
    object of empty objects, two-space indent, labels in ``ord`` (or name) order.
    One small aggregation per category over the vocabulary dimension."""
    order = F.col("ord") if "ord" in vocab.columns else F.lit(0)
    items = (vocab.groupBy("category", "label").agg(F.min(order).alias("ord"))  # once, also if in two groups
             .groupBy("category")
             .agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("l")))
    body = F.array_join(F.transform("l", lambda s: F.concat(F.lit("  "), json_string(s["label"]),
                                                            F.lit(": {}"))), ",\n")
    return items.select("category", F.concat(F.lit("{\n"), body, F.lit("\n}")).alias("categories_json"))


def prompt_dim(spark, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``(category, technique, template)``: one template per labelling task and
    prompting technique, each with the slots ``{entry}`` and ``{categories}``."""
    from ..sources.dims import local_dim
    for _, _, t in rows:
        if t.count("{entry}") != 1 or t.count("{categories}") != 1 or t.index("{entry}") > t.index("{categories}"):
            raise ValueError("a template has {entry} once, then {categories} once")
    return local_dim(spark, rows, [("category", "string"), ("technique", "string"), ("template", "string")])


def with_template_keys(tasks: DataFrame, templates: DataFrame) -> DataFrame:
    """Tasks once for every technique that their category has a template for."""
    return tasks.join(sized_broadcast(templates.select("category", "technique")), "category")


def _with_template(tasks: DataFrame, template: str | DataFrame) -> DataFrame:
    """Add the template's three fixed parts ``_a _b _c``: of one text for all
    tasks, or joined from :func:`prompt_dim` by category (and by technique
    where the tasks have one)."""
    if isinstance(template, str):
        j = tasks.withColumn("template", F.lit(template))
    else:
        keys = ["category"] + (["technique"] if "technique" in tasks.columns else [])
        j = tasks.join(sized_broadcast(template), keys)
    rest = F.substring_index("template", "{entry}", -1)
    return (j.withColumn("_a", F.substring_index("template", "{entry}", 1))
             .withColumn("_b", F.substring_index(rest, "{categories}", 1))
             .withColumn("_c", F.substring_index(rest, "{categories}", -1)).drop("template"))


def with_entry(papers: DataFrame, fields: Sequence[str] = LABEL_FIELDS) -> DataFrame:
    """Add ``entry_json`` (the paper as JSON text) and its length ``entry_len``
    once per paper, before the paper fans out into one task per category."""
    return (papers.withColumn("entry_json", entry_text(fields))
                  .withColumn("entry_len", F.length("entry_json")))


def with_prompt(tasks: DataFrame, vocab_json: DataFrame, template: str | DataFrame = DEFAULT_TEMPLATE,
                fields: Sequence[str] = LABEL_FIELDS, skip_col: str | None = None) -> DataFrame:
    """Add the prompt text to tasks that carry the paper fields (or a
    prebuilt ``entry_json``). Rows where ``skip_col`` is true get no prompt."""
    entry = F.col("entry_json") if "entry_json" in tasks.columns else entry_text(fields)
    j = _with_template(tasks, template).join(sized_broadcast(vocab_json), "category")
    prompt = F.concat(F.col("_a"), entry, F.col("_b"), F.col("categories_json"), F.col("_c"))
    if skip_col:
        prompt = F.when(~F.col(skip_col), prompt)
    return j.withColumn("prompt", prompt).drop("_a", "_b", "_c")


def with_entry_length(papers: DataFrame, fields: Sequence[str] = LABEL_FIELDS) -> DataFrame:
    """Add ``entry_len`` (length of the paper's JSON text) once per paper,
    before the paper fans out into one task per category."""
    return papers.withColumn("entry_len", entry_text_length(fields))


def with_budget(tasks: DataFrame, vocab_json: DataFrame, template: str | DataFrame = DEFAULT_TEMPLATE,
                fields: Sequence[str] = LABEL_FIELDS, limit: int | Column = TOKEN_LIMIT) -> DataFrame:
    """Add ``prompt_tokens`` (characters // 4, from lengths only) and
    ``over_budget`` (strictly more than ``limit`` tokens, a number or a column). Tasks carry either
    the paper fields or a precomputed ``entry_len``."""
    if "entry_len" not in tasks.columns:
        tasks = with_entry_length(tasks, fields)
    j = _with_template(tasks, template).join(sized_broadcast(vocab_json.select(
        "category", F.length("categories_json").alias("_cl"))), "category")
    n = F.length("_a") + F.length("_b") + F.length("_c") + F.col("entry_len") + F.col("_cl")
    tok = F.floor(n / CHARS_PER_TOKEN).cast("long")
    return (j.withColumn("prompt_tokens", tok).drop("_cl", "_a", "_b", "_c")
             .withColumn("over_budget", F.col("prompt_tokens") > limit))


def budget_label(over_budget_col: str = "over_budget") -> Column:
    """``invalid entry`` for tasks over the budget, else NULL."""
    return F.when(F.col(over_budget_col), F.lit(INVALID_ENTRY))
