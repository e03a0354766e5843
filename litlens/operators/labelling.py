"""One call for the whole labelling run of a paper collection.

tasks (paper x category x run) -> prompt budget (over-budget tasks get
``invalid entry`` without any call) -> prompts -> answers from the user's
function (``label_batch``) -> answer log on shared storage -> labels resolved
from the log.

The log is the run's memory. It is written slice by slice (papers by a hash
of their id), each slice one committed write, and a run with the same
``answers_path`` and ``call_id`` first leaves out the tasks already logged, so
a run that died goes on where its last committed slice ended. Within a slice,
Spark may repeat calls of a task it retries; only one attempt is committed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import (DEFAULT_TEMPLATE, LABEL_FIELDS, TOKEN_LIMIT, entry_text,
                                 vocabulary_json, with_budget, with_prompt)
from ..session import arrow_batches_below, scratch_path
from ..sources.tables import read_if_exists
from .batch import PROMPT_BATCH_BYTES, AnswerFn, answer_log_schema, label_batch
from .labels import INVALID_ENTRY, INVALID_RESULT, TASK_KEYS, resolve_answers
from .memo import answer_once


def label_collection(spark: SparkSession, papers: DataFrame, vocab: DataFrame, fn: AnswerFn,
                     categories: Sequence[str], runs: int = 1, first_run: int = 1,
                     template: str | DataFrame = DEFAULT_TEMPLATE, fields: Sequence[str] = LABEL_FIELDS,
                     limit: int = TOKEN_LIMIT, max_attempts: int = 3,
                     sentinel: str = INVALID_RESULT, answers_path: str | None = None,
                     call_id: str | None = None, slices: int = 1,
                     partitions: int | None = None, rows_per_call: int = 64,
                     categories_json: DataFrame | None = None, settings: DataFrame | None = None,
                     memo_path: str | None = None, buckets: int = 16) -> DataFrame:
    """Labels ``(paper_id, category, run, label, attempts_used)`` for every
    task of this call.

    The raw answers go to ``<answers_path>/call=<call_id>`` (a fresh folder
    under ``spark.checkpoint.dir``, and a fresh id, when not given) in
    ``slices`` commits. Only this call's answers are resolved, so labelling a
    paper again under another id gives the new answers; ``upsert_table`` then
    replaces the old label. ``categories_json`` shows the categories in
    another form than :func:`vocabulary_json`. ``settings``
    (:func:`~litlens.sources.categories.settings_dim`) gives each category its
    own attempts, sentinel, token limit and fields; it takes the place of
    ``max_attempts``, ``sentinel``, ``limit`` and ``fields``. With ``memo_path``
    equal prompts are called once, in ``buckets`` commits, and never again by a
    later run with the same memo (:mod:`~litlens.operators.memo`)."""
    if runs < 1:
        raise ValueError("runs must be at least 1")
    path = f"{(answers_path or scratch_path(spark, 'answers')).rstrip('/')}/call={call_id or uuid.uuid4().hex}"
    kind = papers.schema["paper_id"].dataType.simpleString()
    vj = categories_json if categories_json is not None else vocabulary_json(vocab)
    for k in range(slices):
        mine = papers.filter(F.pmod(F.xxhash64("paper_id"), F.lit(slices)) == k) if slices > 1 else papers
        tasks = _tasks(mine, categories, runs, first_run, fields, limit, max_attempts, settings)
        logged = read_if_exists(spark, path)
        if logged is not None:
            tasks = tasks.join(logged.select(*TASK_KEYS).distinct(), list(TASK_KEYS), "left_anti")
        budget = with_budget(tasks, vj, template, limit=F.col("token_limit"))
        prompts = with_prompt(budget, vj, template, skip_col="over_budget")
        if memo_path:
            log = answer_once(prompts, vocab, fn, memo_path, buckets, partitions=partitions,
                              rows_per_call=rows_per_call, skip_col="over_budget")
        else:
            log = label_batch(prompts, vocab, fn, partitions=partitions, rows_per_call=rows_per_call,
                              skip_col="over_budget")
        with arrow_batches_below(spark, PROMPT_BATCH_BYTES):
            log.write.mode("append").parquet(path)
    answers = spark.read.schema(answer_log_schema(kind)).parquet(path)
    # attempt 0 marks a task that was not sent (over budget)
    sent = resolve_answers(answers, vocab, max_attempts, sentinel, settings=settings)  # attempts from 1
    skipped = (answers.filter(F.col("attempt") == 0).select(*TASK_KEYS).distinct()
               .select(*TASK_KEYS, F.lit(INVALID_ENTRY).alias("label"),
                       F.lit(None).cast("int").alias("attempts_used")))
    return sent.unionByName(skipped)


def _tasks(papers: DataFrame, categories: Sequence[str], runs: int, first_run: int, fields: Sequence[str],
           limit: int, max_attempts: int, settings: DataFrame | None) -> DataFrame:
    """A row for each paper, category and run, with the paper's JSON text as the
    category shows it, its length, ``token_limit`` and ``attempts``. Each list of
    fields in use becomes one text per paper, before the paper fans out."""
    if settings is None:
        rows = [(c, max_attempts, limit, tuple(fields)) for c in categories]
    else:  # a row a category: the configuration of the run
        known = {r.category: (r.attempts, r.token_limit, tuple(r.fields)) for r in
                 settings.filter(F.col("category").isin(list(categories))).collect()}
        if missing := [c for c in categories if c not in known]:
            raise ValueError(f"no settings for {missing}")
        rows = [(c, *known[c]) for c in categories]
    shown = list(dict.fromkeys(f for *_, f in rows))
    texts = papers.select("paper_id", *[entry_text(f).alias(f"_entry{k}") for k, f in enumerate(shown)])
    texts = texts.select("*", *[F.length(f"_entry{k}").alias(f"_len{k}") for k in range(len(shown))])
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(n).alias("attempts"), F.lit(most).alias("token_limit"),
                              F.col(f"_entry{shown.index(f)}").alias("entry_json"), F.col(f"_len{shown.index(f)}").alias("entry_len"))
                     for c, n, most, f in rows])
    return texts.select("paper_id", F.inline(each)).select(
        "*", F.explode(F.sequence(F.lit(first_run), F.lit(first_run + runs - 1))).alias("run"))
