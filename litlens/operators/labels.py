"""Label resolution: tasks, answer validation, retry resolution, majority vote
and the outcome counts the labelling runs report.

Every operator is one or two hash aggregations keyed by the task
``(paper_id, category, run)``; validation is a broadcast join against the
vocabulary (size-checked). Aggregations are partial (map-side combine), so a
task key repeated many times collapses before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import py_strip
from ..plans.joins import sized_broadcast
from ..session import scratch_dir

TASK_KEYS = ("paper_id", "category", "run")
# Sentinels written instead of a label.
INVALID_RESULT = "invalid result"   # retries exhausted (labelling)
INVALID_ENTRY = "invalid entry"     # over the prompt budget; screening uses it for both


def label_tasks(papers: DataFrame, categories: Sequence[str], runs: int = 1,
                first_run: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """One task per paper x category x run (a generator, no join); ``keep``
    names paper columns carried along into each task."""
    if runs < 1:
        raise ValueError("runs must be at least 1")
    cats = F.array(*[F.lit(c) for c in categories])
    return (papers.select("paper_id", *keep, F.explode(cats).alias("category"))
            .select("*", F.explode(F.sequence(F.lit(first_run),
                                              F.lit(first_run + runs - 1))).alias("run")))


def allowed_answers(vocab: DataFrame) -> DataFrame:
    """``(category, answer, valid=true)`` for a join against stripped answers:
    distinct (a label present in two groups of one category counts once) and
    broadcast when its size check passes."""
    v = vocab.select("category", F.col("label").alias("answer")).distinct()
    return sized_broadcast(v.withColumn("valid", F.lit(True)))



def answer_validity(answers: DataFrame, vocab: DataFrame,
                    response_col: str = "response") -> DataFrame:
    """Each answer with its stripped text and whether it is in the category's
    vocabulary (exact, case-sensitive)."""
    a = answers.withColumn("answer", py_strip(F.col(response_col)))
    return (a.join(allowed_answers(vocab), ["category", "answer"], "left")
             .withColumn("valid", F.coalesce(F.col("valid"), F.lit(False))))


def valid_answers(answers: DataFrame, vocab: DataFrame) -> DataFrame:
    """Answers whose stripped text is an allowed label (left semi join)."""
    a = answers.withColumn("answer", py_strip(F.col("response")))
    return a.join(allowed_answers(vocab).drop("valid"), ["category", "answer"], "left_semi")


def rejected_answers(answers: DataFrame, vocab: DataFrame) -> DataFrame:
    """Answers that are not an allowed label, failed calls included (left anti join)."""
    a = answers.withColumn("answer", py_strip(F.col("response")))
    return a.join(allowed_answers(vocab).drop("valid"), ["category", "answer"], "left_anti")


# (attempt, label id) packed into one long, so the per-task minimum is a plain
# numeric aggregate (hash aggregation, code-generated) instead of a minimum
# over a struct with a string inside (sort-based aggregation).
_ID_BITS = 40


def _vocab_ids(vocab: DataFrame) -> DataFrame:
    """``(category, answer, label_id)``: labels numbered by name, as a broadcast
    side if its size check passes. The numbering sorts the vocabulary, a table
    of a user's labels, and is stored once, so every use sees the same ids."""
    v = vocab.select("category", F.col("label").alias("answer")).distinct()
    w = Window.orderBy("category", "answer")
    numbered = v.withColumn("label_id", F.row_number().over(w).cast("long"))
    scratch_dir(vocab.sparkSession)
    return sized_broadcast(numbered.checkpoint(eager=True))


def _with_ids(answers: DataFrame, ids: DataFrame) -> DataFrame:
    """Answers with their ``label_id`` (NULL: not allowed). Failed calls have no
    answer to look up: they get a key of their own each, so that they do not
    meet under one hot NULL key when the join shuffles."""
    key = F.coalesce("answer", F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string")))
    return (answers.withColumn("_key", key)
            .join(ids.select("category", F.col("answer").alias("_key"), "label_id"), ["category", "_key"], "left")
            .drop("_key"))


def resolve_answers(answers: DataFrame, vocab: DataFrame, max_attempts: int = 3,
                    sentinel: str = INVALID_RESULT,
                    keys: Sequence[str] = TASK_KEYS, settings: DataFrame | None = None) -> DataFrame:
    """First valid answer per task within ``max_attempts``; the sentinel when
    every attempt failed. ``attempts_used`` is NULL for exhausted tasks.
    Attempts count from 1 (attempt 0 marks a task that was not sent).

    ``settings`` (``category, attempts, sentinel``) gives each category its own
    limit and sentinel; categories without a row there are left out."""
    if settings is not None:
        own = sized_broadcast(settings.select("category", F.col("attempts").alias("_most"), F.col("sentinel").alias("_sentinel")))
        within = answers.join(own.drop("_sentinel"), "category").filter(F.col("attempt") <= F.col("_most"))
        found = resolve_answers(within.drop("_most"), vocab, (1 << 31) - 1, None, keys)
        return found.join(own.drop("_most"), "category").select(
            *keys, F.coalesce("label", "_sentinel").alias("label"), "attempts_used")
    in_range = F.col("attempt").between(1, max_attempts)
    a = answers.filter(in_range).withColumn("answer", py_strip(F.col("response")))
    ids = _vocab_ids(vocab)
    code = F.shiftleft(F.col("attempt").cast("long"), _ID_BITS) + F.col("label_id")
    best = _with_ids(a, ids).groupBy(*keys).agg(F.min(code).alias("code"))  # NULL label_id: not valid
    mask = (1 << _ID_BITS) - 1
    dec = best.select(*keys, F.shiftright("code", _ID_BITS).cast("int").alias("attempts_used"),
                      F.col("code").bitwiseAND(F.lit(mask)).alias("label_id"))
    lab = ids.select("label_id", F.col("answer").alias("label"))
    return (dec.join(lab, "label_id", "left")
               .select(*keys, F.coalesce(F.col("label"), F.lit(sentinel)).alias("label"),
                       "attempts_used"))


def majority_vote(answers: DataFrame, vocab: DataFrame, votes: int = 3,
                  sentinel: str = INVALID_RESULT,
                  keys: Sequence[str] = TASK_KEYS) -> DataFrame:
    """Most frequent answer among the first ``votes`` attempts; a tie goes to
    the answer seen first. Validity is tested after the vote; failed calls
    cast no vote, and a task without any vote resolves to the sentinel."""
    cast = answers.filter(F.col("attempt").between(1, votes))  # attempt 0 marks a task not sent
    a = cast.withColumn("answer", py_strip(F.col("response")))
    ids = _vocab_ids(vocab)
    # answers outside the vocabulary vote too, each for its own text: a hash of
    # it stands for the text, so both aggregations stay numeric
    a = _with_ids(a, ids).withColumn("choice", F.coalesce(
        F.col("label_id"), F.when(F.col("answer").isNotNull(), -1 - F.xxhash64("answer").bitwiseAND(F.lit((1 << 62) - 1)))))
    tally = a.groupBy(*keys, "choice").agg(F.count(F.lit(1)).alias("n"),
                                           F.min("attempt").alias("first_seen"))
    # most votes, then seen first; attempts of one task differ, so this names one choice
    rank = F.when(F.col("choice").isNotNull(),
                  F.shiftleft(votes - F.col("n"), 20) + F.col("first_seen").cast("long"))
    won = tally.groupBy(*keys).agg(F.min(rank).alias("best"), F.min_by("choice", rank).alias("label_id"))
    named = won.join(ids.select("label_id", F.col("answer").alias("label")), "label_id", "left")
    return named.select(*keys, F.coalesce("label", F.lit(sentinel)).alias("label"),
                        F.when(F.col("best").isNull(), F.lit(0).cast("long"))
                         .otherwise(votes - F.shiftright("best", 20)).alias("votes"))


def outcome_counts(labelled: DataFrame, sentinel: str = INVALID_RESULT,
                   over_budget: str = INVALID_ENTRY) -> DataFrame:
    """Per (category, run): tasks, valid labels, exhausted retries, over-budget entries."""
    lab = F.col("label")
    return labelled.groupBy("category", "run").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if(~lab.isin(sentinel, over_budget)).alias("n_valid"),
        F.count_if(lab == sentinel).alias("n_invalid"),
        # with one sentinel for both, exhausted and unsent tasks cannot be told apart:
        # they count as invalid only
        F.count_if((lab == over_budget) & F.lit(over_budget != sentinel)).alias("n_over_budget"))


def attempts_used(labelled: DataFrame) -> DataFrame:
    """How many attempts tasks needed (NULL = never valid), per category."""
    return labelled.groupBy("category", "attempts_used").agg(F.count(F.lit(1)).alias("n_tasks"))


def screen_outcomes(papers: DataFrame, col: str = "screen",
                    related: str = "yes", unrelated: str = "no",
                    invalid: str = INVALID_ENTRY) -> DataFrame:
    """Screening counters: invalid, related and unrelated papers."""
    c = F.col(col)
    return papers.agg(F.count_if(c == invalid).alias("n_invalid"),
                      F.count_if(c == related).alias("n_related"),
                      F.count_if(c == unrelated).alias("n_unrelated"))


def pending_tasks(tasks: DataFrame, labelled: DataFrame, retry_invalid: bool = True,
                  sentinel: str = INVALID_RESULT,
                  keys: Sequence[str] = TASK_KEYS) -> DataFrame:
    """Tasks without a final label (left anti join); with ``retry_invalid``
    a task whose retries were exhausted counts as still pending."""
    done = labelled.filter(F.col("label") != sentinel) if retry_invalid else labelled
    return tasks.join(done.select(*keys), list(keys), "left_anti")


def technique_invalid(answers: DataFrame, vocab: DataFrame, techniques: DataFrame,
                      max_attempts: int = 5, votes: int = 3,
                      sentinel: str = INVALID_RESULT) -> DataFrame:
    """Invalid results per prompting technique.

    ``answers`` is an answer log keyed by (paper_id, category, run, attempt);
    ``techniques(run, technique, mode)`` names the technique behind each run and
    whether it retries until valid (``retry``) or votes (``vote``). A log that
    names the technique itself is joined by it, and ``techniques`` needs no run.
    """
    by = "technique" if "technique" in answers.columns else "run"
    a = answers.join(sized_broadcast(techniques.select(*dict.fromkeys([by, "technique", "mode"]))), by)
    retry = resolve_answers(a.filter(F.col("mode") == "retry"), vocab, max_attempts, sentinel,
                            keys=("paper_id", "category", "run", "technique"))
    vote = majority_vote(a.filter(F.col("mode") == "vote"), vocab, votes, sentinel,
                         keys=("paper_id", "category", "run", "technique"))
    both = retry.select("technique", "label").unionByName(vote.select("technique", "label"))
    return both.groupBy("technique").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count_if(F.col("label") == sentinel).alias("n_invalid"))
