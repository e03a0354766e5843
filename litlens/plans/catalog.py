"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
built from the test tables (through the fixture views). Column names and
types match the SQL in :mod:`litlens.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import scalars as S
from ..operators import agree as A
from ..operators import keywords as K
from ..operators import labels as L
from ..operators import sample as O
from ..operators import trends as T
from ..operators import upsert as U
from ..sources import fixtures as X
from ..sources.dims import local_dim
from ..sources.papers import entries
from ..sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CATEGORIES = [c for c, _ in X.FIXTURE_CATEGORIES]
TOPIC_LABELS = [f"label {i}" for i in range(7)] + [L.INVALID_RESULT]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table: every task resolved with 3 attempts."""
    return L.resolve_answers(X.responses(spark, sf_dir), X.vocabulary(spark), max_attempts=3)


def _counts(spark, sf_dir):
    return T.decade_label_counts(T.labelled_papers(X.papers(spark, sf_dir), resolved(spark, sf_dir)))


# ---- trends -----------------------------------------------------------------

@query
def top_label_per_decade(spark, sf_dir):
    r = T.top_label_per_decade(X.papers(spark, sf_dir), resolved(spark, sf_dir))
    return r.withColumn("rank", F.col("rank").cast("int"))


@query
def decade_label_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query
def decade_label_share(spark, sf_dir):
    return T.with_share(_counts(spark, sf_dir))


@query
def decade_share_join(spark, sf_dir):
    return T.with_share_join(_counts(spark, sf_dir))


@query
def decade_totals(spark, sf_dir):
    return T.decade_totals(_counts(spark, sf_dir))


@query
def decade_topic_pivot(spark, sf_dir):
    c = _counts(spark, sf_dir).filter(F.col("category") == "topic")
    return T.pivot_counts(c, TOPIC_LABELS)


@query
def decade_share_pivot(spark, sf_dir):
    return T.pivot_share(T.with_share(_counts(spark, sf_dir)), TOPIC_LABELS, by=("category", "decade"))


@query
def label_span(spark, sf_dir):
    return T.label_span(T.labelled_papers(X.papers(spark, sf_dir), resolved(spark, sf_dir)))


def _dated_screened(spark, sf_dir):
    return T.dated(T.screened(X.papers(spark, sf_dir)).select("paper_id", "date_publication"))


@query
def papers_per_year(spark, sf_dir):
    return T.papers_per_year(_dated_screened(spark, sf_dir))


@query
def papers_cumulative(spark, sf_dir):
    return T.cumulative(T.papers_per_year(_dated_screened(spark, sf_dir)))


@query
def pub_year(spark, sf_dir):
    p = X.papers(spark, sf_dir).select("paper_id", "date_publication")
    y = S.pub_year("date_publication")
    return p.select("paper_id", "date_publication", y.alias("year"), S.decade(y).alias("decade"))


# ---- scans and projections ----------------------------------------------------

@query
def scan_count(spark, sf_dir):
    return X.papers(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_papers"))


@query
def screened_papers(spark, sf_dir):
    return T.screened(X.papers(spark, sf_dir)).select(
        "paper_id", "venue", "title", "date_publication", "screen")


@query
def screened_with_label(spark, sf_dir):
    p = X.papers(spark, sf_dir)
    return (p.filter((F.col("screen") == "yes") & F.col("screen_alt").isNotNull())
            .select("paper_id", "screen_alt"))


@query
def entry_projection(spark, sf_dir):
    return entries(T.screened(X.papers(spark, sf_dir)))


@query
def screen_outcomes(spark, sf_dir):
    return L.screen_outcomes(X.papers(spark, sf_dir))


# ---- label resolution ---------------------------------------------------------

@query
def answer_validity(spark, sf_dir):
    return L.answer_validity(X.responses(spark, sf_dir), X.vocabulary(spark)).select(
        "paper_id", "category", "run", "attempt", "answer", "valid")


@query
def answers_valid_semi(spark, sf_dir):
    return L.valid_answers(X.responses(spark, sf_dir), X.vocabulary(spark)).select(
        "paper_id", "category", "run", "attempt", "response", "answer")


@query
def answers_rejected_anti(spark, sf_dir):
    return L.rejected_answers(X.responses(spark, sf_dir), X.vocabulary(spark)).select(
        "paper_id", "category", "run", "attempt", "response", "answer")


@query
def resolve_answers(spark, sf_dir):
    return resolved(spark, sf_dir)


@query
def outcome_counts(spark, sf_dir):
    return L.outcome_counts(resolved(spark, sf_dir))


@query
def attempts_used(spark, sf_dir):
    return L.attempts_used(resolved(spark, sf_dir))


@query
def majority_vote(spark, sf_dir):
    return L.majority_vote(X.responses(spark, sf_dir), X.vocabulary(spark), votes=3)


def _tasks(spark, sf_dir):
    return L.label_tasks(T.screened(X.papers(spark, sf_dir)), CATEGORIES, runs=X.FIXTURE_RUNS)


@query
def label_tasks(spark, sf_dir):
    return _tasks(spark, sf_dir)


@query
def pending_tasks(spark, sf_dir):
    return L.pending_tasks(_tasks(spark, sf_dir), resolved(spark, sf_dir))


# The seven prompting loops compared on the topic task, one per run
# of the answer log; one votes over 3 answers, the others retry.
TECHNIQUES = [(1, "vanilla", "retry"), (2, "rephrase_and_respond", "retry"),
              (3, "emotion", "retry"), (4, "chain_of_thought", "retry"),
              (5, "self_consistency", "vote"), (6, "few_shot", "retry"), (7, "combined", "retry")]


@query
def technique_invalid(spark, sf_dir):
    t = local_dim(spark, TECHNIQUES, [("run", "int"), ("technique", "string"), ("mode", "string")])
    a = X.responses(spark, sf_dir, runs=len(TECHNIQUES)).filter(F.col("category") == "topic")
    return L.technique_invalid(a, X.vocabulary(spark), t, max_attempts=5, votes=3)


# ---- agreement ------------------------------------------------------------------


def _scores(spark, sf_dir):
    return A.consistency(resolved(spark, sf_dir))


@query
def consistency_per_paper(spark, sf_dir):
    return _scores(spark, sf_dir)


@query
def consistency_by_category(spark, sf_dir):
    return A.consistency_by_category(_scores(spark, sf_dir))


@query
def consistency_box(spark, sf_dir):
    return A.consistency_box(_scores(spark, sf_dir))


@query
def consistency_matrix(spark, sf_dir):
    return A.consistency_matrix(_scores(spark, sf_dir), CATEGORIES)


@query
def assigned_labels(spark, sf_dir):
    return A.assigned_labels(resolved(spark, sf_dir))


@query
def categories_present(spark, sf_dir):
    return A.categories_present(resolved(spark, sf_dir))


@query
def labels_long(spark, sf_dir):
    runs = list(range(1, X.FIXTURE_RUNS + 1))
    return A.labels_long(A.labels_wide(resolved(spark, sf_dir), CATEGORIES, runs))


@query
def category_short_name(spark, sf_dir):
    keys = resolved(spark, sf_dir).select(S.wide_key("category", "run").alias("key")).distinct()
    return A.short_names(keys)


@query
def screen_contingency(spark, sf_dir):
    return A.contingency(X.papers(spark, sf_dir), "screen_alt", "screen",
                         a_name="llm_label", b_name="abstract_label")


# ---- sampling, write-back ---------------------------------------------------------

@query
def sample_papers(spark, sf_dir):
    p = X.papers(spark, sf_dir).filter(F.col("screen_alt") == "yes")
    return O.sample_report(p, 10, seed=42, show_col="date_publication", default="no date")


@query
def label_upsert(spark, sf_dir):
    """Two versions of an update per paper (order negative, NULL or positive),
    and a field the target does not have."""
    p = X.papers(spark, sf_dir)
    u = p.filter(F.col("screen_alt").isNotNull())
    old = u.select("paper_id", F.lit("old").alias("screen"), F.lit("lost").alias("note"),
                   F.when(F.col("paper_id") % 2 == 0, F.lit(-5)).alias("version"))
    new = u.select("paper_id", F.col("screen_alt").alias("screen"), "lang",
                   F.when(F.col("paper_id") % 2 == 0, -1).otherwise(F.col("paper_id")).cast("int").alias("version"))
    updates = old.unionByName(new.withColumnRenamed("lang", "note"))
    return U.upsert(p.select("paper_id", "screen"), updates, ["paper_id"], order="version")


# ---- keyword taxonomy -------------------------------------------------------------

@query
def taxonomy_hits(spark, sf_dir):
    return K.taxonomy_hits(X.papers(spark, sf_dir), X.volume_stems(spark))


@query
def taxonomy_best_topic(spark, sf_dir):
    return K.best_topic(X.papers(spark, sf_dir), X.volume_stems(spark))


# ---- prompts and answering ----------------------------------------------------------

def _prompt_tasks(spark, sf_dir):
    # the paper's JSON text is built once, then fans out to its tasks
    p = P.with_entry(T.screened(X.papers(spark, sf_dir)))
    return L.label_tasks(p, CATEGORIES, runs=1, keep=["entry_json", "entry_len"])


# A limit that the longest documents of every test table exceed.
SHORT_LIMIT = 2_000


@query
def prompt_budget(spark, sf_dir):
    """Tokens of each task's prompt under every technique's template, from
    lengths only, against a limit that some papers exceed."""
    p = P.with_entry_length(T.screened(X.papers(spark, sf_dir))).select("paper_id", "entry_len")
    tasks = L.label_tasks(p, CATEGORIES, runs=1, keep=["entry_len"])
    b = P.with_budget(tasks, X.tree_json(spark), X.prompt_templates(spark), limit=SHORT_LIMIT)
    return b.select("paper_id", "category", "technique", "prompt_tokens", "over_budget")


def stub_answers(batch):
    """Deterministic stand-in for a model: a label number from the prompt
    length and attempt (numbers past the vocabulary are invalid answers);
    some calls fail."""
    out = []
    for pid, prompt, attempt in zip(batch["paper_id"], batch["prompt"], batch["attempt"]):
        if (int(str(pid).lstrip("p")) + int(attempt)) % 5 == 0:
            out.append(None)
        else:
            out.append(f" label {(len(prompt) + 3 * int(attempt)) % 8} ")
    return out


@query
def label_batch_stub(spark, sf_dir):
    from ..operators.batch import label_batch
    vocab = X.vocabulary(spark)
    tasks = P.with_prompt(_prompt_tasks(spark, sf_dir), P.vocabulary_json(vocab))
    log = label_batch(tasks, vocab, stub_answers, max_attempts=3)
    return L.resolve_answers(log, vocab, max_attempts=3)


@query
def technique_votes_stub(spark, sf_dir):
    """All seven prompting techniques through the answer function: each task
    draws by its technique's plan (five attempts until valid, or three for a
    vote), and the log gives the invalid results per technique."""
    from ..operators.batch import EXACTLY, FIRST_VALID, label_batch, with_draw_plan
    vocab = X.vocabulary(spark).filter("category = 'topic'")
    kinds = [("technique", "string"), ("mode", "string"), ("stop", "string"), ("attempts", "int")]
    t = local_dim(spark, [(name, mode, *((EXACTLY, 3) if mode == "vote" else (FIRST_VALID, 5)))
                          for _, name, mode in TECHNIQUES], kinds)
    templates = P.prompt_dim(spark, [("topic", name, f"[{name}] {P.DEFAULT_TEMPLATE}") for _, name, _ in TECHNIQUES])
    p = P.with_entry(T.screened(X.papers(spark, sf_dir))).select("paper_id", "entry_json", "entry_len")
    tasks = L.label_tasks(p, ["topic"], keep=["entry_json", "entry_len"])
    prompts = P.with_prompt(with_draw_plan(P.with_template_keys(tasks, templates), t), P.vocabulary_json(vocab), templates)
    log = label_batch(prompts, vocab, stub_answers)
    return L.technique_invalid(log, vocab, t, max_attempts=5, votes=3)


def stub_by_task(batch):
    """The stand-in of each task: screening answers for ``screen``."""
    out = [None] * len(batch)
    for fn, mine in ((stub_screen, batch["category"] == "screen"), (stub_answers, batch["category"] != "screen")):
        for at, answer in zip(mine.to_numpy().nonzero()[0], fn(batch[mine])):
            out[at] = answer
    return out


@query
def label_collection_settings(spark, sf_dir):
    """One labelling run over tasks of different settings: screening shows the
    abstract only, makes two attempts and gives up with ``invalid entry``."""
    from ..operators.labelling import label_collection
    from ..sources.categories import settings_dim
    vocab = X.vocabulary(spark).unionByName(local_dim(
        spark, [("screen", v) for v in SCREEN_LABELS], [("category", "string"), ("label", "string")]))
    settings = settings_dim(spark, [("screen", 2, L.INVALID_ENTRY, P.TOKEN_LIMIT, P.SCREEN_FIELDS)] +
                            [(c, 3, L.INVALID_RESULT, P.TOKEN_LIMIT, P.LABEL_FIELDS) for c in CATEGORIES])
    p = T.screened(X.papers(spark, sf_dir))
    return label_collection(spark, p, vocab, stub_by_task, ["screen", *CATEGORIES], settings=settings)


def stub_by_prompt(batch):
    """A stand-in that knows nothing but the prompt and the attempt."""
    return [f"label {(len(p) + 3 * int(a)) % 8}" for p, a in zip(batch["prompt"], batch["attempt"])]


@query
def label_collection_memo(spark, sf_dir):
    """Prompts that show the abstract alone, so that copies of a text share one:
    each distinct prompt is called once, in commits by digest."""
    from ..operators.labelling import label_collection
    from ..session import scratch_path
    p = T.screened(X.papers(spark, sf_dir))
    return label_collection(spark, p, X.vocabulary(spark), stub_by_prompt, CATEGORIES, fields=("abstract",),
                            memo_path=scratch_path(spark, "memo"), buckets=4)


@query
def stream_resolve(spark, sf_dir):
    """Answers arrive in three waves (attempt 3, then 1, then 2) and are
    resolved by the stream; the merged labels equal the batch resolution."""
    from ..session import scratch_path
    from ..streaming.resolve_stream import read_labels, start_resolve_stream
    base = scratch_path(spark, "stream-resolve")
    src, parts, ckpt = f"{base}/answers", f"{base}/labels", f"{base}/checkpoint"
    resp = X.responses(spark, sf_dir)
    for wave in (3, 1, 2):
        resp.filter(F.col("attempt") == wave).write.mode("append").parquet(src)
    # one wave of files per micro-batch
    n_files = len(spark.read.parquet(src).inputFiles())
    q = start_resolve_stream(spark, src, X.vocabulary(spark), parts, ckpt, max_attempts=3,
                             files_per_batch=max(1, n_files // 3))
    q.awaitTermination()
    return read_labels(spark, parts).drop("seen")


# ---- the same operators over the other given tables ------------------------------


@query
def label_source_contingency(spark, sf_dir):
    """Two label sources on the same documents (quality, toxic) compared."""
    lab = read_table(spark, sf_dir, "labels").select(
        F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return A.contingency(lab, "quality", "toxic", domain=["0", "1", "missing"])


def _orders(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.year("o_orderdate").alias("year"),
                    F.lit("o_orderpriority").alias("category"),
                    F.col("o_orderpriority").alias("label"))


@query
def orders_cumulative(spark, sf_dir):
    y = _orders(spark, sf_dir).filter(F.col("year").isNotNull())
    return T.cumulative(T.papers_per_year(y, "orders_in_year"), "orders_in_year", "cumulative_orders")


@query
def orders_priority_span(spark, sf_dir):
    return T.label_span(_orders(spark, sf_dir).filter(F.col("year").isNotNull()
                                                      & F.col("label").isNotNull()))


@query
def orders_priority_share_by_year(spark, sf_dir):
    o = _orders(spark, sf_dir).filter(F.col("year").isNotNull() & F.col("label").isNotNull())
    return T.with_share(T.decade_label_counts(o, bucket="year"), bucket="year")


@query
def events_top_type_per_day(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").filter(
        F.col("ts").isNotNull() & F.col("event_type").isNotNull())
    e = e.select(F.to_date("ts").alias("day"), F.lit("event_type").alias("category"),
                 F.col("event_type").alias("label"))
    top = T.top_labels(T.with_share(T.decade_label_counts(e, bucket="day"), bucket="day"),
                       1, bucket="day")
    return top.withColumn("rank", F.col("rank").cast("int"))


@query
def conversation_roles(spark, sf_dir):
    """Roles of each conversation in turn order, one row per turn."""
    c = read_table(spark, sf_dir, "conversations").select(
        "conv_id", F.lit("role").alias("category"), "turn", F.col("role").alias("label"))
    return A.ordered_labels(c, id_col="conv_id", order_col="turn")


@query
def label_collection_stub(spark, sf_dir):
    """The whole labelling run (budget, prompts, answers, persisted log,
    resolution) with the deterministic stand-in answer function."""
    from ..operators.labelling import label_collection
    p = T.screened(X.papers(spark, sf_dir))
    return label_collection(spark, p, X.vocabulary(spark), stub_answers, CATEGORIES, runs=1)


# The screening vocabulary.
SCREEN_LABELS = ["yes", "no"]


def stub_screen(batch):
    """Deterministic stand-in for the screening model: yes / padded no / an
    answer outside the vocabulary, from the prompt length and attempt; some
    calls fail."""
    out = []
    for pid, prompt, attempt in zip(batch["paper_id"], batch["prompt"], batch["attempt"]):
        if (int(pid) + int(attempt)) % 7 == 0:
            out.append(None)
        else:
            out.append(["yes", " no\n", "Maybe"][(len(prompt) + 5 * int(attempt)) % 3])
    return out


@query
def screening_resume_stub(spark, sf_dir):
    """Screening run resumed: papers without a second screening result are
    screened (abstract only, 2 attempts, ``invalid entry`` when exhausted) and
    the results are written back by key into the paper records."""
    from ..operators.labelling import label_collection
    p = X.papers(spark, sf_dir)
    todo = p.filter(F.col("screen_alt").isNull())
    vocab = local_dim(spark, [("screen", v) for v in SCREEN_LABELS],
                      [("category", "string"), ("label", "string")])
    lab = label_collection(spark, todo, vocab, stub_screen, ["screen"], fields=P.SCREEN_FIELDS,
                           max_attempts=2, sentinel=L.INVALID_ENTRY)
    updates = lab.select("paper_id", F.col("label").alias("screen_alt"))
    return U.upsert(p.select("paper_id", "screen_alt"), updates, ["paper_id"])


@query
def prompt_build(spark, sf_dir):
    """The full prompt text of every labelling task of the screened papers, by
    the template of each technique, over the nested category tree."""
    return P.with_prompt(_prompt_tasks(spark, sf_dir), X.tree_json(spark), X.prompt_templates(spark)).select(
        "paper_id", "category", "technique", "prompt")


@query
def label_collection_string_ids(spark, sf_dir):
    """The labelling run over papers whose ids are strings."""
    from ..operators.labelling import label_collection
    p = T.screened(X.papers(spark, sf_dir)).withColumn("paper_id", F.concat(F.lit("p"), F.col("paper_id")))
    return label_collection(spark, p, X.vocabulary(spark), stub_answers, CATEGORIES, runs=1, slices=2)


@query
def consistency_uneven_runs(spark, sf_dir):
    """Runs numbered from 64 on, one category with a single run (not scored),
    one excluded by name."""
    lab = resolved(spark, sf_dir).filter((F.col("category") != "ethics") | (F.col("run") == 1))
    lab = lab.withColumn("run", F.col("run") + 63)
    return A.consistency_by_category(A.consistency(lab), exclude=["openness"])


@query
def conversation_first_word(spark, sf_dir):
    """An answer log of real strings: the first word of each turn is an answer,
    the turns of a conversation are its attempts."""
    vocab = local_dim(spark, [("opening", v) for v in OPENING_WORDS], [("category", "string"), ("label", "string")])
    turns = read_table(spark, sf_dir, "conversations")
    log = turns.select(F.col("conv_id").alias("paper_id"), F.lit("opening").alias("category"), F.lit(1).alias("run"),
                       (F.col("turn") + 1).cast("int").alias("attempt"),
                       F.concat(F.lit(" "), F.lower(F.substring_index("text", " ", 1)), F.lit("\n")).alias("response"))
    return L.resolve_answers(log, vocab, max_attempts=5)


# Words that open a turn.
OPENING_WORDS = ["the", "of", "is", "was", "and", "an", "de", "la", "le", "der", "die", "das", "los", "as"]


@query
def stream_resolve_compacted(spark, sf_dir):
    """The stream stopped after two waves and started again from its checkpoint
    for the third: the state, one compact row a task, comes from Spark's state
    store, so the second run only reads the new wave. Labels equal the batch
    resolution."""
    from ..session import scratch_path
    from ..streaming.resolve_stream import read_labels, start_resolve_stream
    base = scratch_path(spark, "stream-restarted")
    resp, vocab = X.responses(spark, sf_dir), X.vocabulary(spark)
    for waves in ((3, 1), (2,)):
        for k in waves:
            resp.filter(F.col("attempt") == k).write.mode("append").parquet(f"{base}/answers")
        start_resolve_stream(spark, f"{base}/answers", vocab, f"{base}/labels", f"{base}/checkpoint").awaitTermination()
    return read_labels(spark, f"{base}/labels").drop("seen")


# How the answers of the streamed votes are drawn, and when they come.
VOTE_PLAN = [("topic", "exactly", 3), ("ethics", "exactly", 2), ("openness", "first_valid", 3)]


def _vote_waves(spark, sf_dir):
    """Tasks are asked in two hours. Some second answers come a wave later, which
    the patience allows; some third ones come when their task is closed. A last row
    (attempt 0: a task not sent) moves the watermark past all tasks."""
    i, a = F.col("paper_id"), F.col("attempt")
    log = X.responses(spark, sf_dir, runs=2).withColumn("error", F.lit(None).cast("string"))
    log = log.withColumn("hour", (i % 2).cast("int")).withColumn(
        "wave", F.col("hour") + F.when((a == 3) & (i % 14 == 4), 2).when((a == 2) & (i % 5 == 1), 1).otherwise(0))
    log = log.withColumn("asked_at", F.timestamp_seconds(F.col("hour") * 3600 + F.lit(1_700_000_000)))
    end = log.limit(1).withColumn("attempt", F.lit(0)).withColumn(
        "asked_at", F.timestamp_seconds(F.lit(1_700_000_000 + 86_400)))
    for wave in range(3):
        rows = log.filter(F.col("wave") == wave)
        yield (rows.unionByName(end) if wave == 2 else rows).drop("hour", "wave")


def _closed_votes(spark, sf_dir, base, count=False):
    """Each wave is a run of its own from the checkpoint of the one before."""
    from ..streaming.vote_stream import start_counter_stream, start_vote_stream
    plan = local_dim(spark, VOTE_PLAN, [("category", "string"), ("stop", "string"), ("attempts", "int")])
    for rows in _vote_waves(spark, sf_dir):
        rows.write.mode("append").parquet(f"{base}/answers")
        start_vote_stream(spark, f"{base}/answers", X.vocabulary(spark), plan, f"{base}/closed",
                          f"{base}/votes").awaitTermination()
        if count:
            start_counter_stream(spark, f"{base}/closed", f"{base}/counters", f"{base}/counts").awaitTermination()


@query
def stream_votes(spark, sf_dir):
    """Votes and retries closed while answers arrive, late ones left out."""
    from ..session import scratch_path
    base = scratch_path(spark, "stream-votes")
    _closed_votes(spark, sf_dir, base)
    return spark.read.parquet(f"{base}/closed").drop("n_answers")


@query
def stream_counters(spark, sf_dir):
    """The live counters of the same tasks after the last wave."""
    from ..session import scratch_path
    from ..streaming.vote_stream import read_counters
    base = scratch_path(spark, "stream-counters")
    _closed_votes(spark, sf_dir, base, count=True)
    return read_counters(spark, f"{base}/counters")
