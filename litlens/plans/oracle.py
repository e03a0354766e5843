"""Independent SQL (DuckDB dialect) for every registered query.

The fixture views are written again in SQL here (not generated from the Spark
code), over the pre-registered ``documents`` table.
"""

from __future__ import annotations

PAPERS = """papers AS (
  SELECT doc_id AS paper_id, source AS venue, lang,
    concat('paper ', CAST(doc_id AS VARCHAR)) AS title,
    CASE WHEN doc_id % 53 = 0 THEN NULL ELSE text END AS abstract,
    text AS fulltext,
    CASE WHEN doc_id % 37 = 0 THEN NULL WHEN doc_id % 41 = 0 THEN 'n.d.'
         WHEN doc_id % 43 = 0 THEN '31-02-2001'
         ELSE concat(lpad(CAST(1 + doc_id * 11 % 28 AS VARCHAR), 2, '0'), '-',
                     lpad(CAST(1 + doc_id * 7 % 12 AS VARCHAR), 2, '0'), '-',
                     CAST(1965 + doc_id * 31 % 60 AS VARCHAR)) END AS date_publication,
    CASE WHEN doc_id % 3 = 0 THEN 'no' WHEN doc_id % 97 = 1 THEN 'invalid entry'
         ELSE 'yes' END AS screen,
    CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'no'
         WHEN doc_id % 89 = 2 THEN 'invalid entry' ELSE 'yes' END AS screen_alt
  FROM documents)"""

CATS = "(VALUES ('topic', 7), ('ethics', 3), ('openness', 4)) AS k(category, n)"

VOCAB = f"""vocab AS (
  SELECT k.category, concat('label ', CAST(t.i AS VARCHAR)) AS label
  FROM {CATS}
  JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) AS t(i) ON t.i < k.n)"""

RESPONSES = f"""responses AS (
  SELECT d.doc_id AS paper_id, k.category, r.run, a.attempt,
    CASE WHEN (d.doc_id + r.run) % 29 = 0
           OR (d.doc_id * 13 + r.run * 7 + a.attempt * 3) % 11 = 0 THEN NULL
         WHEN (d.doc_id * 5 + r.run) % 31 = 0
           OR (d.doc_id * 5 + r.run * 3 + a.attempt) % 7 = 0 THEN 'This paper belongs to label 1'
         ELSE concat(' label ', CAST((d.doc_id + CASE WHEN (d.doc_id + r.run) % 4 = 0
                     THEN r.run ELSE 0 END) % k.n AS VARCHAR), chr(10)) END AS response
  FROM documents d
  CROSS JOIN {CATS}
  CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS r(run)
  CROSS JOIN (VALUES (1), (2), (3)) AS a(attempt))"""

# Python str.strip() for the white space the fixtures contain
STRIP = "regexp_replace(response, '^\\s+|\\s+$', '', 'g')"

CHECKED = f"""checked AS (
  SELECT r.*, {STRIP} AS answer,
         EXISTS (SELECT 1 FROM vocab v WHERE v.category = r.category
                 AND v.label = {STRIP}) AS valid
  FROM responses r)"""

RESOLVED = """resolved AS (
  SELECT paper_id, category, run,
    coalesce(arg_min(answer, attempt) FILTER (WHERE valid AND attempt <= 3), 'invalid result') AS label,
    CAST(min(attempt) FILTER (WHERE valid AND attempt <= 3) AS INTEGER) AS attempts_used
  FROM checked GROUP BY paper_id, category, run)"""

YEAR = ("CASE WHEN regexp_matches(date_publication, '^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$') "
        "THEN CAST(year(try_strptime(date_publication, '%d-%m-%Y')) AS INTEGER) END")

DATED = f"""dated AS (
  SELECT paper_id, {YEAR} AS year FROM papers WHERE screen = 'yes'),
dated2 AS (
  SELECT paper_id, year, CAST(floor(year / 10) * 10 AS INTEGER) AS decade
  FROM dated WHERE year IS NOT NULL)"""

LP = """lp AS (
  SELECT r.paper_id, d.year, d.decade, r.category, r.label
  FROM resolved r JOIN dated2 d ON r.paper_id = d.paper_id
  WHERE r.run = 1 AND r.label IS NOT NULL)"""

COUNTS = """counts AS (
  SELECT category, decade, label, count(*) AS cnt FROM lp GROUP BY category, decade, label),
shares AS (
  SELECT c.*, CAST(sum(cnt) OVER (PARTITION BY category, decade) AS BIGINT) AS total,
         round_even(cnt / sum(cnt) OVER (PARTITION BY category, decade) * 100, 1) AS pct
  FROM counts c)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


LABEL_CTES = (PAPERS, VOCAB, RESPONSES, CHECKED, RESOLVED)
TREND_CTES = LABEL_CTES + (DATED, LP, COUNTS)

TOPIC_LABELS = [f"label {i}" for i in range(7)] + ["invalid result"]


def _pivot_cols(value: str, fill: str, cast: str) -> str:
    return ",\n  ".join(
        f"CAST(coalesce(sum({value}) FILTER (WHERE label = '{lab}'), {fill}) AS {cast}) AS \"{lab}\""
        for lab in TOPIC_LABELS)


SQL: dict[str, str] = {}

SQL["top_label_per_decade"] = _with(*TREND_CTES) + """
SELECT category, decade, label, cnt, total, pct, CAST(rank AS INTEGER) AS rank FROM (
  SELECT s.*, row_number() OVER (PARTITION BY category, decade ORDER BY cnt DESC, label) AS rank
  FROM shares s) WHERE rank <= 1"""

SQL["decade_label_counts"] = _with(*TREND_CTES) + "SELECT * FROM counts"

SQL["decade_label_share"] = _with(*TREND_CTES) + "SELECT * FROM shares"

SQL["decade_share_join"] = _with(*TREND_CTES) + """
SELECT c.category, c.decade, c.label, c.cnt, CAST(t.total AS BIGINT) AS total,
       round_even(c.cnt / t.total * 100, 1) AS pct
FROM counts c JOIN (SELECT category, decade, sum(cnt) AS total FROM counts
                    GROUP BY category, decade) t
  ON c.category = t.category AND c.decade = t.decade"""

SQL["decade_totals"] = _with(*TREND_CTES) + """
SELECT category, decade, CAST(sum(cnt) AS BIGINT) AS total FROM counts GROUP BY category, decade"""

SQL["decade_topic_pivot"] = _with(*TREND_CTES) + f"""
SELECT decade,
  {_pivot_cols('cnt', '0', 'BIGINT')}
FROM counts WHERE category = 'topic' GROUP BY decade"""

SQL["decade_share_pivot"] = _with(*TREND_CTES) + f"""
SELECT category, decade,
  {_pivot_cols('pct', '0.0', 'DOUBLE')}
FROM shares GROUP BY category, decade"""

SQL["label_span"] = _with(*TREND_CTES) + """
SELECT category, label, min(year) AS first_year, max(year) AS last_year,
       max(year) - min(year) AS span_years
FROM lp GROUP BY category, label"""

SQL["papers_per_year"] = _with(PAPERS, DATED) + """
SELECT year, count(*) AS papers_in_year FROM dated2 GROUP BY year"""

SQL["papers_cumulative"] = _with(PAPERS, DATED) + """
SELECT year, papers_in_year,
  CAST(sum(papers_in_year) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
    AS cumulative_papers,
  sum(papers_in_year) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    / sum(papers_in_year) OVER () * 100 AS cumulative_pct
FROM (SELECT year, count(*) AS papers_in_year FROM dated2 GROUP BY year)"""

SQL["pub_year"] = _with(PAPERS) + f"""
SELECT paper_id, date_publication, {YEAR} AS year,
       CAST(floor({YEAR} / 10) * 10 AS INTEGER) AS decade
FROM papers"""

SQL["scan_count"] = _with(PAPERS) + "SELECT count(*) AS n_papers FROM papers"

SQL["screened_papers"] = _with(PAPERS) + """
SELECT paper_id, venue, title, date_publication, screen FROM papers WHERE screen = 'yes'"""

SQL["screened_with_label"] = _with(PAPERS) + """
SELECT paper_id, screen_alt FROM papers WHERE screen = 'yes' AND screen_alt IS NOT NULL"""

SQL["entry_projection"] = _with(PAPERS) + """
SELECT CAST(paper_id AS VARCHAR) AS _id, abstract, title, fulltext FROM papers WHERE screen = 'yes'"""

SQL["screen_outcomes"] = _with(PAPERS) + """
SELECT count(*) FILTER (WHERE screen = 'invalid entry') AS n_invalid,
       count(*) FILTER (WHERE screen = 'yes') AS n_related,
       count(*) FILTER (WHERE screen = 'no') AS n_unrelated
FROM papers"""

SQL["screen_contingency"] = _with(PAPERS) + """
SELECT llm_label, abstract_label, count(*) AS n FROM (
  SELECT coalesce(screen_alt, 'missing') AS llm_label, coalesce(screen, 'missing') AS abstract_label
  FROM papers)
WHERE llm_label IN ('yes', 'no', 'invalid entry', 'missing')
  AND abstract_label IN ('yes', 'no', 'invalid entry', 'missing')
GROUP BY llm_label, abstract_label"""

SQL["answer_validity"] = _with(PAPERS, VOCAB, RESPONSES, CHECKED) + """
SELECT paper_id, category, run, attempt, answer, valid FROM checked"""

SQL["answers_valid_semi"] = _with(PAPERS, VOCAB, RESPONSES, CHECKED) + """
SELECT paper_id, category, run, attempt, response, answer FROM checked WHERE valid"""

SQL["answers_rejected_anti"] = _with(PAPERS, VOCAB, RESPONSES, CHECKED) + """
SELECT paper_id, category, run, attempt, response, answer FROM checked WHERE NOT valid"""

SQL["resolve_answers"] = _with(*LABEL_CTES) + "SELECT * FROM resolved"

SQL["outcome_counts"] = _with(*LABEL_CTES) + """
SELECT category, run, count(*) AS n_tasks,
  count(*) FILTER (WHERE label NOT IN ('invalid result', 'invalid entry')) AS n_valid,
  count(*) FILTER (WHERE label = 'invalid result') AS n_invalid,
  count(*) FILTER (WHERE label = 'invalid entry') AS n_over_budget
FROM resolved GROUP BY category, run"""

SQL["attempts_used"] = _with(*LABEL_CTES) + """
SELECT category, attempts_used, count(*) AS n_tasks FROM resolved GROUP BY category, attempts_used"""

SQL["majority_vote"] = _with(PAPERS, VOCAB, RESPONSES) + f"""
, tally AS (
  SELECT paper_id, category, run, {STRIP} AS answer, count(*) AS n, min(attempt) AS first_seen
  FROM responses WHERE attempt <= 3 GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY paper_id, category, run
                               ORDER BY (answer IS NULL), n DESC, first_seen) AS rk
  FROM tally)
SELECT r.paper_id, r.category, r.run,
  CASE WHEN v.label IS NOT NULL THEN r.answer ELSE 'invalid result' END AS label,
  CASE WHEN r.answer IS NULL THEN 0 ELSE r.n END AS votes
FROM ranked r LEFT JOIN vocab v ON v.category = r.category AND v.label = r.answer
WHERE rk = 1"""

SQL["label_tasks"] = _with(PAPERS) + """
SELECT p.paper_id, k.category, r.run
FROM papers p
CROSS JOIN (VALUES ('topic'), ('ethics'), ('openness')) AS k(category)
CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS r(run)
WHERE p.screen = 'yes'"""

SQL["pending_tasks"] = _with(*LABEL_CTES) + """
SELECT p.paper_id, k.category, r.run
FROM papers p
CROSS JOIN (VALUES ('topic'), ('ethics'), ('openness')) AS k(category)
CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS r(run)
WHERE p.screen = 'yes' AND NOT EXISTS (
  SELECT 1 FROM resolved x WHERE x.paper_id = p.paper_id AND x.category = k.category
    AND x.run = r.run AND x.label <> 'invalid result')"""

TECHNIQUES = """techniques AS (
  SELECT * FROM (VALUES (1, 'vanilla', 'retry'), (2, 'rephrase_and_respond', 'retry'),
    (3, 'emotion', 'retry'), (4, 'chain_of_thought', 'retry'), (5, 'self_consistency', 'vote'),
    (6, 'few_shot', 'retry'), (7, 'combined', 'retry'))
    AS t(run, technique, mode))"""

SEVEN_RUNS = RESPONSES.replace("(4), (5)) AS r(run)", "(4), (5), (6), (7)) AS r(run)")

SQL["technique_invalid"] = _with(PAPERS, VOCAB, SEVEN_RUNS, CHECKED, TECHNIQUES) + f"""
, retry AS (
  SELECT t.technique, c.paper_id, c.category, c.run,
    bool_or(c.valid) AS ok
  FROM checked c JOIN techniques t ON c.run = t.run
  WHERE t.mode = 'retry' AND c.category = 'topic' AND c.attempt <= 5
  GROUP BY ALL),
tally AS (
  SELECT t.technique, r.paper_id, r.category, r.run, {STRIP} AS answer,
         count(*) AS n, min(r.attempt) AS first_seen
  FROM responses r JOIN techniques t ON r.run = t.run
  WHERE t.mode = 'vote' AND r.category = 'topic' AND r.attempt <= 3
  GROUP BY ALL),
vote AS (
  SELECT technique, paper_id, category, run, answer FROM (
    SELECT *, row_number() OVER (PARTITION BY technique, paper_id, category, run
                                 ORDER BY (answer IS NULL), n DESC, first_seen) AS rk
    FROM tally) WHERE rk = 1)
SELECT technique, count(*) AS n_entries, count(*) FILTER (WHERE NOT ok) AS n_invalid FROM (
  SELECT technique, ok FROM retry
  UNION ALL
  SELECT v.technique, EXISTS (SELECT 1 FROM vocab x WHERE x.category = v.category
                              AND x.label = v.answer) AS ok FROM vote v)
GROUP BY technique"""

# ---- agreement ------------------------------------------------------------------

SCORES = """per_label AS (
  SELECT paper_id, category, label, count(*) AS n FROM resolved
  WHERE label IS NOT NULL GROUP BY paper_id, category, label),
scores AS (
  SELECT paper_id, category, CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS consistency,
         CAST(sum(n) AS BIGINT) AS n_labels
  FROM per_label GROUP BY paper_id, category
  HAVING category IN (SELECT category FROM resolved GROUP BY category
                      HAVING count(DISTINCT run) >= 2))"""

AGREE_CTES = LABEL_CTES + (SCORES,)

SQL["consistency_per_paper"] = _with(*AGREE_CTES) + "SELECT * FROM scores"

SQL["consistency_by_category"] = _with(*AGREE_CTES) + """
SELECT category, round(avg(consistency), 6) AS mean_consistency, count(consistency) AS n_papers
FROM scores GROUP BY category"""

SQL["consistency_box"] = _with(*AGREE_CTES) + """
, q AS (
  SELECT category, count(*) AS n, quantile_cont(consistency, 0.25) AS q1,
         quantile_cont(consistency, 0.5) AS median, quantile_cont(consistency, 0.75) AS q3
  FROM scores WHERE consistency IS NOT NULL GROUP BY category)
SELECT q.category, q.n, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3,
  min(s.consistency) FILTER (WHERE s.consistency BETWEEN q.q1 - 1.5 * (q.q3 - q.q1)
                                                     AND q.q3 + 1.5 * (q.q3 - q.q1)) AS whisker_low,
  max(s.consistency) FILTER (WHERE s.consistency BETWEEN q.q1 - 1.5 * (q.q3 - q.q1)
                                                     AND q.q3 + 1.5 * (q.q3 - q.q1)) AS whisker_high,
  CAST(count(*) FILTER (WHERE NOT (s.consistency BETWEEN q.q1 - 1.5 * (q.q3 - q.q1)
                                                     AND q.q3 + 1.5 * (q.q3 - q.q1))) AS BIGINT)
    AS n_outliers
FROM scores s JOIN q ON s.category = q.category
GROUP BY q.category, q.n, q.q1, q.median, q.q3"""

SQL["consistency_matrix"] = _with(*AGREE_CTES) + """
SELECT paper_id,
  max(consistency) FILTER (WHERE category = 'topic') AS topic,
  max(consistency) FILTER (WHERE category = 'ethics') AS ethics,
  max(consistency) FILTER (WHERE category = 'openness') AS openness
FROM scores GROUP BY paper_id"""

SQL["assigned_labels"] = _with(*LABEL_CTES) + """
SELECT paper_id, category, string_agg(label, ', ' ORDER BY run) AS labels, count(*) AS n_runs
FROM resolved WHERE label IS NOT NULL GROUP BY paper_id, category"""

SQL["categories_present"] = _with(*LABEL_CTES) + "SELECT DISTINCT category FROM resolved"

SQL["labels_long"] = _with(*LABEL_CTES) + """
SELECT paper_id, category, run, label FROM resolved WHERE label IS NOT NULL"""

SQL["category_short_name"] = _with(*LABEL_CTES) + """
SELECT DISTINCT concat('como-tax-', category, '2',
                       CASE WHEN run > 1 THEN concat('-', CAST(run AS VARCHAR)) ELSE '' END) AS key,
       category, run
FROM resolved"""

# ---- sampling, write-back ---------------------------------------------------------

SAMPLE_KEY = "md5(concat('42:', CAST(paper_id AS VARCHAR)))"

SQL["sample_papers"] = _with(PAPERS) + f"""
SELECT CAST(row_number() OVER (ORDER BY {SAMPLE_KEY}, paper_id) AS INTEGER) AS pos, paper_id,
       coalesce(date_publication, 'no date') AS date_publication
FROM papers WHERE screen_alt = 'yes'
ORDER BY {SAMPLE_KEY}, paper_id LIMIT 10"""

SQL["label_upsert"] = _with(PAPERS) + """
SELECT paper_id, coalesce(screen_alt, screen) AS screen,
       CASE WHEN screen_alt IS NOT NULL THEN lang END AS note
FROM papers"""

# ---- keyword taxonomy -------------------------------------------------------------

STEMS = """stems AS (
  SELECT * FROM (VALUES ('A', 'th'), ('A', 'an'), ('A', 'he'), ('B', 'on'), ('B', 'er'),
    ('B', 're'), ('C', 'de'), ('C', 'le'), ('C', 'ou'), ('D', 'or'), ('D', 'the'), ('D', 'in'))
    AS s(topic, stem)),
tok AS (
  SELECT paper_id, unnest(regexp_split_to_array(lower(fulltext), '[^a-z]+')) AS token FROM papers),
hits AS (
  SELECT t.paper_id, s.topic, s.stem, count(*) AS hits
  FROM tok t JOIN stems s ON starts_with(t.token, s.stem)
  WHERE t.token <> '' GROUP BY t.paper_id, s.topic, s.stem)"""

SQL["taxonomy_hits"] = _with(PAPERS, STEMS) + "SELECT * FROM hits"

SQL["taxonomy_best_topic"] = _with(PAPERS, STEMS) + """
, per_topic AS (
  SELECT paper_id, topic, CAST(sum(hits) AS BIGINT) AS hits, count(*) AS stems
  FROM hits GROUP BY paper_id, topic),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY hits DESC, stems DESC, topic) AS rk
  FROM per_topic)
SELECT p.paper_id, coalesce(r.topic, 'Other') AS topic, coalesce(r.hits, 0) AS hits,
       coalesce(r.stems, 0) AS stems
FROM papers p LEFT JOIN ranked r ON r.paper_id = p.paper_id AND r.rk = 1"""


# ---- prompts and answering ----------------------------------------------------------

# the prompt around the paper and the labels
PROMPT_START = "Classify the research paper below into exactly one of the allowed labels.\nPaper (JSON):\n"
PROMPT_MIDDLE = "\nAllowed labels (JSON keys):\n"
PROMPT_END = "\nAnswer with the label only.\n"


def _json_len(col: str) -> str:
    short = f"""length(regexp_replace({col}, '[^"\\\\\\n\\r\\t\\x08\\x0c]', '', 'g'))"""
    ctrl = f"""length(regexp_replace({col}, '[^\\x00-\\x07\\x0b\\x0e-\\x1f]', '', 'g'))"""
    return f"(CASE WHEN {col} IS NULL THEN 4 ELSE length({col}) + 2 + {short} + 5 * {ctrl} END)"


def _prompt_len_sql(fields=("_id", "abstract", "title", "fulltext")) -> str:
    fixed_template = len(PROMPT_START + PROMPT_MIDDLE + PROMPT_END)
    fixed_entry = 4 + sum(len(f'  "{f}": ') for f in fields) + 2 * (len(fields) - 1)
    cols = ["CAST(p.paper_id AS VARCHAR)" if f == "_id" else f"p.{f}" for f in fields]
    return f"{fixed_template} + {fixed_entry} + " + " + ".join(_json_len(c) for c in cols) + " + vj.cl"


PROMPT_LEN = f"""vj AS (
  SELECT category, 4 + sum(length(label) + 8) + 2 * (count(*) - 1) AS cl FROM vocab GROUP BY category),
plen AS (
  SELECT p.paper_id, vj.category, {_prompt_len_sql()} AS plen
  FROM papers p CROSS JOIN vj WHERE p.screen = 'yes')"""

TOPIC_JSON = "{\n" + ",\n".join(f'  "label {k}": [\n    "stem{k}*",\n    "word{k}*"\n  ]' for k in range(7)) + "\n}"
ETHICS_JSON = """{
  "silent": {
    "label 0": {}
  },
  "spoken": {
    "label 1": {},
    "label 2": {}
  }
}"""
OPENNESS_JSON = """{
  "label 0": {},
  "label 1": {},
  "label 2": {},
  "label 3": {}
}"""


def _text(value: str) -> str:
    return "concat(" + ", chr(10), ".join(f"'{part}'" for part in value.split("\n")) + ")"


# category, technique, text before the paper, between paper and labels, after the labels
PROMPTS = "prompts AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{t}', {_text(a)}, {_text(b)}, {_text(z)}, {_text(j)})" for c, t, a, b, z, j in [
        ("topic", "plain", "Name the topic of this paper.\n", "\nTopics and their stems:\n", "\n", TOPIC_JSON),
        ("topic", "steps", "Think step by step. Paper: ", "\nWhich one of ", " fits? Label only.", TOPIC_JSON),
        ("ethics", "plain", "Does this paper treat ethics?\n", "\nOne of:\n", "", ETHICS_JSON),
        ("ethics", "steps", "Quote what the paper says on ethics, then decide.\n", "\n", "\n", ETHICS_JSON),
        ("openness", "plain", "Paper:\n", "\nWhat does it publish? ", "", OPENNESS_JSON),
        ("openness", "steps", "List what the paper publishes.\n", "\nThen choose from ", ".", OPENNESS_JSON),
    ]) + ") AS x(category, technique, a, b, z, labels))"

SQL["prompt_budget"] = _with(PAPERS, PROMPTS) + f"""
SELECT paper_id, category, technique, CAST(n // 4 AS BIGINT) AS prompt_tokens, n // 4 > 2000 AS over_budget
FROM (SELECT p.paper_id, x.category, x.technique, length(x.a) + length(x.b) + length(x.z) + length(x.labels) + 
        {_prompt_len_sql().replace(" + vj.cl", "")} - {len(PROMPT_START + PROMPT_MIDDLE + PROMPT_END)} AS n
      FROM papers p CROSS JOIN prompts x WHERE p.screen = 'yes')"""

SQL["label_batch_stub"] = _with(PAPERS, VOCAB, PROMPT_LEN) + f"""
, att AS (
  SELECT x.paper_id, x.category, a.attempt,
    CASE WHEN (x.paper_id + a.attempt) % 5 = 0 THEN NULL ELSE (x.plen + 3 * a.attempt) % 8 END AS k
  FROM plen x CROSS JOIN (VALUES (1), (2), (3)) AS a(attempt)),
ok AS (
  SELECT att.*, k IS NOT NULL AND k < c.n AS valid FROM att JOIN {CATS.replace('AS k(', 'AS c(')}
    ON att.category = c.category)
SELECT paper_id, category, 1 AS run,
  coalesce(arg_min(concat('label ', CAST(k AS VARCHAR)), attempt) FILTER (WHERE valid), 'invalid result')
    AS label,
  CAST(min(attempt) FILTER (WHERE valid) AS INTEGER) AS attempts_used
FROM ok GROUP BY paper_id, category"""

SQL["stream_resolve"] = SQL["resolve_answers"]

# ---- the same operators over the other given tables ------------------------------

SQL["label_source_contingency"] = """
SELECT quality, toxic, count(*) AS n FROM (
  SELECT coalesce(CAST(quality AS VARCHAR), 'missing') AS quality,
         coalesce(CAST(toxic AS VARCHAR), 'missing') AS toxic FROM labels)
WHERE quality IN ('0', '1', 'missing') AND toxic IN ('0', '1', 'missing')
GROUP BY quality, toxic"""

SQL["orders_cumulative"] = """
SELECT year, orders_in_year,
  CAST(sum(orders_in_year) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
    AS cumulative_orders,
  sum(orders_in_year) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    / sum(orders_in_year) OVER () * 100 AS cumulative_pct
FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders_in_year
      FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)"""

SQL["orders_priority_span"] = """
SELECT 'o_orderpriority' AS category, o_orderpriority AS label,
  CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year,
  CAST(max(year(o_orderdate)) - min(year(o_orderdate)) AS INTEGER) AS span_years
FROM orders WHERE o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL
GROUP BY o_orderpriority"""

SQL["orders_priority_share_by_year"] = """
SELECT category, year, label, cnt, CAST(sum(cnt) OVER (PARTITION BY category, year) AS BIGINT) AS total,
  round_even(cnt / sum(cnt) OVER (PARTITION BY category, year) * 100, 1) AS pct
FROM (SELECT 'o_orderpriority' AS category, CAST(year(o_orderdate) AS INTEGER) AS year,
             o_orderpriority AS label, count(*) AS cnt
      FROM orders WHERE o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2, 3)"""

SQL["events_top_type_per_day"] = """
SELECT category, day, label, cnt, total, pct, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY category, day ORDER BY cnt DESC, label) AS rank FROM (
    SELECT category, day, label, cnt, CAST(sum(cnt) OVER (PARTITION BY category, day) AS BIGINT) AS total,
      round_even(cnt / sum(cnt) OVER (PARTITION BY category, day) * 100, 1) AS pct
    FROM (SELECT 'event_type' AS category, CAST(ts AS DATE) AS day, event_type AS label, count(*) AS cnt
          FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2, 3)))
WHERE rank <= 1"""

SQL["conversation_roles"] = """
SELECT conv_id, 'role' AS category, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position,
       role AS label
FROM conversations WHERE role IS NOT NULL"""

SQL["label_collection_stub"] = SQL["label_batch_stub"]

SQL["screening_resume_stub"] = _with(PAPERS) + f"""
, plen AS (
  SELECT p.paper_id, {_prompt_len_sql(("_id", "abstract")).replace("vj.cl", "27")} AS plen
  FROM papers p WHERE p.screen_alt IS NULL),
att AS (
  SELECT x.paper_id, a.attempt,
    CASE WHEN (x.paper_id + a.attempt) % 7 = 0 THEN NULL
         ELSE (x.plen + 5 * a.attempt) % 3 END AS k
  FROM plen x CROSS JOIN (VALUES (1), (2)) AS a(attempt)),
res AS (
  SELECT paper_id,
    coalesce(arg_min(CASE k WHEN 0 THEN 'yes' ELSE 'no' END, attempt) FILTER (WHERE k IN (0, 1)),
             'invalid entry') AS label
  FROM att GROUP BY paper_id)
SELECT p.paper_id, coalesce(r.label, p.screen_alt) AS screen_alt
FROM papers p LEFT JOIN res r ON r.paper_id = p.paper_id"""


def _json_text(col: str) -> str:
    """JSON string literal of ``col`` (quotes included; NULL -> null): backslash
    and quote escaped first, then each control character (short escapes for
    \\b \\f \\n \\r \\t, upper-case \\u00XX for the others)."""
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    e = f"replace(replace({col}, '\\', '\\\\'), '\"', '\\\"')"
    for c in range(32):
        esc = short.get(c, "\\u%04X" % c)
        e = f"replace({e}, chr({c}), '{esc}')"
    return f"(CASE WHEN {col} IS NULL THEN 'null' ELSE concat('\"', {e}, '\"') END)"


def _entry_sql() -> str:
    fields = ["_id", "abstract", "title", "fulltext"]
    parts = ["'{' || chr(10)"]
    for i, f in enumerate(fields):
        col = "CAST(p.paper_id AS VARCHAR)" if f == "_id" else f"p.{f}"
        sep = "',' || chr(10)" if i < len(fields) - 1 else "chr(10)"
        parts += [f"'  \"{f}\": '", _json_text(col), sep]
    parts.append("'}'")
    return " || ".join(parts)


SQL["prompt_build"] = _with(PAPERS, PROMPTS) + f"""
SELECT p.paper_id, x.category, x.technique, x.a || {_entry_sql()} || x.b || x.labels || x.z AS prompt
FROM papers p CROSS JOIN prompts x WHERE p.screen = 'yes'"""

# ---- queries over edge cases of the operators above ------------------------------

SQL["label_collection_string_ids"] = SQL["label_batch_stub"].replace(
    "(x.plen + 3 *", "(x.plen + 1 + 3 *").replace(
    "SELECT paper_id, category, 1 AS run,", "SELECT concat('p', CAST(paper_id AS VARCHAR)) AS paper_id, category, 1 AS run,")

SQL["consistency_uneven_runs"] = _with(*AGREE_CTES) + """
SELECT category, round(avg(consistency), 6) AS mean_consistency, count(consistency) AS n_papers
FROM scores WHERE category NOT IN ('ethics', 'openness') GROUP BY category"""

SQL["conversation_first_word"] = r"""
WITH answers AS (
  SELECT conv_id, turn + 1 AS attempt,
         regexp_replace(lower(split_part(text, ' ', 1)), '^\s+|\s+$', '', 'g') AS answer
  FROM conversations WHERE turn < 5)
SELECT conv_id AS paper_id, 'opening' AS category, 1 AS run,
  coalesce(arg_min(answer, attempt) FILTER (WHERE valid), 'invalid result') AS label,
  CAST(min(attempt) FILTER (WHERE valid) AS INTEGER) AS attempts_used
FROM (SELECT *, answer IN ('the', 'of', 'is', 'was', 'and', 'an', 'de', 'la', 'le', 'der', 'die', 'das', 'los', 'as')
      AS valid FROM answers)
GROUP BY conv_id"""

SQL["stream_resolve_compacted"] = SQL["resolve_answers"]

SQL["technique_votes_stub"] = _with(PAPERS, VOCAB, PROMPT_LEN, TECHNIQUES) + """
, att AS (
  SELECT x.paper_id, t.technique, t.mode, a.attempt,
    CASE WHEN (x.paper_id + a.attempt) % 5 = 0 THEN NULL
         ELSE (x.plen + length(t.technique) + 3 + 3 * a.attempt) % 8 END AS k
  FROM plen x CROSS JOIN techniques t CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS a(attempt)
  WHERE x.category = 'topic' AND (t.mode = 'retry' OR a.attempt <= 3)),
retried AS (
  SELECT paper_id, technique, coalesce(bool_or(k < 7), false) AS ok FROM att WHERE mode = 'retry' GROUP BY ALL),
voted AS (
  SELECT paper_id, technique, coalesce(k < 7, false) AS ok FROM (
    SELECT paper_id, technique, k, row_number() OVER (PARTITION BY paper_id, technique
      ORDER BY (k IS NULL), count(*) DESC, min(attempt)) AS rk
    FROM att WHERE mode = 'vote' GROUP BY paper_id, technique, k) WHERE rk = 1)
SELECT technique, count(*) AS n_entries, count(*) FILTER (WHERE NOT ok) AS n_invalid
FROM (SELECT * FROM retried UNION ALL SELECT * FROM voted) GROUP BY technique"""

SQL["label_collection_settings"] = SQL["label_batch_stub"] + "\nUNION ALL\n" + (
    "SELECT paper_id, 'screen' AS category, 1 AS run, coalesce(arg_min(CASE k WHEN 0 THEN 'yes' ELSE 'no' END, attempt)"
    " FILTER (WHERE k IN (0, 1)), 'invalid entry') AS label,"
    " CAST(min(attempt) FILTER (WHERE k IN (0, 1)) AS INTEGER) AS attempts_used FROM (\n"
    "  SELECT p.paper_id, a.attempt, CASE WHEN (p.paper_id + a.attempt) % 7 = 0 THEN NULL ELSE ("
    + _prompt_len_sql(("_id", "abstract")).replace("vj.cl", "27") + " + 5 * a.attempt) % 3 END AS k\n"
    "  FROM papers p CROSS JOIN (VALUES (1), (2)) AS a(attempt) WHERE p.screen = 'yes') GROUP BY paper_id")

SQL["label_collection_memo"] = SQL["label_batch_stub"].replace(_prompt_len_sql(), _prompt_len_sql(("abstract",))).replace(
    "CASE WHEN (x.paper_id + a.attempt) % 5 = 0 THEN NULL ELSE (x.plen + 3 * a.attempt) % 8 END", "(x.plen + 3 * a.attempt) % 8")

CLOSED_VOTES = f"""log AS (
  SELECT r.*, {STRIP} AS answer, EXISTS (SELECT 1 FROM vocab v WHERE v.category = r.category AND v.label = {STRIP}) AS valid
  FROM responses r
  WHERE run <= 2 AND attempt <= CASE category WHEN 'ethics' THEN 2 ELSE 3 END
    AND NOT (attempt = 3 AND paper_id % 14 = 4)),
retried AS (
  SELECT paper_id, category, run, coalesce(arg_min(answer, attempt) FILTER (WHERE valid), 'invalid result') AS label,
    CAST(coalesce(max(1) FILTER (WHERE valid), 0) AS BIGINT) AS votes,
    CAST(min(attempt) FILTER (WHERE valid) AS INTEGER) AS attempts_used,
    bool_or(valid) OR count(*) = 3 AS complete, count(*) AS arrived
  FROM log WHERE category = 'openness' GROUP BY ALL),
tally AS (
  SELECT paper_id, category, run, answer, valid, count(*) AS n, min(attempt) AS first_seen
  FROM log WHERE category <> 'openness' GROUP BY ALL),
voted AS (
  SELECT paper_id, category, run, CASE WHEN valid THEN answer ELSE 'invalid result' END AS label,
    CASE WHEN answer IS NULL THEN 0 ELSE n END AS votes, CAST(NULL AS INTEGER) AS attempts_used,
    arrived = CASE category WHEN 'ethics' THEN 2 ELSE 3 END AS complete, arrived
  FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY paper_id, category, run) AS BIGINT) AS arrived,
          row_number() OVER (PARTITION BY paper_id, category, run
                             ORDER BY (answer IS NULL), n DESC, first_seen) AS rk FROM tally) WHERE rk = 1),
closed AS (SELECT * FROM retried UNION ALL SELECT * FROM voted)"""

SQL["stream_votes"] = _with(PAPERS, VOCAB, RESPONSES, CLOSED_VOTES) + """
SELECT paper_id, category, run, label, votes, attempts_used, complete FROM closed"""

SQL["stream_counters"] = _with(PAPERS, VOCAB, RESPONSES, CLOSED_VOTES) + """
SELECT category, run, count(*) AS n_tasks, count(*) FILTER (WHERE label <> 'invalid result') AS n_valid,
  count(*) FILTER (WHERE label = 'invalid result') AS n_invalid, count(*) FILTER (WHERE NOT complete) AS n_timed_out,
  CAST(sum(attempts_used) AS BIGINT) AS attempts
FROM closed GROUP BY category, run"""
