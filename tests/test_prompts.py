import json

from litlens.functions import prompts as P
from litlens.operators import agree as A
from litlens.operators import trends as T
from litlens.sources.papers import write_year_table

TEMPLATE = "Entry:\n{entry}\nLabels:\n{categories}\nAnswer ✓\n"
VOCAB = [("topic", "Machine Learning", 2), ("topic", "HCI \"x\"", 1), ("ethics", "Ignored", 1)]


def _tasks(spark):
    rows = [(7, "topic", 1, "An abstract ü", "T", "full\ntext\t\"q\"\x01"),
            (8, "ethics", 1, None, "Title 😀", "")]
    return spark.createDataFrame(rows, "paper_id long, category string, run int, abstract string, "
                                       "title string, fulltext string")


def _python_prompt(pid, abstract, title, fulltext, labels):
    entry = {"_id": str(pid), "abstract": abstract, "title": title, "fulltext": fulltext}
    cats = {lab: {} for lab in labels}
    return TEMPLATE.format(entry=json.dumps(entry, indent=2, ensure_ascii=False),
                           categories=json.dumps(cats, indent=2, ensure_ascii=False))


def test_prompt_text_and_budget_match_python(spark):
    vocab = spark.createDataFrame(VOCAB, "category string, label string, ord int")
    vj = P.vocabulary_json(vocab)
    got = {r.paper_id: r.prompt for r in P.with_prompt(_tasks(spark), vj, TEMPLATE).collect()}
    exp7 = _python_prompt(7, "An abstract ü", "T", "full\ntext\t\"q\"\x01", ["HCI \"x\"", "Machine Learning"])
    exp8 = _python_prompt(8, None, "Title 😀", "", ["Ignored"])
    assert got[7].lower() == exp7.lower()  # \u0001 hex case may differ; length equal
    assert got[8] == exp8
    b = {r.paper_id: r.prompt_tokens for r in P.with_budget(_tasks(spark), vj, TEMPLATE).collect()}
    assert b == {7: len(exp7) // 4, 8: len(exp8) // 4}


def test_budget_boundary(spark):
    vocab = spark.createDataFrame([("topic", "A", 1)], "category string, label string, ord int")
    vj = P.vocabulary_json(vocab)
    base = P.with_budget(spark.createDataFrame(
        [(1, "topic", 1, "", "", "")], "paper_id long, category string, run int, abstract string, "
                                        "title string, fulltext string"), vj).collect()[0]
    fixed = base.prompt_tokens * 4  # characters besides the full text (rounded down)
    rows = []
    for pid, tokens in [(1, 131_000), (2, 131_001)]:
        # choose a full-text length that gives exactly `tokens` approximate tokens
        probe = P.with_budget(spark.createDataFrame(
            [(pid, "topic", 1, "", "", "x" * (tokens * 4 - fixed))],
            "paper_id long, category string, run int, abstract string, title string, fulltext string"),
            vj).collect()[0]
        rows.append((probe.prompt_tokens, probe.over_budget))
    assert rows == [(131_000, False), (131_001, True)]
    lab = spark.createDataFrame([(True,), (False,)], "over_budget boolean").select(P.budget_label())
    assert [r[0] for r in lab.collect()] == ["invalid entry", None]


def test_presence_and_exclusion(spark):
    wide = spark.createDataFrame([(1, "A", None)], "paper_id long, `como-tax-topic2` string, "
                                                   "`como-tax-topic2-2` string")
    assert A.present(wide, ["como-tax-topic2", "como-tax-ethics2"]) == ["como-tax-topic2"]
    scores = spark.createDataFrame([(1, "topic", 1.0), (1, "como-tax", 0.5)],
                                   "paper_id long, category string, consistency double")
    got = [r.category for r in A.consistency_by_category(scores, exclude=["como-tax"]).collect()]
    assert got == ["topic"]


def test_year_table_sink(spark, tmp_dir):
    y = spark.createDataFrame([(2001, 3), (1999, 1)], "year int, papers_in_year long")
    write_year_table(T.year_table(T.cumulative(y)), tmp_dir + "/years")
    back = spark.read.option("header", True).csv(tmp_dir + "/years").collect()
    assert [(r["Year"], r["Cumulative Papers"], float(r["Cumulative Percentage"])) for r in back] == [
        ("1999", "1", 25.0), ("2001", "4", 100.0)]


def test_task_vocabulary_covers_all_tasks(spark):
    from litlens.sources.categories import TASKS
    names = [t[0] for t in TASKS]
    assert len(names) == 11 and "screen" in names and "openness" in names
