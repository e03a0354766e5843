import json
import os

from litlens.functions.prompts import vocabulary_json
from litlens.sources.categories import category_json, load_categories, task_settings, task_vocabulary

TREE = {
    "Modelling Approach": {"By Hand": {"Slide Rule": {}, "Other": {}},
                           "By Machine": {"Clockwork": {}, "Other": {}}},
    "Type of Evaluation": {"Guess": {}, "Walk": {}, "Weigh": {}},
    "Openness": {"Window": {}, "Shutter": {}},
    "Taxonomy": {"Gardens": ["plant*", "seed*"], "Kitchens": ["cook*", "plant*"],
                 "Other": {}},
}


def _tree(spark, tmp_dir):
    path = os.path.join(tmp_dir, "tree.json")
    with open(path, "w") as f:
        json.dump(TREE, f, indent=2)
    return path


def test_load_categories_keeps_empty_leaves_and_order(spark, tmp_dir):
    label_dim, stem_dim = load_categories(spark, _tree(spark, tmp_dir))
    rows = [(r.category, r.grp, r.label, r.ord) for r in label_dim.orderBy("category", "ord").collect()]
    assert ("Modelling Approach", "By Hand", "Slide Rule", 1) in rows
    assert ("Modelling Approach", "By Machine", "Other", 4) in rows
    assert [r[2] for r in rows if r[0] == "Taxonomy"] == ["Gardens", "Kitchens", "Other"]
    assert [r[2] for r in rows if r[0] == "Type of Evaluation"] == ["Guess", "Walk", "Weigh"]
    stems = sorted((r.topic, r.stem) for r in stem_dim.collect())
    assert stems == [("Gardens", "plant*"), ("Gardens", "seed*"), ("Kitchens", "cook*"), ("Kitchens", "plant*")]
    voc = task_vocabulary(spark, label_dim)
    ordered = lambda task: [r.label for r in voc.filter(f"category = '{task}'").orderBy("ord").collect()]
    assert ordered("modelling_approach") == ["Slide Rule", "Other", "Clockwork"]  # Other once, in file order
    assert ordered("topic") == ["Gardens", "Kitchens", "Other"]
    assert ordered("screen") == ["yes", "no"] and len(ordered("ethics")) == 3     # lists of the task itself
    shown = {r.category: r.categories_json for r in vocabulary_json(label_dim).collect()}
    assert list(json.loads(shown["Modelling Approach"])) == ["Slide Rule", "Other", "Clockwork"]


def test_category_json_keeps_the_tree(spark, tmp_dir):
    got = {r.category: r.categories_json for r in category_json(spark, _tree(spark, tmp_dir)).collect()}
    assert got["topic"] == json.dumps(TREE["Taxonomy"], indent=2)
    assert got["modelling_approach"] == json.dumps(TREE["Modelling Approach"], indent=2)
    assert json.loads(got["screen"]) == {"yes": {}, "no": {}}


def test_task_settings(spark):
    got = {r.category: r for r in task_settings(spark).collect()}
    assert (got["screen"].attempts, got["screen"].sentinel, got["screen"].fields) == (2, "invalid entry", ["_id", "abstract"])
    assert (got["topic"].attempts, got["topic"].sentinel, got["topic"].token_limit) == (3, "invalid result", 131_000)
    assert len(got) == 11
