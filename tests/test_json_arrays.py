import json
import os
import random

import pytest

from litlens.sources.json_arrays import array_objects, pieces
from litlens.sources.papers import load_papers_json

SCHEMA = ("_id string, title string, tags array<struct<k: string, v: array<int>>>, "
          "more struct<inner: struct<text: string>>")
BITS = ["}", "{", "[", "]", '"', "\\", "\\}", '}"', ",", "a", " ", "\n", "é", "中", "😀", "\t", '\\"', "}{"]


def _text(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, 30)))


def _paper(rng, i):
    p = {"_id": f"{i}", "title": _text(rng)}
    if rng.random() < 0.5:
        p["tags"] = [{"k": _text(rng), "v": [rng.randint(0, 9) for _ in range(rng.randint(0, 3))]}
                     for _ in range(rng.randint(0, 3))]
    if rng.random() < 0.5:
        p["more"] = {"inner": {"text": _text(rng)} if rng.random() < 0.7 else None}
    return p


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_split_arrays_equal_multiline(spark, tmp_dir, small_ranges):
    rng = random.Random(11)
    for f, style in enumerate([{}, {"indent": 2}, {"ensure_ascii": False}, {"separators": (",", ":")}]):
        with open(os.path.join(tmp_dir, f"{f}.json"), "w", encoding="utf-8") as out:
            json.dump([_paper(rng, f"{f}-{i}") for i in range(40)], out, **style)
    with open(os.path.join(tmp_dir, "empty.json"), "w") as out:
        out.write("[]")
    split = load_papers_json(spark, tmp_dir, SCHEMA, split=True)
    whole = load_papers_json(spark, tmp_dir, SCHEMA)
    key = lambda r: r.paper_id
    assert sorted(split.collect(), key=key) == sorted(whole.collect(), key=key)
    # one file is read by many tasks
    ranges = pieces(spark, os.path.join(tmp_dir, "1.json")).select("start").distinct().count()
    assert ranges > 10


def test_objects_are_numbered_in_file_order(spark, tmp_dir, small_ranges):
    path = os.path.join(tmp_dir, "a.json")
    with open(path, "w") as out:
        json.dump([{"_id": i, "t": "x}" * (i % 7)} for i in range(100)], out)
    rows = sorted((r.object, json.loads(r.text)["_id"]) for r in array_objects(spark, path).collect())
    assert rows == [(i, i) for i in range(100)]


def test_other_elements_are_left_out(spark, tmp_dir, small_ranges):
    with open(os.path.join(tmp_dir, "a.json"), "w") as out:
        out.write(' [ \n {"_id": "s"} , null, 5, "x}{", "\\"}", {"_id": "t"}\n, 1 ]\n')
    rows = load_papers_json(spark, tmp_dir, SCHEMA, split=True).collect()
    assert sorted(r.paper_id for r in rows) == ["s", "t"]
