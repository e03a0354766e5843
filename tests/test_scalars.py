import json

import pandas as pd
from pyspark.sql import functions as F

from litlens.functions import scalars as S

DATES = ["05-03-1999", "5-3-1999", "05/03/1999", "31-02-2001", "29-02-1900", "29-02-2000",
         "01-02-03", "01-02-20033", " 05-03-1999", "05-03-1999 ", "", None, "n.d.", "12-12-2024"]


def test_pub_year_matches_pandas(spark):
    df = spark.createDataFrame([(d,) for d in DATES], "d string")
    got = [r[0] for r in df.select(S.pub_year("d")).collect()]
    exp = pd.to_datetime(pd.Series(DATES, dtype="object"), format="%d-%m-%Y", errors="coerce").dt.year
    exp = [None if pd.isna(x) else int(x) for x in exp]
    assert got == exp


def test_decade(spark):
    df = spark.createDataFrame([(1999,), (2000,), (2009,), (None,)], "y int")
    assert [r[0] for r in df.select(S.decade("y")).collect()] == [1990, 2000, 2000, None]


STRINGS = ["label 1", " label 1\n", "\tlabel 1\t", " label 1 ", "　x ",
           "\x1clabel\x1f", "Label 1", "", "   ", "a b", "​x", "﻿x"]


def test_strip_matches_python(spark):
    df = spark.createDataFrame([(s,) for s in STRINGS] + [(None,)], "s string")
    got = [r[0] for r in df.select(S.py_strip("s")).collect()]
    assert got == [s.strip() for s in STRINGS] + [None]


TEXTS = ['plain', 'quote " and \\ backslash', 'new\nline\ttab\r\x08\x0c', 'ctrl \x01\x1f\x7f',
         'non-ascii é ß 漢字 😀', '', None, 'slash / and  ']


def test_json_string_and_length(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select(S.json_string("t").alias("j"), S.json_text_length("t").alias("n")).collect()
    for t, r in zip(TEXTS, rows):
        exp = json.dumps(t, ensure_ascii=False)
        assert r["j"].lower() == exp.lower()  # control escapes: hex case may differ
        assert r["n"] == len(exp)


def test_entry_json_layout(spark):
    df = spark.createDataFrame([("7", None, "T \"x\"")], "_id string, abstract string, title string")
    txt = df.select(S.entry_json([(c, F.col(c)) for c in df.columns])).collect()[0][0]
    exp = json.dumps({"_id": "7", "abstract": None, "title": 'T "x"'}, indent=2, ensure_ascii=False)
    assert txt == exp


def test_approx_tokens(spark):
    df = spark.createDataFrame([("a" * 7,), ("😀" * 8,), ("",)], "t string")
    assert [r[0] for r in df.select(S.approx_tokens("t")).collect()] == [1, 2, 0]


def test_wide_keys_round_trip(spark):
    keys = ["como-tax-topic2", "como-tax-topic2-2", "como-tax-type_of_evaluation2-5",
            "como-tax-openess2-12"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [(r[0], r[1]) for r in df.select(S.key_category("k"), S.key_run("k")).collect()]
    assert got == [("topic", 1), ("topic", 2), ("type_of_evaluation", 5), ("openness", 12)]
    back = df.select(S.wide_key(S.key_category("k"), S.key_run("k"))).collect()
    assert [r[0] for r in back] == [*keys[:3], "como-tax-openness2-12"]  # written under the vocabulary's name
