import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from litlens.llm import langid as X
from litlens.llm.catalog import op11_language_id

SF_MID = "/root/testdata/sf0.01"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"aa": "kala mato sipu nelo", "bb": "brzt krvn shtl prst", "cc": "你好 世界 语言 模型", "dd": "ñandú çeda éxito über"}


def made(lang, rng, n=30):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def plain_slots(text):
    """Slots of all n-grams of a text, one by one."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = []
    for w in words:
        w = f" {w} "
        for n in range(1, X.LONGEST + 1):
            for i in range(len(w) - n + 1):
                if w[i:i + n].strip():
                    h = 0
                    for c in w[i:i + n]:
                        h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
                    out.append((((h ^ h >> 15) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - X.SLOT_BITS))
    return sorted(out)


def test_grams_of_each_text():
    texts = ["Hello, wörld! a", "", "  12 ", "x", "ÀÉ 你好吗 z9z", "İstanbul\tabcdefgh"]
    slots, first, letters = X.grams(texts)
    assert letters.tolist() == [sum(c.isalpha() for c in t.lower()) for t in texts]
    for k, t in enumerate(texts):
        if letters[k]:
            stop = first[k + 1] if k + 1 < len(texts) else len(slots[0])
            got = sorted(int(s) for a in slots for s in a[first[k]:stop] if s != X.SLOTS)
            assert got == plain_slots(t)


def test_long_texts_are_cut_where_no_gram_is_lost(monkeypatch):
    rng = random.Random(1)
    text = " ".join(made(lang, rng, 40) for lang in WORDS)
    whole = plain_slots(text)
    monkeypatch.setattr(X, "WINDOW", 50)
    parts = list(X.windows(text))
    assert "".join(parts) == text and len(parts) > 10
    assert sorted(s for p in parts for s in plain_slots(p)) == whole
    assert ["".join(X.windows("x" * 120))] == ["x" * 120]


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 7, 40, 150):
        code = X.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) == {-1, 1}
        assert (np.abs(code.sum(0)) < n).all()
        near = min((code[i] != code[k]).sum() for i in range(n) for k in range(i))
        assert near >= (code.shape[1] + 1) // 2 if n <= X.EXHAUSTIVE else near >= code.shape[1] // 5


def test_wrong_bits_are_corrected_and_flagged():
    code = X.codewords(4)
    model = X.LanguageModel(("a", "b", "c", "d"), code, np.zeros((1, 7)), np.ones(code.shape), np.ones(7))
    z = np.repeat(code.astype(float) * 5, 8, axis=0)
    for i in range(len(z)):
        if i % 8 < 7:
            z[i, i % 8] *= -1  # one wrong bit of seven: distance 4
    best, score, unsure = X.decode(z, model)
    assert best.tolist() == [i // 8 for i in range(len(z))] and not unsure.any() and (score > 0.5).all()
    between = (code[0] + code[1]).astype(float)[None] * 5 + code[0] * 0.01
    best, score, unsure = X.decode(between, model)
    assert best[0] == 0 and score[0] < 0.6 and X.decode(np.zeros((1, 7)), model)[2][0]


def test_rows(spark):
    rng = random.Random(3)
    rows = [(i, made(lang, rng), lang, lang, 1) for i, lang in enumerate(list(WORDS) * 15)]
    odd = [(1001, None, "aa", None, None), (1002, "", "aa", "s", 0), (1003, "12 34 !?", "aa", "s", 0),
           (1004, made("bb", rng), None, "s", 0), (1004, made("bb", rng), None, "s", 0),
           (None, made("cc", rng), "aa", "s", 0), (1005, made("dd", rng, 60_000), "zz", "s", 0), (1006, "kala", None, "s", 0)]
    docs = spark.createDataFrame(rows + odd, DOCS).selectExpr("*", "1 as id", "2 as letters", "3 as margins", "true as held_out")
    keep = F.col("doc_id") % 5 != 1
    got = X.identify_languages(docs, keep & (F.col("doc_id") < 1000)).collect()
    assert len(got) == len(rows + odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang and by[i].score > 0.9 for i, _, lang, *_ in rows)
    assert [by[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3 and by[1001].score == 0
    assert (by[1004].lang_pred, by[None].lang_pred, by[1005].lang_pred, by[1006].lang_pred) == ("bb", "cc", "dd", "aa")
    assert by[None].held_out and not by[0].held_out and by[1].held_out
    # copies of a language's rows, and a language's share, leave predictions alone
    more = docs.unionByName(docs.filter("lang = 'aa'")).unionByName(docs.filter("lang = 'aa'"))
    again = {r.doc_id: r.lang_pred for r in X.identify_languages(more, keep & (F.col("doc_id") < 1000)).collect()}
    assert again == {i: r.lang_pred for i, r in by.items()}


def test_few_languages(spark):
    assert X.identify_languages(spark.createDataFrame([], DOCS), F.lit(True)).collect() == []
    one = spark.createDataFrame([(1, "kala", "aa", "s", 1), (2, "brzt", None, "s", 1)], DOCS)
    assert [(r.lang_pred, r.score) for r in X.identify_languages(one, F.lit(True)).collect()] == [("aa", 1.0)] * 2
    none = X.identify_languages(one, F.lit(False)).collect()
    assert [(r.lang_pred, r.score, r.held_out) for r in none] == [("und", 0.0, True)] * 2


def test_held_out_accuracy(spark):
    got = op11_language_id(spark, SF_MID).toPandas()
    docs = pd.read_parquet(f"{SF_MID}/documents.parquet")
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) == len(both)
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in both.doc_id]).all()
    held = both[both.held_out & both.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.98 and len(held) > 100
    assert both.score.between(0, 1).all() and set(both.lang_pred) <= {*docs.lang.dropna(), "und"}
