import random

import numpy as np

from litlens.llm import quality as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_em_finds_accuracies(monkeypatch):
    monkeypatch.setattr(Q, "RANGE", {Q.BAD: (0.55, 0.99), Q.GOOD: (0.55, 0.99)})
    rng = np.random.default_rng(1)
    good = rng.random(40_000) < 0.75
    truth = {0: 0.95, 1: 0.85, 2: 0.7, 3: 0.9}
    v = np.zeros((len(good), 4), int)
    for k, a in truth.items():
        cast, right = rng.random(len(good)) < 0.8, rng.random(len(good)) < a
        v[:, k] = np.where(cast, np.where(good == right, Q.GOOD, Q.BAD), Q.ABSTAIN)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    _, accuracy = Q.em(patterns, counts.astype(float))
    assert np.abs(accuracy - list(truth.values())).max() < 0.03


def test_votes_of_edge_texts():
    for text in (None, "", " \n\t"):
        v = dict(zip(Q.LABELLERS, Q.votes(text)))
        assert v.pop("length") == Q.BAD and set(v.values()) == {Q.ABSTAIN} and Q.features(text) is None
    assert np.isclose((Q.features("a b\n") ** 2)[:-1].sum(), 1)


def junk(rng, words):
    kind = rng.randint(0, 2)
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w + rng.choice(["###", "%%%", "&&&"]) for w in words)
    return " ".join(w for w in words for _ in range(9))


def test_rows(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows, bad = [], set()
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        text = " ".join(w + "." if k % 12 == 11 else w for k, w in enumerate(words)).capitalize() + "."
        if i % 6 == 0:
            text = junk(rng, words)
            bad.add(i)
        rows.append((i, text, "en", "s", 1))
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (402, " \n ", "en", "s", 0), (None, rows[1][1], "en", "s", 1),
             (1, rows[1][1], "en", "s", 1), (403, "A sentence of words. " * 9_000 + "end " * 40_000, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = Q.quality_scores(df.selectExpr("*", "1 as score", "2 as id", "3 as pattern"), sample=200).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = {r.doc_id: r.kept for r in got}
    assert [i for i in range(400) if kept[i] == (i in bad)] == []
    assert kept[None] and not any(kept[i] for i in (400, 401, 402))
    left = Q.keep_good(df, sample=200)
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in df.collect() if kept[r.doc_id])


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert Q.quality_scores(empty).collect() == [] and Q.keep_good(empty).collect() == []


def test_query_on_labelled_rows(spark):
    from litlens.llm.catalog import QUERIES
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in QUERIES["op8_quality_classifier"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(kept) == 1000
    clean = [kept[i] for i, q in labels.items() if q == 1]
    junk = [kept[i] for i, q in labels.items() if q == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.05
