import math
import os
import random

import public_tokenizers

import corpus_pipeline as P
from litlens.llm import sentencepiece_scan as S

from test_simhash import plain_components, plain_fingerprint

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_and_run_agree_with_brute_force(spark, tmp_dir):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = P.quality(spark, docs, sf)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in kept.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = [(i in rows) == bool(q) for i, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)
    last = {}
    for i, r in rows.items():
        text = "".join(c.lower() if c.isascii() else c for c in r.text)
        last[text] = max(i, last.get(text, i))
    rows = {i: r for i, r in rows.items() if i in set(last.values())}
    home = plain_components({i: plain_fingerprint(r.text) for i, r in rows.items()}, 4)
    rows = {i: r for i, r in rows.items() if home[i] == i}
    p = S.pieces(S.read_model(public_tokenizers.path(P.MODEL)))
    got = P.run(spark, sf).collect()
    assert {(r.doc_id, r.n_tokens, tuple(r.ids)) for r in got} == {
        (i, len(ids), tuple(ids)) for i, ids in ((i, p.whole.encode(r.text)) for i, r in rows.items())}
    assert len(got) == len(rows)


def test_stages_take_edge_rows(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 999)) for _ in range(80)) + ".",
             "en", "s", 1) for i in range(20)]
    rows += [(30, None, None, None, None), (31, "", "en", "s", 0), (None, rows[0][1], "en", None, 1), rows[1], (32, rows[2][1], "x", "t", 1),
             (33, "long " * 50_000, "en", "s", 1)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, DOCS)
        for name, stage in P.STAGES:
            out = stage(spark, docs, "")
            assert name == P.STAGES[-1][0] or out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        ids = [r.doc_id for r in docs.collect()]
        assert len(ids) == len(set(ids)) and (not table or {None, *range(20)} - {2} <= set(ids) | {1, 2})


def test_last_stage_finds_the_slots_in_a_new_process_state(spark):
    import importlib
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}", 1) for i in range(50)], DOCS).selectExpr("*", "'x' as _id", "1 as _slot")
    out = P.mix(spark, docs, "")
    assert out.columns == docs.columns
    new = importlib.reload(P)
    stored = sorted(tuple(r) for r in new.pieces(spark, out, "elsewhere").collect())
    path, slots = new._mix_of(spark, docs)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == sorted(tuple(r) for r in slots.collect())
    other = docs.filter("doc_id < 40")  # slots that were never stored are made
    assert len(stored) == 50 and all(r.slot is not None for r in new.pieces(spark, other, "").collect())


def test_run_returns_the_slots_of_the_mix(spark):
    from litlens.llm.catalog import MIX_POWER
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.slot, r.place) for r in P.run(spark, sf).collect()}
    kept = docs.filter(docs.doc_id.isin(list(got)))
    rows = {}
    for r in kept.collect():
        rows.setdefault(r.source, []).append(r.doc_id)
    n = {s: len(ids) for s, ids in rows.items()}
    # earliest deadline first, slot by slot, over the blocks of every source
    names = sorted(n, key=lambda s: (s is not None, s))
    weight = {s: n[s] ** MIX_POWER for s in names}
    total, taken, slot, at = sum(weight.values()), dict.fromkeys(names, 0), 0, {}
    while any(taken[s] * 16 < n[s] for s in names):
        ready = [(math.ceil((taken[s] + 1) * total / weight[s]), i, s) for i, s in enumerate(names)
                 if math.floor(taken[s] * total / weight[s]) <= slot]
        s = min(ready)[2]
        at[s, taken[s]] = slot
        taken[s] += 1
        slot += 1
    want = sorted((s, at[s, k // 16], k % 16) for s in names for k in range(n[s]))
    source = {r.doc_id: r.source for r in kept.collect()}
    assert sorted((source[i], *where) for i, where in got.items()) == want


def test_last_stage_reads_the_slots_and_does_not_make_them_again(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"stored text {i}", "en", f"s{i % 4}", 1) for i in range(60)], DOCS)
    out = P.mix(spark, docs, "")
    want = {r.doc_id: (r.slot, r.place) for r in P.mix_schedule(docs, power=P.MIX_POWER).collect()}
    monkeypatch.setattr(P, "mix_schedule", None)
    assert {r.doc_id: (r.slot, r.place) for r in P.pieces(spark, out, "").collect()} == want


def test_small_tables_of_a_wide_shuffle_are_stored_in_few_files(spark, tmp_dir, monkeypatch):
    from litlens.llm import common
    monkeypatch.setattr(common, "scratch_root", lambda spark: tmp_dir)
    monkeypatch.setattr(P, "scratch_root", lambda spark: tmp_dir)
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    rows = [(i, " ".join(f"w{i * 7 + k}" for k in range(9)), "en", f"s{i % 3}", 1) for i in range(300)]
    rows += [(1000 + i, rows[i][1], "en", "s0", 1) for i in range(100)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(2)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        kept = sorted(r.doc_id for r in P.exact(spark, docs, "").collect())
        left = sorted(r.doc_id for r in P.near(spark, docs, "").collect())
        P.mix(spark, docs, "")
        few = common.few_files(spark)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert kept == [*range(100, 300), *range(1000, 1100)]
    assert left == sorted(i for i, c in plain_components({r[0]: plain_fingerprint(r[1]) for r in rows}, 4).items() if i == c)
    parts = {d: len([f for f in os.listdir(f"{tmp_dir}/{d}") if f.startswith("part-")]) for d in os.listdir(tmp_dir)}
    assert max(parts.values()) <= few
    kinds = ("exact-survivors", "exact-gone", "cc", "simhash-nodes", "simhash-found", "simhash-gone", "mix-order", "mix-placed")
    assert all(any(d.startswith(f"llm-{k}-") for d in parts) for k in kinds)
    assert spark.read.parquet(*[f"{tmp_dir}/{d}" for d in parts if d.startswith("corpus-mix-")]).count() == 400
