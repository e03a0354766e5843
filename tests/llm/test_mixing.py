import math
import random
from fractions import Fraction

import pytest

from litlens.llm import mixing as M

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_schedule(weights, blocks):
    """Earliest deadline first, slot by slot: {(source, block): (release, deadline, slot)}."""
    total, taken, slot, out = sum(weights.values()), dict.fromkeys(weights, 0), 0, {}
    names = sorted(weights, key=lambda s: (s is not None, s or ""))
    while any(taken[s] < blocks[s] for s in names):  # ended sources go on taking slots
        ready = [(math.ceil((taken[s] + 1) * total / weights[s]), i) for i, s in enumerate(names)
                 if math.floor(taken[s] * total / weights[s]) <= slot]
        if ready:
            due, i = min(ready)
            s = names[i]
            out[s, taken[s]] = (math.floor(taken[s] * total / weights[s]), due, slot)
            taken[s] += 1
        slot += 1
    return out


def test_schedule_equals_plain_edf(spark):
    rng = random.Random(4)
    rows = [(i, None, "en", rng.choice(["hot", "hot", "hot", "b", "c", None]), 1) for i in range(700)]
    docs = spark.createDataFrame(rows + rows[:3] + [(None, "x", "en", "b", 1)], DOCS)
    weights = {"hot": 2, "b": 1, None: 1}
    got = M.mix_schedule(docs.selectExpr("*", "1 as slot", "2 as block", "3 as id"), weights, block_rows=4,
                         period=20).collect()
    assert sorted(r.doc_id for r in got) == list(range(700))
    assert all(r.slot is None and r.block is None for r in got if r.source == "c")
    n = {s: sum(r[3] == s for r in rows) for s in weights}
    want = plain_schedule(weights, {s: -(-k // 4) for s, k in n.items()})
    for s, k in n.items():
        mine = [r for r in got if r.source == s]
        assert sorted((r.block, r.place) for r in mine) == [(i // 4, i % 4) for i in range(k)]
        assert all((r.release, r.deadline, r.slot) == want[s, r.block] and r.release <= r.slot < r.deadline for r in mine)


def test_documents_in_order(spark):
    rows = [(i, f"t{i}", "en", "ab"[i % 2], 1) for i in range(60)] + [(None, None, None, None, None), (5, "t5", "en", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = M.mix_documents(docs, block_rows=5).collect()
    assert sorted(map(str, got)) == sorted(map(str, docs.collect()))
    assert got[-1].doc_id is None
    sources = [r.source for r in got[:-1]]
    assert all(abs(sources[:k].count("a") - k * 30 / 61) <= 10 for k in range(61))


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert M.mix_schedule(empty).collect() == [] and M.mix_documents(empty).columns == empty.columns


def test_query(spark):
    from litlens.llm.catalog import MIX_POWER, QUERIES
    sf = "/root/testdata/sf0.001"
    n = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n[r.source] = n.get(r.source, 0) + 1
    want = plain_schedule({s: Fraction(k ** MIX_POWER) for s, k in n.items()}, {s: -(-k // 16) for s, k in n.items()})
    got = QUERIES["op10_mixing"](spark, sf).collect()
    assert len(got) == sum(n.values())
    for r in got:
        assert (r.release, r.deadline, r.slot) == want[r.source, r.block]


def test_clashing_columns_and_weights_beyond_64_bits(spark):
    docs = spark.createDataFrame([(i, "t", "en", "ab"[i % 2], 1) for i in range(40)], DOCS).selectExpr(
        "*", "'x' as _id", "1 as _slot", "2 as _place", "3 as mix_slot", "4 as MIX_id")
    got = M.mix_documents(docs, block_rows=4)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    with pytest.raises(Exception, match="a weight is too small"):
        M.mix_schedule(docs, weights={"a": 1.0, "b": 1e-18}, block_rows=1).collect()
    # the smallest that fits goes through the long columns
    rows = M.mix_schedule(docs, weights={"a": 1.0, "b": 1e-16}, block_rows=1).collect()
    assert all(r.release <= r.slot < r.deadline < 2 ** 63 for r in rows) and len({r.slot for r in rows}) == 40


@pytest.mark.parametrize("seed, sources", [(0, 3), (1, 40), (2, 3000)])
def test_target_weights_hold_over_many_periods(seed, sources):
    """Against the target weights themselves, at each block of a long schedule."""
    rng = random.Random(seed)
    weights = [Fraction(rng.choice([1, 7, rng.random() * 30])) for _ in range(sources - 1)]
    weights.append(sum(weights) / 2)  # a third of all
    shares, total = M.exact_shares(weights), sum(weights)
    assert [Fraction(n, sum(shares)) for n in shares] == [w / total for w in weights]
    blocks = [int(50_000 * w / total) + 1 for w in weights]
    rows = list(M.whole_schedule(shares, blocks))
    assert sorted((i, k) for i, k, *_ in rows) == [(i, k) for i, n in enumerate(blocks) for k in range(n)]
    assert len({r[4] for r in rows}) == len(rows)
    for i, k, release, due, slot in rows:  # before its slot k blocks, after it k + 1: both within one of the share
        share = weights[i] / total
        assert abs(k - slot * share) < 1 and abs(k + 1 - (slot + 1) * share) < 1 and release <= slot < due


def test_tiny_weight_needs_no_walk_over_vacant_slots():
    rows = list(M.whole_schedule([10 ** 12, 1], [5, 5]))
    assert len(rows) == 10 and all(release <= slot < due for *_, release, due, slot in rows)


def test_schedule_meets_target_weights(spark):
    docs = spark.createDataFrame([(i, None, "en", f"s{i % 1500}" if i % 3 else "hot", 1) for i in range(6000)], DOCS)
    got = M.mix_schedule(docs, block_rows=1).collect()
    n = {}
    for r in got:
        n[r.source] = n.get(r.source, 0) + 1
    assert sorted(r.slot for r in got) == list(range(6000))  # all sources end together
    assert all(abs(r.block - Fraction(r.slot * n[r.source], 6000)) < 1 for r in got)
