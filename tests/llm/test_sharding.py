import random
import zlib

import pytest

from litlens.llm import sharding as S

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def size(t):
    return len((t or "").encode()) + 1


def plain_capacity(sizes, shards):
    """Smallest capacity by trying every run of groups as the largest shard."""
    sums = sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)})
    for c in sums:
        used, room = 0, 0
        for s in sizes:
            if s > c:
                break
            if s > room:
                used, room = used + 1, c
            room -= s
        else:
            if used <= shards:
                return c


@pytest.mark.parametrize("fan", [2, 3, 50])
def test_search_is_exact(fan):
    rng = random.Random(fan)
    for _ in range(150):
        sizes = [rng.choice([1, 2, 3, rng.randint(1, 400)]) for _ in range(rng.randint(1, 30))]
        shards = rng.randint(1, 9)
        ends = [sum(sizes[:i + 1]) for i in range(len(sizes))]

        def look(ranges):
            out = []
            for a, b in ranges:
                width = -(-(b - a) // fan)
                seen = {}
                for e in ends:
                    if a < e <= b:
                        seen.setdefault((e - a - 1) // width, []).append(e)
                out += [(min(v), max(v), len(v)) for v in seen.values()]
            return out
        capacity, cuts = S.minimax_cuts(ends[-1], shards, look)
        assert capacity == plain_capacity(sizes, shards)
        assert max(b - a for a, b in zip([0, *cuts], cuts)) <= capacity and cuts[-1] == ends[-1]
        assert set(cuts) <= set(ends)
        at, want = 0, []
        for _ in range(shards):  # the greedy cut at this capacity
            at = max(e for e in [at, *ends] if e <= at + capacity)
            want.append(at)
        assert cuts == want


def check(rows, got, shards):
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    home = {}
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    for r in got:
        t = text[r.doc_id]
        assert (r.size, r.text_crc32) == (size(t), zlib.crc32((t or "").encode()))
        assert home.setdefault(t, r.shard) == r.shard
        assert r.law == "bytes" and r.grown_shard is None
    groups = {}
    for i, t in rows:
        g = groups.setdefault(t, [None, 0])
        g[0], g[1] = min(x for x in (g[0], i) if x is not None), g[1] + size(t)
    order = [g[1] for g in sorted(groups.values())]
    total = {}
    for r in got:
        total[r.shard] = total.get(r.shard, 0) + r.size
    assert max(total.values()) == plain_capacity(order, shards)


def test_rows(spark):
    rng = random.Random(3)
    texts = [None, "", "hot text " * 30] + ["é" * rng.randint(0, 60) + str(k) for k in range(60)] + ["x" * 9000]
    rows = [(i, texts[2] if i % 3 == 0 else rng.choice(texts)) for i in range(200)] + [(7, "again"), (7, "again")]
    rows = [r for r in rows if r[0] != 7 or r[1] == "again"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = S.shard_documents(docs.selectExpr("*", "1 as size", "2 as grp", "3 as id"), 8, fan=4).collect()
    assert len(got) == len(rows)
    check(rows, got, 8)


def test_null_ids_and_empty(spark):
    got = S.shard_documents(spark.createDataFrame([(None, "a"), (None, None), (1, "a")], "doc_id long, text string"),
                            2).collect()
    assert len(got) == 3 and len({r.shard for r in got if r.size == 2}) == 1
    assert S.shard_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_query(spark):
    from litlens.llm.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, QUERIES["op9_sharding"](spark, sf).collect(), 8)
