import random

from litlens.llm.prefix_doubling import offsets, repeated_positions, repeated_runs
from litlens.llm.suffix_dedup import remove_repeated_bytes


def _brute(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p:p + length]] = min(i, first.get(b[p:p + length], i))
    out = []
    for i, t in rows:
        b, runs = (t or "").encode(), []
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + length
                else:
                    runs.append([p, p + length])
        out += [(i, a, z) for a, z in runs]
    return sorted(out)


def test_offsets_reach_the_length():
    assert offsets(50) == [8, 16, 18] and offsets(8) == [] and offsets(9) == [1] and offsets(64) == [8, 16, 32]


def test_doubling_equals_brute_force_and_the_sampled_way(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    shared = [word(70) for _ in range(4)]
    rows = [(i, word(rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 9):] + word(rng.randint(0, 40)))
            for i in range(25)]
    rows += [(30, None), (31, ""), (32, "a" * 300), (33, "a" * 120), (34, shared[0][:49])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "'x' as rank", "1 as pos")
    want = _brute(rows, 50)
    assert want and sorted(map(tuple, repeated_runs(docs).collect())) == want
    sampled = [(r.doc_id, s.start, s.stop) for r in remove_repeated_bytes(docs).collect() for s in r.removed]
    assert sorted(sampled) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_positions(docs).collect() == []
