import math

import numpy as np
import pytest

from litlens.llm import embed_dedup as E

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows, threshold=0.95):
    """(n_links, component, kept) of each row by all pairs in double precision."""
    good = [i for i, (v, x) in enumerate(rows) if v is not None and x and all(
        c is not None and math.isfinite(c) for c in x) and any(x)]
    parent, n = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for p, i in enumerate(good):
        a = np.array(rows[i][1], np.float32).astype(float)
        for j in good[p + 1:]:
            b = np.array(rows[j][1], np.float32).astype(float)
            if len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                n[i] += 1
                n[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i in good:
        low[root(i)] = min(low.get(root(i), rows[i][0]), rows[i][0])
    out = []
    for i, (v, _) in enumerate(rows):
        c = low[root(i)] if i in good else v
        out.append((v, n[i], c, v == c or v is None))
    return sorted(out, key=str)


def clusters(rng, count, dim, noise):
    rows = []
    for c in range(count):
        centre = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 30)):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + noise * rng.standard_normal(dim)]))
    return rows


@pytest.mark.parametrize("tile", [2048, 10])
def test_links_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(E, "TILE", tile)
    rng = np.random.default_rng(5)
    rows = clusters(rng, 25, 64, 0.1)
    rows += [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [None] * 64), (1004, [math.nan] + [1.0] * 63),
             (1005, [math.inf] + [1.0] * 63), (1006, rows[0][1][:32]), (1007, [2 * x for x in rows[3][1]]),
             (1008, rows[3][1]), (1008, rows[3][1]), (None, rows[3][1]), (1009, [1.0]), (1010, [2.0]), (1011, [-1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).selectExpr("*", "1 as node", "2 as vector", "3 as n")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = sorted((tuple(r) for r in E.embedding_links(df).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    want = plain(rows)
    assert len(got) == len(want)
    # the bands miss a pair at the threshold with a probability below 1 %
    same = sum(g == w for g, w in zip(got, want))
    assert same >= 0.98 * len(want) and all(g[1] <= w[1] for g, w in zip(got, want))


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((400, 64))
    b = a + 0.6 * rng.standard_normal((400, 64))
    keys, code, factor = E.encode(np.vstack([a, b]))
    g = E.Group(np.vstack([a, b]), code, factor, keys, 0.95)
    i = np.arange(400)
    estimate = (g.code[i] * g.turned[i + 400]).sum(axis=1)
    true = (a * b).sum(axis=1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    assert abs((estimate - true).mean()) < 0.01
    assert (np.abs(estimate - true) <= g.bound[i]).all()


def test_empty_table(spark):
    assert E.embedding_links(spark.createDataFrame([], VECTORS)).collect() == []


def test_query(spark):
    from litlens.llm.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op3_embedding_near_dedup"](spark, sf).collect()), key=str) == plain(rows)
