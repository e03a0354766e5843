import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from litlens.llm import simhash as S

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, max_bits):
    """Smallest id reachable, by union over all pairs."""
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbBzZéÉ \t\n\x0b\x0c\r\x1c .", max_size=60), st.integers(1, 5))
def test_fingerprint_equals_the_definition(text, width):
    assert S.fingerprint(text, width) == plain_fingerprint(text, width)


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = S.fingerprint(text, 4)
    monkeypatch.setattr(S, "HASHES_AT_ONCE", 7)
    assert S.fingerprint(text, 4) == whole == plain_fingerprint(text)


def test_variants_reach_every_pair_within_the_bits():
    rng = random.Random(1)
    keys = S.variants(4)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        met = [k for k, mask, bit in keys if x & mask % 2**64 == y & mask % 2**64
               and (bit < 0 or (x ^ y) >> bit & 1)]
        assert met


def test_links_keep_components(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = {0: 0, 1: 1, 2: 2**64 - 1}
    for i in range(3, 400):  # dense clusters, chains between them, and loners
        x = rng.choice(seeds) if i % 5 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5, 7])):
            x ^= 1 << b
        fps[i] = x
    distinct = {}
    for i, x in fps.items():
        distinct.setdefault(x, i)
    rows = [(int(np.uint64(x).astype(np.int64)), i) for x, i in distinct.items()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # groups over batch borders
    try:
        found = S.components(S.links(spark.createDataFrame(rows, "fp long, node long"), 4)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    want = plain_components({i: x for x, i in distinct.items()}, 4)
    got = {r.node: r.component for r in found}
    assert {i: got.get(i, i) for i in want} == want


def test_whole_operator_with_edge_rows(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(5, base, "en", "a", 1), (3, base.upper(), None, None, None), (9, base + " more", "en", "b", 1),
            (7, None, "en", "a", 0), (2, "", "en", "a", 0), (8, " \t\n", "en", "a", 0), (4, "x", "en", "a", 1),
            (4, "x", "en", "a", 1), (None, base, "en", "a", 1), (6, "y " * 50_000, "en", "a", 1)]
    out = S.simhash_components(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as fp", "2 as node", "'t' as id"))
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in out.collect())
    texts = {r[0] or -1: r[1] for r in rows}
    assert [g[1] for g in got] == [f"{plain_fingerprint(texts[g[0]]):016x}" for g in got]
    want = plain_components({i: plain_fingerprint(t) for i, t in texts.items() if i > 0}, 4)
    assert all(c == want.get(i, 3) for i, _, c in got)
    kept = S.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(
        [-1] + [r[0] for r in rows if r[0] and want[r[0]] == r[0]])
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_table(spark):
    assert S.simhash_components(spark.createDataFrame([], DOCS)).collect() == []


def test_query_equals_brute_force(spark):
    from litlens.llm.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = plain_components(fps, 4)
    got = QUERIES["op1_simhash_near_dedup"](spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (i, f"{x:016x}", want[i]) for i, x in fps.items()} and len(got) == len(docs)


def test_clashing_ids_keep_unlike_texts(spark):
    import random
    rng = random.Random(4)
    a, b = (" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(300)) for _ in range(2))
    rows = [(1, a), (2, a + " end"), (2, b), (3, b), (3, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as gone_h")
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(tuple(r)[:2] for r in kept.collect()) == sorted([(1, a), (2, b)])
