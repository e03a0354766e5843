import hashlib
import math
import random
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from litlens.llm import prefix_trie as X
from litlens.llm.catalog import op13_prefix_trie

CONVERSATIONS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SMALL = "/root/testdata/sf0.001"


def plain(rows, shared=True):
    """The trie, node by node."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [turn[1:] for turn in sorted(v)] for c, v in by.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if shared else 0
        convs[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].add(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        own_saved = (len(m) - 1) * len(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own_saved
            leaves[k[:d]] += not children[k]
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def trie(spark, rows, **kw):
    table = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "1 as conv", "2 as pos", "3 as t1", "'x' as rep")
    heads = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("int")
    out = X.conversation_trie(table, F.col("conv") - F.col("conv") % 100, heads, 5, **kw)
    assert out.columns[:len(COLUMNS)] == COLUMNS
    return sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=lambda r: r[:2])


def test_all_kinds_of_conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(-3, 40), *range(100, 130), 205, 317]:  # branching early, some replaced whole
        turns = [rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.randint(1, 9))]
        rows += [(c, t, rng.choice(["user", "assistant"]) if t == 3 else "user", x) for t, x in enumerate(turns)]
    rows += [(50, None, None, None), (50, 0, "user", "x"), (50, 0, "user", "x"), (50, 0, "assistant", "y"),
             (51, 1, "", ""), (None, 1, "user", "lost"), (52, 5, "user", "ü€𝄞"), (52, None, "system", "s")]
    rows += [(c, t, "user", "same" * t) for c in [*range(500, 560), *range(1000, 1060)] for t in range(8)]  # copies
    # long ones that share their first turns, and prefixes of each other
    rows += [(c, t, "user", f"turn {t}") for c, n in ((2007, 150), (2008, 140), (2009, 150)) for t in range(n)]
    rows[-1] = (2009, 149, "user", "another end")
    rows += [(c, t, "user", f"turn {t}") for c in range(3020, 3050) for t in range(c - 3010)]
    rng.shuffle(rows)
    assert trie(spark, rows, container_turns=300) == plain(rows)


def test_digest_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(X, "IDS_A_ROW", 7)
    rows = [(c, 10 if c % 3 else c) for c in range(10, 500)]
    got = {r.rep: r.ends_sha256 for r in X.id_digests(spark.createDataFrame(rows, "conv long, rep long")).collect()}
    groups = defaultdict(list)
    for c, rep in rows:
        groups[rep].append(c)
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in groups.items()}


def test_query_on_the_whole_table(spark):
    t = pq.read_table(f"{SMALL}/conversations.parquet").to_pydict()
    got = sorted((tuple(r[c] for c in COLUMNS) for r in op13_prefix_trie(spark, SMALL).collect()), key=lambda r: r[:2])
    assert got == plain(list(zip(t["conv_id"], t["turn"], t["role"], t["text"])))
