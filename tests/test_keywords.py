import random
import re

from litlens.operators import keywords as K

PAPERS = [(1, "The design of user interfaces; DESIGNING interfaces!"),
          (2, "Nothing matches here."), (3, None),
          (4, "Learning to learn: learners design and learn")]
STEMS = [("UI", "design*"), ("UI", "interfac*"), ("UI", "user*"), ("Learning", "learn*"),
         ("Learning", "design*"), ("Empty", "zzz*")]


def _brute(papers, stems):
    out = {}
    for pid, text in papers:
        toks = [t for t in re.split("[^a-z]+", (text or "").lower()) if t]
        for topic, stem in stems:
            s = stem.rstrip("*")
            n = sum(t.startswith(s) for t in toks)
            if n:
                out[(pid, topic, s)] = n
    return out


def test_hits_match_brute_force(spark):
    p = spark.createDataFrame(PAPERS, "paper_id long, fulltext string")
    s = spark.createDataFrame(STEMS, "topic string, stem string")
    got = {(r.paper_id, r.topic, r.stem): r.hits for r in K.taxonomy_hits(p, s).collect()}
    assert got == _brute(PAPERS, STEMS)


def test_best_topic(spark):
    p = spark.createDataFrame(PAPERS, "paper_id long, fulltext string")
    s = spark.createDataFrame(STEMS, "topic string, stem string")
    got = {r.paper_id: (r.topic, r.hits, r.stems) for r in K.best_topic(p, s).collect()}
    assert got == {1: ("UI", 5, 3), 2: ("Other", 0, 0), 3: ("Other", 0, 0), 4: ("Learning", 5, 2)}


def test_prefix_match_plans_as_hash_join(spark):
    p = spark.createDataFrame(PAPERS, "paper_id long, fulltext string")
    s = spark.createDataFrame(STEMS, "topic string, stem string")
    plan = K.taxonomy_hits(p, s)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_trie_and_prefix_join_agree_with_brute_force(spark):
    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("abc") for _ in range(rng.randint(1, most)))
    papers = [(i, rng.choice([" ", "-", "1", "É"]).join(word(8) for _ in range(60)).upper()) for i in range(20)]
    stems = sorted({(t, word(6) + "*") for t in "XYZ" for _ in range(40)})
    odd = [("X", "a b*"), ("Y", "é*"), ("Z", "a-c"), ("Z", "a" * 150 + "*"), ("Y", None)]
    p = spark.createDataFrame(papers + [(99, None), (98, "")], "paper_id long, fulltext string")
    for extra in ([], odd[:3] + odd[4:], odd):  # the last has a stem beyond the pattern's length
        s = spark.createDataFrame(stems + extra, "topic string, stem string")
        for most in (0, K.TRIE_MAX_STEMS):
            got = {(r.paper_id, r.topic, r.stem): r.hits for r in K.taxonomy_hits(p, s, trie_max=most).collect()}
            assert got == _brute(papers, stems)


def test_pattern_takes_the_longest_stem():
    pattern = re.compile("(?<![a-z])" + K.trie_pattern(["the", "th", "an", "and", "a", "theor"]))
    assert pattern.findall("theory then and an x ban those") == ["theor", "the", "and", "an", "th"]


def test_twenty_stem_lengths_add_no_rows(spark):
    s = spark.createDataFrame([("T", "a" * n) for n in range(1, 22)], "topic string, stem string")
    p = spark.createDataFrame([(1, "aaa " + "a" * 30)], "paper_id long, fulltext string")
    plan = K.taxonomy_hits(p, s)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" in plan and plan.count("BroadcastHashJoin") >= 1 and "NestedLoop" not in plan
    hits = {r.stem: r.hits for r in K.taxonomy_hits(p, s).collect()}
    assert hits == {"a" * n: 2 if n <= 3 else 1 for n in range(1, 22)}
