import random

from hypothesis import given, settings
from hypothesis import strategies as st

from litlens.llm import substring_dedup as S

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_sentences(text):
    """Cut by looking at every character."""
    out, at, i = [], 0, 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in ".!?":
            j += 1
        stop = j > i and (j == len(text) or text[j].isspace())
        if stop or text[i] == "\n":
            j = j if stop else i + 1
            while j < len(text) and text[j].isspace():
                j += 1
            out.append(text[at:j])
            at = j
        i = max(j, i + 1)
    return [*out, text[at:]] if at < len(text) else out


def plain_dedup(docs, run, min_words):
    words = {i: [tuple("".join(c.lower() if c.isascii() else c for c in s).split()) for s in plain_sentences(t)]
             for i, t in docs.items()}
    first, out = {}, {}
    for i in sorted(docs):
        for k in range(len(words[i]) - run + 1):
            first.setdefault(tuple(words[i][k:k + run]), (i, k))
    for i, t in docs.items():
        gone = set()
        for k in range(len(words[i]) - run + 1):
            key = tuple(words[i][k:k + run])
            if sum(map(len, key)) >= min_words and first[key] != (i, k):
                gone |= set(range(k, k + run))
        s = plain_sentences(t)
        out[i] = ("".join(x for k, x in enumerate(s) if k not in gone), len(s), len(gone))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.!? \n", max_size=40))
def test_sentences(text):
    ends = S.sentence_ends(text)
    assert [text[a:b] for a, b in zip([0, *ends], ends)] == (plain_sentences(text) or [""])


def test_equals_brute_force(spark):
    rng = random.Random(1)
    sentences = [" ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randint(0, 40))
                          for _ in range(rng.randint(1, 9))) + rng.choice([".", "!", "?!", "\n"]) for _ in range(60)]
    docs = {i: rng.choice([" ", "  ", "\n"]).join(rng.choice(sentences) for _ in range(rng.randint(0, 25)))
            for i in range(120)}
    docs |= {200: "hot passage one is here now. hot passage two is there then. " * 50, 201: "Hot passage ONE is here now. "
             "Hot passage two is  there then.", 202: "", 203: "no stop " * 20_000}
    rows = [(i, t, "en", "s", 1) for i, t in docs.items()] + [(300, None, None, None, None), (None, docs[3], "en", "s", 1),
                                                             (5, docs[5], "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as id", "2 as at", "3 as starts")
    got = S.remove_repeated_sentences(df, 2, 6).collect()
    want = plain_dedup(docs, 2, 6)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert (r.kept_text, r.n_removed) == (docs[3], 0)
        elif r.doc_id == 300:
            assert (r.kept_text, r.n_sentences, r.n_removed) == (None, 0, 0)
        else:
            assert (r.kept_text, r.n_sentences, r.n_removed) == want[r.doc_id]


def test_empty_table(spark):
    assert S.remove_repeated_sentences(spark.createDataFrame([], DOCS)).collect() == []


def test_query(spark):
    from litlens.llm.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(i, n, r, t) for i, (t, n, r) in plain_dedup(docs, S.RUN, S.MIN_WORDS).items()}
    got = QUERIES["op6_substring_dedup"](spark, sf).collect()
    assert {(r.doc_id, r.n_sentences, r.n_removed, r.kept_text) for r in got} == want and len(got) == len(docs)


def test_long_sentences_and_text_without_spaces(spark):
    rng = random.Random(7)
    words = lambda n: " ".join("w" + str(rng.randint(0, 10 ** 6)) for _ in range(n))
    lone, passage = words(60) + ". ", words(300)
    han = lambda n: "".join(chr(rng.randint(0x4e00, 0x9fff)) for _ in range(n))
    chinese = han(12) + "。" + han(12) + "！"
    docs = {1: words(8) + ". " + lone + words(8) + ".", 2: words(9) + ". " + lone + words(9) + ".",
            3: words(200) + " " + passage + " " + words(200), 4: words(150) + " " + passage + " " + words(170),
            5: han(9) + "。" + chinese + han(9) + "。", 6: han(7) + "。" + chinese + han(8) + "。",
            7: han(400), 9: words(100)}
    docs[8] = han(100) + docs[7][50:350] + han(100)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs.items()], DOCS)
    got = {r.doc_id: r for r in S.remove_repeated_sentences(df).collect()}
    assert all(got[i].kept_text == docs[i] for i in (1, 3, 5, 7, 9))
    assert got[2].kept_text == docs[2].replace(lone, "") and (got[2].n_sentences, got[2].n_removed) == (3, 1)
    assert got[6].kept_text == docs[6].replace(chinese, "") and got[6].n_removed == 2
    own = set(docs[4].split()) - set(passage.split())
    left = got[4].kept_text.split()
    assert own <= set(left) and len(left) <= 320 + 130 and got[4].n_removed == 0
    assert 200 <= len(got[8].kept_text) <= 200 + 130
    assert got[8].kept_text[:100] == docs[8][:100] and got[8].kept_text[-100:] == docs[8][-100:]
