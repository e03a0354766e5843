import random
import re
from collections import Counter

from litlens.llm import phrases as X

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_counts(rows, longest):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).decode()
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, least, longest, top):
    f, n = plain_counts(rows, longest)
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    found = []
    for (lang, p), a in often.items():
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = [b for (other, q), b in often.items() if other == lang and len(q) > len(p)
                  and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if all(100 * b < 50 * a for b in inside):
            found.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out, rank = [], Counter()
    for lang, score, a, p, l, r in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, l, r, n[lang], -score))
    return out


def made(seed, n=260):
    rng = random.Random(seed)
    words = "the The of a new york city big apple x y Z é 你好 \x1c nbsp word".split(" ")
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"])
                       for _ in range(rng.randint(0, 25)))
        rows.append((i, text + rng.choice(["", "New York City", "big apple x y"]), rng.choice(["en", "en", "de", None]), "s", 1))
    return rows + [(1, None, "en", None, None), (2, "", "fr", None, None), (None, "new york city", "en", "s", 1),
                   (7, "again and again " * 9_000, "en", "s", 1), (7, "again and again " * 9_000, "en", "s", 1),
                   (8, "x" * 200_000, "de", "s", 1)]


def test_against_plain_counting(spark, monkeypatch):
    rows = made(1)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n", "2 as len", "'x' as phrase", "3 as shard").repartition(3)
    monkeypatch.setattr(X, "WINDOW_WORDS", 500)  # windows end inside texts and pieces
    monkeypatch.setattr(X, "CHUNK", 300)
    got = [tuple(r) for r in X.collocations(docs, min_count=10, longest=3, top=12).collect()]
    assert sorted(got) == plain(rows, 10, 3, 12) and len(got) > 12


def test_longer_phrases_and_few_slots(spark):
    rows = made(2, 150)
    docs = spark.createDataFrame(rows, DOCS)
    # with 16 slots nearly every phrase is active early; counts stay exact
    counts, names = X.frequent_phrases(docs, 12, longest=4, shards=3, slot_bits=4)
    f, n = plain_counts(rows, 4)
    names = names.collect()
    word = {r.h: (r.lang, r.word) for r in names if r.word is not None}
    got = {(word[r.w[0]][0], tuple(word[h][1] for h in r.w)): r.n for r in counts.collect()}
    assert got == {k: a for k, a in f.items() if a >= 12}
    assert {r.lang: r.n for r in names if r.word is None and r.n} == {k: v for k, v in n.items() if v}


def test_words_across_chunks(monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 5)
    text = "Abcdefghij k,lm\tno.p q" * 3 + "é" * 20
    got = [w for part in X.words_of(text) for w in part]
    want = []
    for piece in re.split("[.,;:!?\x0a-\x0d]", text):
        want += [w.encode().translate(X.BYTES) for w in re.findall("[^\x20\x09]+", piece)] + [b"\xff"]
    assert got == want


def test_empty_table(spark):
    assert X.collocations(spark.createDataFrame([], DOCS)).collect() == []
