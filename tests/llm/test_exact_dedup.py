import hashlib

from litlens.llm import exact_dedup as X

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return (text or "").encode().translate(X.ASCII_LOWER)


def test_rows(spark):
    long = "Long text " * 20_000
    rows = [(1, "Same Text", "en", "a", 1), (9, "same text", "en", "a", 1), (4, "SAME TEXT", None, None, None),
            (2, "same texT ", "en", "a", 1), (3, None, "en", "a", 1), (8, "", "en", "a", 1), (5, "É", "en", "a", 1),
            (6, "é", "en", "a", 1), (10, long, "en", "a", 1), (11, long + "A", "en", "a", 1),
            (12, long + "a", "en", "a", 1), (13, long + "b", "en", "a", 1), (20, "twice", "en", "a", 1),
            (20, "twice", "en", "a", 1), (None, "same text", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as id", "2 as len", "3 as head", "4 as keep_id")
    got = [tuple(r) for r in X.exact_duplicates(docs).collect()]
    want = []
    for i, t, *_ in rows:
        same = [r[0] for r in rows if r[0] is not None and low(r[1]) == low(t)]
        want.append((i, max(same), len(same), i == max(same)) if i is not None else (None, None, 1, True))
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = X.drop_exact_duplicates(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    # a row repeated with its id stays once
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(i) for i in [9, 2, 8, 5, 6, 10, 12, 13, 20, None])


def test_digest(spark):
    docs = spark.createDataFrame([(1, "AÉz"), (2, None)], "id long, text string")
    got = {r.id: bytes(r.sha) for r in X.normalized_sha256(docs).collect()}
    assert got == {1: hashlib.sha256("aÉz".encode()).digest(), 2: hashlib.sha256(b"").digest()}


def test_empty_table(spark):
    assert X.exact_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_shuffled_semi_join(spark, monkeypatch):
    monkeypatch.setattr(X, "small_or_plain", lambda df: df)
    rows = [(i, f"text {i // 3}") for i in range(90)]
    got = X.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(i, i // 3 * 3 + 2, 3, i % 3 == 2) for i in range(90)]


def test_clashing_ids_keep_unique_texts(spark):
    rows = [(1, "same", "en", "a", 1), (2, "same", "en", "a", 1), (1, "unique text here", "en", "a", 1),
            (2, "other", "en", "a", 1), (2, "OTHER", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as gone_id", "2 as same", "3 as h")
    kept = X.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text.lower()) for r in kept.collect()) == [(1, "unique text here"), (2, "other"), (2, "same")]
    got = X.exact_duplicates(docs, digest="sha").collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in got) == [
        (1, 1, True), (1, 2, False), (2, 2, True), (2, 2, True), (2, 2, True)]
    assert {r.sha for r in got} == {hashlib.sha256(low(t)).hexdigest() for _, t, *_ in rows}
