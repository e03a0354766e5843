import os

import pytest

from litlens.llm.catalog import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("edge"))
    base_text = "A sentence of some words stands here now. Another sentence of some words follows it at once. "
    docs = [(1, base_text * 3, "en", "a", 1), (2, base_text * 3, "en", "a", 1), (2, base_text * 3, "en", "a", 1),
            (3, None, None, None, None), (4, "", "", "", 0), (5, " \n\t", "en", None, 0), (None, base_text, "en", "a", 1),
            (None, None, None, None, None), (6, "x" * 120_000, "en", "b", 1), (7, base_text.upper() * 3, "de", "b", 1)]
    vectors = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], None), (2, [1.0, 0.01], None), (3, None, 1), (4, [], 1),
               (5, [0.0, 0.0], 1), (6, [None, 1.0], 1), (None, [1.0, 0.0], 1), (7, [float("nan"), 1.0], 1)]
    turns = [(1, 0, "user", "a"), (1, 1, None, None), (2, None, "user", "a"), (2, 1, None, ""), (None, 1, "user", "lost"),
             (3, 0, "user", "x" * 120_000), (3, 0, "user", "x" * 120_000)]
    for name, rows, parts in (("full", (docs, vectors, turns), 2), ("empty", ([], [], []), 1)):
        spark.createDataFrame(rows[0], DOCS).repartition(parts).write.parquet(os.path.join(base, name, "documents.parquet"))
        spark.createDataFrame(rows[1], VECTORS).write.parquet(os.path.join(base, name, "embeddings.parquet"))
        spark.createDataFrame(rows[2], TURNS).write.parquet(os.path.join(base, name, "conversations.parquet"))
    return base, docs, vectors


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_repeats_and_long_texts(spark, tables, name):
    base, docs, vectors = tables
    got = QUERIES[name](spark, os.path.join(base, "full")).collect()
    if name.startswith(("op12", "op13")):  # rows of their own: see their tests
        assert got or name.startswith("op12")
        return
    key = "vec_id" if "embedding" in name else "doc_id"
    ids = {r[0] for r in (vectors if key == "vec_id" else docs)}
    if name.startswith("op10"):  # rows without an id have no place in the mix
        ids -= {None}
    assert {r[key] for r in got} == ids
    if not name.startswith(("op2_", "op10")):
        assert len(got) == len(vectors if key == "vec_id" else docs)
    if name.startswith("op4"):
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got if r.doc_id in (1, 2, 7)) == [
            (1, 7, 4), (2, 7, 4), (2, 7, 4), (7, 7, 4)]
        assert all(len(r.text_sha256) == 64 for r in got)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tables, name):
    assert QUERIES[name](spark, os.path.join(tables[0], "empty")).collect() == []
