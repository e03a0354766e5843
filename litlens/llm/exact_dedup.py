"""Exact dedup by progressive refinement: rows are grouped by length, then by
a prefix hash, then by a hash of the whole text. Each round only takes the
rows whose group still has company, so full texts are read again and hashed
only for the survivors of the two cheap rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, small_or_plain, split_join, stored, text_hash, unused, without_rows

PREFIX_BYTES = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized_sha256(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, sha`` (32 bytes) of each text with A-Z lower-cased; NULL is empty."""
    kind = texts.schema[id_col].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha = [hashlib.sha256((t.as_py() or "").encode().translate(ASCII_LOWER)).digest() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.binary())], ["id", "sha"])

    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        digest, f"id {kind}, sha binary")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     digest: str | None = None) -> DataFrame:
    """Which rows have equal texts (after lower-casing A-Z), and which one stays.

    Returns id, ``keep_id`` (the largest id of the equal texts), ``group_size``
    (rows of the group) and ``kept`` for every row. NULL text counts as empty.
    A row without an id cannot be told from others: it is kept and compared
    with nothing (``keep_id`` NULL, size 1). Rows that repeat an id and its
    text count in ``group_size`` and share the decision; other texts of the
    same id are decided apart. An empty table gives an empty result; other
    columns of ``docs`` are ignored. ``digest`` names a column to add: SHA-256 of
    every row's normalised text.
    """
    found = _decided(docs, id_col, text_col, digest is not None)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept",
                        *([F.col("sha").alias(digest)] if digest else []))


def _decided(docs: DataFrame, id_col: str, text_col: str, digest: bool = False) -> DataFrame:
    """``id, h`` (hash of the text as it stands) and the decision of every row.
    Rows are known by both, so ids that clash keep their texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    prefix = F.translate(F.substring(text, 1, PREFIX_BYTES), UPPER, LOWER)
    sha = [F.sha2(F.translate(text, UPPER, LOWER).cast("binary"), 256).alias("sha")] if digest else []
    rows = stored(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("len"),
                              F.xxhash64(prefix).alias("head"), *sha), "exact-rows")
    left = rows.filter(F.col("id").isNotNull()).select("id", "h", "len", "head")
    for keys in (["len"], ["len", "head"]):
        company = left.groupBy(*keys).count().filter("count > 1").drop("count")
        left = split_join(left, company, keys)
    survivors = stored(left.select("id", "h").distinct(), "exact-survivors", narrow=True)
    again = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("row"), text.alias("text"))
    again = again.select("row.id", "row.h", "row", "text").join(small_or_plain(survivors), ["id", "h"], "left_semi")
    hashed = stored(normalized_sha256(again, "row").select("id.id", "id.h", "sha"), "exact-hashed")
    groups = hashed.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1")
    found = split_join(hashed, groups, ["sha"]).select("id", "h", "keep_id", "n").dropDuplicates(["id", "h"])
    keep = F.coalesce("keep_id", "id")
    return rows.drop("len", "head").join(found, ["id", "h"], "left").select(
        "id", "h", *[c for c in rows.columns if c == "sha"], keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("id") == keep, F.lit(True)).alias("kept"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_duplicates` does not keep; of
    rows that repeat an id and a text (after lower-casing A-Z), one stays. Rows
    that only share an id are rows of their own; rows without an id stay."""
    gone = stored(_decided(docs, id_col, text_col).filter("not kept").select("id", "h").distinct(), "exact-gone", narrow=True)
    left = without_rows(docs, gone, id_col, text_hash(text_col))
    repeated = stored(docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1")
                      .select(id_col), "exact-repeated", narrow=True)
    if repeated.isEmpty():
        return left
    repeated = small_or_plain(repeated)
    same = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER).cast("binary"), 256)
    key = unused(docs, "same")
    once = left.join(repeated, id_col, "left_semi").withColumn(key, same).dropDuplicates([id_col, key]).drop(key)
    return left.join(repeated, id_col, "left_anti").unionByName(once)
