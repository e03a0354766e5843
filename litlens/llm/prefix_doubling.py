"""Repeated byte strings by distributed prefix doubling.

Every position of every text starts with the rank of its first eight bytes. In
each round a position is paired with the rank ``offset`` bytes further on, Spark
sorts the distinct pairs, and a pair's place in that order is the rank of the
string of both together: lengths 8, 16, 32 and then the wanted one, whose last
offset makes the two halves overlap. A string that only one position has is
unique, and so is all that is longer: its position leaves, and takes no part as
the second half of another. Positions of the wanted length that share a rank are
equal strings.

Ranks of a round are made from counted pairs (combined map-side, so a string that
a third of all positions share is one row a task), by range partitions with
prefix totals; positions get them back by a join whose hot keys Spark splits.
Nothing is held by a group or a task but single rows, and each round is stored.
The work is what the method costs, several shuffles of a row for each byte of
text; ``suffix_dedup`` finds the same strings for a small part of that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running, split_join, stored

FIRST = 8
#: Positions of a batch of rows: it bounds what a Python worker holds.
ROWS = 1 << 18


def _positions(length: int):
    """Every position at which eight bytes start, of texts that reach ``length``."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column("id"), b.column("text")):
                data = np.frombuffer(t.as_py() or b"", np.uint8) if t.is_valid and i.is_valid else np.empty(0, np.uint8)
                n = len(data) - FIRST + 1
                if len(data) < length:
                    continue
                for s in range(0, n, ROWS):
                    e = min(n, s + ROWS)
                    head = np.lib.stride_tricks.sliding_window_view(data[s:e + FIRST - 1], FIRST)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(e - s, i.as_py(), np.int64)), pa.array(np.arange(s, e, dtype=np.int64)),
                         pa.array(np.ascontiguousarray(head).view(">i8").reshape(-1).astype(np.int64))], ["id", "pos", "a"])
    return of


def _reranked(pairs: DataFrame, name: str) -> DataFrame:
    """``(id, pos, rank)`` of the positions whose pair ``(a, b)`` is not unique."""
    shared = stored(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), f"{name}-pairs")
    ranks = running(shared, ["a", "b"], {"rank": F.lit(1)}, f"{name}-order")
    return stored(split_join(pairs, ranks, ["a", "b"]).select("id", "pos", "rank"), name)


def offsets(length: int) -> list[int]:
    """How far the second half of each round lies from the first."""
    have, out = FIRST, []
    while have < length:
        out.append(min(have, length - have))
        have += out[-1]
    return out


def repeated_positions(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, pos, rank, least)``: the positions of strings of ``length`` bytes that
    start at more than one place, their rank in byte order of the signed heads, and
    the smallest id that has the string.

    Texts are UTF-8 bytes; NULL and empty texts, texts shorter than ``length`` and
    rows without an id have no position. Rows that repeat an id count as one text
    if they are equal; different texts of one id are not supported. Other columns
    of ``docs`` are ignored; an empty table gives none."""
    if length < FIRST:
        raise ValueError(f"length must be at least {FIRST}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    heads = rows.dropDuplicates(["id"]).mapInArrow(_positions(length), "id long, pos long, a long")
    known = _reranked(stored(heads.withColumn("b", F.lit(0)), "double-heads"), "double-8")
    for offset in offsets(length):
        second = known.select("id", (F.col("pos") - offset).alias("pos"), F.col("rank").alias("b"))
        pairs = known.select("id", "pos", F.col("rank").alias("a")).join(second, ["id", "pos"])
        known = _reranked(stored(pairs, f"double-{offset}-halves"), f"double-{offset}")
    least = known.groupBy("rank").agg(F.min("id").alias("least"))
    return split_join(known, least, ["rank"]).select("id", "pos", "rank", "least")


def repeated_runs(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start, stop)``: maximal runs of bytes covered by a string that also
    starts in a row with a smaller id. See :func:`repeated_positions`."""
    later = repeated_positions(docs, length, id_col, text_col).filter("id > least").select("id", "pos")
    by = Window.partitionBy("id").orderBy("pos")
    new = (F.col("pos") > F.coalesce(F.lag("pos").over(by), F.lit(-length - 1)) + length).cast("long")
    run = later.withColumn("new", new).withColumn("run", F.sum("new").over(by))
    return run.groupBy("id", "run").agg(F.min("pos").alias("start"), (F.max("pos") + length).alias("stop")).drop("run")
