"""Mixing sources to target weights by Pfair scheduling.

Block k of a source with weight w is released at floor(k / w) and due at
ceil((k + 1) / w); earliest deadline first over these windows keeps every
source within one block of its share at every slot. Weights are exact ratios
of integers: nothing is rounded or reserved, so the bound holds against the
target weights at any length. The schedule is made by one task that goes on
from block to block, holds one waiting block a source and hands its blocks on
in portions; the blocks are joined to the documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running, small_or_plain, stored, unused

#: Blocks that are handed on at once.
PERIOD = 10_000
#: Slots, in multiples of the blocks, up to which ended sources still take part.
VACANT = 4
#: Slots there are; a weight too small for its blocks to end before is refused.
LAST_SLOT = 1 << 62


def exact_shares(weights: list[Fraction]) -> list[int]:
    """Integers in the exact ratio of ``weights``."""
    scale = math.lcm(*(w.denominator for w in weights))
    shares = [int(w * scale) for w in weights]
    common = math.gcd(*shares)
    return [n // common for n in shares]


def whole_schedule(shares: list[int], blocks: list[int], vacant: int = VACANT) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, release, deadline, slot) of each of a source's blocks by
    earliest deadline first, ties to the first source, in the order of slots.

    Sources that ended still take their slots, which stay vacant, up to slot
    ``vacant`` x all blocks: the others keep the slots they would have had.
    Beyond it they are left out, so a tiny weight costs no walk over vacant
    slots; the windows of the others hold all the same.
    """
    total, left = sum(shares), sum(blocks)
    if any(n and -(-n * total // share) + left > LAST_SLOT for n, share in zip(blocks, shares)):
        raise ValueError(f"a weight is too small: its source would not end before slot {LAST_SLOT}")
    stop = vacant * left
    waiting = [(0, i, 0) for i in range(len(shares))]  # (release, source, block): sorted, so a heap
    ready: list[tuple[int, int, int, int]] = []
    slot = 0
    while left:
        while waiting and waiting[0][0] <= slot:
            release, i, k = heapq.heappop(waiting)
            if k < blocks[i] or slot < stop:
                heapq.heappush(ready, (-(-(k + 1) * total // shares[i]), i, k, release))
        if not ready:
            slot = waiting[0][0]
            continue
        due, i, k, release = heapq.heappop(ready)
        if k < blocks[i]:
            yield i, k, release, due, slot
            left -= 1
        heapq.heappush(waiting, ((k + 1) * total // shares[i], i, k + 1))
        slot += 1


def block_slots(sizes: DataFrame, weights: Mapping[str | None, float] | None, power: float, block_rows: int,
                portion: int, vacant: int = VACANT) -> DataFrame:
    """A row for each block of the ``source, first, n`` rows that has a slot."""
    names = ["first", "block", "release", "deadline", "slot"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in batches:
            for source, first, n in zip(*(c.to_pylist() for c in b.columns)):
                w = n ** power if weights is None else weights.get(source, 0)
                if w > 0:
                    found.append(((source is not None, source or ""), first, n, Fraction(w)))
        if not found:
            return
        _, firsts, counts, exact = zip(*sorted(found))
        out = []
        for i, *row in whole_schedule(exact_shares(list(exact)), [-(-n // block_rows) for n in counts], vacant):
            out.append((firsts[i], *row))
            if len(out) == portion:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    # one row a source meets in the task: earliest deadline first goes slot by slot
    return sizes.select("source", "first", "n").repartition(1).mapInArrow(of, ", ".join(f"{c} long" for c in names))


def mix_schedule(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 1.0,
                 block_rows: int = 16, period: int = PERIOD, id_col: str = "doc_id",
                 source_col: str = "source", vacant: int = VACANT) -> DataFrame:
    """Slot of every document in the mix.

    ``weights`` are the target shares of blocks by source (None is the NULL
    source); without them, a source weighs the power ``power`` of its row count
    (1: its share, so that all sources run out together). A source's documents
    stand in a hashed order and are cut into blocks of ``block_rows``; the last
    block may be shorter. Up to the slot in which the first source runs out,
    each source has had its share of the slots to within one block; after it
    the slots of ended sources stay vacant and the others keep their windows, so
    no document is dropped or repeated. ``period`` is the number of blocks
    handed on at once; the schedule does not depend on it. Ended sources take part
    up to slot ``vacant`` x all blocks. A weight so small that its source would
    not end before slot 2 ** 62 is refused with a ValueError.

    Returns id, source, ``block``, ``place`` (row in its block), ``release``,
    ``deadline`` and ``slot``. A source without a positive weight is not
    scheduled: NULL from ``block`` on. Rows that repeat an id are one document;
    rows without an id are left out. Other columns of ``docs`` are ignored.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.min(source_col).alias("source"))
    order = ["source", "mixed", "id"]
    placed = stored(running(rows.withColumn("mixed", F.xxhash64("id")), order, {"upto": F.lit(1)}, "mix-order", narrow=True),
                    "mix-placed", narrow=True)
    sizes = stored(placed.groupBy("source").agg(F.min("upto").alias("first"), F.count("*").alias("n")), "mix-sizes", narrow=True)
    slots = stored(block_slots(sizes, weights, power, block_rows, period, vacant), "mix-slots").withColumnRenamed(
        "first", "first2").withColumnRenamed("block", "block2")
    starts = small_or_plain(sizes.select(F.col("source").alias("s"), "first"))
    out = placed.join(starts, F.col("source").eqNullSafe(F.col("s")))
    since = F.col("upto") - F.col("first")
    out = out.withColumn("of", F.floor(since / block_rows)).join(
        slots.hint("merge"), (F.col("first") == F.col("first2")) & (F.col("of") == F.col("block2")), "left")
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("block2").alias("block"),
        F.when(F.col("block2").isNotNull(), since % block_rows).alias("place"), "release", "deadline", "slot")


def mix_plan(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 1.0,
             block_rows: int = 16, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """A stored row of id, ``slot`` and ``place`` for every document."""
    return stored(mix_schedule(docs, weights, power, block_rows, id_col=id_col, source_col=source_col)
                  .select(id_col, "slot", "place"), "mix-plan", narrow=True)


def in_mix_order(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` sorted into the mix of ``plan``; rows without a slot
    come last. The texts move twice, by id to meet their slots and then into
    order; the join is the same at every size."""
    own, slot, place = (unused(docs, f"mix_{c}") for c in ("id", "slot", "place"))
    plan = plan.select(F.col(id_col).alias(own), F.col("slot").alias(slot), F.col("place").alias(place))
    return docs.join(plan.hint("merge"), F.col(id_col) == F.col(own), "left").orderBy(
        F.col(slot).asc_nulls_last(), place, F.xxhash64(id_col)).drop(own, slot, place)


def mix_documents(docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 1.0,
                  block_rows: int = 16, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows of ``docs`` sorted into the mix; rows without a slot come last."""
    return in_mix_order(docs, mix_plan(docs, weights, power, block_rows, id_col, source_col), id_col)
