"""Sharding: minimax contiguous partition.

Atomic groups (rows of equal text) stand in a fixed order; the smallest shard
capacity for which greedy filling needs no more than the wanted shards is
found by binary search, and the order is cut there.

The groups stay distributed. The driver only sees a summary: exact cumulative
sizes at a bounded number of points, refined around the places where a greedy
cut can fall until the search is exact (each refinement divides the open gaps
by ``FAN``; 2 or 3 rounds are usual).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running, split_join, stored

#: Points a refinement returns for each open range.
FAN = 2048


class Outline:
    """Known cumulative sizes; a gap is closed when nothing lies inside it."""

    def __init__(self, total: int):
        self.points, self.closed = [0, total], [True, False]  # closed[i]: the gap that ends at points[i]

    def floor(self, x: int, most: bool) -> int:
        """The largest group end <= x: a lower bound, or an upper one if ``most``."""
        i = bisect_right(self.points, x) - 1
        if most and i + 1 < len(self.points) and not self.closed[i + 1]:
            return x
        return self.points[i]

    def greedy(self, capacity: int, shards: int, most: bool) -> list[int]:
        ends, at = [], 0
        for _ in range(shards):
            at = self.floor(at + capacity, most) if at < self.points[-1] else at
            ends.append(at)
        return ends

    def smallest(self, shards: int, most: bool) -> int:
        low, high = -(-self.points[-1] // shards), self.points[-1]
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, shards, most)[-1] >= self.points[-1]:
                high = mid
            else:
                low = mid + 1
        return low

    def open_ranges(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Open gaps that meet one of the spans, neighbours merged."""
        out: list[list[int]] = []
        for i in range(1, len(self.points)):
            a, b = self.points[i - 1], self.points[i]
            if not self.closed[i] and any(lo < b and hi >= a for lo, hi in spans):
                if out and out[-1][1] == a:
                    out[-1][1] = b
                else:
                    out.append([a, b])
        return [(a, b) for a, b in out]

    def add(self, found: list[tuple[int, int, int]], ranges: list[tuple[int, int]]) -> None:
        """``found``: (smallest end, largest end, number of ends) of each non-empty bucket."""
        gaps = dict(zip(self.points, self.closed, strict=True))
        for a, b in ranges:
            for p in [p for p in gaps if a < p < b]:
                gaps.pop(p)
        for least, most, n in found:
            gaps[most] = n <= 2
            gaps[least] = True  # nothing lies between the bucket before and this one's first end
        self.points = sorted(gaps)
        self.closed = [gaps[p] for p in self.points]


def minimax_cuts(total: int, shards: int,
                 look: Callable[[list[tuple[int, int]]], list[tuple[int, int, int]]]) -> tuple[int, list[int]]:
    """Smallest capacity and the shard ends of the greedy cut at it."""
    known = Outline(total)
    while True:
        low, high = known.smallest(shards, True), known.smallest(shards, False)
        most, least = known.greedy(high, shards, True), known.greedy(low, shards, False)
        if low == high and most == least:
            return high, least
        ranges = known.open_ranges(list(zip(least, most, strict=True)))
        known.add(look(ranges), ranges)


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                    fan: int = FAN) -> DataFrame:
    """Put every row into one of ``shards`` shards of near-equal bytes.

    A row's size is the UTF-8 length of its text plus 1 (NULL text: 1). Rows of
    equal text (NULL equals NULL, and differs from the empty text) are an atomic
    group; groups are ordered by their smallest id, a group of NULL ids first.
    Shards are runs of groups, numbered from 0; trailing shards stay empty when
    there are fewer groups. ``slot`` counts a shard's rows from 0 in that order,
    rows of a group by id. Repeated rows are rows of their own. An empty table
    gives an empty result. Other columns of ``docs`` are ignored.

    Columns: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``,
    ``grown_shard`` (NULL: only a key law has it).
    """
    text = F.col(text_col)
    rows = stored(docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("grp")), "shard-rows")
    first = rows.groupBy("grp").agg(F.min("id").alias("first_id"))
    grouped = split_join(rows, first, ["grp"]).select("first_id", "grp", "id", "size", "crc")
    placed = stored(running(grouped, ["first_id", "grp", "id"], {"bytes_to": F.col("size"), "rows_to": F.lit(1)},
                            "shard-order"), "shard-placed")
    ends = stored(placed.groupBy("grp").agg(F.max("bytes_to").alias("end")).select("end"), "shard-ends")
    total = ends.agg(F.max("end")).first()[0] or 0

    def look(ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """At most ``fan`` rows for each range, and at most a range for each cut."""
        at, inside = F.lit(None).cast("long"), F.lit(False)
        for k, (a, b) in enumerate(ranges):
            hit = (F.col("end") > a) & (F.col("end") <= b)
            width = -(-(b - a) // fan)
            at = F.when(hit, k * fan + F.floor((F.col("end") - a - 1) / width)).otherwise(at)
            inside = inside | hit
        got = ends.filter(inside).groupBy(at.alias("bucket")).agg(F.min("end"), F.max("end"), F.count("*"))
        return [tuple(r)[1:] for r in got.collect()]

    _, cuts = minimax_cuts(total, shards, look) if total else (0, [])
    rows_at = {r[0]: r[1] for r in placed.filter(F.col("bytes_to").isin(cuts[:-1] or [0]))
               .select("bytes_to", "rows_to").collect()}  # one row a cut
    shard, start = F.lit(0), F.lit(0).cast("long")
    for k, cut in enumerate(cuts[:-1], 1):
        past = F.col("bytes_to") > cut
        shard = F.when(past, F.lit(k)).otherwise(shard)
        start = F.when(past, F.lit(rows_at.get(cut, 0)).cast("long")).otherwise(start)
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        shard.cast("int").alias("shard"), (F.col("rows_to") - 1 - start).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
