"""SimHash near-dedup with deletion-variant signatures.

With at most 2k differing bits and k + 1 segments, one segment differs by at
most one bit. Each fingerprint is indexed once per segment as it is, and once
per bit with that bit as a wildcard; fingerprints that meet under an equal key
are verified by their distance. Equal fingerprints are one node, so copies are
never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, split_join, stored, text_hash, without_rows
from .components import components

SEED = 42
#: Groups up to this size are compared pair by pair, larger ones by search.
SMALL_GROUP = 16
#: Shingle hashes whose bits are summed at once.
HASHES_AT_ONCE = 1 << 15


def fingerprint(text: str | None, width: int) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 without words."""
    words = (text or "").encode().translate(ASCII_LOWER).split()  # splits on 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=edges[1:])
    starts, stops = edges[:n].tolist(), (edges[min(width, len(words)):] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        part = zip(starts[at:at + HASHES_AT_ONCE], stops[at:at + HASHES_AT_ONCE])
        h = np.array([xxhash.xxh64_intdigest(joined[a:z], SEED) for a, z in part], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id, h, fp`` for every row: a hash of the text as it stands, and the 64
    bits as a long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["id", "h", "fp"])

    return docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("h"), F.col(text_col).alias("text")).mapInArrow(
        of, f"id {kind}, h long, fp long")


def variants(max_bits: int) -> list[tuple[int, int, int]]:
    """(number, mask, wildcard bit or -1) of every key of a fingerprint."""
    count = max_bits // 2 + 1
    cuts = [64 * k // count for k in range(count + 1)]
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        whole = ((1 << hi) - 1) ^ ((1 << lo) - 1)
        out += [(whole, -1)] + [(whole & ~(1 << i), i) for i in range(lo, hi)]
    return [(k, mask - (1 << 64) if mask >> 63 else mask, bit) for k, (mask, bit) in enumerate(out)]


def _forest(fp: np.ndarray, node: np.ndarray, max_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join what is linked inside one group: each member joins once."""
    left, a, b = np.arange(len(fp)), [], []
    while left.size:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= max_bits
            if near.any():
                hit, left = left[near], left[~near]
                a.append(np.full(hit.size, node[at]))
                b.append(node[hit])
                queue.extend(hit)
    return a, b


def _links(v: np.ndarray, key: np.ndarray, fp: np.ndarray, node: np.ndarray, bit: np.ndarray,
           max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside whole groups of rows sorted by (v, key). ``bit`` is the
    wildcard bit (-1: none); pairs equal there meet under the plain key."""
    new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (key[1:] != key[:-1])])
    size = np.diff(np.r_[new, len(v)])
    a, b = [], []
    member = np.repeat(size, size)
    rest = np.repeat(new + size, size) - np.arange(len(v))  # rows of the group from here on
    for lag in range(1, SMALL_GROUP):
        i = np.flatnonzero((rest > lag) & (member <= SMALL_GROUP))
        if not i.size:
            break
        x = fp[i] ^ fp[i + lag]
        ok = np.bitwise_count(x) <= max_bits
        wild = bit[i]
        ok &= (wild < 0) | (((x >> np.maximum(wild, 0).astype(np.uint64)) & np.uint64(1)) == 1)
        a.append(node[i[ok]])
        b.append(node[i[ok] + lag])
    for at, n in zip(new[size > SMALL_GROUP], size[size > SMALL_GROUP]):
        more = _forest(fp[at:at + n], node[at:at + n], max_bits)
        a += more[0]
        b += more[1]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp, node`` that give
    the same connected components as all links of at most ``max_bits``."""
    wild = {k: bit for k, _, bit in variants(max_bits)}
    each = F.array(*[F.struct(F.lit(k).alias("v"), F.lit(mask).cast("long").alias("mask"))
                     for k, mask, _ in variants(max_bits)])
    keyed = nodes.select("fp", "node", F.inline(each)).select(
        "v", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "node")
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.array([wild[k] for k in range(len(wild))])
        held: list[list[np.ndarray]] = []

        def done(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _links(rows[0], rows[1], rows[2].view(np.uint64), rows[3], bits[rows[0]], max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(rows[0]):
                continue
            # rows of the last group wait for the next batch
            tail = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1:].sum() + 1) \
                if (rows[0][0], rows[1][0]) != (rows[0][-1], rows[1][-1]) else 0
            if held and (tail or (held[0][0][0], held[0][1][0]) != (rows[0][0], rows[1][0])):
                whole = [np.concatenate(c) for c in zip(*held, [c[:tail] for c in rows])]
                held = []
                if len(whole[0]):
                    yield done(whole)
            elif tail:
                yield done([c[:tail] for c in rows])
            held.append([c[tail:] for c in rows])
        if held:
            yield done([np.concatenate(c) for c in zip(*held)])

    return keyed.repartition(width, "v", "key").sortWithinPartitions("v", "key").mapInArrow(meet, "a long, b long")


def simhash_components(docs: DataFrame, width: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Fingerprint and connected component of every row.

    Returns id, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest id reachable over links of at most ``max_bits`` differing bits.
    A text without words (also NULL) has the fingerprint zero, which links like
    any other. Ids are longs; a row without an id takes the component of its
    fingerprint, NULL if no row with an id has it. Repeated rows agree. An
    empty table gives an empty result; other columns of ``docs`` are ignored.
    """
    return _components(docs, width, max_bits, id_col, text_col).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(docs: DataFrame, width: int, max_bits: int, id_col: str, text_col: str) -> DataFrame:
    """``id, h, fp, component_id`` of every row."""
    rows = stored(fingerprints(docs, width, id_col, text_col), "simhash-rows")
    # a fingerprint is its own node: ids may clash
    nodes = stored(rows.groupBy("fp").agg(F.min("id").cast("long").alias("least"))
                   .select("fp", F.col("fp").alias("node"), "least"), "simhash-nodes", narrow=True)
    found = components(links(nodes.filter("least is not null").drop("least"), max_bits))
    placed = nodes.join(found, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = split_join(placed, smallest, ["component"]).select("fp", "component_id")
    return split_join(rows, named, ["fp"]).select("id", "h", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, of
    equal ids the one with the least text hash. Ids that clash keep their texts
    apart; rows that repeat both id and text stay or go together; rows without
    an id stay."""
    found = stored(_components(docs, width, max_bits, id_col, text_col).filter("id is not null")
                   .select("id", "h", "component_id").distinct(), "simhash-found", narrow=True)
    first = found.filter("id = component_id").groupBy("component_id").agg(F.min("h").alias("first"))
    gone = stored(split_join(found, first, ["component_id"]).filter("id != component_id or h != first").select("id", "h"),
                  "simhash-gone", narrow=True)
    return without_rows(docs, gone, id_col, text_hash(text_col))
