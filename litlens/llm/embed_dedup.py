"""Embedding near-dedup with randomised-rotation binary codes.

A vector's code is the signs of its rotated unit vector, stored with the inner
product of the code and the vector. The code of one vector and the rotated
other one give an unbiased estimate of their cosine with a confidence bound
that depends on the stored factor; only pairs whose bound reaches the
threshold are recomputed, in double precision.

Candidates are pairs that agree in one of several bands of sign bits. A pair
is handled in the first band in which it agrees, so links are counted where
they are found and never gathered as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, small_or_plain, split_join, stored
from .components import components

#: Bands and their bits: at a cosine of 0.95 two vectors agree in a bit with
#: probability 0.899, and in one band of 24 with probability 0.992.
BANDS, BAND_BITS = 24, 16
#: Width of the confidence interval; RaBitQ's bound fails with a probability
#: that falls as exp(-c * EPSILON ** 2).
EPSILON = 4.0
SEED = 20240607
#: Members of a band's bucket that one task compares; larger buckets are tiled.
TILE = 2048
#: Groups up to this size are compared row by lagged row.
SMALL_GROUP = 16
#: Rows of held groups that are worked on together.
ROWS_AT_ONCE = 20_000


@cache
def rotations(dim: int) -> tuple[np.ndarray, ...]:
    """Enough random rotations for the bits of all bands."""
    rng = np.random.default_rng([SEED, dim])
    out = []
    for _ in range(-(-BANDS * BAND_BITS // dim)):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return tuple(out)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys (rows x BANDS), packed codes and correction factors."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    dim, turned = unit.shape[1], [unit @ r.T for r in rotations(unit.shape[1])]
    bits = np.hstack([t >= 0 for t in turned])[:, :BANDS * BAND_BITS]
    keys = bits.reshape(len(unit), BANDS, BAND_BITS) @ (1 << np.arange(BAND_BITS))
    factor = np.abs(turned[0]).sum(axis=1) / np.sqrt(dim)
    return keys.astype(np.uint16), np.packbits(turned[0] >= 0, axis=1), factor


class Group:
    """Rows of one dimension with what the estimates need."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray, factor: np.ndarray, keys: np.ndarray,
                 threshold: float):
        dim = vectors.shape[1]
        self.vectors, self.keys, self.threshold = vectors, keys, threshold
        self.norm = np.sqrt((vectors * vectors).sum(axis=1))
        self.code = (np.unpackbits(codes, axis=1)[:, :dim] * 2.0 - 1) / np.sqrt(dim) / factor[:, None]
        self.turned = (vectors / self.norm[:, None]) @ rotations(dim)[0].T
        self.bound = EPSILON * np.sqrt(np.maximum(0, 1 - factor ** 2)) / factor / np.sqrt(max(1, dim - 1)) + 1e-9

    def linked(self, i: np.ndarray, j: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) are links that no earlier band has."""
        estimate = np.einsum("ij,ij->i", self.code[i], self.turned[j])
        ok = np.flatnonzero(estimate + self.bound[i] >= self.threshold)
        out = np.zeros(len(i), bool)
        out[ok] = self._exact(i[ok], j[ok], band[ok])
        return out

    def _exact(self, i: np.ndarray, j: np.ndarray, band: np.ndarray) -> np.ndarray:
        met = self.keys[i] == self.keys[j]
        first = met.argmax(axis=1) == band
        out = np.zeros(len(i), bool)
        i, j = i[first], j[first]
        out[first] = np.einsum("ij,ij->i", self.vectors[i], self.vectors[j]) / (self.norm[i] * self.norm[j]) \
            >= self.threshold
        return out

    def linked_block(self, rows: np.ndarray, columns: np.ndarray, band: int) -> np.ndarray:
        """The same for all rows x columns of one bucket."""
        estimate = self.code[rows] @ self.turned[columns].T
        out = np.zeros(estimate.shape, bool)
        r, c = np.nonzero(estimate + self.bound[rows][:, None] >= self.threshold)
        out[r, c] = self._exact(rows[r], columns[c], np.full(len(r), band))
        return out


def bucket_links(g: Group, band: np.ndarray, start: np.ndarray, size: np.ndarray, part: np.ndarray,
                 weight: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Weighted links of every row inside its group, and pairs that connect
    what is linked. ``part`` is 0 or 1 in a tile of two parts, else -1: then
    all pairs of the group count."""
    n = np.zeros(len(band), np.int64)
    edges = []
    member = np.repeat(size, size)
    rest = np.repeat(start + size, size) - np.arange(len(band))
    for lag in range(1, SMALL_GROUP):
        i = np.flatnonzero((rest > lag) & (member <= SMALL_GROUP))
        if not i.size:
            break
        i = i[(part[i] < 0) | (part[i] != part[i + lag])]
        i = i[g.linked(i, i + lag, band[i])]
        np.add.at(n, i, weight[i + lag])
        np.add.at(n, i + lag, weight[i])
        edges.append((i, i + lag))
    for at, m in zip(start[size > SMALL_GROUP], size[size > SMALL_GROUP]):
        rows = np.arange(at, at + m)
        label = np.arange(m)
        left, right = (rows, rows) if part[at] < 0 else (rows[part[rows] == 0], rows[part[rows] == 1])
        for k in range(0, len(left), 512):
            some = left[k:k + 512]
            hit = g.linked_block(some, right, int(band[at]))
            if part[at] < 0:
                hit &= some[:, None] < right[None, :]
            n[some] += hit @ weight[right]
            n[right] += weight[some] @ hit
            for r, h in zip(some - at, hit):
                if h.any():
                    seen = label[right[h] - at]
                    if (seen != label[r]).any():
                        low = min(seen.min(), label[r])
                        label[np.isin(label, np.r_[seen, label[r]])] = low
        moved = np.flatnonzero(label != np.arange(m))
        edges.append((rows[moved], rows[label[moved]]))
    return n, edges


def _index(groups: DataFrame, wide: bool) -> DataFrame:
    """A row for each vector and band."""
    kind = np.float64 if wide else np.float32

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [np.array(v.as_py(), kind) for v in b.column(2)]
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for k in range(0, len(at), 1000):
                    rows = at[k:k + 1000]
                    v = np.stack([vectors[r] for r in rows])
                    keys, codes, factor = encode(v.astype(np.float64))
                    every, pick = np.repeat(np.arange(len(rows)), BANDS), pa.array(np.repeat(rows, BANDS))
                    as_bytes = [pa.array([x.tobytes() for x in c]).take(pa.array(every)) for c in (keys, codes, v)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(every), dim, np.int32)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32),
                                                                                       len(rows))),
                         pa.array(keys.reshape(-1).astype(np.int32)), b.column(0).take(pick), b.column(1).take(pick),
                         pa.array(factor[every]), *as_bytes],
                        ["dim", "band", "key", "node", "n", "factor", "keys", "code", "vector"])

    return groups.select("node", "n", "vector").mapInArrow(
        of, "dim int, band int, key int, node long, n long, factor double, keys binary, code binary, vector binary")


def _tiled(index: DataFrame) -> DataFrame:
    """Buckets above TILE rows are cut into parts, and a row goes to each pair
    of parts that has its own: every pair of a bucket meets in one tile."""
    sizes = stored(index.groupBy("dim", "band", "key").count().filter(F.col("count") > TILE)
                   .withColumn("parts", F.ceil(F.col("count") / TILE).cast("int")).drop("count"), "embed-hot")
    joined = index.join(small_or_plain(sizes), ["dim", "band", "key"], "left")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    tiles = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                    lambda q: F.struct(F.least(F.col("mine"), q).alias("a"), F.greatest(F.col("mine"), q).alias("b"))))
    return joined.withColumn("mine", mine).withColumn("tile", F.explode(tiles)).select(
        "dim", "band", "key", F.col("tile.a").alias("a"), F.col("tile.b").alias("b"),
        F.when(F.col("tile.a") == F.col("tile.b"), -1).when(F.col("mine") == F.col("tile.a"), 0).otherwise(1)
        .cast("int").alias("part"), "node", "n", "factor", "keys", "code", "vector")


GROUP_KEYS = ["dim", "band", "key", "a", "b"]


def _links(tiled: DataFrame, threshold: float, wide: bool) -> DataFrame:
    """``node, other, n``: counts (other is NULL) and connecting pairs (n is NULL)."""
    kind = np.float64 if wide else np.float32

    def work(table: pa.Table) -> pa.RecordBatch:
        ids = [table.column(c).to_numpy() for c in GROUP_KEYS]
        change = np.logical_or.reduce([c[1:] != c[:-1] for c in ids]) if len(ids[0]) > 1 else np.zeros(0, bool)
        start = np.flatnonzero(np.r_[True, change])
        size = np.diff(np.r_[start, len(ids[0])])
        keep = np.repeat(size > 1, size)
        node, weight, out = table.column("node").to_numpy(), table.column("n").to_numpy(), []
        if keep.any():
            table = table.filter(pa.array(keep))
            size = size[size > 1]
            start = np.r_[0, np.cumsum(size)[:-1]]
            dims = table.column("dim").to_numpy()
            node, weight = table.column("node").to_numpy(), table.column("n").to_numpy()
            raw = {c: table.column(c).to_pylist() for c in ("vector", "code", "keys")}
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)  # rows of a dimension stand together
                lo, hi = int(at[0]), int(at[-1]) + 1
                mine = (start >= lo) & (start < hi)
                rows = slice(lo, hi)
                g = Group(np.frombuffer(b"".join(raw["vector"][rows]), kind).reshape(hi - lo, -1).astype(np.float64),
                          np.frombuffer(b"".join(raw["code"][rows]), np.uint8).reshape(hi - lo, -1),
                          table.column("factor").to_numpy()[rows],
                          np.frombuffer(b"".join(raw["keys"][rows]), np.uint16).reshape(hi - lo, -1), threshold)
                n, edges = bucket_links(g, table.column("band").to_numpy()[rows], start[mine] - lo, size[mine],
                                        table.column("part").to_numpy()[rows], weight[rows])
                own = node[rows]
                some = np.flatnonzero(n)
                out.append((own[some], None, n[some]))
                out += [(own[i], own[j], None) for i, j in edges if len(i)]
        column = lambda k: pa.array([], pa.int64()) if not out else pa.concat_arrays(
            [pa.nulls(len(x[0]), pa.int64()) if x[k] is None else pa.array(x[k], pa.int64()) for x in out])
        return pa.RecordBatch.from_arrays([column(0), column(1), column(2)], ["node", "other", "n"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS_AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            ids = [table.column(c).to_numpy() for c in GROUP_KEYS]
            other = np.logical_or.reduce([c != c[-1] for c in ids])
            tail = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0  # the last group may go on
            if tail:
                yield work(table.slice(0, tail))
                held = table.slice(tail).to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    n = shuffle_width(tiled.sparkSession)
    return tiled.repartition(n, *GROUP_KEYS).sortWithinPartitions(*GROUP_KEYS).mapInArrow(
        of, "node long, other long, n long")


def embedding_links(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """Near-duplicate vectors by cosine.

    Returns id, ``n_links`` (other rows linked directly), ``component_id``
    (smallest id reachable by links, itself included) and ``kept`` (it is its
    own component). Vectors that are NULL, empty, zero, or hold a NULL or
    non-finite component link with nothing, and vectors of other dimensions
    are not compared. Rows of an equal vector link with each other, also rows
    that repeat an id; they are compared once with the others. Ids are longs;
    a row without an id links with nothing (component NULL, kept). An empty
    table gives an empty result; other columns are ignored.
    """
    vector = F.col(vector_col)
    wide = vectors.schema[vector_col].dataType.elementType.simpleString() != "float"
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col(id_col).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(good, vector).alias("vector"))
    sound = rows.filter("vector is not null")
    groups = stored(sound.groupBy("vector").agg(F.min("id").cast("long").alias("node"), F.count("*").alias("n")),
                    "embed-groups")
    found = stored(_links(_tiled(stored(_index(groups, wide), "embed-index")), threshold, wide), "embed-links")
    counts = found.filter("n is not null").groupBy("node").agg(F.sum("n").alias("links"))
    parts = components(found.filter("other is not null"), "node", "other")
    named = groups.join(counts, "node", "left").join(parts, "node", "left").select(
        "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    out = split_join(sound, named, ["vector"]).select("id", "n_links", "component_id").unionByName(
        rows.filter("vector is null").select("id", F.lit(0).cast("long").alias("n_links"),
                                             F.col("id").cast("long").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
