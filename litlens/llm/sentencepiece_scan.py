"""SentencePiece encoding and decoding with a max-plus scan over chunks.

Short texts are encoded as they are. A giant text is split into chunks. The
state at a cut is the piece that covers or ends at it; a chunk yields the
max-plus transfer matrix between the states of its two cuts, the matrices are
combined associatively along the document, and with its entry and exit state
known each chunk is backtraced on its own.

The matrices have the weights 0 and -inf. In byte-pair models a sequence of
pieces is the encoding of its text exactly if every two neighbours are the
encoding of theirs, so a path has weight 0 if all its neighbours agree and
-inf otherwise, and one path per text has weight 0. (A sum of the model's
scores would be maximal for other pieces than the model's own encoding.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import split_join, stored

#: Characters of a chunk; longer texts are split.
CHUNK = 32_768
#: Characters of the first window in which two encodings are joined.
WINDOW = 256
#: Characters of the texts that are encoded in one call.
AT_ONCE = 1 << 20
#: Protobuf field normalizer_spec { add_dummy_prefix: false }, merged into a model.
NO_PREFIX = b"\x1a\x02\x18\x00"
_LOADED: dict[int, Pieces] = {}


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Pieces:
    """A byte-pair model, and what of its encodings the chunks need. Texts here
    are fragments: a document is its text behind one space."""

    def __init__(self, model: bytes):
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.part = sentencepiece.SentencePieceProcessor(model_proto=model + NO_PREFIX)
        n = self.whole.get_piece_size()
        names = [self.whole.id_to_piece(i) for i in range(n)]
        byte = [self.whole.is_byte(i) for i in range(n)]
        # characters of a piece; of a byte-fallback sequence the first byte counts
        self.chars = np.array([int(int(p[3:5], 16) & 0xC0 != 0x80) if b else len(p)
                               for p, b in zip(names, byte)], np.int64)
        self.longest = max(len(p) for p, b in zip(names, byte) if not b)
        self.known: dict[tuple[str, str], bool] = {}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.part.encode(text), np.int64)

    def ends(self, text: str) -> np.ndarray:
        """Ends of the pieces of ``text``, from 0 (the start) on."""
        return np.unique(np.r_[0, np.cumsum(self.chars[self.encode(text)])])

    def agree(self, a: str, b: str) -> bool:
        """Whether the encoding of a + b is the piece a, then the piece b."""
        if (a, b) not in self.known:
            if len(self.known) > 1 << 20:
                self.known.clear()
            self.known[a, b] = self.ends(a + b).tolist() == ([0, len(a), len(a) + len(b)] if b else [0, len(a)])
        return self.known[a, b]

    def states(self, before: str, after: str) -> list[tuple[int, int]]:
        """(start, end) of the pieces that start before a cut and end at or behind it."""
        text, cut = before + after, len(before)
        return [(a - cut, b - cut) for a in range(max(0, cut - self.longest), cut)
                for b in range(cut, min(len(text), a + self.longest) + 1) if self.agree(text[a:b], "")]


def pieces(model: bytes) -> Pieces:
    if hash(model) not in _LOADED:
        _LOADED[hash(model)] = Pieces(model)
    return _LOADED[hash(model)]


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


class Chunk:
    """Characters [start, stop) of a document with their surroundings."""

    def __init__(self, p: Pieces, before: str, text: str, after: str):
        self.p, self.text, self.at, self.stop = p, before + text + after, len(before), len(before) + len(text)
        self.entries = p.states(before, text + after) if before else [(0, 0)]
        self.exits = p.states(before + text, after) if after else [(0, 0)]
        self.first, self.last = not before, not after
        self.base = p.ends(text) + self.at  # piece ends of the chunk alone
        self.on_base = set(self.base.tolist())

    def piece_after(self, at: int) -> str:
        i = int(np.searchsorted(self.base, at, "right"))
        return self.text[at:self.base[i]]

    def piece_before(self, at: int) -> str:
        i = int(np.searchsorted(self.base, at, "left")) - 1
        return self.text[self.base[i]:at]

    def head(self, b: int) -> tuple[str, int]:
        """First piece of the path from ``b``, and where it joins the chunk's own encoding."""
        width = WINDOW
        while True:
            stop = min(b + width, self.stop)
            if b in self.on_base and b < self.stop:
                return self.piece_after(b), b
            ends = (self.p.ends(self.text[b:stop]) + b).tolist()
            for left, at in zip(ends, ends[1:]):
                if at in self.on_base and at < self.stop and self.p.agree(self.text[left:at], self.piece_after(at)):
                    return self.text[b:ends[1]], at
            if stop == self.stop:
                return self.text[b:ends[1]] if len(ends) > 1 else "", self.stop
            width *= 2

    def tail(self, a: int, joined: int, b: int) -> str:
        """Last piece of the path from ``b``, which joins at ``joined``, to ``a``."""
        width = WINDOW
        while True:
            i = int(np.searchsorted(self.base, a - width, "right")) - 1
            if i < 0 or self.base[i] <= joined:
                ends = self.p.ends(self.text[b:a]) + b
                return self.text[ends[-2]:a]
            q = int(self.base[i])
            ends = self.p.ends(self.text[q:a]) + q
            if self.p.agree(self.piece_before(q), self.text[q:ends[1]]):
                return self.text[ends[-2]:a]
            width *= 2

    def matrix(self) -> np.ndarray:
        """Weight of the path from each entry to each exit state."""
        out = np.full((len(self.entries), len(self.exits)), -np.inf, np.float32)
        heads = {b: self.head(self.at + b) for _, b in self.entries}
        tails: dict[tuple[int, int], str] = {}
        for i, (a, b) in enumerate(self.entries):
            piece, joined = heads[b]
            if not self.first and not self.p.agree(self.text[self.at + a:self.at + b], piece):
                continue
            for j, (c, d) in enumerate(self.exits):
                if self.last:
                    out[i, j] = 0
                elif self.at + b < self.stop + c:
                    if (b, c) not in tails:
                        tails[b, c] = self.tail(self.stop + c, joined, self.at + b)
                    if self.p.agree(tails[b, c], self.text[self.stop + c:self.stop + d]):
                        out[i, j] = 0
                elif self.at + b == self.stop + c and self.p.agree(
                        self.text[self.at + a:self.at + b], self.text[self.stop + c:self.stop + d]):
                    out[i, j] = 0
        return out


def best_states(matrices: list[np.ndarray]) -> list[int]:
    """State at each cut on the best path from the document's start to its end."""
    forward = [np.zeros((1, 1), np.float32)]
    for m in matrices:
        forward.append(compose(forward[-1], m))
    backward = [np.zeros((1, 1), np.float32)]
    for m in reversed(matrices):
        backward.append(compose(m, backward[-1]))
    score = [(f[0] + b[:, 0]) for f, b in zip(forward, reversed(backward))]
    if not all(np.isfinite(s).any() for s in score):
        raise RuntimeError("no path through the chunks: the model is not a byte-pair model")
    return [int(s.argmax()) for s in score]


def split_text(text: str, chunk: int, margin: int) -> list[tuple[str, str, str]]:
    """(before, text, after) of each chunk; the last one is never short."""
    cuts = list(range(0, max(1, len(text) - chunk // 2), chunk)) + [len(text)]
    return [(text[max(0, a - margin):a], text[a:b], text[b:b + margin]) for a, b in zip(cuts, cuts[1:])]


def _encode_short(texts: DataFrame, model: bytes, kind: str) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)

        def made(rows: list[int], part: list[str | None]) -> pa.RecordBatch:
            ids = iter(p.whole.encode([t for t in part if t is not None], num_threads=1))
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)),
                 pa.array([None if t is None else next(ids) for t in part], pa.list_(pa.int32()))], ["id", "ids"])

        for batch in batches:
            rows, part, chars = [], [], 0
            for r, t in enumerate(batch.column(1)):
                t = t.as_py()
                rows.append(r)
                part.append(t)
                chars += len(t or "")
                if chars >= AT_ONCE:
                    yield made(rows, part)
                    rows, part, chars = [], [], 0
            if rows:
                yield made(rows, part)

    return texts.mapInArrow(of, f"id {kind}, ids array<int>")


def _encode_giant(giant: DataFrame, model: bytes, chunk: int) -> DataFrame:
    """``key, ids`` of the distinct giant texts; ``giant`` has ``key, text``."""
    spark = giant.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "key binary, k int, before string, body string, after string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = pieces(model).longest
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                parts = split_text(" " + text.as_py(), chunk, margin)
                for at in range(0, len(parts), 64):
                    some = parts[at:at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()] * len(some), pa.binary()),
                         pa.array(range(at, at + len(some)), pa.int32()), *map(pa.array, zip(*some))],
                        ["key", "k", "before", "body", "after"])

    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                c = Chunk(p, r.before, r.body, r.after)
                m = c.matrix()
                rows.append((r.key, r.k, [b for _, b in c.entries], [d for _, d in c.exits], m.shape[0],
                             np.isfinite(m).tobytes()))
            yield pd.DataFrame(rows, columns=["key", "k", "entry", "exit", "height", "open"])

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        states = best_states([np.where(np.frombuffer(m, bool).reshape(h, -1), 0, -np.inf).astype(np.float32)
                              for m, h in zip(group["open"], group["height"])])
        return pd.DataFrame({"key": group["key"], "k": group["k"],
                             "b": [e[s] for e, s in zip(group["entry"], states)],
                             "d": [x[s] for x, s in zip(group["exit"], states[1:])]})

    def backtrace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model)
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "k": batch["k"], "ids": [
                p.encode((r.body + r.after)[r.b:len(r.body) + r.d]).astype(np.int32)
                for r in batch.itertuples()]})

    chunks = stored(giant.groupBy("key").agg(F.first("text").alias("text")).mapInArrow(cut, schema)
                    .repartition(width, "key", "k"), "pieces-chunks")
    matrices = chunks.mapInPandas(
        transfer, "key binary, k int, entry array<int>, exit array<int>, height int, open binary")
    # a cell of Spark has at most 2 GiB, so a document has at most 65,536 chunks of 32,768 characters,
    # whose matrices (a byte a weight) are all that one group holds
    states = matrices.groupBy("key").applyInPandas(scan, "key binary, k int, b int, d int")
    traced = split_join(chunks, states, ["key", "k"]).mapInPandas(backtrace, "key binary, k int, ids array<int>")
    return traced.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts")).select(
        "key", F.flatten("parts.ids").alias("ids"))


def encode(docs: DataFrame, model: bytes, chunk: int = CHUNK, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """id and ``ids``, the piece ids of every row's text, as the model's own
    library gives them for the whole text. NULL text: NULL; empty text: an
    empty array. Texts of over ``chunk`` characters go through the scan, equal
    ones once. NULL ids and repeated rows are rows of their own; an empty table
    gives an empty result; other columns of ``docs`` are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    giant = rows.filter(long).select("id", F.unhex(F.sha2("text", 256)).alias("key"), "text")
    short = _encode_short(rows.filter(~long), model, kind)
    made = split_join(giant.select("id", "key"), _encode_giant(giant.select("key", "text"), model, chunk), ["key"])
    return short.unionByName(made.select("id", "ids")).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``text`` of every row of piece ids (NULL: NULL, none: empty). The
    inverse of :func:`encode`, but for U+2581, which the model reads as a space."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids = batch.column(1).slice(at, 500)
                flat = ids.flatten().to_pylist() if ids.flatten().null_count else ids.flatten().to_numpy().tolist()
                ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
                text = [p.whole.decode(flat[a:z]) if ok else None
                        for a, z, ok in zip([0, *ends], ends, ids.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array(text, pa.string())],
                                                 ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(
        of, f"id {kind}, text string").withColumnRenamed("id", id_col)
