"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document.
Expectation-maximisation over the vote patterns of the whole corpus estimates
how accurate each labeller is, without any true label. The posterior of a
document's pattern is the target of a hashed linear scorer, trained on a
bounded sample, and the scorer decides on every document.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, stored

#: Votes.
ABSTAIN, BAD, GOOD = 0, 1, 2
#: Documents the scorer is trained on: those of the smallest id hashes.
SAMPLE = 8_000
#: Hash buckets of the scorer; the last one takes repeated words.
BUCKETS = 1 << 12
#: Where the estimation starts: the accuracy of a bad and of a good vote, and
#: the share of good documents. A bad vote names a defect and is taken to be
#: right more often than a good one, which only finds none: the ranges that
#: accuracies (and the share) may take keep the votes of one kind of junk from
#: being outvoted by the many good votes of the corpus.
START, START_GOOD = {BAD: 0.9, GOOD: 0.7}, 0.7
RANGE, SHARE_RANGE = {BAD: (0.8, 0.98), GOOD: (0.55, 0.8)}, (0.05, 0.8)
SYMBOLS = np.frombuffer(b"#$%&*|<>{}[]=+^~\\/@_", np.uint8)
SYMBOL_SET = frozenset(SYMBOLS.tolist())
LABELLERS = ("symbols", "symbol_bytes", "symbol_ends", "capitals", "bangs", "stops", "repeats", "near_repeats",
             "squeezed", "lines", "length", "prose", "varied")


def votes(text: str | None) -> list[int]:
    """One vote per labeller, over the whole text. All but the last two say
    bad or abstain, and each kind of junk is seen by several of them."""
    raw = (text or "").encode()
    words = raw.translate(ASCII_LOWER).split()
    n = len(words)
    if not n:
        return [BAD if name == "length" else ABSTAIN for name in LABELLERS]
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = seen[97:123].sum() + seen[65:91].sum() + seen[128:].sum()
    symbols, stops = seen[SYMBOLS].sum(), seen[[33, 46, 63]].sum() / n
    size = (len(raw) - seen[32] - seen[9:14].sum()) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ratio = len(raw) / len(zlib.compress(raw, 1))
    bad = [
        symbols / n > 0.25,
        symbols / len(raw) > 0.03,
        sum(w[-1] in SYMBOL_SET for w in words) / n > 0.2,
        seen[65:91].sum() / max(1, letters) > 0.4,
        seen[33] / n > 0.2,
        n >= 20 and stops > 0.6,
        sum(map(operator.eq, words, words[1:])) / n > 0.3 and n >= 8,
        sum(map(operator.eq, words, words[2:])) / n > 0.4 and n >= 8,
        ratio > 8,
        len(lines) >= 4 and len(set(lines)) / len(lines) < 0.6,
        n < 3,
    ]
    good = [n >= 40 and 0.02 <= stops <= 0.35 and 3 <= size <= 10, n >= 40 and ratio < 4]
    return [BAD if x else ABSTAIN for x in bad] + [GOOD if x else ABSTAIN for x in good]


def vote_table(docs: DataFrame) -> DataFrame:
    """``id, pattern``: the votes of each ``id, text`` row as digits of base 3."""
    place = 3 ** np.arange(len(LABELLERS))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array([votes(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, len(LABELLERS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((v @ place).astype(np.int32))], ["id", "pattern"])

    return docs.mapInArrow(of, f"id {docs.schema['id'].dataType.simpleString()}, pattern int")


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good per vote pattern (rows of ``patterns``), and the
    accuracy of each labeller: how often a vote of it is right. How often a
    labeller abstains is taken to tell nothing about the document."""
    says_good, says_bad = patterns == GOOD, patterns == BAD
    cast = counts @ (says_good | says_bad)
    mainly = np.where(counts @ says_good > counts @ says_bad, GOOD, BAD)
    accuracy = np.array([START[k] for k in mainly])
    low, high = np.array([RANGE[k] for k in mainly]).T
    prior, q = START_GOOD, np.full(len(patterns), 2.0)
    for _ in range(rounds):
        odds = np.log(accuracy / (1 - accuracy))
        new = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + says_good @ odds - says_bad @ odds)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
        right = counts * q @ says_good + counts * (1 - q) @ says_bad
        accuracy = np.clip((right + 1) / (cast + 2), low, high)
        prior = np.clip(counts @ q / counts.sum(), *SHARE_RANGE)
    return q, accuracy


def features(text: str | None) -> np.ndarray | None:
    """Roots of the shares of hashed byte trigrams, and of repeated words; None without words."""
    raw = (text or "").encode()
    words = raw.translate(ASCII_LOWER).split()
    if not words:
        return None
    b = np.frombuffer(b"\n" + raw + b"\n", np.uint8).astype(np.uint32)
    mixed = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D))
    at = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(20)
    out = np.bincount(np.minimum(at, BUCKETS - 2), minlength=BUCKETS) / len(at)
    out[-1] = sum(map(operator.eq, words, words[1:])) / len(words)
    return np.sqrt(out)


def train(x: np.ndarray, target: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Weights and bias of a logistic scorer for soft targets (Adam, full batches)."""
    w, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, rounds + 1):
        off = (1 / (1 + np.exp(-(x @ w[:-1].astype(x.dtype) + w[-1]))) - target).astype(x.dtype)
        g = np.r_[off @ x / len(x) + decay * w[:-1], off.mean()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict[str, float]]:
    """Scorer weights for the ``id, text`` rows, and the labellers' accuracies."""
    table = stored(vote_table(docs), "quality-votes")
    seen = table.groupBy("pattern").count().collect()  # at most 2 ** 13 rows
    none = np.zeros(BUCKETS + 1)
    if not seen:
        return none, {}
    digits = np.array([[r.pattern // 3 ** k % 3 for k in range(len(LABELLERS))] for r in seen])
    q, accuracy = em(digits, np.array([r["count"] for r in seen], float))
    posterior = {r.pattern: float(p) for r, p in zip(seen, q)}
    chosen = table.filter("id is not null").orderBy(F.xxhash64("id"), "id").limit(sample).dropDuplicates(["id"])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at, value = [], [], []
            for r, t in enumerate(b.column(2)):
                x = features(t.as_py())
                if x is not None:
                    rows.append(r)
                    at.append(np.flatnonzero(x).astype(np.uint16).tobytes())
                    value.append(x[x > 0].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array([posterior[p.as_py()] for p in
                                                                       b.column(1).take(pa.array(rows, pa.int64()))],
                                                                      pa.float64()),
                 pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["id", "target", "at", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["id"], r["target"], r["at"], r["value"]) for b in batches for r in b.to_pylist()),
                      key=lambda r: r[0])
        if rows:
            x = np.zeros((len(rows), BUCKETS), np.float32)
            for k, (_, _, at, value) in enumerate(rows):
                x[k, np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
            w = train(x, np.array([r[1] for r in rows], np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([w.tolist()])], ["w"])

    kind = docs.schema["id"].dataType.simpleString()
    made = docs.join(F.broadcast(chosen), "id").select("id", "pattern", "text").mapInArrow(  # `sample` rows
        sparse, f"id {kind}, target double, at binary, value binary")
    got = made.repartition(1).mapInArrow(learn, "w array<double>").collect()  # the sample in one task
    weights = np.array(got[0].w) if got else none
    return weights, dict(zip(LABELLERS, accuracy.tolist()))


def quality_scores(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.4, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Score and decision for every row.

    Returns id, ``score`` (0 to 1) and ``kept`` (the score reaches
    ``threshold``). A text without words (also NULL) scores 0. The scorer is
    fitted here, on at most ``sample`` rows with an id; the labellers' votes
    are counted over all rows. Rows without an id and repeated rows are scored
    like others. An empty table gives an empty result; other columns of
    ``docs`` are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    weights, _ = fit(rows, sample)
    return score_with(rows, weights, threshold).withColumnRenamed("id", id_col)


def _scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for r, t in enumerate(texts):
        x = features(t.as_py())
        if x is not None:
            out[r] = 1 / (1 + np.exp(-(x @ weights[:-1] + weights[-1])))
    return out


def score_with(rows: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _scores(b.column(1), weights)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(s >= threshold)],
                                             ["id", "score", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(of, f"id {kind}, score double, kept boolean")


def keep_good(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.4, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``."""
    weights, _ = fit(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), sample)
    at, schema = docs.columns.index(text_col), docs.schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(b.column(at), weights) >= threshold))

    return docs.mapInArrow(of, schema)
