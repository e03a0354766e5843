"""Language ID with error-correcting output codes.

Every language has a codeword of +1 and -1 bits. A bit is predicted by a binary
classifier over hashed character n-grams: the log-odds of the n-grams among the
languages with the bit set against the others, counted over all texts to learn
from. Decoding takes the language whose codeword has the least loss, each bit's
loss weighted by how often it was right for that language (loss-weighted
decoding). A text is ambiguous where the bits by themselves are nearer to
another codeword, or nearly as near.

Texts are read twice: once to count, once for the margins of the bits, which are
stored; weights, scales and predictions come from the stored margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_or_plain, stored

UNDETERMINED = "und"
#: n-grams of 1 to this many characters, inside a word and its two borders.
LONGEST = 4
SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
#: Added to the count of every slot.
SMOOTHING = 0.5
#: Characters whose n-grams are made at once; a longer text is cut behind a
#: non-letter, which no n-gram spans, or after so many letters without one.
WINDOW = 1 << 17
#: Languages up to which every split of them into two sets is a bit.
EXHAUSTIVE = 6
#: Steepness of a bit's loss in its margin; the best is chosen per bit.
SCALES = tuple(2.0 ** k for k in range(-5, 3))
#: Languages whose counts a task holds before it hands them on.
HELD_LANGUAGES = 64

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Each code point as itself if it is a letter, else as a space."""
    if not _letters:
        points = np.arange(0x110000, dtype=np.uint32)
        is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _letters.append(np.where(is_letter, points, np.uint32(32)))
    return _letters[0]


def windows(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > WINDOW:
        stop = at + WINDOW
        while stop > at and text[stop - 1].isalpha():
            stop -= 1
        stop = stop if stop > at else at + WINDOW
        yield text[at:stop]
        at = stop
    yield text[at:]


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Slots of the n-grams that start at each normalised character (``SLOTS``
    where there is none) for each n, the first character of every text, and the
    letters of every text. No n-gram spans two words."""
    low = [" " + t.lower() for t in texts]
    starts = np.cumsum([0, *map(len, low)])[:-1]
    raw = letter_table()[np.frombuffer(("".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = raw == 32
    keep = np.ones(len(raw), bool)
    np.logical_not(space[1:] & space[:-1], out=keep[1:])
    first = (np.cumsum(keep) - 1)[starts]
    a, space = raw[keep], space[keep]
    out, h, inner = [], np.zeros(len(a), np.uint32), np.zeros(len(a), bool)
    for n in range(1, LONGEST + 1):
        m = len(a) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193)
        h += a[n - 1:]
        s = h ^ (h >> np.uint32(15))
        s *= np.uint32(0x9E3779B1)
        s >>= np.uint32(32 - SLOT_BITS)
        if n == 1:
            off = space[:m]
        else:
            if n > 2:
                inner = inner[:m] | space[n - 2:n - 2 + m]
            off = inner[:m]
        slots = np.full(len(a), SLOTS, np.uint32)
        slots[:m] = np.where(off, np.uint32(SLOTS), s)
        out.append(slots)
    letters = np.diff(np.r_[0, np.cumsum(~space)][np.r_[first, len(a)]])
    return out, first, letters


def codewords(count: int) -> np.ndarray:
    """A row of +1 and -1 a language. Up to ``EXHAUSTIVE`` languages every split
    is a bit; beyond, 10 random bits per doubling, the best separated of 100."""
    if count < 2:
        return np.ones((count, 0), np.int8)
    if count <= EXHAUSTIVE:
        return np.array([[1 if m >> k & 1 else -1 for m in range(1, 1 << (count - 1))] for k in range(count)], np.int8)
    bits, best, far = 10 * int(np.ceil(np.log2(count))), None, -1
    for seed in range(100):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (count, bits))
        same = code.astype(np.int32) @ code.T.astype(np.int32) - 2 * bits * np.eye(count, dtype=np.int32)
        distance = (bits - int(same.max())) // 2
        if distance > far and (np.abs(code.sum(0, dtype=np.int64)) < count).all():
            best, far = code, distance
    return best


@dataclass(frozen=True)
class LanguageModel:
    """``langs`` and their ``code``; ``odds`` of every slot for every bit (the
    last row is zero); ``trust``: weight of a bit for a language; ``scale``."""
    langs: tuple[str, ...]
    code: np.ndarray
    odds: np.ndarray
    trust: np.ndarray
    scale: np.ndarray

    @property
    def apart(self) -> int:
        """The least distance of two codewords."""
        if len(self.langs) < 2:
            return 0
        return min(int((self.code[i] != self.code[k]).sum()) for i in range(len(self.langs)) for k in range(i))


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang, slot, n``: n-grams of all texts with a language. A task holds one
    array of counts for each of up to ``HELD_LANGUAGES`` languages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n[:SLOTS])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())],
                    ["lang", "slot", "n"])
            held.clear()

        for b in batches:
            waiting: dict[str, list[str]] = {}
            sizes: dict[str, int] = {}

            def add(lang: str) -> None:
                n = held.setdefault(lang, np.zeros(SLOTS + 1, np.int64))
                for slots in grams(waiting.pop(lang))[0]:
                    n += np.bincount(slots, minlength=SLOTS + 1)
                sizes[lang] = 0

            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                for part in windows(text.as_py()):
                    waiting.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    if sizes[lang] >= WINDOW:
                        add(lang)
            for lang in list(waiting):
                add(lang)
                if len(held) >= HELD_LANGUAGES:
                    yield from hand_on()
        yield from hand_on()

    parts = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        "text is not null and lang is not null").mapInArrow(count, "lang string, slot int, n long")
    return parts.groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def learn_bits(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """The binary classifiers, of all rows of ``docs`` that have both a text with
    letters and a language. Languages weigh alike, whatever their share. The
    driver gets a row a language and one number per slot and bit."""
    counts = stored(count_grams(docs, text_col, lang_col), "langid-counts")
    totals = sorted((r.lang, r.n) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect())
    langs = tuple(lang for lang, _ in totals)
    code = codewords(len(langs))
    odds = np.zeros((SLOTS + 1, code.shape[1]), np.float32)
    if code.shape[1]:
        share = [1.0 / (n + SMOOTHING * SLOTS) for _, n in totals]
        rows = [(lang, j, share[i], int(code[i, j])) for i, lang in enumerate(langs) for j in range(code.shape[1])]
        spark = docs.sparkSession
        signs = spark.createDataFrame(rows, "lang string, bit int, share double, sign int")
        both = counts.join(small_or_plain(signs), "lang").groupBy("slot", "bit").agg(
            *[F.sum(F.when(F.col("sign") == s, F.col("n") * F.col("share")).otherwise(0.0)).alias(name)
              for s, name in ((1, "yes"), (-1, "no"))])
        seen = both.toArrow()
        mass = {s: np.zeros((SLOTS, code.shape[1])) for s in (1, -1)}
        at = seen["slot"].to_numpy(), seen["bit"].to_numpy()
        mass[1][at], mass[-1][at] = seen["yes"].to_numpy(), seen["no"].to_numpy()
        sides = {}
        for s in (1, -1):
            has = code == s
            sides[s] = (mass[s] + SMOOTHING * (has * np.array(share)[:, None]).sum(0)) / has.sum(0)
        odds[:SLOTS] = np.log(sides[1]) - np.log(sides[-1])
    return LanguageModel(langs, code, odds, np.ones(code.shape), np.ones(code.shape[1]))


def bit_margins(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``letters`` of it and ``margins``: the
    log-odds of each bit, summed and divided by the root of the n-grams."""
    others = [c for c in docs.columns if c != text_col]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = model.code.shape[1]
        for b in batches:
            sums, seen = np.zeros((b.num_rows, width)), np.zeros(b.num_rows)
            letters = np.zeros(b.num_rows, np.int64)
            texts, rows, size = [], [], 0

            def add() -> None:
                slots, first, n = grams(texts)
                per = model.odds[slots[0]]
                real = (slots[0] != SLOTS).astype(np.int64)
                for s in slots[1:]:
                    per += model.odds[s]
                    real += s != SLOTS
                some = np.flatnonzero(n)
                if some.size:
                    # texts without letters share their start with the next text
                    np.add.at(sums, np.array(rows)[some], np.add.reduceat(per, first[some], axis=0))
                    np.add.at(seen, np.array(rows)[some], np.add.reduceat(real, first[some]))
                    np.add.at(letters, np.array(rows)[some], n[some])
                texts.clear()
                rows.clear()

            for r, text in enumerate(b.column(0)):
                for part in windows(text.as_py() or ""):
                    texts.append(part)
                    rows.append(r)
                    size += len(part)
                    if size >= WINDOW:
                        add()
                        size = 0
            if texts:
                add()
            z = sums / np.sqrt(seen + 1)[:, None]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(letters), pa.array(list(z), pa.list_(pa.float64()))],
                [*others, "letters", "margins"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + ["letters long", "margins array<double>"])
    return docs.select(text_col, *others).mapInArrow(margins, schema)


def learn_trust(margins: DataFrame, model: LanguageModel, lang_col: str = "lang") -> LanguageModel:
    """``model`` with the weight of each bit for each language (how often it was
    right) and the scale of each bit, of all rows of ``margins`` with a language."""
    width = model.code.shape[1]
    if not width:
        return model
    rows = [(lang, j, int(model.code[i, j])) for i, lang in enumerate(model.langs) for j in range(width)]
    signs = margins.sparkSession.createDataFrame(rows, "lang string, bit int, sign int")
    each = margins.filter("letters > 0").select(F.col(lang_col).alias("lang"), F.posexplode("margins").alias("bit", "z"))
    m = F.col("z") * F.col("sign")
    seen = each.join(small_or_plain(signs), ["lang", "bit"]).groupBy("lang", "bit").agg(
        F.avg((m > 0).cast("double")).alias("right"),
        *[F.avg(F.log1p(F.exp(-F.greatest(F.least(m * s, F.lit(50.0)), F.lit(-50.0))))).alias(f"l{k}")
          for k, s in enumerate(SCALES)]).collect()
    at = {lang: i for i, lang in enumerate(model.langs)}
    right, loss = np.zeros(model.code.shape), np.zeros((width, len(SCALES)))
    for r in seen:
        right[at[r.lang], r.bit] = r.right
        loss[r.bit] += [r[f"l{k}"] for k in range(len(SCALES))]
    return replace(model, trust=right, scale=np.array(SCALES)[loss.argmin(1)])


def decode(z: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, ambiguous) of each row of margins. The score is the
    language's share of exp(-loss), a loss counting as one bit's for each
    ``apart`` bits, since so many tell any two languages apart."""
    width = model.code.shape[1]
    if not width:
        return np.zeros(len(z), np.int64), np.ones(len(z)), np.zeros(len(z), bool)
    trust = model.trust + 1e-9
    trust = trust / trust.sum(1, keepdims=True)
    m = np.clip(z * model.scale, -500, 500)
    loss = np.stack([np.logaddexp(0, -m * word) @ w for word, w in zip(model.code, trust)], 1)
    p = np.exp(-(loss - loss.min(1, keepdims=True)) * width / max(1, model.apart))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    wrong = np.stack([((m > 0) != (word > 0)).sum(1) for word in model.code], 1)
    rows = np.arange(len(z))
    mine = wrong[rows, best]
    wrong[rows, best] = width + 1
    return best, p[rows, best], wrong.min(1) <= mine


def identified(margins: DataFrame, model: LanguageModel, min_score: float = 0.9) -> DataFrame:
    """``margins`` with ``lang_pred``, ``score`` and ``ambiguous`` instead of the
    margins: ambiguous if another codeword is as near to the bits, or the score
    is below ``min_score``. ``und`` with the score 0 where there are no letters,
    or nothing to learn from."""
    others = [c for c in margins.columns if c not in ("margins", "letters")]
    kinds = {f.name: f.dataType.simpleString() for f in margins.schema}

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UNDETERMINED], object)
        for b in batches:
            z = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, model.code.shape[1])
            none = (b.column(0).to_numpy() == 0) | (len(model.langs) == 0)
            if model.langs:
                best, score, unsure = decode(z, model)
            else:
                best, score, unsure = np.zeros(len(z), int), np.zeros(len(z)), np.zeros(len(z), bool)
            score = np.where(none, 0.0, score)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[2:], pa.array(names[np.where(none, len(model.langs), best)], pa.string()),
                 pa.array(np.round(score, 6)), pa.array(unsure | (score < min_score))],
                [*others, "lang_pred", "score", "ambiguous"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + ["lang_pred string, score double, ambiguous boolean"])
    return margins.select("letters", "margins", *others).mapInArrow(decide, schema)


def identify_languages(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang") -> DataFrame:
    """The language of every row's whole text, learned from the rows of ``docs``
    where ``learn_from`` is true and both text and language are known.

    Returns id, ``held_out`` (not among the rows that may be learned from; true
    where ``learn_from`` is NULL), ``lang_pred`` (a learned language; ``und``
    for NULL texts, texts without letters, or if nothing was learned), ``score``
    (0 to 1) and ``ambiguous``. Language, source and id are no inputs of a
    prediction, so equal texts get equal predictions. Rows are kept as they are:
    repeated ones and rows without an id too. Ties of the loss go to the first
    language by name. An empty table gives an empty result; other columns of
    ``docs`` are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(~learn_from, F.lit(True)).alias("held_out"),
                       F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    model = learn_bits(rows.filter("not held_out"))
    margins = stored(bit_margins(rows, model), "langid-margins")
    model = learn_trust(margins.filter("not held_out and lang is not null"), model)
    return identified(margins.drop("lang"), model).withColumnRenamed("id", id_col)
