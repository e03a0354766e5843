"""Substring dedup with sliding sentence spans: every run of consecutive
sentences is hashed, the hashes are joined over all documents, and sentences
covered by a run that is not the first of its kind are removed. Long sentences
are also cut at points that their content alone selects, and spans of pieces are
compared in the same way, so a long passage needs no sentence ends to be seen."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, split_join, stored

#: Sentences of a run, and words a run must have: shorter ones recur by chance.
RUN, MIN_WORDS = 2, 10
#: A sentence ends behind its stops before white space, behind full-width stops
#: and the quotes that close there, or at a line end.
BREAK = re.compile(r"(?:[.!?\u061f\u06d4\u0964\u0965\u0589\u104b\u1362]+(?=\s|$)"
                   r"|[\u3002\uff01\uff1f\uff61]+[\u300d\u300f\u201d\u2019\uff09]*|\n)\s*")
#: Letters of scripts without spaces (Thai, Lao, Myanmar, Khmer, kana, Han):
#: two of them count as a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
LETTER, TOKEN = re.compile(f"[{UNSPACED}]"), re.compile(f"[{UNSPACED}]|[^\\s{UNSPACED}]+")
#: Words of a span of pieces, so of a sentence that is cut; tokens around a cut among which it
#: is the least hash; tokens of a hash; characters of a token that is taken apart.
LONG, AROUND, GRAM, SOLID = 50, 16, 4, 64
#: Runs of a batch that is handed on.
ROWS_AT_ONCE = 200_000


def sentence_ends(text: str) -> list[int]:
    """Ends of the sentences, each with the white space behind it."""
    ends = [m.end() for m in BREAK.finditer(text)]
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def length(text: str, words: list[bytes]) -> float:
    """Words, where two letters of scripts without spaces, or two characters
    beyond the ``SOLID`` first of a word, count as one."""
    n = len(words) + sum(len(w) - SOLID for w in words if len(w) > SOLID and w.isascii()) / 2
    return n if text.isascii() else n + len(LETTER.findall(text)) / 2


def cuts(text: str) -> tuple[list[int], list[float]]:
    """Starts of the pieces, and their words; all but the first start at tokens whose hash, with the next
    ones, is less than that of any other within ``AROUND`` tokens."""
    at, names, words = [], [], []
    for m in TOKEN.finditer(text):
        parts = [(m.start(), m[0])] if len(m[0]) <= SOLID else list(enumerate(m[0], m.start()))
        for i, t in parts:
            at.append(i)
            words.append(0.5 if len(parts) > 1 or LETTER.match(t) else 1)
            names.append(xxhash.xxh3_64_intdigest(t.encode().translate(ASCII_LOWER)))
    n = len(at) - GRAM + 1
    if n <= 2 * AROUND:
        return [0], [sum(words)]
    one, h = np.array(names, np.uint64), np.zeros(n, np.uint64)
    for j in range(GRAM):  # wraps at 64 bits
        h = (h ^ one[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    least = np.ones(n - 2 * AROUND, bool)
    middle = h[AROUND:n - AROUND]
    for j in range(1, AROUND + 1):
        least &= (middle < h[AROUND - j:n - AROUND - j]) & (middle < h[AROUND + j:n - AROUND + j])
    first = [0, *(np.flatnonzero(least) + AROUND).tolist()]
    return [0, *(at[i] for i in first[1:])], np.add.reduceat(words, first).tolist()


def pieces(text: str, ends: list[int]) -> Iterator[tuple[int, list[int], set[tuple[int, int]]]]:
    """(sentence, bounds of its pieces, spans) of the long sentences. From each
    piece on, and up to each piece, the shortest span of ``LONG`` words counts."""
    for k, (a, b) in enumerate(zip([0, *ends], ends)):
        s = text[a:b]
        if length(s, s.encode().translate(ASCII_LOWER).split()) < LONG:
            continue
        starts, words = cuts(s)
        n, upto, spans, j = len(starts), [0, *accumulate(words)], set(), 0
        for i in range(n):  # from piece i on
            while j < n and upto[j] - upto[i] < LONG:
                j += 1
            if upto[j] - upto[i] < LONG:
                break
            spans.add((i, j))
        i = 0
        for j in range(1, n + 1):  # up to piece j
            while upto[j] - upto[i] >= LONG:
                i += 1
            if i:
                spans.add((i - 1, j))
        yield k, [a + c for c in starts] + [b], spans


def long_spans(text: str, ends: list[int]) -> list[tuple[int, int, int]]:
    """(sentence, start, stop) of each span of pieces, in order."""
    return [(k, bounds[i], bounds[j]) for k, bounds, spans in pieces(text, ends) for i, j in sorted(spans)]


def runs(text: str, run: int, min_words: int) -> list[tuple[int, int, int, bool]]:
    """(first sentence, two hash halves, first of its kind here) of each run, and
    of each span in a long sentence, numbered -1, -2 and so on."""
    ends = sentence_ends(text)
    words = [text[a:b].encode().translate(ASCII_LOWER).split() for a, b in zip([0, *ends], ends)]
    plain, counts = [b" ".join(w) for w in words], [length(text[a:b], w) for a, b, w in zip([0, *ends], ends, words)]
    spans = [(i, b"\n".join(plain[i:i + run])) for i in range(len(ends) - run + 1) if sum(counts[i:i + run]) >= min_words]
    spans += [(-1 - j, b"\0" + b" ".join(text[a:b].encode().translate(ASCII_LOWER).split()))
              for j, (_, a, b) in enumerate(long_spans(text, ends))]
    out, seen = [], set()
    for i, form in spans:
        h = xxhash.xxh3_128_digest(form)
        out.append((i, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True),
                    h not in seen))
        seen.add(h)
    return out


def run_table(docs: DataFrame, run: int, min_words: int) -> DataFrame:
    """A row for each run of the ``id, text`` rows."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, count = [], [], 0
            for r, text in enumerate(b.column(1)):
                found = runs(text.as_py(), run, min_words)
                ids += [r] * len(found)
                rows += found
                count += len(found)
                if rows and (count >= ROWS_AT_ONCE or r + 1 == b.num_rows):
                    at, h1, h2, new = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(ids)), pa.array(at, pa.int32()), pa.array(h1), pa.array(h2),
                         pa.array(new)], ["id", "at", "h1", "h2", "new"])
                    ids, rows, count = [], [], 0
            if rows:
                at, h1, h2, new = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(ids)), pa.array(at, pa.int32()), pa.array(h1), pa.array(h2),
                     pa.array(new)], ["id", "at", "h1", "h2", "new"])

    return docs.mapInArrow(of, f"id {docs.schema['id'].dataType.simpleString()}, at int, h1 long, h2 long, new boolean")


def without_sentences(text: str, starts: list[int], run: int) -> tuple[str, int, int]:
    """The text without the runs and spans numbered ``starts``; sentences,
    and those of which nothing is left."""
    ends = sentence_ends(text)
    gone = np.zeros(len(ends) + run, bool)
    for s in starts:
        if s >= 0:
            gone[s:s + run] = True
    gone = gone[:len(ends)]
    if not starts:
        return text, len(ends) if text else 0, 0
    dropped: dict[int, list[tuple[int, int]]] = {}
    if any(s < 0 for s in starts):
        spans = long_spans(text, ends)
        for s in sorted((s for s in starts if s < 0), reverse=True):  # in order of their starts
            k, a, b = spans[-1 - s]
            dropped.setdefault(k, []).append((a, b))
    out = []
    for k, (a, b) in enumerate(zip([0, *ends], ends)):
        if gone[k]:
            continue
        at, left = a, []
        for c, d in dropped.get(k, ()):
            left.append(text[at:max(at, c)])
            at = max(at, d)
        out += [*left, text[at:b]]
        gone[k] = k in dropped and not any(left) and at == b
    return "".join(out), len(ends) if text else 0, int(gone.sum())


def remove_repeated_sentences(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                              text_col: str = "text") -> DataFrame:
    """Every row with its text freed from repeated runs of sentences.

    Runs are equal if their words are (A-Z lower-cased, white space as one
    space). The first of equal runs is the one in the smallest id, at the
    smallest position there; sentences of the others go, overlaps included.
    Decisions are made on the input, not on what is left. Sentences of ``LONG``
    words or more are also cut into pieces of about 33 words at points that the
    words around them select; spans of pieces that reach ``LONG`` words are
    compared like runs. So of a repeated passage inside a longer sentence the
    ends up to its outermost cuts stay. Runs of fewer than ``min_words`` words
    stay, as do texts of fewer than ``run`` sentences if none is long. Where a script has no spaces,
    and in words of over ``SOLID`` characters, two characters count as a word.

    Returns id, ``kept_text``, ``n_sentences`` and ``n_removed`` (those of which
    nothing is left). NULL text is
    kept as NULL, with no sentences. A row without an id is compared with
    nothing; rows that repeat an id are one document. An empty table gives an
    empty result; other columns of ``docs`` are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spans = stored(run_table(rows.filter("id is not null and text is not null"), run, min_words), "spans")
    repeated = spans.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = split_join(spans, repeated, ["h1", "h2"]).filter("first < id or not new")
    per_doc = gone.groupBy("id").agg(F.collect_set("at").alias("starts"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [(None, 0, 0) if t.as_py() is None else without_sentences(t.as_py(), s.as_py() or [], run)
                    for t, s in zip(b.column(1), b.column(2))]
            kept, n, removed = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())],
                ["id", "kept_text", "n_sentences", "n_removed"])

    return rows.join(per_doc, "id", "left").select("id", "text", "starts").mapInArrow(
        cut, f"id {kind}, kept_text string, n_sentences long, n_removed long").withColumnRenamed("id", id_col)
