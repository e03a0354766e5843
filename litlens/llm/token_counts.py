"""Token counts by offset-mapped attribution.

A document's fields are joined and encoded once, whole. The byte lengths of
the tokens give their spans, which are interval-joined to the spans of the
fields and sections; a token that crosses a border is allocated by a rule.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "most", "split")
SEPARATOR = "\n"
#: White space of the patterns (Unicode White_Space), in runs too long for a
#: pattern engine that recurses; and the end of the patterns that such a run may
#: be cut out of: they take it whole, less its last character before a word.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
SPACE_RULE = r"\s+(?!\S)|\s+"
_LOADED: dict[tuple[str, int], tuple[tiktoken.Encoding, np.ndarray]] = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def tokenizer(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file, and the byte length of each token."""
    key = (pattern, hash(ranks))
    if key not in _LOADED:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        lengths = np.zeros(max(table.values()) + 1, np.int64)
        lengths[list(table.values())] = [len(t) for t in table]
        _LOADED[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), lengths
    return _LOADED[key]


def encode(encoding: tiktoken.Encoding, text: str, pattern: str) -> list[int]:
    """The tokens of a whole text. Long runs of white space are pieces of their
    own under ``SPACE_RULE`` and go past the pattern engine, with the same tokens."""
    if not pattern.endswith(SPACE_RULE):
        return encoding.encode_ordinary(text)
    out, at = [], 0
    for run in LONG_SPACE.finditer(text):
        stop = run.end() - (run.end() < len(text))
        out += encoding.encode_ordinary(text[at:run.start()])
        out += encoding._encode_single_piece(text[run.start():stop])
        at = stop
    return out + encoding.encode_ordinary(text[at:])


def section_spans(fields: Sequence[str | None], breaks: re.Pattern) -> tuple[str, list[int], list[int], list[int]]:
    """The joined text, and (field, section, end in characters) of its sections.

    Spans follow each other without gaps: a section keeps the break behind it,
    and the last section of a field keeps the separator behind the field. A
    field always has a first section, also if it is NULL or empty.
    """
    text, field, section, ends = [], [], [], []
    at = 0
    for k, value in enumerate(fields):
        value, last = value or "", k == len(fields) - 1
        stops = [m.end() for m in breaks.finditer(value) if m.end() > m.start()]
        if not stops or stops[-1] < len(value) or len(value) == 0:
            stops.append(len(value))
        for s, stop in enumerate(stops):
            field.append(k)
            section.append(s)
            ends.append(at + stop)
        if not last:
            ends[-1] += len(SEPARATOR)
            value += SEPARATOR
        text.append(value)
        at += len(value)
    return "".join(text), field, section, ends


def attribute(token_ends: np.ndarray, char_of_byte: np.ndarray, span_ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each span. ``token_ends``: in bytes; ``span_ends``: in
    characters, ascending. A token's span is that of the characters it has
    bytes of. ``first``: the span of its first character; ``most``: the span
    with most of its characters, the earlier one of equals; ``split``: each
    span gets the fraction of its characters that lie there."""
    out = np.zeros(len(span_ends))
    if not len(token_ends):
        return out
    first = char_of_byte[np.r_[0, token_ends[:-1]]]
    last = char_of_byte[token_ends - 1]
    a, z = np.searchsorted(span_ends, first, "right"), np.searchsorted(span_ends, last, "right")
    inside = (a == z) | (rule == "first")
    out += np.bincount(a[inside], minlength=len(out))
    for i in np.flatnonzero(~inside):
        cuts = np.r_[first[i], span_ends[a[i]:z[i]], last[i] + 1]
        parts = np.diff(cuts)
        if rule == "most":
            out[a[i] + int(parts.argmax())] += 1
        else:
            out[a[i]:z[i] + 1] += parts / parts.sum()
    return out


def token_counts(docs: DataFrame, fields: Sequence[str], ranks: bytes, pattern: str, breaks: str = r"\n",
                 rule: str = "first", id_col: str = "doc_id") -> DataFrame:
    """Tokens of every section of every field of every row.

    The ``fields`` (NULL: empty) are joined by a newline and encoded once; each
    is cut into sections behind every match of ``breaks``. ``rule`` allocates
    the tokens that cross a border, see :func:`attribute`. Returns id,
    ``field``, ``section`` (from 0), ``n_chars`` (with the separator behind)
    and ``n_tokens`` (a double; whole numbers unless the rule is ``split``).
    The counts of a row sum to the tokens of its joined text. NULL ids and
    repeated rows are rows of their own; an empty table gives an empty result;
    other columns of ``docs`` are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names, kind = list(fields), docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = tokenizer(ranks, pattern)
        find = re.compile(breaks)
        for batch in batches:
            rows, field, section, chars, tokens = [], [], [], [], []
            for r in range(batch.num_rows):
                text, f, s, ends = section_spans([batch.column(c + 1)[r].as_py() for c in range(len(names))], find)
                raw = np.frombuffer(text.encode(), np.uint8)
                char_of_byte = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32 if len(raw) < 1 << 31 else np.int64) - 1
                token_ends = np.cumsum(lengths[np.array(encode(encoding, text, pattern), np.int64)])
                rows += [r] * len(f)
                field += f
                section += s
                chars.append(np.diff(ends, prepend=0))
                tokens.append(attribute(token_ends, char_of_byte, np.array(ends), rule))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array([names[k] for k in field]),
                     pa.array(section, pa.int32()), pa.array(np.concatenate(chars), pa.int64()),
                     pa.array(np.concatenate(tokens))], ["id", "field", "section", "n_chars", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"f{k}") for k, c in enumerate(names)]).mapInArrow(
        count, f"id {kind}, field string, section int, n_chars long, n_tokens double").withColumnRenamed("id", id_col)
