"""Phrase collocation mining by dynamic itemset counting.

The corpus lies in shards that are scanned in turn, round and round. Words are
counted from the first shard on; a longer phrase becomes active at the first
shard border at which the phrases without its last and without its first word
have both reached the threshold, and is counted for one full cycle from there,
so counts of all lengths run interleaved and every count is exact.

Which phrases have reached the threshold, and at which border, is kept in one
table of fixed size for each length, by a hash of the phrase. Phrases that share
a slot only make others active early: they are counted in full and then fall
below the threshold. So the tables' size bounds what tasks are sent, and never
changes the result.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import scratch_root, small_or_plain, split_join, stored

#: Marks the border of a piece; no byte of UTF-8 text has this value.
BORDER = 0xFF
#: A-Z in lower case, the ends of pieces as borders, tabs as spaces.
BYTES = bytes(b + 32 if 65 <= b <= 90 else BORDER if b in b".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b
              for b in range(256))
#: Words of one language that a task counts at once.
WINDOW_WORDS = 1 << 20
#: Bytes of a text that are cut into words at once.
CHUNK = 1 << 22
NEVER = 255
#: First ranking of a language's phrases by parts, so that no task sorts them all.
RANK_PARTS = 64

#: Bytes of text for each part that the counts are dealt to by hash; a part's
#: counts meet in one task.
PART_BYTES = 1 << 24
#: Words a task remembers to have named.
NAMED = 1 << 21

COUNTED = "part long, len int, act int, keys binary, n binary, old boolean"
MERGED = "part long, len int, act int, keys binary, n binary, reached binary"


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a whole text in portions, with a border as a word of its own
    between pieces and at the end."""
    data, at = text.encode().translate(BYTES), 0
    while at < len(data):
        stop = len(data)
        if stop - at > CHUNK:
            ends = [i for i in (data.find(b" ", at + CHUNK), data.find(bytes([BORDER]), at + CHUNK)) if i >= 0]
            stop = min(ends, default=stop)
        yield data[at:stop].replace(b"\xff", b" \xff ").split()
        at = stop
    yield [b"\xff"]


class Phrases:
    """The phrases in a list of words: local word ids, 64-bit hashes of the words
    (salted with the language) and of the phrases of each length by their first
    word. Phrases that end before word ``seen`` were counted with those before."""

    def __init__(self, words: list[bytes], seen: int, lang: str):
        index: defaultdict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        index[b"\xff"] = 0
        self.seen, self.lang = seen, lang
        self.at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        self.names, salt = list(index), lang.encode() + b"\xff"
        self.known = np.array([xxhash.xxh3_64_intdigest(salt + w) for w in self.names], np.uint64)

    def hashes(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, hash, whether a border is inside) of the phrase that starts
        at each word."""
        h, border = self.known[self.at], self.at == 0
        yield 1, h, border
        for k in range(2, longest + 1):
            nxt = self.at[k - 1:]
            h = (h[:-1] ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) + self.known[nxt]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
            border = border[:-1] | (nxt == 0)
            yield k, h, border

    def distinct(self, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """One start and the number of each distinct phrase among those at ``first``."""
        key = self.at[first]
        for j in range(1, k):
            if j > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(self.names) + self.at[first + j]
        _, one, n = np.unique(key, return_index=True, return_counts=True)
        return first[one], n

    def keys(self, first: np.ndarray, k: int) -> np.ndarray:
        """The hashes of the words of each phrase, a row a phrase."""
        return np.stack([self.known[self.at[first + j]] for j in range(k)], 1)


def in_windows(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[Phrases]:
    """All phrases of the ``lang, text`` rows, by language in windows of words."""
    held: dict[str, tuple[list[bytes], int]] = {}

    def window(lang: str) -> Phrases:
        words, seen = held.pop(lang)
        keep = words[len(words) - (longest - 1):] if longest > 1 else []
        held[lang] = keep, len(keep)
        return Phrases(words, seen, lang)

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            for words in words_of(text.as_py()):
                if lang not in held:
                    held[lang] = [], 0
                held[lang][0].extend(words)
                if len(held[lang][0]) >= WINDOW_WORDS:
                    yield window(lang)
        if sum(len(w) for w, _ in held.values()) >= 2 * WINDOW_WORDS:
            for lang in list(held):
                yield window(lang)
                del held[lang]  # texts end with a border, so nothing goes on
    for lang in list(held):
        yield window(lang)


def _blob(a: np.ndarray, kind: str) -> bytes:
    return a.astype(kind).tobytes()


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """The slot of each row of word hashes, as :meth:`Phrases.hashes` has it."""
    h = keys[:, 0]
    for j in range(1, keys.shape[1]):
        h = (h ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) + keys[:, j]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h >> np.uint64(64 - bits)


def scan(shard: DataFrame, active: list[np.ndarray], step: int, shards: int, parts: int) -> DataFrame:
    """Counts of the active phrases of one shard (``lang, text``): a row holds
    the hashes and counts of those of a window in one part, of one length and
    one first step."""
    longest, bits = len(active), int(len(active[0])).bit_length() - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for window in in_windows(batches, longest):
            rows, since = [], None
            for k, h, border in window.hashes(longest):
                if k == 1:
                    act = np.zeros(len(h), np.int64)
                else:
                    act = np.maximum(since[:-1], since[1:]).astype(np.int64)
                first = np.flatnonzero(~border & (act <= step) & (step < act + shards))
                first = first[first + k - 1 >= window.seen]
                since = np.where(border, NEVER, active[k - 1][h >> np.uint64(64 - bits)])
                if not first.size:
                    continue
                first, n = window.distinct(first, k)
                part = h[first] % np.uint64(parts)
                order = np.lexsort((act[first], part))
                first, n, part = first[order], n[order], part[order]
                a = act[first]
                new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (a[1:] != a[:-1])])
                keys = window.keys(first, k)
                for i, j in zip(new.tolist(), [*new[1:].tolist(), len(first)]):
                    rows.append((int(part[i]), k, int(a[i]), _blob(keys[i:j], "<u8"), _blob(n[i:j], "<i8"), False))
            for i in range(0, len(rows), 1000):
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[i:i + 1000]), kinds)],
                                                 [c.split()[0] for c in COUNTED.split(", ")])

    return shard.select("lang", "text").mapInArrow(count, COUNTED)


def merged(counted: DataFrame, min_count: int, step: int, shards: int, bits: int) -> DataFrame:
    """The counts of each part summed, without those that ended their cycle below
    ``min_count``; ``reached`` has the slots of those that now got there."""

    def of(table: pa.Table) -> pa.Table:
        rows = []
        lens, acts = table["len"].to_numpy(), table["act"].to_numpy()
        for k, act in sorted(set(zip(lens.tolist(), acts.tolist()))):
            here = table.filter(pa.array((lens == k) & (acts == act)))
            keys = np.frombuffer(b"".join(here["keys"].to_pylist()), "<u8").reshape(-1, k)
            n = np.frombuffer(b"".join(here["n"].to_pylist()), "<i8")
            old = np.repeat(here["old"].to_numpy(zero_copy_only=False), [len(b) // 8 for b in here["n"].to_pylist()])
            order = np.lexsort(keys.T)
            keys, n, old = keys[order], n[order], old[order]
            new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            total, before = np.add.reduceat(n, new), np.add.reduceat(np.where(old, n, 0), new)
            keys = keys[new]
            slots = np.unique(_slots(keys[(total >= min_count) & (before < min_count)], bits))
            keep = (total >= min_count) | (act + shards > step)
            rows.append((table["part"][0].as_py(), k, act, _blob(keys[keep], "<u8"), _blob(total[keep], "<i8"),
                         _blob(slots, "<u4")))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], [c.split()[0] for c in MERGED.split(", ")])

    return counted.groupBy("part").applyInArrow(of, MERGED)


def _numbers(solid: DataFrame) -> DataFrame:
    """``w, n`` of every phrase: the hashes of its words and its count."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, keys, n in zip(*(c.to_pylist() for c in b.columns)):
                n = np.frombuffer(n, "<i8")
                w = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * k), pa.array(np.frombuffer(keys, "<i8")))
                yield pa.RecordBatch.from_arrays([w, pa.array(n)], ["w", "n"])

    return solid.select("len", "keys", "n").mapInArrow(of, "w array<long>, n long")


def _names(laid: DataFrame, reached: np.ndarray) -> DataFrame:
    """``lang, word, h, n``: the words whose slot has reached the threshold, with
    their hashes, and a row without a word with the number of words."""
    bits = int(len(reached)).bit_length() - 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for window in in_windows(batches, 1):
            rows = [(window.lang, None, 0, int((window.at != 0).sum()))]
            often = reached[window.known >> np.uint64(64 - bits)] != NEVER
            often[0] = False
            for i, h in zip(np.flatnonzero(often).tolist(), window.known[often].view(np.int64).tolist()):
                if h not in known:
                    known.add(h)
                    rows.append((window.lang, window.names[i], h, 0))
            if len(known) > NAMED:
                known.clear()
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)],
                                             ["lang", "word", "h", "n"])

    return laid.select("lang", "text").mapInArrow(of, "lang string, word string, h long, n long")


def frequent_phrases(docs: DataFrame, min_count: int, longest: int = 3, shards: int = 2, slot_bits: int = 22,
                     text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Every phrase of up to ``longest`` words with at least ``min_count``
    occurrences in its language (NULL: ``und``), as ``w, n`` (64-bit hashes of its
    words, salted with the language), and ``lang, word, h, n``: the words of these
    hashes, and for each language a row without a word that counts all its words.

    A scan reads one of the ``shards``; counts are dealt by hash to parts whose
    number follows the bytes of text. The driver keeps 2 ** ``slot_bits`` bytes for each length and gets the
    slots of the phrases that reach the threshold in a step."""
    spark = docs.sparkSession
    path = f"{scratch_root(spark)}/llm-phrase-shards-{uuid.uuid4().hex}"
    seen = Observation()
    docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter(
        "text is not null").withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards))).observe(
        seen, F.sum(F.octet_length("text")).alias("bytes")).write.option("compression", "zstd").partitionBy("shard").parquet(path)
    parts = max(8, (seen.get["bytes"] or 0) // PART_BYTES)
    laid = spark.read.schema("lang string, text string, shard int").parquet(path)
    active = [np.full(1 << slot_bits, NEVER, np.uint8) for _ in range(longest)]
    dashed, solid, step, end = None, [], 0, shards
    while step < end:
        counted = scan(laid.filter(F.col("shard") == step % shards), active, step, shards, parts)
        if dashed is not None:
            counted = dashed.unionByName(counted)
        step += 1
        counted = stored(merged(counted, min_count, step, shards, slot_bits), "phrases")
        for k, slots in counted.filter("octet_length(reached) > 0").select("len", "reached").collect():
            at = np.frombuffer(slots, "<u4")
            active[k - 1][at] = np.minimum(active[k - 1][at], step)
        done = F.col("act") + shards <= step
        dashed = counted.filter(~done).drop("reached").withColumn("old", F.lit(True))
        solid.append(counted.filter(done & (F.octet_length("n") > 0)))
        last = max((int(a[a != NEVER].max()) for a in active[:-1] if (a != NEVER).any()), default=0)
        end = max(end, last + shards) if last else end
        if end >= NEVER:
            raise ValueError(f"{shards} shards take {NEVER} steps or more")
    counts = solid[0]
    for s in solid[1:]:
        counts = counts.unionByName(s)
    names = _names(laid, active[0]).groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))
    return stored(_numbers(counts), "phrases-frequent"), stored(names, "phrases-names")


def _whole(c: str) -> Column:
    return F.col(c).cast("decimal(16,0)")


def collocations(docs: DataFrame, min_count: int = 10, longest: int = 3, top: int = 2000, cover_percent: int = 50,
                 shards: int = 2, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of 2 to ``longest`` words of each language.

    Texts are lower-cased (A-Z) and cut into pieces at ``. , ; : ! ?`` and line
    breaks, pieces into words at spaces and tabs; phrases lie inside a piece. A
    phrase with a >= ``min_count`` occurrences is cut after its first k words
    into parts with l and r; its score is floor(1000000 a a / (l r)) of the cut
    with the least one, the smallest k of equals. Phrases inside a longer one
    with at least ``cover_percent`` of their occurrences are dropped.

    Returns lang, rank (by score, occurrences, then the phrase's bytes), phrase,
    a, l, r, n (words of the language) and score, the first ``top`` of each
    language. NULL texts have no words, a NULL language is ``und``; repeated
    rows count each time, also without an id; an empty table gives an empty
    result; other columns of ``docs`` are ignored. Products are exact decimals:
    counts may have up to 16 digits.
    """
    counts, names = frequent_phrases(docs, min_count, longest, shards, text_col=text_col, lang_col=lang_col)
    candidates = counts.filter("size(w) > 1").select("w", F.col("n").alias("a"))
    cuts = candidates.select("w", "a", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k")).select(
        "w", "a", "k", F.slice("w", F.lit(1), F.col("k")).alias("head"), F.slice("w", F.col("k") + 1, F.size("w")).alias("tail"))
    # both parts occur at least as often as the phrase, so their counts are known
    cuts = split_join(cuts, counts.select(F.col("w").alias("head"), F.col("n").alias("l")), ["head"])
    cuts = split_join(cuts, counts.select(F.col("w").alias("tail"), F.col("n").alias("r")), ["tail"])
    cuts = cuts.withColumn("up", _whole("a") * _whole("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn(
        "down", _whole("l") * _whole("r")).withColumn("score", F.expr("up div down"))
    scored = cuts.groupBy("w", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    longer = candidates.filter("size(w) > 2").select("a", "w", F.explode(F.expr(
        "flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> struct(i, m))))")).alias("part"))
    covered = longer.select("a", F.slice("w", F.col("part.i"), F.col("part.m")).alias("w")).groupBy("w").agg(
        F.max("a").alias("most"))
    kept = split_join(scored, covered, ["w"], "left").filter(
        F.col("most").isNull() | (100 * F.col("most") < cover_percent * F.col("a"))).drop("most")
    words = names.filter("word is not null").select("h", "lang", "word")
    spelt = split_join(kept.select("w", F.posexplode("w").alias("i", "h")), words, ["h"]).groupBy("w").agg(
        F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("words"))
    rows = stored(split_join(kept, spelt, ["w"]).select(
        "lang", F.array_join(F.col("words.word"), " ").alias("phrase"), "a", "best.l", "best.r", "best.score"), "phrases-scored")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    # at most RANK_PARTS x top rows of a language are left
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = names.filter("word is null").select("lang", "n")
    return rows.join(small_or_plain(totals), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
