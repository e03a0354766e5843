"""Keyword taxonomy: match paper words against topic stems (``stem*``) and
pick the best-matching topic per paper.

A prefix match ``token LIKE stem || '%'`` would plan as a nested-loop join.
Here every word gives its longest stem once, found in the text by a pattern that
is the trie of the stems, and meets the prefix closure (each stem with the stems
that are its own prefixes). Nothing fans out by stem length, words without a stem
make no row, the join is a size-checked broadcast, and the hits shuffle once,
combined map-side.

The pattern is written for up to ``TRIE_MAX_STEMS`` stems of ``TRIE_MAX_LENGTH``
letters. Beyond it the match is an equi-join of the words' prefixes at the stem
lengths in use; the hits are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import sized_broadcast

TOKEN_SPLIT = "[^a-z]+"   # fixed value: a token is a run of letters a-z after lower-casing
NO_TOPIC = "Other"        # fixed value: topic of a paper without any hit
# stems that one pattern holds, and letters of a stem; they change the plan, not the hits
TRIE_MAX_STEMS = 5_000
TRIE_MAX_LENGTH = 100


def clean_stems(stems: DataFrame) -> DataFrame:
    """``(topic, stem)`` with the trailing ``*`` removed, lower case, distinct."""
    s = stems.select("topic", F.lower(F.regexp_replace("stem", r"\*+$", "")).alias("stem"))
    return s.filter(F.length("stem") > 0).distinct()


def tokens(df: DataFrame, text_col: str = "fulltext", id_col: str = "paper_id") -> DataFrame:
    """One row per word occurrence: ``(id, token)``; empty strings dropped."""
    t = df.select(id_col, F.explode(F.split(F.lower(F.col(text_col)), TOKEN_SPLIT)).alias("token"))
    return t.filter(F.length("token") > 0)


def trie_pattern(stems: Sequence[str]) -> str:
    """A pattern that matches the longest of ``stems`` at a place: common heads are
    written once, and a stem inside a longer one leaves the rest optional."""
    trie: dict = {}
    for stem in stems:
        node = trie
        for ch in stem:
            node = node.setdefault(ch, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [ch + written(node[ch]) for ch in sorted(node) if ch]
        if not ways:
            return ""
        return ("(?:" + "|".join(ways) + ")" if len(ways) > 1 or "" in node else ways[0]) + ("?" if "" in node else "")

    return written(trie)


def prefix_closure(stems: DataFrame) -> DataFrame:
    """``(longest, topic, stem)``: the rows of every stem that a word has when
    ``longest`` is its longest one, itself included."""
    s = stems.select("topic", "stem")
    every = s.select(F.col("stem").alias("longest")).distinct()
    heads = F.transform(F.sequence(F.lit(1), F.length("longest")), lambda n: F.substring("longest", F.lit(1), n))
    return every.select("longest", F.explode(heads).alias("stem")).join(s, "stem").select("longest", "topic", "stem")


def taxonomy_hits(papers: DataFrame, stems: DataFrame, text_col: str = "fulltext",
                  id_col: str = "paper_id", trie_max: int = TRIE_MAX_STEMS) -> DataFrame:
    """``(id, topic, stem, hits)``: occurrences of words starting with each stem."""
    s = clean_stems(stems).filter(~F.col("stem").rlike("[^a-z]"))  # words are letters only
    words = [r[0] for r in s.select("stem").distinct().limit(trie_max + 1).collect()]
    if not words or len(words) > trie_max or max(map(len, words)) > TRIE_MAX_LENGTH:
        return _hits_by_length(papers, s, text_col, id_col)
    longest = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"(?<![a-z]){trie_pattern(words)}"), F.lit(0))
    found = papers.select(id_col, F.explode(longest).alias("longest"))
    return (found.join(sized_broadcast(prefix_closure(s)), "longest")
                 .groupBy(id_col, "topic", "stem").agg(F.count(F.lit(1)).alias("hits")))


def _hits_by_length(papers: DataFrame, s: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Hits of any number of stems: words are joined by their prefixes."""
    # distinct stem lengths: bounded by the longest stem, read from the small dimension
    lengths = sorted(r[0] for r in s.select(F.length("stem")).distinct().collect())
    if not lengths:
        return papers.select(id_col, F.lit(None).cast("string").alias("topic"),
                             F.lit(None).cast("string").alias("stem"),
                             F.lit(0).cast("long").alias("hits")).limit(0)
    # only words whose shortest prefix starts some stem fan out, and only into the prefixes they have
    heads = s.select(F.substring("stem", 1, lengths[0]).alias("head")).distinct()
    tok = tokens(papers, text_col, id_col).withColumn("head", F.substring("token", 1, lengths[0]))
    tok = tok.join(sized_broadcast(heads), "head", "left_semi")
    tl = F.length("token")
    prefixes = F.filter(F.array(*[F.when(tl >= n, F.substring("token", 1, n)) for n in lengths]),
                        lambda x: x.isNotNull())
    pref = tok.select(id_col, F.explode(prefixes).alias("stem"))
    return (pref.join(sized_broadcast(s), "stem")
                .groupBy(id_col, "topic", "stem").agg(F.count(F.lit(1)).alias("hits")))


def topic_scores(hits: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """Per (paper, topic): total hits and number of distinct stems hit."""
    return hits.groupBy(id_col, "topic").agg(F.sum("hits").alias("hits"),
                                              F.count(F.lit(1)).alias("stems"))


def best_topic(papers: DataFrame, stems: DataFrame, text_col: str = "fulltext",
               id_col: str = "paper_id") -> DataFrame:
    """Exactly one topic per paper: most hits, then most distinct stems, then
    the alphabetically first topic; ``Other`` when nothing matched.

    Plan: three hash exchanges of small rows, never of texts: the distinct
    stems, the hits by (paper, topic, stem), and the hits by paper; the
    per-topic sums and the per-paper ranking run inside the last one. Papers without hits enter as a zero-score ``Other`` row through a
    union, so no join back to the papers is needed. A paper's rows are
    bounded by the size of the stem dimension."""
    hits = taxonomy_hits(papers, stems, text_col, id_col)
    none = papers.select(id_col, F.lit(NO_TOPIC).alias("topic"),
                         F.lit(None).cast("string").alias("stem"), F.lit(0).cast("long").alias("hits"))
    rows = hits.unionByName(none).repartition(id_col)
    sc = rows.groupBy(id_col, "topic").agg(F.sum("hits").alias("hits"),
                                           F.count("stem").alias("stems"))
    w = Window.partitionBy(id_col).orderBy(F.col("hits").desc(), F.col("stems").desc(), "topic")
    return (sc.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1)
              .select(id_col, "topic", "hits", "stems"))
