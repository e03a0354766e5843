"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .common import read_table
from .embed_dedup import embedding_links
from .exact_dedup import exact_duplicates
from .langid import identify_languages
from .mixing import mix_schedule
from .phrases import collocations
from .prefix_trie import conversation_trie
from .quality import quality_scores
from .sentencepiece_scan import decode, encode, read_model
from .sharding import shard_documents
from .simhash import simhash_components
from .substring_dedup import remove_repeated_sentences
from .suffix_dedup import remove_repeated_bytes
from .token_counts import read_ranks, token_counts

SENTENCEPIECE_MODEL = "piece_bpe_32k.model"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
#: Sources weigh the root of their size: small ones come more often than their share.
MIX_POWER = 0.5


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"), width=4, max_bits=4)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of language, source and every line of the text, of one encoding."""
    ranks = read_ranks(public_tokenizers.path(BYTE_RANKS))
    out = token_counts(read_table(spark, sf_dir, "documents"), ["lang", "source", "text"], ranks,
                       public_tokenizers.PATTERN, breaks=r"\n", rule="first")
    return out.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"), digest="text_sha256")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the piece ids and of the text decoded from them."""
    docs = read_table(spark, sf_dir, "documents")
    model = read_model(public_tokenizers.path(SENTENCEPIECE_MODEL))
    ids = encode(docs, model)
    back = decode(ids.select(F.struct("doc_id", F.size("ids").alias("n"), F.xxhash64("ids").alias("h")).alias("d"),
                             "ids"), model, id_col="d")
    return back.select(
        "d.doc_id", F.greatest("d.n", F.lit(0)).alias("n_tokens"), F.col("d.h").alias("ids_xxhash64"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("decoded_crc32"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("decoded_bytes"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document, with the sentences it had and lost."""
    return remove_repeated_sentences(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_sentences", "n_removed", "kept_text")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(read_table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(read_table(spark, sf_dir, "documents"))
    return scores.withColumn("score", F.round("score", 4))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), shards=8)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_schedule(read_table(spark, sf_dir, "documents"), power=MIX_POWER)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return identify_languages(read_table(spark, sf_dir, "documents"), learn_from=~held_out)


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"), min_count=10, longest=3, top=2000, cover_percent=50)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("int")
    return conversation_trie(read_table(spark, sf_dir, "conversations"), base=F.col("conv") - F.col("conv") % 100,
                             heads=heads, most=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
    "op11_language_id": op11_language_id,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_prefix_trie": op13_prefix_trie,
}
