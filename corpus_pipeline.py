"""A corpus pipeline of five of the operators in ``litlens.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; its result is written as Parquet and read again as the next one's docs.
The mixing stage stores the slots it gave in the shared folder, under a digest of
the ids and sources it saw; the last stage reads them there, in any process, and
returns them with the pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlens.llm.catalog import MIX_POWER
from litlens.llm.common import few_files, read_table, scratch_root
from litlens.llm.exact_dedup import drop_exact_duplicates
from litlens.llm.mixing import mix_schedule
from litlens.llm.quality import keep_good
from litlens.llm.sentencepiece_scan import encode, read_model
from litlens.llm.simhash import drop_near_duplicates

MODEL = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one of the largest id."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates by SimHash, the one of the smallest id."""
    return drop_near_duplicates(docs, width=4, max_bits=4)


def _mix_path(spark: SparkSession, docs: DataFrame) -> str:
    """Where the slots of these documents are stored."""
    n, mark = docs.select(F.count("*"), F.bit_xor(F.xxhash64("doc_id", "source"))).first()
    return f"{scratch_root(spark)}/corpus-mix-{n}-{(mark or 0) & (1 << 64) - 1:016x}"


def _mix_slots(docs: DataFrame) -> DataFrame:
    return mix_schedule(docs, power=MIX_POWER).select(F.col("doc_id").alias("mixed_id"), "slot", "place")


def _mix_of(spark: SparkSession, docs: DataFrame) -> tuple[str, DataFrame]:
    """Where the slots of these documents are stored, and what they are: both
    depend on ids and sources only."""
    return _mix_path(spark, docs), _mix_slots(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each with its slot in a mix in which a source weighs the
    root of its size: small ones come more often than their share. The slots go
    to a table of their own, so the texts need not move."""
    path, slots = _mix_of(spark, docs)
    slots.coalesce(few_files(spark)).write.mode("overwrite").parquet(path)
    return docs


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The SentencePiece ids of every document, with its slot in the mix and its
    place there; both NULL for rows without an id. Slots that are no longer
    stored are made again from the same documents."""
    try:
        slots = spark.read.parquet(_mix_path(spark, docs))
    except AnalysisException:
        slots = _mix_slots(docs)
    ids = encode(docs, read_model(public_tokenizers.path(MODEL)))
    return ids.join(slots.hint("merge"), F.col("doc_id") == F.col("mixed_id"), "left").select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), "ids", "slot", "place")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("simhash near-dedup", near),
          ("mixing to target weights", mix), ("sentencepiece encoding", pieces)]

#: SQL expresses neither the classifier nor the fingerprints nor the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    base = f"{scratch_root(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
