"""Paper sources and report sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_arrays import read_json_array

# ids are strings in a paper collection; a numeric id column is read with its own
# type by passing another schema
PAPER_SCHEMA = ("paper_id string, venue string, lang string, title string, abstract string, "
                "fulltext string, date_publication string, url string, screen string, screen_alt string")
PAPER_JSON_SCHEMA = ("_id string, title string, abstract string, fulltext string, "
                     "date_publication string, url string")


def load_papers(spark: SparkSession, path: str, schema: str = PAPER_SCHEMA) -> DataFrame:
    """The paper collection from parquet with an explicit schema; a field
    absent from the files reads as NULL. The id keeps the type it has in the
    files, so string and numeric ids both work."""
    kind = spark.read.parquet(path).schema["paper_id"].dataType.simpleString()
    return spark.read.schema(schema.replace("paper_id string", f"paper_id {kind}")).parquet(path)


def load_papers_json(spark: SparkSession, path: str, schema: str = PAPER_JSON_SCHEMA,
                     split: bool = False) -> DataFrame:
    """Papers from UTF-8 JSON files holding one array of paper objects each;
    ``_id`` becomes ``paper_id``, the key every operator uses. ``split`` reads a
    large file by many tasks instead of one."""
    if split:
        return read_json_array(spark, path, schema).withColumnRenamed("_id", "paper_id")
    return (spark.read.schema(schema).option("multiLine", True).option("encoding", "UTF-8")
            .json(path).withColumnRenamed("_id", "paper_id"))


def write_share_csv(shares: DataFrame, out_dir: str, labels: dict[str, Sequence[str]],
                    checkpoint: bool = True) -> None:
    """One CSV per category: decade x label share matrix (missing = 0.0),
    rounded shares as computed, header row, ordered by decade.

    ``labels`` gives each category's label columns (vocabulary plus
    sentinels), which fixes the schema and avoids a distinct-values job.
    The share table (category x decade x label: small) is checkpointed once
    into the shared scratch folder, so the per-category writes do not each
    recompute the pipeline behind it (``checkpoint=False`` when the caller
    already materialised it)."""
    shares = shares.select("category", "decade", "label", "pct")
    if checkpoint:
        from ..session import scratch_dir
        scratch_dir(shares.sparkSession)
        shares = shares.checkpoint(eager=True)
    for category, labs in labels.items():
        m = (shares.filter(F.col("category") == category)
             .groupBy("decade").pivot("label", list(labs)).agg(F.first("pct"))
             .na.fill(0.0, subset=list(labs)).orderBy("decade"))
        (m.coalesce(1).write.mode("overwrite").option("header", True)
         .csv(f"{out_dir.rstrip('/')}/category={category}"))


def write_year_table(table: DataFrame, path: str) -> None:
    """The yearly report as one CSV with a header, by year."""
    table.orderBy(table.columns[0]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def entries(papers: DataFrame, fields: Sequence[str] = ("_id", "abstract", "title", "fulltext"),
            id_col: str = "paper_id") -> DataFrame:
    """Papers projected to the entry fields a prompt shows: ``_id`` as a
    string, a field the collection lacks as NULL (column pruning keeps the
    scan to these columns)."""
    cols = []
    for f in fields:
        if f == "_id":
            cols.append(F.col(id_col).cast("string").alias("_id"))
        elif f in papers.columns:
            cols.append(F.col(f))
        else:
            cols.append(F.lit(None).cast("string").alias(f))
    return papers.select(*cols)
