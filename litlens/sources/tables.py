"""Parquet table access for the driver's test tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_if_exists(spark: SparkSession, path: str, merge: bool = False) -> DataFrame | None:
    """The parquet table at ``path``, or None if there is no such path yet;
    every other error (a damaged file, another format) is raised."""
    try:
        return spark.read.option("mergeSchema", merge).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
