"""JSON arrays of objects read by many tasks a file.

``multiLine`` JSON hands a whole file to one task. Here a file is read as text
that ends at each ``}``: Spark splits such text by byte ranges like lines. A brace
ends an object only outside a string, and outside of any object within it, so each
piece needs to know in what state it begins. The state is small (inside a string
or not, and the depth), and what a run of pieces does to it composes: a piece
turns the string state if it has an odd number of quotes, and changes the depth by
one amount if it begins outside a string and by another if inside. So the pieces
of a byte range are summed on their own, the ranges of a file are summed over one
row a range, and both sums together give every piece its beginning state. Pieces
of one object then meet by a key and are parsed by ``from_json``.

Escapes never cross a piece: no JSON escape ends in ``}``. Texts of an object of
any length are whole; an object must fit a string cell, as in Spark's own reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Patterns of JSON text: an escaped character, and a string (or what a cut left of one).
ESCAPED = r"\\."
STRING = r'"[^"]*("|\z)'


def _depth(text: Column) -> Column:
    """Brackets opened less those closed in ``text``, strings left out."""
    bare = F.regexp_replace(text, STRING, "")
    return (F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))).cast("long")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, id, text)``: text up to and with each ``}``, in the order of
    ``(start, id)`` in a file; the rest after the last one too. ``start`` is the
    byte range a task read it in."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.monotonically_increasing_id().alias("id"), F.concat("value", F.lit("}")).alias("text"))


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """``(file, object, text)``: the JSON text of every object that is an element
    of the array in each file, numbered in order from 0. NULLs, numbers and texts
    among the elements are left out; arrays among them are not supported, and of a
    file that breaks off inside an object that object may be missing or NULL."""
    p = pieces(spark, path)
    plain = F.regexp_replace("text", ESCAPED, "")
    p = p.withColumn("turns", F.length(F.regexp_replace(plain, '[^"]', "")) % 2)
    # both cases: the piece begins outside a string, or inside one
    p = p.withColumn("outside", _depth(plain)).withColumn("inside", _depth(F.concat(F.lit('"'), plain)))

    in_range = Window.partitionBy("file", "start").orderBy("id")
    before = in_range.rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("turned", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2)
    # depth of the range so far if it began outside, and if inside
    as_begun = [F.when(F.col("turned") == k, F.col("outside")).otherwise(F.col("inside")) for k in (0, 1)]
    p = p.select("file", "start", "id", "text", "turns", "turned", as_begun[0].alias("step0"), as_begun[1].alias("step1"))
    p = p.withColumn("sum0", F.sum("step0").over(in_range)).withColumn("sum1", F.sum("step1").over(in_range))

    ranges = p.groupBy("file", "start").agg(F.sum("turns").alias("turns"), F.sum("step0").alias("all0"),
                                            F.sum("step1").alias("all1"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("begins", F.coalesce(F.sum("turns").over(earlier), F.lit(0)) % 2)
    ranges = ranges.withColumn("all", F.when(F.col("begins") == 0, F.col("all0")).otherwise(F.col("all1")))
    ranges = ranges.select("file", "start", "begins", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))

    own = F.when(F.col("begins") == 0, F.col("sum0")).otherwise(F.col("sum1"))
    step = F.when(F.col("begins") == 0, F.col("step0")).otherwise(F.col("step1"))
    p = p.join(ranges, ["file", "start"]).select(
        "file", "start", "id", "text", (F.col("base") + own).alias("depth"), (F.col("base") + own - step).alias("was"),
        ((F.col("begins") + F.col("turned") + F.col("turns")) % 2 == 0).alias("bare"))
    # a brace outside strings that leads back to the array's depth ends an element
    p = p.withColumn("ends", (F.col("bare") & (F.col("depth") == 1)).cast("long"))
    p = p.withColumn("object", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    found = p.groupBy("file", "start").agg(F.sum("ends").alias("n"))
    found = found.select("file", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    whole = p.join(found, ["file", "start"]).groupBy("file", (F.col("first") + F.col("object")).alias("object")).agg(
        F.array_sort(F.collect_list(F.struct("start", "id", "text"))).alias("parts"), F.max("ends").alias("ends"))
    text = F.array_join(F.transform("parts", lambda x: x["text"]), "")
    # what lies between elements: the array's bracket, commas, white space, elements that are no objects
    between = r'^[^{"]*+(?:"(?:[^"\\]++|\\.)*+"[^{"]*+)*+'
    return whole.filter("ends = 1").select("file", "object", F.regexp_replace(text, between, "").alias("text"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON array files as rows of ``schema``."""
    return array_objects(spark, path).select(F.from_json("text", schema).alias("row")).select("row.*")
