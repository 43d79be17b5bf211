"""One large JSON object ``{"id": "entity", ...}`` read in parallel and written as one file.

Spark's text source cuts a file into byte ranges and, with the comma as
line separator, each range into the pieces between commas.  A comma is a
border between members if an even number of quotes (escaped ones aside)
lies before it.  Quotes are counted for each range, the ranges' sums - one
row each - are added up in file order, and so every range knows whether it
starts inside a string and with which member: no task reads a whole file,
none waits for another.  Pieces of a member whose strings hold commas meet
by its number.

Values are strings, numbers, booleans or null (as text); of repeated keys
the last holds, as in a dictionary; an object without members has no rows;
anything else - text that isn't an object, nested values - raises.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE = ("file", "block")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, row, value, quotes)``: what lies between commas, in the order of ``row`` within its range."""
    value = F.col("value")
    plain = F.regexp_replace(value, r"\\.", "")  # an escape is never cut: no comma can follow its backslash
    return spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value",
        (F.length(plain) - F.length(F.replace(plain, F.lit('"')))).cast("long").alias("quotes"))


def _numbered(pieces: DataFrame) -> DataFrame:
    """Adds ``member``: how many borders of its file lie before the piece."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(*RANGE).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    opened = pieces.withColumn("own", F.coalesce(F.sum("quotes").over(here), F.lit(0)))
    # borders of a range, if it starts outside a string and if inside
    ranges = opened.groupBy(*RANGE).agg(F.sum("quotes").alias("quotes"), F.sum((F.col("own") % 2 == 0).cast("long")).alias("even"),
                                        F.sum((F.col("own") % 2 == 1).cast("long")).alias("odd"))
    started = ranges.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    started = started.withColumn("borders", F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd"))) \
        .select(*RANGE, "inside", F.coalesce(F.sum("borders").over(earlier), F.lit(0)).alias("before"))
    placed = opened.join(F.broadcast(started), list(RANGE)) \
        .withColumn("starts", ((F.col("own") + F.col("inside")) % 2 == 0).cast("long"))
    upto = Window.partitionBy(*RANGE).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("member", F.col("before") + F.sum("starts").over(upto))


def read_json_object(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value)`` of the members of the object in each file of ``path``."""
    numbered = _numbered(_pieces(spark, path))
    order = F.array_sort(F.collect_list(F.struct("block", "row", "value")))
    members = numbered.groupBy("file", "member").agg(F.array_join(F.transform(order, lambda p: p["value"]), ",").alias("text"))
    last = members.groupBy("file").agg(F.max("member").alias("last"))  # one row a file
    ends = members.join(F.broadcast(last), "file")
    body = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    first, closing = F.col("member") == 1, F.col("member") == F.col("last")
    good = (~first | body.startswith("{")) & (~closing | body.endswith("}"))
    cut = F.substring(body, F.when(first, 2).otherwise(1), F.length(body) - first.cast("int") - closing.cast("int"))
    found = ends.select("file", "member", "last", F.col("text"), good.alias("good"), cut.alias("cut"))
    single = F.from_json(F.concat(F.lit("{"), F.col("cut"), F.lit("}")), "map<string,string>")
    nothing = (F.col("last") == 1) & (F.trim(F.regexp_replace("cut", r"\s+", "")) == "")
    bad = F.raise_error(F.concat(F.lit("not a member of a JSON object: "), F.substring("text", 1, 200)))
    wrong = ~F.col("good") | F.col("m").isNull() | (F.size("m") != 1) | F.element_at(F.map_values("m"), 1).rlike(r"^\s*[\[{]") \
        & F.col("cut").rlike(r':\s*[\[{]')
    # one expression: a filter and the check could change places
    held = F.when(F.col("good") & nothing, F.create_map().cast("map<string,string>")) \
        .when(wrong, bad.cast("map<string,string>")).otherwise(F.col("m"))
    rows = found.withColumn("m", single).select("file", "member", F.explode(held).alias("key", "value"))
    return rows.groupBy("file", "key").agg(F.max_by("value", "member").alias("value")).select("key", "value")


def write_json_object(rows: DataFrame, path: str) -> None:
    """``(key, value)`` strings as one object in one file: members stream through the task that writes it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = "{"
        for batch in batches:
            lines = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines.append(f"{between}{json.dumps(key)}: {json.dumps(value)}")
                between = ", "
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["{}" if between == "{" else "}"])], names=["value"])

    rows.select(F.col("key").cast("string"), F.col("value").cast("string")).coalesce(1).mapInArrow(run, "value string") \
        .write.mode("error").option("lineSep", "\n").text(path)
