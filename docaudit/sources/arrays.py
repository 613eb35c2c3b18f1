"""JSON arrays of any length, read by all tasks: a file is split where tasks may begin, also in the middle of a record.

Spark cuts the file at every ``}``, which splits at any byte. Whether such a brace ends a record depends on all text
before it: whether it stands in a string, and how deep. Each split finds both for the two cases that it begins
outside or inside a string; one row a split, added up in order, then tells which case holds and how deep it begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.session import stored

SPLIT = ["file", "block"]


def _length_of(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, value, quotes, even, odd, opener): the text before each closing brace, in order of id within a split.

    ``quotes`` counts what opens or closes a string. ``even`` and ``odd`` are the changes of depth if the
    fragment begins outside and inside a string. ``opener`` is the first sign that is no blank.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    cut = raw.withColumn("_parts", F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1))  # without escaped signs

    def depth(parity: int) -> Column:
        outside = F.array_join(F.filter("_parts", lambda x, i: i % 2 == parity), "")
        return F.transform(F.array(outside), lambda x: _length_of(x, "{[") - _length_of(x, "}]"))[0]

    opener = F.regexp_extract("value", r"^[\s\x{FEFF}]*(\S)", 1)
    return cut.select(*SPLIT, "id", "value", (F.size("_parts") - 1).alias("quotes"), depth(0).alias("even"), depth(1).alias("odd"), opener.alias("opener"))


def _both_ways(fragments: DataFrame) -> DataFrame:
    """Depth after each fragment and its brace, and whether that brace is outside strings, counted from the begin of the split:
    ``d0``, ``out0`` if it begins outside a string, ``d1``, ``out1`` if inside."""
    run = Window.partitionBy(*SPLIT).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = fragments.withColumn("_after", F.sum("quotes").over(run) % 2)
    begun = (F.col("_after") + F.col("quotes")) % 2  # in a string at the begin of the fragment
    rows = inside.withColumns({
        "out0": F.col("_after") == 0,
        "out1": F.col("_after") == 1,
        "_c0": F.when(begun == 0, F.col("even")).otherwise(F.col("odd")) - F.when(F.col("_after") == 0, 1).otherwise(0),
        "_c1": F.when(begun == 0, F.col("odd")).otherwise(F.col("even")) - F.when(F.col("_after") == 1, 1).otherwise(0),
    })
    return rows.withColumns({"d0": F.sum("_c0").over(run), "d1": F.sum("_c1").over(run)})


def _placed(ways: DataFrame, begins: DataFrame) -> DataFrame:
    """Fragments with ``ends``, whether a record ends at their brace."""
    rows = ways.join(begins, SPLIT)
    depth = F.col("depth") + F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))
    outside = F.when(F.col("inside") == 0, F.col("out0")).otherwise(F.col("out1"))
    return rows.withColumn("ends", outside & (depth == F.col("base")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): each object of the arrays of the files below ``path``, numbered from 0 in each file.

    A file holds an array of objects, several arrays one after another, or objects without an array, one or more. Other items
    of an array are passed over; an object that the end of its file cuts off gives no row; a file without objects
    none. A task holds a split, whatever the length of the file, and a record.
    """
    fragments = stored(_fragments(spark, path), "array-fragments")  # sums below read its numbers only
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbers = fragments.drop("value")
    sums = _both_ways(numbers).groupBy(*SPLIT).agg(
        (F.sum("quotes") % 2).alias("odd_quotes"), F.max_by("d0", "id").alias("t0"), F.max_by("d1", "id").alias("t1"), F.min_by("opener", "id").alias("opener")
    )
    sums = sums.withColumn("inside", F.coalesce(F.sum("odd_quotes").over(before), F.lit(0)) % 2)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = sums.select(
        *SPLIT, "inside",
        F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("t0")).otherwise(F.col("t1"))).over(before), F.lit(0)).alias("depth"),
        F.when(F.first("opener").over(whole) == "[", 1).otherwise(0).alias("base"),
    )
    begins = stored(begins, "array-begins")
    ended = _placed(_both_ways(numbers), begins).groupBy(*SPLIT).agg(F.count_if("ends").alias("n_ends"))
    earlier = stored(ended.select(*SPLIT, F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("earlier")), "array-ends")
    run = Window.partitionBy(*SPLIT).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _placed(_both_ways(fragments), begins.join(earlier, SPLIT))
    record = F.col("earlier") + F.sum(F.col("ends").cast("bigint")).over(run) - F.col("ends").cast("bigint")
    parts = placed.select("file", record.alias("record"), F.struct("block", "id", "value").alias("_p"), "ends")
    joined = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list("_p")).alias("_p"), F.max("ends").alias("_whole")).where("_whole")
    text = F.regexp_replace(F.array_join(F.col("_p.value"), "}"), r"^[^{]*", "")
    return joined.select("file", "record", F.concat(text, F.lit("}")).alias("text"))


def scan_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON arrays as rows of ``schema``; one that cannot be read gives a row of nulls."""
    return records(spark, path).select(F.from_json("text", schema).alias("_r")).select("_r.*")
