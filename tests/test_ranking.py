"""Positions in groups: ranges give what a plain window gives."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from docaudit.operators import ranking


def test_ranges_equal_window(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(40)}", rng.choice([0.2, 0.8, 0.9]), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, c double, i long")
    order = [-F.col("c"), F.col("i")]
    w = Window.partitionBy("g").orderBy(*order)
    plain = {(r.g, r.i): r.p for r in df.withColumn("p", F.row_number().over(w) - 1).collect()}
    got = ranking.position(df, ["g"], order, "p")
    assert {(r.g, r.i): r.p for r in got.collect()} == plain and got.columns == ["g", "c", "i", "p"]


def test_null_group_over_several_ranges(spark):
    df = spark.range(3000).select(F.lit(None).cast("string").alias("g"), "id")
    assert ranking.position(df, ["g"], [F.col("id")], "p").where("p <> id").count() == 0


def test_rows_are_shuffled_once(spark):
    """What is returned joins a row a range to the saved rows: no window over them, and no column that only orders."""
    rows = [(None if i % 7 == 0 else f"g{i % 5}", i % 3, float(i % 11), i, "x" * i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, h int, c double, i long, t string").repartition(6)
    order = [-F.col("c"), F.col("i")]
    for keys in (["g", "h"], ["h"], []):
        got = ranking.position(df, keys, order, "p", drop=["c", "t"])
        assert got.columns == ["g", "h", "i", "p"]
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" not in plan and "_ord" not in plan
        w = Window.partitionBy(*keys).orderBy(*order)
        assert {r.i: r.p for r in got.collect()} == {r.i: r.p for r in df.select("i", (F.row_number().over(w) - 1).alias("p")).collect()}
    assert ranking.position(df.filter("false"), ["g"], order, "p").count() == 0


def test_pages_keep_everything(spark):
    df = spark.range(2500).select(F.lit("a").alias("g"), F.col("id").alias("i"))
    out = ranking.pages(df, ["g"], "i", F.col("i"), "l", 1000).orderBy("page").collect()
    assert [len(r.l) for r in out] == [1000, 1000, 500]
    assert sum((r.l for r in out), []) == list(range(2500))
