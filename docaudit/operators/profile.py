"""What a corpus holds: columns, content items, value counts, samples, single documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.text import head
from docaudit.operators.ranking import pages


def column_inventory(df: DataFrame) -> DataFrame:
    """Name, type and position of every column with the row count (read from file footers)."""
    cols = [
        F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(n).alias("column_name"), F.lit(t).alias("column_type"))
        for i, (n, t) in enumerate(df.dtypes)
    ]
    return df.agg(F.count("*").alias("n_rows")).select(F.inline(F.array(*cols)), "n_rows")


def content_census(corpus: DataFrame) -> DataFrame:
    """Content items by type; reads the type field only."""
    return corpus.select(F.explode("paper_content.type").alias("type")).groupBy(
        F.coalesce("type", F.lit("unknown")).alias("type")
    ).agg(F.count("*").alias("n_items"))


def content_keys(corpus: DataFrame) -> DataFrame:
    """Which item fields are ever filled."""
    item = F.col("item")
    fields = ["type", "text", "image_url"]
    return (
        corpus.select(F.explode("paper_content").alias("item"))
        .agg(*[F.count(item[f]).alias(f) for f in fields])
        .select(F.inline(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).alias("n_filled")) for f in fields])))
    )


def row_flags(corpus: DataFrame) -> DataFrame:
    """Rows with an image, and rows with local content."""
    return corpus.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.exists("paper_content", lambda x: x["type"] == "image_url")).alias("rows_with_images"),
        F.count_if(F.size("error_local_content") > 0).alias("rows_with_local_content"),
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of the non-null values of several columns in one pass over the data."""
    cells = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.inline(cells)).where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(F.count("*").alias("n"))
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def sample_items(corpus: DataFrame, order: str, n_rows: int = 5, n_items: int = 20) -> DataFrame:
    """Items of the first rows with a 200-character preview: a sampling report by design."""
    rows = corpus.orderBy(order).limit(n_rows).select(order, F.posexplode("paper_content").alias("pos", "item"))
    text = F.col("item.text")
    return (
        rows.orderBy(order, "pos")
        .limit(n_items)
        .select(
            order,
            "pos",
            F.coalesce("item.type", F.lit("unknown")).alias("type"),
            text.isNotNull().alias("has_text"),
            F.col("item.image_url").isNotNull().alias("has_image_url"),
            F.when(text != "", head(text, 200)).alias("text_preview"),
        )
    )


def same_id(df: DataFrame, key: str, wanted: str) -> Column:
    """Equality by text, written so that the filter reaches the scan."""
    kind = df.schema[key].dataType.simpleString()
    if kind == "string":
        return F.col(key) == F.lit(wanted)
    # the constant is converted, not the column; a text that is no such number matches nothing
    return F.col(key) == F.lit(wanted).try_cast(kind)


def get_paper(corpus: DataFrame, wanted: str, key: str = "paper_id", text_chars: int = 3000, url_chars: int = 500) -> DataFrame:
    """One document with its long items shortened for display."""

    def short(text: Column, n: int) -> Column:
        return F.when(F.length(text) > n, F.concat(head(text, n), F.lit("... [truncated]"))).otherwise(text)

    found = corpus.where(same_id(corpus, key, wanted))
    if "paper_content" not in corpus.columns:
        return found
    return found.withColumn("n_content_items", F.size("paper_content")).withColumn(
        "paper_content",
        F.transform(
            "paper_content",
            lambda x: F.struct(
                x["type"].alias("type"),
                short(x["text"], text_chars).alias("text"),
                F.when(
                    x["image_url"].isNotNull(), F.struct(short(x["image_url"]["url"], url_chars).alias("url"))
                ).alias("image_url"),
            ),
        ),
    )


def list_papers(df: DataFrame, key: str, title: str, columns: list[str], limit: int = 50, offset: int = 0, after=None) -> DataFrame:
    """One page of documents in key order, with the total.

    ``after`` (the last key of the page before) turns a deep page into a pushed-down
    filter and a short top-k, where ``offset`` has to pass over all rows before it.
    """
    total = df.select(F.count("*"))
    page = df if after is None else df.where(F.col(key) > F.lit(after))
    ordered = page.select(key, head(F.col(title), 200).alias(title), *columns).orderBy(key)
    if after is None and offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit).withColumn("total", total.scalar())


def restrict(df: DataFrame, ids: DataFrame | list, key: str) -> DataFrame:
    """Keep the given ids: a pushed-down IN list, or a semi join that Spark sizes itself."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(key), key, "left_semi")
    return df.where(F.col(key).isin(list(ids)))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def collapse_annotations(df: DataFrame, key: str, index: str, listed: list[str], first: list[str], size: int = 1000) -> DataFrame:
    """One row per document and page: lists of some columns, first value of the others.

    A document with up to ``size`` annotations has exactly one page.
    """
    lists = pages(df, [key], index, F.struct(*listed), "_l", size)
    firsts = df.groupBy(key).agg(*[F.min_by(c, index).alias(c) for c in first])
    out = lists.join(firsts, key)
    return out.select(key, "page", *first, *[F.col("_l")[c].alias(c) for c in listed])


def corpus_profile(corpus: DataFrame, categories: list[str]) -> DataFrame:
    """The schema report as one long table (dimension, value, n)."""

    def long(df: DataFrame, dimension: str, value: str, n: str) -> DataFrame:
        return df.select(F.lit(dimension).alias("dimension"), F.col(value).cast("string").alias("value"), F.col(n).alias("n"))

    flags = row_flags(corpus)
    melted = flags.select(
        F.inline(F.array(*[F.struct(F.lit("rows").alias("dimension"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in flags.columns]))
    )
    parts = [
        melted,
        long(content_census(corpus), "content_type", "type", "n_items"),
        long(content_keys(corpus), "item_key", "key", "n_filled"),
        value_counts(corpus, categories),
    ]
    return reduce(DataFrame.unionByName, parts)
