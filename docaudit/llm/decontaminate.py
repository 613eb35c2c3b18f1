"""Benchmark decontamination by winnowed fingerprints, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import documents, free_name, stored, text_key

SPAN = 10  # words of a window
GRAM = 5  # words of a fingerprinted gram; any SPAN words hold a whole run of SPAN - GRAM + 1 grams
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case; none for null."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, PARTING), "")


def starts(count: Column, width: Column | int) -> Column:
    """0, 1, ... for each run of ``width`` in ``count`` values; empty if there is none."""
    last = count - F.lit(width) if isinstance(width, int) else count - width
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def grams(words: Column, n: int) -> Column:
    """A hash of each ``n`` consecutive words."""
    return F.transform(starts(F.size(words), n), lambda i: F.xxhash64(F.slice(words, i + 1, n)))


def winnowed(hashes: Column, width: int) -> Column:
    """The least hash of every ``width`` consecutive ones."""
    return F.array_distinct(F.transform(starts(F.size(hashes), width), lambda i: F.array_min(F.slice(hashes, i + 1, width))))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words of the window) and window, its words joined by one space, distinct.

    A window is SPAN consecutive words of an item; an item of fewer words, but not none, is one window.
    """
    items = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("words")).filter("size(words) > 0")
    n = F.least(F.size("words"), F.lit(SPAN))
    one = items.select("item_id", "words", n.alias("n")).select("item_id", "n", "words", F.explode(starts(F.size("words"), F.col("n"))).alias("i"))
    return one.select("item_id", "n", F.array_join(F.slice("words", F.col("i") + 1, F.col("n")), " ").alias("window")).distinct()


def window_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """key, i, n, window: each start in a document of a benchmark window.

    ``docs`` has key and words. Full windows are sought through fingerprints: the least gram hash of each
    run of grams, which a shared window shares. Where a fingerprint of the benchmark occurs, the windows
    around it are compared word by word. Shorter windows have a length each, at most SPAN - 1 of them, and
    are sought as grams of that length. Fingerprint tables are written first, so Spark knows their
    size when it decides how to join.
    """
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # SPAN numbers at most
    texts = stored(windows.select("n", "window").distinct(), "benchmark-windows")
    found = []
    if SPAN in lengths:
        own = winnowed(grams(F.split("window", " "), GRAM), SPAN - GRAM + 1)
        prints = stored(texts.filter(F.col("n") == SPAN).select(F.explode(own).alias("mark")).distinct(), "benchmark-prints")
        hashed = docs.withColumn("hashes", grams(F.col("words"), GRAM))
        # The outer form: for the inner one Spark adds a filter on the array, which computes it twice.
        marks = F.explode_outer(winnowed(F.col("hashes"), SPAN - GRAM + 1)).alias("mark")
        marked = hashed.select("key", "words", "hashes", marks).join(prints, "mark")
        at = F.filter(F.transform("hashes", lambda h, i: F.when(h == F.col("mark"), i)), lambda i: i.isNotNull())
        last = F.size("words") - SPAN
        around = F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(p - (SPAN - GRAM), F.lit(0)), F.greatest(F.least(p, last), F.lit(0)))))
        tried = marked.select("key", "words", F.explode(F.array_distinct(around)).alias("i")).filter(F.col("i") <= F.size("words") - SPAN)
        found.append(tried.select("key", "i", F.lit(SPAN).alias("n"), F.array_join(F.slice("words", F.col("i") + 1, SPAN), " ").alias("window")))
    for n in lengths:
        if n < SPAN:
            at = docs.select("key", "words", F.explode(starts(F.size("words"), n)).alias("i"))
            found.append(at.select("key", "i", F.lit(n).alias("n"), F.array_join(F.slice("words", F.col("i") + 1, n), " ").alias("window")))
    if not found:
        return docs.select("key", F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit("").alias("window")).limit(0)
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return hits.join(texts, ["n", "window"]).select("key", "i", "n", "window").distinct()


def covered(spans: Column) -> Column:
    """How many words the (i, n) spans cover, the spans in order."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("sum"))

    def add(acc: Column, s: Column) -> Column:
        end = s["i"] + s["n"]
        more = F.greatest(end - F.greatest(acc["upto"], s["i"]), F.lit(0))
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["sum"] + more).alias("sum"))

    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["sum"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word inside any occurrence of a benchmark window is hit. Null and empty texts have no
    words; nor have such items, which never occur. Rows that repeat a doc_id and text get the same
    answer each; item_ids that repeat count once, a null item_id as none. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select("doc_id", text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("words"))
    windows = stored(benchmark_windows(benchmark), "benchmark-items")
    hits = stored(window_hits(keyed.select("key", "words"), windows), "benchmark-hits")
    spans = hits.groupBy("key").agg(covered(F.collect_set(F.struct("i", "n"))).cast("long").alias("n_hit"))
    items = hits.select("key", "n", "window").distinct().join(windows, ["n", "window"]).filter("item_id is not null").select("key", F.col("item_id").cast("string").alias("item_id")).distinct()
    ids = F.collect_list("item_id")
    items = items.groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(ids), ",").alias("ids"))
    per_text = stored(spans.join(items, "key", "left"), "benchmark-texts")
    rows = keyed.select("doc_id", "key", F.size("words").cast("long").alias("n_words")).join(per_text, "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    sha = F.sha2(F.coalesce("ids", F.lit("")), 256)
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), sha.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no window with the benchmark, with all their columns, whatever their names.

    A null or empty text has no words and stays, as do all rows if the benchmark has none; repeated rows stay or go together.
    """
    keyed = docs.select(text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("words"))
    hits = window_hits(keyed, stored(benchmark_windows(benchmark), "benchmark-items"))
    name = free_name(docs, "hit_key")
    hit = stored(hits.select(F.col("key").alias(name)).distinct(), "benchmark-hits")
    return docs.join(hit, text_key(F.col("text")) == F.col(name), "left_anti")


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
