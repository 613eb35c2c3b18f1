"""Catalog: tables written by the sinks and read again by the scans, and the whole corpus flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.operators import extract, metrics
from docaudit.plans import flows, inputs
from docaudit.plans.inputs import CORPUS_SQL
from docaudit.plans.registry import query
from docaudit.session import shared_path
from docaudit.sources import readers, sinks


@query("corpus_scan", """
SELECT doc_id::VARCHAR AS paper_id, left(text, 60) AS title, lang AS paper_category, 4::BIGINT AS n_items FROM documents""")
def _(spark, sf):
    path = shared_path(spark, "corpus")
    inputs.corpus(spark, sf).withColumnRenamed("paper_id", "doi/arxiv_id").write.parquet(path)
    return readers.scan_corpus(spark, path).select("paper_id", "title", "paper_category", F.size("paper_content").alias("n_items"))


@query("prediction_round_trip", """
SELECT doc_id::VARCHAR AS paper_id, source AS title, lang AS paper_category, n_chars AS total_snippets, 'Lemma ' || (doc_id % 9) AS error_location,
 round((doc_id % 10) / 10, 6) AS confidence FROM documents""")
def _(spark, sf):
    d, i = inputs.table(spark, sf, "documents"), F.col("doc_id")
    finding = F.struct(F.lit("x").alias("error_category"), F.concat(F.lit("Lemma "), (i % 9).cast("string")).alias("error_location"), (i % 10 / 10).alias("confidence"))
    rows = d.select(i.cast("string").alias("paper_id"), F.col("source").alias("title"), F.col("lang").alias("paper_category"), F.array(finding).alias("predicted_errors"), F.col("n_chars").alias("total_snippets"))
    path = shared_path(spark, "predictions")
    sinks.write_predictions(rows, path, "r1")
    back = readers.scan_predictions(spark, f"{path}/run=r1", lines=True)
    return back.select("paper_id", "title", "paper_category", "total_snippets", F.inline("predicted_errors")).select(
        "paper_id", "title", "paper_category", "total_snippets", "error_location", "confidence"
    )


@query("array_scan", """
SELECT doc_id::VARCHAR AS paper_id, sha256(text) AS title_digest, lang AS paper_category, n_chars AS total_snippets, (doc_id % 3 + 1)::BIGINT AS n_errors FROM documents""")
def _(spark, sf):
    d, i = inputs.table(spark, sf, "documents"), F.col("doc_id")
    found = F.transform(F.sequence(F.lit(0), i % 3), lambda n: F.struct(F.concat(F.lit('"}],{ \\'), n.cast("string")).alias("error_category"), F.lit("Lemma 1").alias("error_location")))
    row = F.struct(i.cast("string").alias("paper_id"), F.col("text").alias("title"), F.col("lang").alias("paper_category"), found.alias("predicted_errors"), F.col("n_chars").alias("total_snippets"))
    arrays = d.groupBy(F.floor(i / 100)).agg(F.to_json(F.collect_list(row), {"pretty": "true"}).alias("value"))
    path = shared_path(spark, "arrays")
    arrays.select("value").write.text(path)
    back = readers.scan_predictions(spark, path)
    return back.select("paper_id", F.sha2("title", 256).alias("title_digest"), "paper_category", "total_snippets", F.size("predicted_errors").alias("n_errors"))


@query("case_scan", """
SELECT conv_id::VARCHAR AS id, count(*)::BIGINT AS n_steps, max(length(text))::BIGINT AS longest, CASE conv_id % 2 WHEN 0 THEN 'math' ELSE 'gsm8k' END AS split FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    c = inputs.table(spark, sf, "conversations")
    steps = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    cases = steps.select(
        F.col("conv_id").cast("string").alias("id"), F.lit("g").alias("generator"), F.lit("").alias("problem"), F.col("s.text").alias("steps"),
        F.lit(True).alias("final_answer_correct"), F.lit(-1).alias("label"), F.when(F.col("conv_id") % 2 == 0, "math").otherwise("gsm8k").alias("split"),
    )
    path = shared_path(spark, "cases")
    cases.write.partitionBy("split").parquet(path)
    parts = [readers.scan_cases(spark, path, split).withColumn("split", F.lit(split)) for split in ("math", "gsm8k")]
    return parts[0].unionByName(parts[1]).select("id", F.size("steps").alias("n_steps"), F.array_max(F.transform("steps", F.length)).alias("longest"), "split")


@query("metrics_json", """
SELECT lang AS name, count(*)::BIGINT AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1""")
def _(spark, sf):
    d = inputs.table(spark, sf, "documents").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))
    path = shared_path(spark, "metrics")
    sinks.write_metrics(d, path)
    return spark.read.schema("name string, n bigint, mean double").json(path)


@query("confusion_csv", """
SELECT quality::BIGINT AS actual, count(*) FILTER (toxic = 0)::BIGINT AS predicted_0, count(*) FILTER (toxic = 1)::BIGINT AS predicted_1 FROM labels GROUP BY 1""")
def _(spark, sf):
    path = shared_path(spark, "confusion")
    sinks.write_confusion(metrics.confusion(inputs.table(spark, sf, "labels"), "quality", "toxic"), path)
    return spark.read.option("header", True).csv(path).select(*[F.col(c).cast("bigint").alias(c) for c in ("actual", "predicted_0", "predicted_1")])


@query("image_sink", """
SELECT doc_id::VARCHAR AS paper_id, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS digest FROM documents""")
def _(spark, sf):
    path = shared_path(spark, "images")
    sinks.write_images(extract.images(inputs.corpus(spark, sf)), path)
    return spark.read.parquet(path).select("paper_id", F.octet_length("image").alias("n_bytes"), F.sha2("image", 256).alias("digest"))


# Of each document's rows, one for every third id beside its own, only one is segmented.
@query("verified_corpus", f"""
WITH {CORPUS_SQL} SELECT paper_id, 1::BIGINT AS n_rows FROM papers""")
def _(spark, sf):
    c = inputs.corpus(spark, sf)
    out = flows.verify_corpus(c.unionByName(c.where(F.col("paper_id").cast("bigint") % 3 == 0)), mode="uncertainty", budget=20)
    totals = out["snippets"].groupBy("paper_id").agg(F.count("*").alias("n"), F.count_distinct("snippet_id").alias("d"))
    same = totals.where("n = d").join(out["predictions"], "paper_id").where(F.col("n") == F.col("total_snippets"))
    return same.groupBy("paper_id").agg(F.count("*").alias("n_rows"))
