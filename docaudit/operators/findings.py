"""From verifier results to findings, and from findings to document totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.constants import FALLBACK_THRESHOLD, THRESHOLDS
from docaudit.functions.modeljson import parse_object, report_candidates
from docaudit.functions.text import lookup
from docaudit.operators.ranking import pages, position
from docaudit.schemas import FINDING, RAW_ERRORS


def threshold_for(verifier: Column, strictness: str = "strict", overrides: dict | None = None) -> Column:
    """Confidence a verifier must reach; unknown verifiers use the text threshold."""
    table = overrides if overrides is not None else THRESHOLDS[strictness]
    if not table:
        return F.lit(FALLBACK_THRESHOLD)
    return F.coalesce(lookup(table, verifier), F.lit(table.get("text", FALLBACK_THRESHOLD)))


def is_finding(strictness: str = "strict", overrides: dict | None = None) -> Column:
    return F.coalesce(
        F.col("error_detected") & (F.col("confidence") >= threshold_for(F.col("verifier_name"), strictness, overrides)),
        F.lit(False),
    )


def id_location(snippet_id: Column) -> Column:
    """Location read off an id: what follows its second underscore, else the whole id."""
    rest = F.regexp_extract(snippet_id, r"(?s)^[^_]*_[^_]*_(.*)$", 1)
    return F.when(snippet_id.rlike("^[^_]*_[^_]*_"), rest).otherwise(snippet_id)


def findings(results: DataFrame, strictness: str = "strict", overrides: dict | None = None,
             location: Column | None = None) -> DataFrame:
    """Results that count as predicted errors."""
    return results.where(is_finding(strictness, overrides)).select(
        "paper_id",
        "snippet_id",
        "order_key",
        F.coalesce(F.when(F.col("predicted_error_category") != "", F.col("predicted_error_category")), F.lit("Unknown")).alias(
            "error_category"
        ),
        (F.col("location") if location is None else location).alias("error_location"),
        "confidence",
        "verifier_name",
    )


def ranked(found: DataFrame) -> DataFrame:
    """Add pred_idx: position in the document by falling confidence, then by order."""
    return position(found, ["paper_id"], [-F.col("confidence"), F.col("order_key")], "pred_idx")


def finding_pages(ranked_findings: DataFrame, size: int = 1000) -> DataFrame:
    """Ranked findings as lists per document, in pages of bounded length."""
    item = F.struct(*[c for c in ranked_findings.columns if c not in ("paper_id", "pred_idx")])
    return pages(ranked_findings, ["paper_id"], "pred_idx", item, "predicted_errors", size)


def rollup(papers: DataFrame, results: DataFrame, strictness: str = "strict", overrides: dict | None = None,
           triaged: bool = False) -> DataFrame:
    """One row per document, also for those without results: counts and verifier usage.

    Rows accepted by triage count as snippets, but not as verified ones. After a triage pass
    (``triaged``) the usage counts all snippets under "triage", since all went through it.

    Counting per (document, verifier) first keeps the shuffle to a handful of rows per
    document and task, even for a document that owns a third of all results.
    """
    per_verifier = results.groupBy("paper_id", "verifier_name").agg(
        F.count("*").alias("n"),
        F.count_if(is_finding(strictness, overrides)).alias("errors"),
        F.max(F.when(is_finding(strictness, overrides), F.col("confidence"))).alias("top"),
    )
    per_paper = per_verifier.groupBy("paper_id").agg(
        F.sum("n").alias("total_snippets"),
        F.sum(F.when(F.col("verifier_name") != "triage", F.col("n"))).alias("snippets_verified"),
        F.sum("errors").alias("errors_detected"),
        F.max("top").alias("top_confidence"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("verifier_name", "n")))).alias("verifier_usage"),
    )
    if triaged:
        others = F.map_filter("verifier_usage", lambda k, _: k != "triage")
        per_paper = per_paper.withColumn("verifier_usage", F.map_concat(others, F.create_map(F.lit("triage"), "total_snippets")))
    return papers.join(per_paper, "paper_id", "left").withColumns(
        {
            "total_snippets": F.coalesce("total_snippets", F.lit(0)).cast("bigint"),
            "snippets_verified": F.coalesce("snippets_verified", F.lit(0)).cast("bigint"),
            "errors_detected": F.coalesce("errors_detected", F.lit(0)).cast("bigint"),
            "verifier_usage": F.coalesce("verifier_usage", F.expr("cast(map() as map<string, bigint>)")),
        }
    )


def verifier_usage(results: DataFrame, triaged: DataFrame | None = None) -> DataFrame:
    """Snippets per verifier over all documents. With a triage pass, each document counts
    its triaged snippets under "triage" if they outnumber the accepted ones."""
    per = results.groupBy("paper_id", "verifier_name").agg(F.count("*").alias("n"))
    if triaged is not None:
        passes = triaged.groupBy("paper_id").agg(F.count("*").alias("n")).withColumn("verifier_name", F.lit("triage"))
        per = per.unionByName(passes).groupBy("paper_id", "verifier_name").agg(F.max("n").alias("n"))
    return per.groupBy("verifier_name").agg(F.sum("n").alias("n_snippets"))


def run_totals(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count("*").alias("papers"),
        F.coalesce(F.sum("total_snippets"), F.lit(0)).alias("total_snippets"),
        F.coalesce(F.sum("snippets_verified"), F.lit(0)).alias("snippets_verified"),
        F.coalesce(F.sum("errors_detected"), F.lit(0)).alias("errors_detected"),
    )


def raw_errors(responses: DataFrame, response: str = "response") -> DataFrame:
    """Findings of a whole-document review, from the model's raw answer."""
    parsed = responses.withColumn("_r", parse_object(F.col(response), RAW_ERRORS))
    rows = parsed.select("paper_id", F.posexplode_outer("_r.errors").alias("order_key", "e")).where(F.col("e").isNotNull())

    def or_unknown(c: Column) -> Column:
        return F.coalesce(F.when(c != "", c), F.lit("Unknown"))

    return rows.select(
        "paper_id",
        F.concat(F.col("paper_id").cast("string"), F.lit("_baseline")).alias("snippet_id"),
        F.col("order_key").cast("bigint").alias("order_key"),
        or_unknown(F.col("e.error_category")).alias("error_category"),
        or_unknown(F.col("e.error_location")).alias("error_location"),
        F.coalesce(F.col("e.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.coalesce("e.supporting_evidence", F.lit("")).alias("supporting_evidence"),
        F.lit("single_call_baseline").alias("verifier_name"),
    )


def reports(outputs: DataFrame, saved: DataFrame | None = None, output: str = "output") -> DataFrame:
    """Report of each document: the one inside its output text, else its saved report
    (see ``scan_reports``) if that holds findings, else an empty one with verdict UNKNOWN."""
    body = F.from_json(
        F.get(report_candidates(F.col(output)), F.lit(0)), f"struct<verdict: string, predicted_errors: array<{FINDING}>>"
    )
    found = outputs.select("paper_id", body.alias("_own"))
    if saved is None:
        found = found.withColumn("_saved", F.lit(None).cast(f"struct<verdict: string, predicted_errors: array<{FINDING}>>"))
    else:
        kept = saved.where(F.size("predicted_errors") > 0)
        found = found.join(
            kept.select("paper_id", F.struct("verdict", "predicted_errors").alias("_saved")), "paper_id", "left"
        )
    pick = F.coalesce("_own", "_saved")
    return found.select(
        "paper_id",
        pick.isNotNull().alias("success"),
        F.coalesce(pick["verdict"], F.lit("UNKNOWN")).alias("verdict"),
        F.coalesce(pick["predicted_errors"], F.expr(f"cast(array() as array<{FINDING}>)")).alias("predicted_errors"),
    )
