"""Cheap scoring of every snippet, and the choice of those that deserve a specialist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.constants import (
    SWEEP_GRID, THEOREM_TYPES, TRIAGE_WORDS, UNCERTAINTY_THRESHOLD, VISUAL_TYPES,
)
from docaudit.functions.text import contains_any, strip
from docaudit.operators import routing


def rule_score(df: DataFrame) -> DataFrame:
    """Deterministic scorer: adds uncertainty and suggested_route."""
    body = F.lower(F.coalesce(F.when(F.col("latex") != "", F.col("latex")), F.col("content")))
    verdict = (
        F.when(F.col("snippet_type") == "EQUATION", F.struct(F.lit(0.72).alias("u"), F.lit("math").alias("r")))
        .when(contains_any(body, TRIAGE_WORDS), F.struct(F.lit(0.65).alias("u"), F.lit("text").alias("r")))
        .when(F.col("snippet_type").isin(VISUAL_TYPES), F.struct(F.lit(0.40).alias("u"), F.lit("vision").alias("r")))
        .otherwise(F.struct(F.lit(0.08).alias("u"), F.lit("none").alias("r")))
    )
    ready = routing.can_verify("triage")
    scored = df.withColumn("_t", F.when(ready, verdict))
    return scored.withColumns(
        {
            "uncertainty": F.coalesce("_t.u", F.lit(0.0)),
            "suggested_route": F.coalesce("_t.r", F.lit("none")),
        }
    ).drop("_t")


def default_label(kind: Column) -> Column:
    return (
        F.when(kind == "EQUATION", "math")
        .when(kind.isin(VISUAL_TYPES), "vision")
        .when(kind.isin(THEOREM_TYPES), "proof")
        .otherwise("text")
    )


def clamp(value: Column) -> Column:
    """A number in [0, 1]; 0 where the text is not a number."""
    number = value.try_cast("double")
    return F.when(number.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def scorer_outcome(df: DataFrame, raw: str, label: str, failed: str, threshold: float = UNCERTAINTY_THRESHOLD) -> DataFrame:
    """Read an external triage scorer's raw output; a failed call fails open."""
    ready, broken = routing.can_verify("triage"), F.col(failed)
    named = F.when(strip(F.lower(F.col(label))) != "", strip(F.lower(F.col(label)))).otherwise("text")
    return df.withColumns(
        {
            "uncertainty": F.when(~ready, 0.0)
            .when(broken, F.lit(max(threshold, 0.5)))
            .otherwise(clamp(F.col(raw))),
            "suggested_route": F.when(~ready, "none").when(broken, default_label(F.col("snippet_type"))).otherwise(named),
        }
    )


def select_uncertain(df: DataFrame, threshold: float = UNCERTAINTY_THRESHOLD, budget: int | None = None,
                     group: str = "paper_id", order: str = "order_key") -> DataFrame:
    """Rows at or above the threshold, at most ``budget`` per document (highest first).

    The rank filter becomes a per-task group limit ahead of the shuffle, so a huge
    document sends at most ``budget`` rows per task, whatever its size.
    """
    above = df.where(F.col("uncertainty") >= threshold)
    if budget is None:
        return above
    best = Window.partitionBy(group).orderBy(F.desc("uncertainty"), F.asc(order))
    return above.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= budget).drop("_rank")


def accepted(snippets: DataFrame, verified: DataFrame, key: str = "snippet_id") -> DataFrame:
    """Snippets without a specialist result, recorded as low risk."""
    return snippets.join(verified.select(key), key, "left_anti").withColumns(
        {
            "verifier_name": F.lit("triage"),
            "status": F.lit("NO_ERROR"),
            "error_detected": F.lit(False),
            "confidence": F.greatest(F.lit(0.0), 1.0 - F.col("uncertainty")),
        }
    )


def region(kind: Column, section_idx: Column) -> Column:
    """Name of the document region a snippet belongs to."""
    return (
        F.when(kind == "EQUATION", "Equation Chain")
        .when(kind.isin(VISUAL_TYPES), "Figures / Tables")
        .when(kind.isin(THEOREM_TYPES), "Theorems / Proofs")
        .when(section_idx.isNotNull(), F.concat(F.lit("Section "), section_idx.cast("string")))
        .otherwise("Other")
    )


def uncertainty_map(df: DataFrame, section_idx: Column, group: str = "paper_id") -> DataFrame:
    """Mean, maximum and number of scores per document and region."""
    return df.groupBy(group, region(F.col("snippet_type"), section_idx).alias("region")).agg(
        F.avg("uncertainty").alias("mean_uncertainty"),
        F.max("uncertainty").alias("max_uncertainty"),
        F.count("*").alias("n"),
    )


def escalations(selected: DataFrame, k: int = 20, group: str = "paper_id", order: str = "order_key") -> DataFrame:
    """The k most uncertain selected snippets per document."""
    best = Window.partitionBy(group).orderBy(F.desc("uncertainty"), F.asc(order))
    return selected.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def threshold_sweep(scored: DataFrame, grid: list[float] = SWEEP_GRID, group: str = "paper_id") -> DataFrame:
    """What each threshold would have cost and found, from scores computed once.

    Input columns: uncertainty, routed_to (null if no specialist) and is_finding.
    All thresholds are conditional aggregates of one pass, so rows are not multiplied
    by the grid and partial aggregation shrinks each document before the shuffle.
    """
    aggs = []
    for i, theta in enumerate(grid):
        on = F.col("uncertainty") >= theta
        aggs += [
            F.count_if(on).alias(f"c{i}"),
            F.count_if(on & F.col("is_finding")).alias(f"e{i}"),
            F.array_sort(F.collect_set(F.when(on, F.col("routed_to")))).alias(f"r{i}"),
        ]
    rows = [
        F.struct(
            F.lit(theta).alias("threshold"),
            F.col(f"c{i}").alias("specialist_calls"),
            F.col(f"e{i}").alias("errors_detected"),
            F.col(f"r{i}").alias("routes_used"),
        )
        for i, theta in enumerate(grid)
    ]
    return scored.groupBy(group).agg(*aggs).select(group, F.inline(F.array(*rows)))


def sweep_findings(scored: DataFrame, grid: list[float] = SWEEP_GRID) -> DataFrame:
    """The findings (``is_finding``) each threshold keeps, one row per threshold and finding."""
    passed = F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= F.col("uncertainty"))
    return scored.where("is_finding").withColumn("threshold", F.explode(passed))
