"""Scorers: built-in content rules as expressions, user models as partition functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.constants import (
    CATEGORY_DATA, CATEGORY_FIGURE, CATEGORY_PROOF, CITATION_WORDS, CONTRADICTION_WORDS, REVIEW_WORDS,
)
from docaudit.functions.text import contains_any
from docaudit.operators.extract import symbol_domain

VERDICT = "struct<error_detected: boolean, confidence: double, predicted_error_category: string>"


def verdict(detected: bool, confidence: float, category: str | None = None) -> Column:
    return F.struct(
        F.lit(detected).alias("error_detected"),
        F.lit(confidence).cast("double").alias("confidence"),
        F.lit(category).cast("string").alias("predicted_error_category"),
    )


def citation_rule(text: Column) -> Column:
    low = F.lower(text)
    return F.when(contains_any(low, CITATION_WORDS), verdict(True, 0.85, CATEGORY_PROOF)).otherwise(verdict(False, 0.90))


def visual_rule(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(F.contains(low, F.lit("duplicat")), verdict(True, 0.85, CATEGORY_FIGURE))
        .when(F.contains(low, F.lit("inconsist")), verdict(True, 0.72, CATEGORY_DATA))
        .otherwise(verdict(False, 0.90))
    )


def text_rule(text: Column) -> Column:
    low = F.lower(text)
    suspicious = contains_any(low, CONTRADICTION_WORDS)
    proof = F.contains(low, F.lit("theorem")) & contains_any(low, ["proof", "lemma"])
    return (
        F.when(suspicious & proof, verdict(True, 0.78, CATEGORY_PROOF))
        .when(suspicious, verdict(False, 0.82))
        .otherwise(verdict(False, 0.95))
    )


def review_rule(text: Column) -> Column:
    """Whole-document review: one error if the text uses a telling word, else null."""
    return F.when(contains_any(F.lower(text), REVIEW_WORDS), verdict(True, 0.80, CATEGORY_PROOF))


def statement_class(text: Column) -> Column:
    """(statement_class, domain) of a mathematical statement, by its surface cues."""
    low = F.lower(text)

    def cls(name: str, domain: str) -> Column:
        return F.struct(F.lit(name).alias("statement_class"), F.lit(domain).alias("domain"))

    declares = F.contains(text, F.lit("\\mathbb")) | F.contains(text, F.lit("\\in"))
    case = None
    for letter, domain in (("r", "real"), ("n", "natural"), ("z", "integer")):
        cond = declares & F.contains(low, F.lit("\\mathbb{%s}" % letter))
        value = cls("uncheckable_declaration", domain)
        case = F.when(cond, value) if case is None else case.when(cond, value)
    return (
        case.when(
            F.contains(text, F.lit("> 0")) & ~F.contains(low, F.lit("sqrt")),
            cls("uncheckable_declaration", "positive_real"),
        )
        .when(contains_any(low, ["(a+b)^2", "(a + b)^2"]), cls("checkable_derivation", "real"))
        .when(
            F.contains(text, F.lit("=")) & contains_any(low, ["define", "let", "definition"]),
            cls("uncheckable_declaration", "unknown"),
        )
        .when(contains_any(low, ["constraint", "condition", "circle", "unit"]), cls("checkable_constraint", "real"))
        .otherwise(cls("checkable_derivation", "unknown"))
    )


def declared_domain(text: Column) -> Column:
    """Domain from the LaTeX patterns, else from the statement cues."""
    return F.coalesce(symbol_domain(text), statement_class(text)["domain"])


def status_of(eligible: Column, failed: Column, detected: Column) -> Column:
    return (
        F.when(~eligible | failed, "SKIPPED").when(detected, "ERROR_DETECTED").otherwise("NO_ERROR")
    )


def best_chunk_finding(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """One finding per snippet from its chunks.

    Columns in: chunk_idx, failed, error_detected, confidence, reasoning,
    predicted_error_category. An error beats a clean chunk, then confidence, then
    the earlier chunk. One aggregation with partial results, so a snippet of any
    number of chunks stays cheap.
    """
    ok = ~F.col("failed")
    score = F.when(ok, F.struct(F.col("error_detected"), F.coalesce("confidence", F.lit(0.0)), -F.col("chunk_idx")))
    pick = F.struct("chunk_idx", "error_detected", "confidence", "reasoning", "predicted_error_category")
    best = chunks.groupBy(*keys).agg(
        F.max_by(pick, score).alias("_b"),
        F.count("*").alias("n_chunks"),
        F.count_if(~ok).alias("n_failed"),
    )
    none = F.col("n_failed") == F.col("n_chunks")
    where = F.concat(
        F.lit("[chunk "), (F.col("_b.chunk_idx") + 1).cast("string"), F.lit("/"), F.col("n_chunks").cast("string"), F.lit("] ")
    )
    return best.select(
        *keys,
        "n_chunks",
        "n_failed",
        F.when(none, "UNVERIFIABLE").when(F.col("_b.error_detected"), "ERROR_DETECTED").otherwise("NO_ERROR").alias("status"),
        F.coalesce(F.when(~none, F.col("_b.error_detected")), F.lit(False)).alias("error_detected"),
        F.when(none, 0.0).otherwise(F.col("_b.confidence")).alias("confidence"),
        F.when(none, F.lit(None).cast("string"))
        .otherwise(F.concat(F.when(F.col("n_chunks") > 1, where).otherwise(F.lit("")), F.coalesce("_b.reasoning", F.lit(""))))
        .alias("reasoning"),
        F.when(~none, F.col("_b.predicted_error_category")).alias("predicted_error_category"),
    )


class ScorerRegistry:
    """Named scorers. An expression scorer maps the text column to a verdict struct; a
    batch scorer is a pandas iterator function that adds the verdict columns."""

    def __init__(self) -> None:
        self._expressions: dict[str, Callable[[Column], Column]] = {}
        self._batches: dict[str, Callable[[Iterator], Iterator]] = {}

    def _claim(self, name: str, scorer: Callable) -> None:
        held = self._expressions.get(name) or self._batches.get(name)
        if held is not None and held is not scorer:
            raise ValueError(f"scorer {name!r} is already registered")

    def register(self, name: str, scorer: Callable[[Column], Column]) -> None:
        self._claim(name, scorer)
        self._expressions[name] = scorer

    def register_batch(self, name: str, scorer: Callable[[Iterator], Iterator]) -> None:
        self._claim(name, scorer)
        self._batches[name] = scorer

    def has(self, name: str) -> bool:
        return name in self._expressions or name in self._batches

    def get(self, name: str) -> Callable:
        if not self.has(name):
            raise KeyError(f"no scorer named {name!r}; known: {self.names()}")
        return self._expressions.get(name) or self._batches[name]

    def names(self) -> list[str]:
        return sorted([*self._expressions, *self._batches])

    def apply(self, routed: DataFrame, route: str = "verifier_name", text: str = "content") -> DataFrame:
        """Score every row by the scorer its route names; rows of unknown routes are SKIPPED.

        Expression scorers share one CASE in one pass. Each batch scorer sees only the
        rows routed to it: the filter sits below the Python boundary.
        """
        name = F.col(route)
        case = F.lit(None).cast(VERDICT)
        for key, scorer in self._expressions.items():
            case = F.when(name == key, scorer(F.col(text))).otherwise(case)
        native = routed if not self._batches else routed.where(~F.coalesce(name.isin(list(self._batches)), F.lit(False)))
        out = [native.withColumn("_v", case)]
        schema = routed.schema
        for key, scorer in self._batches.items():
            part = routed.where(name == key)
            cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            scored = part.mapInPandas(
                scorer, f"{cols}, error_detected boolean, confidence double, predicted_error_category string"
            )
            out.append(
                scored.withColumn("_v", F.struct("error_detected", "confidence", "predicted_error_category")).drop(
                    "error_detected", "confidence", "predicted_error_category"
                )
            )
        union = reduce(DataFrame.unionByName, out)
        missing = F.col("_v").isNull()
        return union.select(
            *routed.columns,
            F.when(missing, "SKIPPED").when(F.col("_v.error_detected"), "ERROR_DETECTED").otherwise("NO_ERROR").alias("status"),
            F.coalesce("_v.error_detected", F.lit(False)).alias("error_detected"),
            F.coalesce("_v.confidence", F.lit(0.0)).alias("confidence"),
            F.col("_v.predicted_error_category").alias("predicted_error_category"),
        )


def default_registry() -> ScorerRegistry:
    """The built-in deterministic scorers."""
    registry = ScorerRegistry()
    registry.register("text", text_rule)
    registry.register("vision", visual_rule)
    registry.register("citation", citation_rule)
    registry.register("llm_only", text_rule)
    return registry
