"""Which verifier takes a snippet. All of it is column arithmetic: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.constants import DEFAULT_ROUTE, LABEL_ROUTES, TEXT_TYPES, TYPE_ROUTES, VERIFIERS, VISUAL_TYPES
from docaudit.functions.text import lookup, strip
from docaudit.operators.extract import citation_heavy

DIGIT = r"\p{Nd}|[²³¹⁰⁴-⁹₀-₉]"


def can_verify(verifier: str, enabled: bool = True) -> Column:
    """Whether ``verifier`` can take the row (columns snippet_type, content, latex)."""
    kind, content = F.col("snippet_type"), F.coalesce(F.col("content"), F.lit(""))
    latex = F.coalesce(F.col("latex"), F.lit(""))
    filled = strip(content) != ""
    rules = {
        "math_equation": F.length(latex) > 2,
        "progressive_math": F.length(latex) > 2,
        "text": kind.isin(TEXT_TYPES) & filled,
        "citation": kind.isin(TEXT_TYPES) & filled,
        "vision": kind.isin(VISUAL_TYPES),
        "statistical": F.concat(content, F.lit(" "), latex).rlike(DIGIT),
        "triage": filled | (latex != ""),
        "llm_only": filled,
    }
    return rules[verifier] if enabled else F.lit(False)


def eligibility(snippets: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """One boolean column per verifier."""
    return snippets.withColumns({f"can_{v}": can_verify(v, v not in disabled) for v in VERIFIERS})


def type_route(kind: Column, routes: dict | None = None, progressive: bool = False) -> Column:
    """Verifier by snippet type; given routes are laid over the defaults."""
    table = {**TYPE_ROUTES, **(routes or {})}
    if progressive:
        table["EQUATION"] = "progressive_math"
    return F.coalesce(lookup(table, kind), F.lit(DEFAULT_ROUTE))


def label_route(label: Column, kind: Column, labels: dict | None = None, **type_options) -> Column:
    """Verifier by triage label: "none" gives null, an unknown label goes by type."""
    found = lookup(labels or LABEL_ROUTES, strip(F.lower(F.coalesce(label, F.lit("")))))
    return F.when(found == "", F.lit(None).cast("string")).otherwise(
        F.coalesce(found, type_route(kind, **type_options))
    )


def with_specialist(snippets: DataFrame, label: str = "suggested_route", target: str = "routed_to",
                    single_scorer: bool = False, disabled: tuple[str, ...] = (), **options) -> DataFrame:
    """Add the first of label route and type route that can take the snippet; null if neither can.

    Both routes are projected first, so the checks below read two columns instead of
    repeating the lookups.
    """
    if single_scorer:
        return snippets.withColumn(target, F.lit("llm_only"))
    routed = snippets.withColumns(
        {
            "_by_label": label_route(F.col(label), F.col("snippet_type"), **options),
            "_by_type": type_route(F.col("snippet_type")),
            "_usable": F.filter(
                F.array(*[
                    F.when(can_verify(v, v not in disabled), F.lit(v)) for v in VERIFIERS if v != "triage"
                ]),
                lambda v: v.isNotNull(),
            ),
        }
    )

    def usable(name: str) -> Column:
        return F.when(F.array_contains("_usable", F.col(name)), F.col(name))

    return routed.withColumn(target, F.coalesce(usable("_by_label"), usable("_by_type"))).drop(
        "_by_label", "_by_type", "_usable"
    )


def prompt_family(mode: str) -> Column:
    """Question family of the single-scorer mode ("same-prompt" or "separate-prompts")."""
    if mode == "same-prompt":
        return F.lit("same")
    if mode != "separate-prompts":
        raise ValueError(f"unknown mode {mode!r}")
    return (
        F.when(F.col("snippet_type") == "EQUATION", "math")
        .when(F.col("snippet_type").isin(VISUAL_TYPES), "figure_table")
        .when(citation_heavy(F.col("content")), "citation")
        .otherwise("text")
    )


def route(snippets: DataFrame, single_scorer: bool = False, **options) -> DataFrame:
    """Exhaustive routing: every snippet gets the verifier of its type."""
    name = F.lit("llm_only") if single_scorer else type_route(F.col("snippet_type"), **options)
    return snippets.withColumn("verifier_name", name)
