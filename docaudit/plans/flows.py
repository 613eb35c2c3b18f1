"""The end-to-end jobs: exhaustive and triaged checking, evaluation, step cases.

Flows return DataFrames; the only shuffle keys are paper_id and snippet_id. What several of
their tables build on, snippets, results and aligned rows, is written to the shared folder
once while the flow is set up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.constants import UNCERTAINTY_THRESHOLD
from docaudit.operators import align, extract, findings, metrics, routing, scorers, segment, triage
from docaudit.session import stored

RESULT = [
    "paper_id", "snippet_id", "order_key", "location", "verifier_name", "status",
    "error_detected", "confidence", "predicted_error_category",
]


def score_routed(routed: DataFrame, registry: scorers.ScorerRegistry, keep: tuple[str, ...] = (),
                 disabled: tuple[str, ...] = ()) -> DataFrame:
    """Run the scorer each row is routed to; rows it cannot take, or without a scorer, are SKIPPED."""
    name = F.col("verifier_name")
    ready = F.lit(None).cast("boolean")
    for scorer in registry.names():
        ready = F.when(name == scorer, routing.can_verify(scorer, scorer not in disabled)).otherwise(ready)
    sent = routed.withColumn("_send", F.when(ready, name))
    return registry.apply(sent, route="_send").select(*RESULT, *keep)


def exhaustive(snippets: DataFrame, registry: scorers.ScorerRegistry | None = None, **route_options) -> DataFrame:
    """Every snippet to the scorer of its type."""
    return score_routed(routing.route(snippets, **route_options), registry or scorers.default_registry())


def triaged(snippets: DataFrame, registry: scorers.ScorerRegistry | None = None,
            threshold: float = UNCERTAINTY_THRESHOLD, budget: int | None = None) -> DataFrame:
    """Score all snippets cheaply, send the uncertain ones to specialists, accept the rest.

    One pass: selection, routing and the expression scorers are columns of the same
    projection, and a batch scorer sees only the rows sent to it. A budget adds one
    join with the selected ids, of which there are at most ``budget`` per document.
    """
    scored = routing.with_specialist(triage.rule_score(snippets))
    if budget is None:
        chosen = F.col("uncertainty") >= threshold
    else:
        ids = triage.select_uncertain(scored, threshold, budget).select("snippet_id", F.lit(True).alias("_chosen"))
        scored = scored.join(ids, "snippet_id", "left")
        chosen = F.coalesce("_chosen", F.lit(False))
    results = score_routed(scored.withColumn("verifier_name", F.when(chosen, F.col("routed_to"))), registry or scorers.default_registry(), ("uncertainty",))
    low = F.col("verifier_name").isNull()
    return results.select(
        *[c for c in RESULT if c not in ("verifier_name", "status", "confidence")],
        F.when(low, "triage").otherwise(F.col("verifier_name")).alias("verifier_name"),
        F.when(low, "NO_ERROR").otherwise(F.col("status")).alias("status"),
        F.when(low, F.greatest(F.lit(0.0), 1.0 - F.col("uncertainty"))).otherwise(F.col("confidence")).alias("confidence"),
    ).select(*RESULT)


def predictions(papers: DataFrame, results: DataFrame, strictness: str = "strict", triaged: bool = False) -> DataFrame:
    """Document roll-up. Every snippet has one result, so the totals need no second scan."""
    return findings.rollup(papers, results, strictness, triaged=triaged)


def evaluate(predicted: DataFrame, annotations: DataFrame, category: str | None = None,
             judged: DataFrame | None = None) -> dict[str, DataFrame]:
    """Aligned rows and all metric tables of a run."""
    if category is not None:
        predicted = align.only_category(predicted, category)
        annotations = align.only_category(annotations, category)
    if judged is None:
        aligned = align.align(predicted, annotations)
    else:
        aligned = align.align_judged(predicted, annotations, judged)
    aligned = stored(aligned, "aligned")
    categories = metrics.paper_categories(annotations) if "paper_category" in annotations.columns else None
    table = metrics.breakdown(aligned, categories)
    labels = metrics.aligned_labels(aligned)
    return {
        "aligned": aligned,
        "metrics": table,
        "worst": metrics.worst(table),
        "totals": metrics.dataset_totals(aligned, annotations),
        "confusion": metrics.confusion(labels, "truth", "guess"),
        "class_report": metrics.class_report(labels, "truth", "guess"),
        "micro_macro": metrics.micro_macro(aligned),
        "per_paper": metrics.per_paper(aligned),
    }


def report(profile: DataFrame, totals: DataFrame, usage: DataFrame, table: DataFrame) -> DataFrame:
    """The run summary as one long table (section, name, metric, value)."""

    def melt(df: DataFrame, section: str, name, metrics_: list[str]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics_])
        return df.select(F.lit(section).alias("section"), name.alias("name"), F.inline(cells))

    parts = [
        melt(profile, "dataset", F.concat_ws(": ", "dimension", "value"), ["n"]),
        melt(totals, "pipeline", F.lit("run"), ["papers", "total_snippets", "snippets_verified", "errors_detected"]),
        melt(usage, "verifiers", F.col("verifier_name"), ["n_snippets"]),
        melt(
            table, "metrics", F.concat_ws(": ", "dimension", "category"),
            ["tp", "fp", "fn", "precision", "recall", "f1", "accuracy", "support"],
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def verify_corpus(corpus: DataFrame, mode: str = "exhaustive", strictness: str = "strict", **options) -> dict[str, DataFrame]:
    """A whole corpus: results, findings and roll-up of each document.

    The corpus has a row per annotation; its documents are segmented once each. Snippets and results
    are written, so the corpus is parsed and scored once, also after the loss of an executor.
    """
    content = extract.without_payloads(F.col("paper_content")).alias("paper_content")  # images would only be shuffled
    papers = corpus.select("paper_id", "title", "paper_category", content).dropDuplicates(["paper_id"])
    snippets = stored(segment.segment(papers), "snippets")
    run = {"exhaustive": exhaustive, "uncertainty": triaged}[mode]
    results = stored(run(snippets, **options), "results")
    return {
        "snippets": snippets,
        "results": results,
        "findings": findings.ranked(findings.findings(results, strictness)),
        "predictions": predictions(papers.select("paper_id", "title", "paper_category"), results, strictness, mode == "uncertainty"),
    }


def step_case_results(cases: DataFrame, step_results: DataFrame) -> DataFrame:
    """Per case the true and the predicted first wrong step."""
    found = metrics.first_error_step(step_results)
    return cases.select(F.col("id").alias("paper_id"), F.col("label").cast("bigint").alias("true_label")).join(
        found, "paper_id", "left"
    ).withColumn("predicted_label", F.coalesce("predicted_label", F.lit(-1)).cast("bigint"))
