"""What is known about the symbols of a document at each of its statements.

The reading order becomes a column, so "known before statement k" is a comparison of
two integers after an equi-join on (paper_id, symbol); no state is carried along.

Tables: declarations (paper_id, symbol, domain, definition, snippet_id, order_idx),
uses (paper_id, symbol, snippet_id, order_idx),
obligations (paper_id, obligation_id, condition, depends_on, order_idx).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.constants import CATEGORY_PROOF, DOMAIN_IMPLIES, OBLIGATION_RULES
from docaudit.functions.text import contains_any
from docaudit.operators.claims import lookup_lists
from docaudit.operators.ranking import position
from docaudit.session import stored

NO_STRINGS = "cast(array() as array<string>)"
LAYERS = ["symbolic", "dimensional", "side_condition", "numeric"]


def order_index(statements: DataFrame, seen: str = "pos") -> DataFrame:
    """Index of each snippet in its document by first appearance."""
    first = statements.groupBy("paper_id", "snippet_id").agg(F.min(seen).alias("_seen"))
    return position(first, ["paper_id"], [F.col("_seen"), F.col("snippet_id")], "order_idx", drop=["_seen"])


def merge_declarations(declarations: DataFrame) -> DataFrame:
    """One row per symbol: the first known domain and the first definition win, the
    earliest snippet is the source. Aggregates only, so partial results shrink map-side."""
    known = F.col("domain") != "unknown"
    defined = F.col("definition").isNotNull()
    at = F.struct("order_idx", "snippet_id")
    return declarations.groupBy("paper_id", "symbol").agg(
        F.coalesce(F.min_by("domain", F.when(known, at)), F.lit("unknown")).alias("domain"),
        F.min(F.when(known, F.col("order_idx"))).alias("domain_from"),
        F.min_by("definition", F.when(defined, at)).alias("definition"),
        F.min(F.when(defined, F.col("order_idx"))).alias("defined_from"),
        F.min_by("snippet_id", at).alias("source_snippet"),
        F.min("order_idx").alias("first_seen"),
        (F.min_by("domain", at) == "unknown").alias("began_unknown"),
    )


def predicates(domain: Column, began_unknown: Column | None = None) -> Column:
    """What a domain implies; a symbol first seen without a domain stays complex as well."""
    implied = F.coalesce(lookup_lists(DOMAIN_IMPLIES, domain), F.expr(NO_STRINGS))
    if began_unknown is None:
        return implied
    return F.when(began_unknown, F.array_union(implied, F.array(F.lit("complex")))).otherwise(implied)


def implied_predicates(merged: DataFrame) -> DataFrame:
    """One row per symbol and predicate."""
    return merged.select(
        "paper_id", "symbol", F.explode(predicates(F.col("domain"), F.col("began_unknown"))).alias("predicate")
    )


def context_before(uses: DataFrame, merged: DataFrame) -> DataFrame:
    """For each use of a symbol, what was declared strictly before that statement."""
    return as_of(uses.join(merged, ["paper_id", "symbol"], "left"))


def as_of(joined: DataFrame) -> DataFrame:
    """Uses beside their symbols' merged declarations: what of those lies before the use."""
    k = F.col("order_idx")
    return joined.select(
        "paper_id",
        "snippet_id",
        "order_idx",
        "symbol",
        F.coalesce(F.col("first_seen") < k, F.lit(False)).alias("is_known"),
        F.when(F.col("domain_from") < k, F.col("domain"))
        .when(F.col("first_seen") < k, "unknown")
        .alias("domain"),
        F.when(F.col("defined_from") < k, F.col("definition")).alias("definition"),
    )


def needed_predicates(condition: Column) -> Column:
    """Predicates any of which satisfies the condition text."""
    low = F.lower(condition)
    parts = [
        F.when(contains_any(low, words), F.array(*[F.lit(p) for p in needs])).otherwise(F.expr(NO_STRINGS))
        for words, needs in OBLIGATION_RULES
    ]
    return F.array_distinct(F.concat(*parts))


def resolve_obligations(obligations: DataFrame, merged: DataFrame) -> DataFrame:
    """When, and by which symbol, each side condition was first satisfied; else pending."""
    deps = obligations.select(
        "paper_id", "obligation_id", "order_idx", needed_predicates(F.col("condition")).alias("_need"),
        F.explode_outer("depends_on").alias("symbol"),
    )
    facts = merged.select("paper_id", "symbol", "domain", "domain_from")
    return first_resolution(resolution(deps.join(facts, ["paper_id", "symbol"], "left")), "paper_id", "obligation_id")


def resolution(joined: DataFrame) -> DataFrame:
    """Obligations beside the facts of one of their symbols: _at, where that symbol satisfies them."""
    hit = F.arrays_overlap("_need", predicates(F.col("domain"))) & F.col("domain_from").isNotNull()
    return joined.withColumn("_at", F.when(hit, F.greatest("order_idx", "domain_from")))


def first_resolution(rows: DataFrame, *keys: str) -> DataFrame:
    return (
        rows.groupBy(*keys)
        .agg(F.min("_at").alias("resolved_at"), F.min_by("symbol", F.when(F.col("_at").isNotNull(), F.struct("_at", "symbol"))).alias("resolved_by"))
        .withColumn("status", F.when(F.col("resolved_at").isNull(), "pending").otherwise("resolved"))
    )


def dependency_edges(uses: DataFrame, merged: DataFrame) -> DataFrame:
    """Snippet -> snippet that first declared a symbol it depends on."""
    j = uses.join(merged.select("paper_id", "symbol", "source_snippet", "first_seen"), ["paper_id", "symbol"])
    return (
        j.where(F.col("first_seen") <= F.col("order_idx"))
        .select(
            "paper_id",
            F.col("snippet_id").alias("from_snippet"),
            F.col("source_snippet").alias("to_snippet"),
            F.lit("uses_symbol").alias("relation"),
        )
        .distinct()
    )


def symbol_sources(merged: DataFrame) -> DataFrame:
    return merged.select("paper_id", "symbol", "source_snippet")


def transitive_dependencies(edges: DataFrame) -> DataFrame:
    """All snippets reachable from each snippet, itself excluded; cycles end by themselves.

    Reach doubles: with all pairs known up to a distance of n, those beyond it up to 2n have a snippet exactly n away
    on their shortest way, so pairs of distance n joined with all known pairs give them. Rounds grow with the
    logarithm of the longest shortest way, and on a chain each pair is made once. Each round is saved, so
    lineage stays short and a lost executor costs one round at most.
    """
    step = edges.select("paper_id", F.col("from_snippet").alias("a"), F.col("to_snippet").alias("b"), F.lit(1).cast("bigint").alias("far"))
    known = stored(step.where(F.col("a") != F.col("b")).distinct(), "reach")
    reach = 1
    while True:
        onward = known.select("paper_id", F.col("a").alias("b"), F.col("b").alias("c"), F.col("far").alias("rest"))
        longer = known.where(F.col("far") == reach).join(onward, ["paper_id", "b"]).where(F.col("a") != F.col("c"))
        longer = longer.groupBy("paper_id", "a", F.col("c").alias("b")).agg((F.min("rest") + reach).alias("far"))
        fresh = stored(longer.join(known, ["paper_id", "a", "b"], "left_anti").select(*known.columns), "reach")
        if fresh.isEmpty():
            return known.select("paper_id", F.col("a").alias("snippet_id"), F.col("b").alias("depends_on"))
        known, reach = known.unionByName(fresh), 2 * reach


def definitive_layer(layers: DataFrame, key: str = "snippet_id") -> DataFrame:
    """The first layer that proved or disproved a statement decides it."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    settled = F.col("status").isin("proved", "disproved")
    first = layers.groupBy(key).agg(F.min_by(F.struct("layer", "status"), F.when(settled, rank)).alias("_d"))
    wrong = F.col("_d.status") == "disproved"
    return first.select(
        key,
        F.col("_d.layer").alias("layer"),
        F.when(wrong, "INVALID").when(F.col("_d.status") == "proved", "VALID").otherwise("UNVERIFIABLE").alias("status"),
        F.when(wrong, 0.70).when(F.col("_d.status") == "proved", 0.75).otherwise(0.0).alias("confidence"),
        F.when(wrong, CATEGORY_PROOF).alias("predicted_error_category"),
    )


def statement_verdict(statement_class: Column, verdict: Column, fraction: Column, n_evaluated: Column,
                      has_code: Column | None = None) -> Column:
    """(status, confidence, obligation) by statement class; status null means: ask the layers.

    A declaration is always valid, and a constraint is never refuted by sampling.
    """

    def out(status: str | None, confidence: float, obligation: bool = False) -> Column:
        return F.struct(
            F.lit(status).cast("string").alias("status"),
            F.lit(confidence).alias("confidence"),
            F.lit(obligation).alias("has_obligation"),
        )

    derivation = statement_class != "checkable_constraint"
    refuted = derivation & (F.coalesce(n_evaluated, F.lit(0)) >= 5) & (F.coalesce(fraction, F.lit(0.0)) >= 0.999)
    case = F.when(statement_class == "uncheckable_declaration", out("VALID", 1.0))
    if has_code is not None:
        case = case.when(~has_code, out("MALFORMED", 0.0))
    return (
        case.when(verdict == "VALID", out("VALID", 0.85))
        .when(verdict == "INVALID_NUMERIC", out("INVALID", 0.9))
        .when(verdict == "CONDITIONAL_VALID", out("VALID", 0.7, True))
        .when((verdict == "SYMBOLIC_NONZERO") & refuted, out("INVALID", 0.75))
        .when(verdict == "HARNESS_ERROR", out("MALFORMED", 0.0))
        .otherwise(out(None, 0.0))
    )


def side_conditions(statements: DataFrame, merged: DataFrame) -> DataFrame:
    """How much is declared about the free symbols of each statement (column free_symbols)."""
    rows = statements.select("paper_id", "snippet_id", F.explode_outer("free_symbols").alias("symbol"))
    j = rows.join(merged.select("paper_id", "symbol", "domain", "began_unknown"), ["paper_id", "symbol"], "left")
    held = F.when(F.col("domain").isNotNull(), predicates(F.col("domain"), F.col("began_unknown"))).otherwise(F.expr(NO_STRINGS))
    per = j.withColumn("_h", held).groupBy("paper_id", "snippet_id").agg(
        F.count("symbol").alias("n_symbols"),
        F.count_if(F.size("_h") > 0).alias("n_known"),
        F.count_if(F.array_contains("_h", "real") | F.array_contains("_h", "complex")).alias("n_placed"),
    )
    state = (
        F.when(F.col("n_symbols") == 0, "no_symbols")
        .when(F.col("n_known") == 0, "none_declared")
        .when(F.col("n_placed") == F.col("n_symbols"), "all_declared")
        .otherwise("some_declared")
    )
    return per.withColumn("state", state)


def context_digest(merged: DataFrame, assumptions: DataFrame, obligations: DataFrame,
                   n_symbols: int = 20, n_definitions: int = 10, n_assumptions: int = 10, n_obligations: int = 5) -> DataFrame:
    """A bounded summary per document, one line per entry (section, rank, line).

    Every cap is a rank filter, applied per task before the shuffle.
    """

    def top(df: DataFrame, section: str, k: int, order: list[Column], line: Column) -> DataFrame:
        w = Window.partitionBy("paper_id").orderBy(*order)
        return (
            df.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .select("paper_id", F.lit(section).alias("section"), "rank", line.alias("line"))
        )

    extras = F.array_join(
        F.filter(
            F.array(
                F.when(F.col("domain") != "unknown", F.concat(F.lit("domain="), "domain")),
                F.when(F.col("definition").isNotNull(), F.concat(F.lit("defined_as="), "definition")),
            ),
            lambda x: x.isNotNull(),
        ),
        ", ",
    )
    symbol_line = F.concat(F.lit("- "), "symbol", F.when(extras != "", F.concat(F.lit("  ("), extras, F.lit(")"))).otherwise(F.lit("")))
    parts = [
        top(merged, "symbols", n_symbols, [F.col("symbol")], symbol_line),
        top(
            merged.where(F.col("definition").isNotNull()), "definitions", n_definitions,
            [F.col("defined_from"), F.col("symbol")], F.concat(F.lit("- "), "symbol", F.lit(" = "), "definition"),
        ),
        top(
            assumptions, "assumptions", n_assumptions, [F.desc("order_idx"), F.desc("description")],
            F.concat(F.lit("- ["), "snippet_id", F.lit("] "), "description"),
        ),
        top(
            obligations, "obligations", n_obligations, [F.desc("order_idx"), F.desc("obligation_id")],
            F.concat(F.lit("- ["), "obligation_id", F.lit("] "), "condition"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def digest_text(digest: DataFrame) -> DataFrame:
    """The digest lines of a document as one text; at most a few dozen lines each."""
    return digest.groupBy("paper_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("section", "rank", "line"))), lambda x: x["line"]), "\n"
        ).alias("digest")
    )
