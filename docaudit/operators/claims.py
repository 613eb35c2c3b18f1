"""Numeric claims recomputed, units converted, residuals sampled, verdicts classified."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.constants import (
    CATEGORY_PROOF, CATEGORY_STATISTICS, DOMAIN_IMPLIES, NONZERO_EPS, SAMPLE_COUNT, SAMPLE_POINTS,
)
from docaudit.functions.arithmetic import evaluate_text, sample_residual
from docaudit.functions.modeljson import verdict_lines
from docaudit.functions.text import lookup


def tolerance(value: Column) -> Column:
    """A positive number, else 0.01."""
    t = value.try_cast("double")
    return F.coalesce(F.when((t > 0) & ~F.isnan(t), t), F.lit(0.01))


def within(computed: Column, expected: Column, tol: Column) -> Column:
    return F.abs(computed - expected) / F.greatest(F.abs(expected), F.lit(1e-12)) <= tol


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def apply_op(op: Column, args: Column) -> Column:
    """Value of an operation on an array of doubles, null where it is undefined.

    Python's rules: floor division and modulo follow the divisor's sign, rounding is
    half to even.
    """
    a, b = F.get(args, F.lit(0)), F.get(args, F.lit(1))
    total = F.aggregate(args, F.lit(0.0), lambda x, y: x + y)
    whole = F.when(b != 0, F.floor(a / b).cast("double"))
    table: dict[str, Column] = {
        "+": a + b,
        "-": a - b,
        "*": a * b,
        "/": F.try_divide(a, b),
        "//": whole,
        "%": a - b * whole,
        "**": F.pow(a, b),
        "pow": F.pow(a, b),
        "sum": total,
        "mean": F.try_divide(total, F.size(args)),
        "min": F.array_min(args),
        "max": F.array_max(args),
        "sqrt": F.when(a >= 0, F.sqrt(a)),
        "ln": F.ln(a),
        "log": F.when(b.isNull(), F.ln(a)).otherwise(F.try_divide(F.ln(a), F.ln(b))),
        "log10": F.log10(a),
        "log2": F.log2(a),
        "exp": F.exp(a),
        "abs": F.abs(a),
        "round": F.bround(a),
        "floor": F.floor(a).cast("double"),
        "ceil": F.ceil(a).cast("double"),
    }
    case = None
    for name, value in table.items():
        case = F.when(op == name, value) if case is None else case.when(op == name, value)
    return finite(case)


def check_typed(claims: DataFrame) -> DataFrame:
    """Claims as (op, operands array<double>, expected, tolerance): all inside the JVM."""
    return _judge(claims.withColumn("computed", apply_op(F.col("op"), F.col("operands"))))


def check_text(claims: DataFrame) -> DataFrame:
    """Claims as a free-form ``expr``; the only step that needs a Python worker."""
    out = claims.withColumn("_v", evaluate_text(F.col("expr")))
    return _judge(out.withColumns({"computed": F.col("_v.computed"), "_error": F.col("_v.error")}).drop("_v"))


def _judge(df: DataFrame) -> DataFrame:
    reason = F.col("_error") if "_error" in df.columns else F.lit(None).cast("string")
    df = df.withColumns({"expected": F.col("expected").try_cast("double"), "tolerance": tolerance(F.col("tolerance"))})
    return df.withColumns(
        {
            "passed": within(F.col("computed"), F.col("expected"), F.col("tolerance")),
            "error": F.when(F.col("expected").isNull(), "non-numeric expected value").when(
                F.col("computed").isNull(), F.coalesce(reason, F.lit("not computable"))
            ),
        }
    ).drop("_error")


def check_units(claims: DataFrame, units: DataFrame) -> DataFrame:
    """value [from_unit] against expected [to_unit]; an unknown pair of units stays null.

    ``units`` is a caller's table (from_unit, to_unit, factor, offset); Spark broadcasts
    it by its own size estimate.
    """
    return _judge(
        claims.join(units, ["from_unit", "to_unit"], "left").withColumn(
            "computed", F.col("value") * F.col("factor") + F.coalesce("offset", F.lit(0.0))
        )
    )


def claim_verdicts(checks: DataFrame, key: str = "snippet_id", order: str = "claim_idx") -> DataFrame:
    """One verdict per snippet: no evaluable claim, any failure (all named), or consistent."""
    counts = checks.groupBy(key).agg(
        F.count("passed").alias("n_evaluable"), F.count_if(~F.col("passed")).alias("n_failed")
    )
    failed = checks.where(~F.col("passed")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "description"))).alias("_d"))
    bad, none = F.col("n_failed") > 0, F.col("n_evaluable") == 0
    return counts.join(failed, key, "left").select(
        key,
        "n_evaluable",
        "n_failed",
        F.when(none, "UNVERIFIABLE").when(bad, "INVALID").otherwise("VALID").alias("status"),
        bad.alias("error_detected"),
        F.when(none, 0.0).when(bad, 0.9).otherwise(0.85).alias("confidence"),
        F.when(bad, CATEGORY_STATISTICS).alias("predicted_error_category"),
        F.array_join(F.transform("_d", lambda d: d["description"]), "; ").alias("failed_claims"),
    )


# --- sampled residuals -------------------------------------------------------------------


def sample_values(rank: int, domain: Column | None = None) -> Column:
    """Values of the rank-th symbol at all samples, moved into the symbol's domain.

    Every domain's values are constants, so a row picks an array and computes none.
    """
    points = [SAMPLE_POINTS[(i + rank) % len(SAMPLE_POINTS)] for i in range(SAMPLE_COUNT)]
    plain = [p / q for p, q in points]

    def values(positive: bool, whole: bool) -> Column:
        moved = [abs(v) if positive else v for v in plain]
        return F.array(*[F.lit((float(int(v)) if abs(v) >= 1 else 1.0) if whole else v) for v in moved])

    if domain is None:
        return values(False, False)
    positive = domain.isin([d for d, implied in DOMAIN_IMPLIES.items() if {"positive", "nonnegative"} & set(implied)])
    whole = domain.isin([d for d, implied in DOMAIN_IMPLIES.items() if "integer" in implied])
    return F.when(positive & whole, values(True, True)).when(positive, values(True, False)).when(whole, values(False, True)).otherwise(values(False, False))


def lookup_lists(table: dict[str, list[str]], key: Column) -> Column:
    """Fixed table of string lists, keyed by string."""
    packed = lookup({k: ",".join(v) for k, v in table.items()}, key)
    return F.filter(F.split(packed, ","), lambda s: s != "")


def complex_ln(x: Column) -> tuple[Column, Column]:
    """Real and imaginary part of the logarithm of a real number; null at zero."""
    return F.ln(F.abs(x)), F.when(x < 0, F.pi()).otherwise(0.0)


def complex_sqrt(x: Column) -> tuple[Column, Column]:
    """Real and imaginary part of the root of a real number."""
    return F.sqrt(F.greatest(x, F.lit(0.0))), F.sqrt(F.greatest(-x, F.lit(0.0)))


def residual_stats(df: DataFrame, residual: Callable[..., Column | tuple[Column, Column]], n_symbols: int,
                   domains: list[Column] | None = None) -> DataFrame:
    """Statistics of a residual expression over the fixed sample points of each row.

    The samples are an array inside the row: rows are not multiplied and nothing shuffles. A residual
    that leaves the real numbers, as logarithms and roots of negative ones do, is given as its
    real and imaginary part (``complex_ln``, ``complex_sqrt``) and counts by its absolute value.
    """
    values = [sample_values(j, domains[j] if domains else None).alias(f"x{j}") for j in range(n_symbols)]
    samples = F.arrays_zip(*values) if values else F.sequence(F.lit(1), F.lit(SAMPLE_COUNT))

    def size(at: Column) -> Column:
        r = residual(*[at[f"x{j}"] for j in range(n_symbols)])
        return F.hypot(*r) if isinstance(r, tuple) else F.abs(r)

    sizes = F.filter(F.transform(samples, size), lambda r: r < float("inf"))  # neither null nor NaN is less
    df = df.withColumn("_s", sizes)
    n = F.size("_s")
    return df.withColumns(
        {
            "n_evaluated": n.cast("bigint"),
            "nonzero_fraction": F.when(n > 0, F.size(F.filter("_s", lambda r: r > NONZERO_EPS)) / n).otherwise(0.0),
            "max_abs": F.coalesce(F.array_max("_s"), F.lit(0.0)),
        }
    ).drop("_s")


def residual_stats_text(df: DataFrame) -> DataFrame:
    """The same for free-form columns lhs, rhs, symbols and domains (arrays of strings)."""
    out = df.withColumn("_r", sample_residual(F.col("lhs"), F.col("rhs"), F.col("symbols"), F.col("domains")))
    return out.select(*df.columns, "_r.*")


def numeric_layer(stats: DataFrame) -> DataFrame:
    """Layer verdict of sampled residuals; a row without symbols is a constant."""
    constant = F.col("n_symbols") == 0
    n, frac, size = F.col("n_evaluated"), F.col("nonzero_fraction"), F.col("max_abs")

    def out(status: str, confidence: float) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"))

    verdict = (
        F.when(n == 0, out("unknown", 0.0))
        .when(constant & (size < 1e-12), out("proved", 0.85))
        .when(constant, out("disproved", 0.9))
        .when(frac >= 0.999, out("disproved", 0.75))
        .when(frac <= 0.03, out("proved", 0.6))
        .otherwise(out("unknown", 0.0))
    )
    return stats.withColumn("_v", verdict).withColumns(
        {"status": F.col("_v.status"), "confidence": F.col("_v.confidence")}
    ).drop("_v")


def parsed_verdict(output: Column, last: bool = True) -> Column:
    """The verdict line of captured output as a struct: the last valid one, or the first."""
    lines = verdict_lines(output)
    line = F.try_element_at(lines, F.lit(-1 if last else 1))
    return F.from_json(
        line, "struct<verdict: string, residual: string, nonzero_fraction: double, n_evaluated: bigint, condition: string>"
    )


def equation_verdict(return_code: Column, verdict: Column, equation_type: Column, fraction: Column,
                     n_evaluated: Column, unverifiable: Column | None = None) -> Column:
    """(status, confidence, predicted_error_category) of one checked equation, conservatively:
    a residual with free symbols counts against identities only."""

    def out(status: str, confidence: float, category: str | None = None) -> Column:
        return F.struct(
            F.lit(status).alias("status"),
            F.lit(confidence).alias("confidence"),
            F.lit(category).cast("string").alias("predicted_error_category"),
        )

    skip = equation_type.isin("definition", "conditional", "unverifiable")
    if unverifiable is not None:
        skip = skip | unverifiable
    refuted = (
        (equation_type == "identity")
        & (F.coalesce(n_evaluated, F.lit(0)) >= 5)
        & (F.coalesce(fraction, F.lit(0.0)) >= 0.999)
    )
    return (
        F.when(F.coalesce(skip, F.lit(False)), out("UNVERIFIABLE", 0.0))
        .when(return_code != 0, out("MALFORMED", 0.0))
        .when(verdict == "VALID", out("VALID", 0.85))
        .when(verdict == "INVALID_NUMERIC", out("INVALID", 0.9, CATEGORY_PROOF))
        .when((verdict == "SYMBOLIC_NONZERO") & refuted, out("INVALID", 0.75, CATEGORY_PROOF))
        .when(verdict == "HARNESS_ERROR", out("MALFORMED", 0.0))
        .otherwise(out("UNVERIFIABLE", 0.0))
    )
