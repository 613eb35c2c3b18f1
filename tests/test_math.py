"""Claims, verdicts, symbol context, step metrics."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from docaudit.constants import DOMAIN_IMPLIES
from docaudit.functions.arithmetic import NotArithmetic, evaluate, points_for
from docaudit.operators import claims, context, metrics


@pytest.mark.parametrize(
    "text,value",
    [("4 - 9 * 2 + 0.5", -13.5), ("(17 + 25) / (8 - 2)", 7), ("log10(0.01)", -2), ("mean([1, 7, 13, 3])", 6), ("sqrt(2.25)", 1.5), ("round(8.449, 2)", 8.45),
     ("-7 // 2", -4), ("-7 % 3", 2), ("pow(3, 5)", 243), ("max(1, 5, 2) + pi - pi", 5)],
)
def test_values(text, value):
    assert evaluate(text) == pytest.approx(value)


@pytest.mark.parametrize(
    "text", ["exec('1')", "rate * 2", "print(3)", "1 if 2 else 3", "[i for i in (1, 2)]", " ", "1/0", "1e308 * 10", "-1e308 * 10", "9.0**9**9**9", "(1).real", "[1, 2]", "sqrt(-1)", "min(x=1)"]
)
def test_refused(text):
    with pytest.raises(NotArithmetic):
        evaluate(text)


def test_typed_ops_follow_python(spark):
    rng = random.Random(4)
    ops = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "//": lambda a, b: a // b, "%": lambda a, b: a % b}
    rows = [(o, [rng.uniform(-9, 9), rng.choice([-3.0, 2.5, 0.0, 4.0])]) for o in ops for _ in range(12)]
    df = spark.createDataFrame(rows, "op string, operands array<double>")
    for r in df.select("*", claims.apply_op(F.col("op"), F.col("operands")).alias("v")).collect():
        try:
            expected = ops[r.op](*r.operands)
        except ZeroDivisionError:
            expected = None
        assert (r.v is None) if expected is None else r.v == pytest.approx(expected, abs=1e-9)


def test_percentages(spark):
    c = spark.createDataFrame(
        [("bad", 0, "sum", "45 + 37", "80", "0.01"), ("bad", 1, "two", "2", "3", None), ("bad", 2, "three", "2", "3", None), ("bad", 3, "four", "2", "3", None), ("none", 0, "n", "rate * 2", "3", None), ("good", 0, "ok", "45 + 35", "80", "-5"), ("text", 0, "t", "1", "many", None)],
        "snippet_id string, claim_idx int, description string, expr string, expected string, tolerance string",
    )
    v = {r.snippet_id: r for r in claims.claim_verdicts(claims.check_text(c)).collect()}
    assert (v["bad"].status, v["bad"].confidence, v["bad"].predicted_error_category) == ("INVALID", 0.9, "Statistical reporting")
    assert v["bad"].failed_claims == "sum; two; three; four"
    assert v["none"].status == "UNVERIFIABLE" and v["good"].status == "VALID" and v["text"].status == "UNVERIFIABLE"


def verdict_by_rule(rc, verdict, kind, n, share):
    """The rule in words: only a run that ended decides, only identities are disproved by samples."""
    if kind == "conditional":
        return "UNVERIFIABLE"
    if rc != 0:
        return "MALFORMED"
    if verdict == "VALID":
        return "VALID"
    if verdict == "INVALID_NUMERIC":
        return "INVALID"
    if verdict == "SYMBOLIC_NONZERO":
        return "INVALID" if kind == "identity" and (n or 0) >= 5 and (share or 0.0) >= 0.999 else "UNVERIFIABLE"
    return "UNVERIFIABLE"


def test_verdict_of_every_combination(spark):
    runs = list(itertools.product((0, 1), ("VALID", "INVALID_NUMERIC", "SYMBOLIC_NONZERO", None), ("identity", "numeric", "conditional"), (None, 4, 30), (None, 0.5, 1.0)))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(runs)], "i int, rc int, v string, t string, n long, f double")
    out = df.select("i", claims.equation_verdict(F.col("rc"), F.col("v"), F.col("t"), F.col("f"), F.col("n")).alias("o")).collect()
    for r in out:
        assert r.o.status == verdict_by_rule(*runs[r.i]), runs[r.i]


def test_native_and_text_samples_agree(spark):
    df = spark.createDataFrame([(1, "(a + b) ** 2", "a ** 2 + b ** 2", ["a", "b"], ["integer", "positive_real"])], "i int, lhs string, rhs string, symbols array<string>, domains array<string>")
    a = claims.residual_stats_text(df).first()
    b = claims.residual_stats(df, lambda x, y: (x + y) * (x + y) - x * x - y * y, 2, [F.lit("integer"), F.lit("positive_real")]).first()
    assert (a.n_evaluated, a.nonzero_fraction, round(a.max_abs, 9)) == (b.n_evaluated, b.nonzero_fraction, round(b.max_abs, 9)) and a.n_evaluated == 30


def test_sample_values_are_constants(spark):
    """A row picks its domain's values; they are those that text residuals are sampled at."""
    names = [*DOMAIN_IMPLIES, "other", None]
    df = spark.createDataFrame([(n,) for n in names], "domain string")
    for rank in (0, 3):
        values = claims.sample_values(rank, F.col("domain"))
        got = {r.domain: r.v for r in df.select("domain", values.alias("v")).collect()}
        assert all(got[n] == [float(x) for x in points_for(rank, n)] for n in names)
    plan = df.select(claims.sample_values(0, F.col("domain")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


DECL = "paper_id string, symbol string, domain string, definition string, snippet_id string, order_idx int"


def test_merge_and_obligations(spark):
    d = spark.createDataFrame(
        [("p", "x", "unknown", None, "s0", 0), ("p", "x", "positive_real", None, "s2", 2), ("p", "x", "integer", "Q/N", "s3", 3), ("p", "n", "integer", None, "s1", 1)], DECL
    )
    m = {r.symbol: r for r in context.merge_declarations(d).collect()}
    assert (m["x"].domain, m["x"].source_snippet, m["x"].definition, m["x"].domain_from) == ("positive_real", "s0", "Q/N", 2)
    held = {(r.symbol, r.predicate) for r in context.implied_predicates(context.merge_declarations(d)).collect()}
    assert {("n", "rational"), ("n", "real"), ("n", "complex"), ("x", "positive")} <= held
    o = spark.createDataFrame(
        [("p", "o1", "x != 0", ["x"], 0), ("p", "o2", "y > 0", ["y"], 1), ("p", "o3", "n is real", ["z", "n"], 4), ("p", "o4", "n != 0", ["n"], 1), ("p", "o5", "x > 0", [], 1)],
        "paper_id string, obligation_id string, condition string, depends_on array<string>, order_idx int",
    )
    r = {x.obligation_id: (x.status, x.resolved_at) for x in context.resolve_obligations(o, context.merge_declarations(d)).collect()}
    assert r == {"o1": ("resolved", 2), "o2": ("pending", None), "o3": ("resolved", 4), "o4": ("pending", None), "o5": ("pending", None)}


def test_closure_with_cycles(spark):
    rng = random.Random(9)
    edges = {("p", f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(18)} | {("q", "a", "b"), ("q", "b", "a"), ("q", "c", "c")}
    expected = set()
    for pid, start, _ in edges:
        seen, stack = set(), [start]
        while stack:
            x = stack.pop()
            for p2, a, b in edges:
                if p2 == pid and a == x and b not in seen:
                    seen.add(b)
                    stack.append(b)
        expected |= {(pid, start, b) for b in seen if b != start}
    df = spark.createDataFrame(list(edges), "paper_id string, from_snippet string, to_snippet string")
    assert {tuple(r) for r in context.transitive_dependencies(df).collect()} == expected


STEP = "paper_id string, true_label int, predicted_label int"


def test_step_metrics(spark):
    m = metrics.step_metrics(spark.createDataFrame([("a", -1, -1), ("b", 2, 2), ("c", 3, -1)], STEP)).first()
    assert m.accuracy == pytest.approx(2 / 3)
    assert (m.correct_with_error, m.correct_all_correct, m.false_negatives, m.false_positives) == (1, 1, 1, 0)
    p = {r.true_label: r.accuracy for r in metrics.position_accuracy(spark.createDataFrame([("a", 1, 1), ("b", 1, 0), ("c", -1, -1)], STEP)).collect()}
    assert p == {1: 0.5, -1: 1.0}
    empty = metrics.step_metrics(spark.createDataFrame([], STEP)).first()
    assert (empty.total_cases, empty.accuracy) == (0, 0.0)
    assert metrics.describe_split("gsm8k")["n_cases"] == 400 and metrics.describe_split("x") == {}


@pytest.mark.parametrize("text,typed", [("log(x)", claims.complex_ln), ("sqrt(x)", claims.complex_sqrt)])
def test_negative_points_count_alike(spark, text, typed):
    df = spark.createDataFrame([(text, "0", ["x"], ["real"])], "lhs string, rhs string, symbols array<string>, domains array<string>")
    a = claims.residual_stats_text(df).first()
    b = claims.residual_stats(df, typed, 1, [F.lit("real")]).first()
    assert (a.n_evaluated, a.nonzero_fraction) == (b.n_evaluated, b.nonzero_fraction) and a.max_abs == pytest.approx(b.max_abs)
