"""Catalog: numeric claims, sampled residuals, symbol context."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.constants import SAMPLE_POINTS
from docaudit.operators import claims, context
from docaudit.plans import inputs
from docaudit.plans.inputs import SYMBOLS_SQL
from docaudit.plans.registry import query

# --- claims -----------------------------------------------------------------------------------

OPS = ["+", "*", "/", "%", "sum", "mean", "//"]


def _claims(spark, sf):
    """Order lines as claims: the line number picks the operation."""
    li = inputs.table(spark, sf, "lineitem")
    q, t, d, p = (F.col(c) for c in ("l_quantity", "l_tax", "l_discount", "l_extendedprice"))
    return li.select(
        F.col("l_orderkey").alias("snippet_id"),
        F.col("l_linenumber").alias("claim_idx"), "l_partkey", "l_suppkey",
        F.get(F.array(*[F.lit(o) for o in OPS]), (F.col("l_linenumber") - 1) % len(OPS)).alias("op"),
        F.array(q, t, d).alias("operands"),
        F.when(F.col("l_returnflag") == "R", "n/a").otherwise((p / 1000).cast("string")).alias("expected"),
        F.when(F.col("l_linestatus") == "F", "0.9").otherwise("-1").alias("tolerance"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("description"),
    )


CLAIMS_SQL = """cl AS (
 SELECT l_orderkey AS snippet_id, l_linenumber AS claim_idx, l_partkey, l_suppkey, 'part ' || l_partkey AS description,
  CASE (l_linenumber - 1) % 7 WHEN 0 THEN l_quantity + l_tax WHEN 1 THEN l_quantity * l_tax WHEN 2 THEN CASE WHEN l_tax <> 0 THEN l_quantity / l_tax END
   WHEN 3 THEN CASE WHEN l_tax <> 0 THEN l_quantity - l_tax * floor(l_quantity / l_tax) END WHEN 4 THEN l_quantity + l_tax + l_discount WHEN 5 THEN (l_quantity + l_tax + l_discount) / 3
   ELSE CASE WHEN l_tax <> 0 THEN floor(l_quantity / l_tax) END END AS computed,
  CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / 1000 END AS expected, CASE WHEN l_linestatus = 'F' THEN 0.9::DOUBLE ELSE 0.01::DOUBLE END AS tolerance FROM lineitem),
ck AS (SELECT *, abs(computed - expected) / greatest(abs(expected), 1e-12) <= tolerance AS passed FROM cl)"""


@query("numeric_claims", f"""
WITH {CLAIMS_SQL} SELECT snippet_id, claim_idx::BIGINT AS claim_idx, l_partkey, l_suppkey, round(computed, 6) AS computed, round(expected, 6) AS expected, tolerance, passed,
 CASE WHEN expected IS NULL THEN 'non-numeric expected value' WHEN computed IS NULL THEN 'not computable' END AS error FROM ck""")
def _(spark, sf):
    c = claims.check_typed(_claims(spark, sf))
    return c.select("snippet_id", "claim_idx", "l_partkey", "l_suppkey", "computed", "expected", "tolerance", "passed", "error")


@query("claim_verdicts", f"""
WITH {CLAIMS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY snippet_id ORDER BY claim_idx, l_partkey, l_suppkey) AS r FROM ck WHERE passed = false),
c AS (SELECT snippet_id, count(passed) AS n, count(*) FILTER (passed = false) AS b FROM ck GROUP BY 1), d AS (SELECT snippet_id, string_agg(description, '; ' ORDER BY r) AS t FROM f GROUP BY 1)
SELECT snippet_id, n::BIGINT AS n_evaluable, b::BIGINT AS n_failed, CASE WHEN n = 0 THEN 'UNVERIFIABLE' WHEN b > 0 THEN 'INVALID' ELSE 'VALID' END AS status, b > 0 AS error_detected,
 CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN b > 0 THEN 0.9::DOUBLE ELSE 0.85::DOUBLE END AS confidence, CASE WHEN b > 0 THEN 'Statistical reporting' END AS predicted_error_category, t AS failed_claims FROM c LEFT JOIN d USING (snippet_id)""")
def _(spark, sf):
    order = F.struct("claim_idx", "l_partkey", "l_suppkey").alias("claim_idx")
    c = claims.check_typed(_claims(spark, sf)).withColumn("claim_idx", order)
    return claims.claim_verdicts(c)


@query("free_claims", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey,
 round(CASE l_linenumber WHEN 1 THEN (l_quantity + l_tax) * 2 WHEN 2 THEN sqrt(l_quantity) WHEN 3 THEN (l_quantity + l_tax + 3) / 3 WHEN 4 THEN CASE WHEN l_tax <> 0 THEN l_quantity / l_tax END WHEN 5 THEN NULL WHEN 6 THEN pow(l_quantity, 2) ELSE log10(l_quantity) + floor(l_tax) END, 6) AS computed
FROM lineitem""")
def _(spark, sf):
    li = inputs.table(spark, sf, "lineitem")
    q, t = F.col("l_quantity").cast("string"), F.col("l_tax").cast("string")
    n = F.col("l_linenumber")
    expr = (
        F.when(n == 1, F.concat(F.lit("("), q, F.lit(" + "), t, F.lit(") * 2")))
        .when(n == 2, F.concat(F.lit("sqrt("), q, F.lit(")")))
        .when(n == 3, F.concat(F.lit("mean(["), q, F.lit(", "), t, F.lit(", 3])")))
        .when(n == 4, F.concat(q, F.lit(" / "), t))
        .when(n == 5, F.concat(F.lit("__import__('os') + "), q))
        .when(n == 6, F.concat(q, F.lit(" ** 2")))
        .otherwise(F.concat(F.lit("log10("), q, F.lit(") + floor("), t, F.lit(")")))
    )
    shaped = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", expr.alias("expr"), F.lit("1").alias("expected"), F.lit("0.01").alias("tolerance")
    )
    return claims.check_text(shaped).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "computed")


@query("unit_checks", """
SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN p_size * 1.8 + 32 WHEN 2 THEN p_size / 3.6 END, 6) AS computed,
 CASE p_partkey % 4 WHEN 0 THEN abs(p_size * 1000.0 - p_retailprice * 10) / greatest(abs(p_retailprice * 10), 1e-12) <= 0.01 WHEN 1 THEN abs(p_size * 1.8 + 32 - p_retailprice * 10) / greatest(abs(p_retailprice * 10), 1e-12) <= 0.01
  WHEN 2 THEN abs(p_size / 3.6 - p_retailprice * 10) / greatest(abs(p_retailprice * 10), 1e-12) <= 0.01 END AS passed FROM part""")
def _(spark, sf):
    units = spark.createDataFrame(
        [("km", "m", 1000.0, 0.0), ("degC", "degF", 1.8, 32.0), ("km/h", "m/s", 1 / 3.6, 0.0)],
        "from_unit string, to_unit string, factor double, offset double",
    )
    pick = F.col("p_partkey") % 4
    c = inputs.table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_size").cast("double").alias("value"),
        F.when(pick == 0, "km").when(pick == 1, "degC").when(pick == 2, "km/h").otherwise("furlong").alias("from_unit"),
        F.when(pick == 0, "m").when(pick == 1, "degF").when(pick == 2, "m/s").otherwise("ly").alias("to_unit"),
        (F.col("p_retailprice") * 10).alias("expected"),
        F.lit(None).cast("string").alias("tolerance"),
    )
    return claims.check_units(c, units).select("p_partkey", "computed", "passed")


POINTS_SQL = "[" + ", ".join(f"{p}/{q}::DOUBLE" for p, q in SAMPLE_POINTS) + "]"
RESIDUAL_SQL = f"""pts AS (SELECT i, pt[i % 16 + 1] AS x, pt[(i + 1) % 16 + 1] AS y FROM (SELECT unnest(range(30)) AS i, {POINTS_SQL} AS pt)),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity,
  CASE WHEN l_returnflag = 'A' AND x = 0 THEN NULL ELSE sqrt(pow(l_quantity * (x + y) - (l_quantity * x + l_quantity * y) + CASE l_returnflag WHEN 'R' THEN l_tax * x WHEN 'A' THEN ln(abs(x)) ELSE 0 END, 2)
    + CASE WHEN l_returnflag = 'A' AND x < 0 THEN pow(pi(), 2) ELSE 0 END) END AS m FROM lineitem CROSS JOIN pts),
rs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, count(m) AS n, CASE WHEN count(m) > 0 THEN count(*) FILTER (m > 1e-9) / count(m) ELSE 0 END AS f, coalesce(max(m), 0) AS s, count(*) AS c
 FROM r GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity)"""


def _residuals(spark, sf):
    li = inputs.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_tax")
    q, t, flag = F.col("l_quantity"), F.col("l_tax"), F.col("l_returnflag")

    def residual(x, y):
        real, imaginary = claims.complex_ln(x)
        extra = F.when(flag == "R", t * x).when(flag == "A", real).otherwise(0.0)
        return q * (x + y) - (q * x + q * y) + extra, F.when(flag == "A", imaginary).otherwise(0.0)

    return claims.residual_stats(li, residual, 2)


@query("residual_stats", f"WITH {RESIDUAL_SQL} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, (n)::BIGINT AS n_evaluated, round(f, 6) AS nonzero_fraction, round(s, 6) AS max_abs FROM rs")
def _(spark, sf):
    return _residuals(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n_evaluated", "nonzero_fraction", "max_abs")


@query("numeric_layer", f"""
WITH {RESIDUAL_SQL} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, CASE WHEN n = 0 THEN 'unknown' WHEN f >= 0.999 THEN 'disproved' WHEN f <= 0.03 THEN 'proved' ELSE 'unknown' END AS status,
 CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN f >= 0.999 THEN 0.75::DOUBLE WHEN f <= 0.03 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM rs""")
def _(spark, sf):
    r = claims.numeric_layer(_residuals(spark, sf).withColumn("n_symbols", F.lit(2)))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "status", "confidence")


@query("sampled_domains", f"""
WITH pts AS (SELECT i, pt[i % 16 + 1] AS x FROM (SELECT unnest(range(30)) AS i, {POINTS_SQL} AS pt)),
e AS (SELECT event_id, {inputs.DOMAINS!r}[regexp_extract(props, '[0-9]+')::INT % 8 + 1] AS domain FROM events),
v AS (SELECT event_id, CASE domain WHEN 'positive_real' THEN abs(x) WHEN 'integer' THEN trunc(x) WHEN 'natural' THEN trunc(abs(x)) ELSE x END AS x FROM e CROSS JOIN pts)
SELECT event_id, count(*)::BIGINT AS n_evaluated, round(count(*) FILTER (abs(x - 2) > 1e-9) / count(*), 6) AS nonzero_fraction, round(max(abs(x - 2)), 6) AS max_abs FROM v GROUP BY 1""")
def _(spark, sf):
    e = inputs.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    d = e.select("event_id", F.get(F.array(*[F.lit(x) for x in inputs.DOMAINS]), k % 8).alias("domain"))
    return claims.residual_stats(d, lambda x: x - 2.0, 1, [F.col("domain")]).select(
        "event_id", "n_evaluated", "nonzero_fraction", "max_abs"
    )


@query("free_residuals", f"""
WITH pts AS (SELECT i, pt[i % 16 + 1] AS x, pt[(i + 1) % 16 + 1] AS y FROM (SELECT unnest(range(30)) AS i, {POINTS_SQL} AS pt)),
e AS (SELECT event_id, regexp_extract(props, '[0-9]+')::INT AS k FROM events),
v AS (SELECT event_id, CASE WHEN k % 3 = 0 THEN 0.0 WHEN k % 3 = 1 THEN abs(2 * x * y) ELSE abs(k * x - k) END AS m FROM e CROSS JOIN pts)
SELECT event_id, count(*)::BIGINT AS n_evaluated, round(count(*) FILTER (m > 1e-9) / count(*), 6) AS nonzero_fraction, round(CASE WHEN max(m) < 1e-9 THEN 0 ELSE max(m) END, 6) AS max_abs FROM v GROUP BY 1""")
def _(spark, sf):
    e = inputs.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    d = e.select(
        "event_id",
        F.when(k % 3 == 2, F.concat(k.cast("string"), F.lit(" * a"))).otherwise("(a + b) ** 2").alias("lhs"),
        F.when(k % 3 == 0, "a ** 2 + 2 * a * b + b ** 2").when(k % 3 == 1, "a ** 2 + b ** 2").otherwise(k.cast("string")).alias("rhs"),
        F.array(F.lit("a"), F.lit("b")).alias("symbols"),
        F.array(F.lit("complex"), F.lit("complex")).alias("domains"),
    )
    r = claims.residual_stats_text(d)
    return r.select("event_id", "n_evaluated", "nonzero_fraction", F.when(F.col("max_abs") < 1e-9, 0.0).otherwise(F.col("max_abs")).alias("max_abs"))


@query("equation_verdicts", """
WITH e AS (SELECT event_id, event_type, value, regexp_extract(props, '[0-9]+')::INT AS k FROM events),
x AS (SELECT *, CASE k % 4 WHEN 0 THEN 'identity' WHEN 1 THEN 'numeric' WHEN 2 THEN 'conditional' ELSE 'identity' END AS t, CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS rc FROM e)
SELECT event_id, CASE WHEN t = 'conditional' THEN 'UNVERIFIABLE' WHEN rc <> 0 THEN 'MALFORMED' WHEN event_type = 'click' THEN 'VALID' WHEN event_type = 'view' THEN 'INVALID'
  WHEN event_type = 'signup' AND t = 'identity' AND k % 3 = 0 AND k >= 5 THEN 'INVALID' WHEN event_type = 'error' THEN 'MALFORMED' ELSE 'UNVERIFIABLE' END AS status,
 CASE WHEN t = 'conditional' OR rc <> 0 THEN 0.0::DOUBLE WHEN event_type = 'click' THEN 0.85::DOUBLE WHEN event_type = 'view' THEN 0.9::DOUBLE WHEN event_type = 'signup' AND t = 'identity' AND k % 3 = 0 AND k >= 5 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM x""")
def _(spark, sf):
    e = inputs.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    names = {"click": "VALID", "view": "INVALID_NUMERIC", "signup": "SYMBOLIC_NONZERO", "error": "HARNESS_ERROR"}
    body = F.concat(
        F.lit('VERDICT:{"verdict": "'), inputs.lookup(names, F.col("event_type")), F.lit('", "nonzero_fraction": '),
        F.when(k % 3 == 0, "1.0").otherwise("0.5"), F.lit(', "n_evaluated": '), k.cast("string"), F.lit("}"),
    )
    output = F.concat(F.lit("VERDICT:{\"verdict\": \"OLD\"}\n"), F.coalesce(body, F.lit("VERDICT:{\"verdict\": \"NEW\"}")))
    d = e.select(
        "event_id", k.alias("k"), claims.parsed_verdict(output).alias("v"),
        F.get(F.array(F.lit("identity"), F.lit("numeric"), F.lit("conditional"), F.lit("identity")), k % 4).alias("t"),
    )
    out = claims.equation_verdict(
        F.when(F.col("k") % 13 == 0, 1).otherwise(0), F.col("v.verdict"), F.col("t"), F.col("v.nonzero_fraction"), F.col("v.n_evaluated")
    )
    return d.select("event_id", out.alias("o")).select("event_id", "o.status", "o.confidence")


# --- symbol context -----------------------------------------------------------------------------


@query("order_index", "SELECT user_id AS paper_id, 'e' || event_id AS snippet_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS order_idx FROM events")
def _(spark, sf):
    st = inputs.statements(spark, sf).select("paper_id", "snippet_id", F.col("order_idx").alias("pos"))
    return context.order_index(st)


def merged(spark, sf):
    return context.merge_declarations(inputs.declarations(inputs.statements(spark, sf)))


@query("merged_declarations", f"WITH {SYMBOLS_SQL} SELECT * FROM merged")
def _(spark, sf):
    return merged(spark, sf)


@query("implied_predicates", f"""
WITH {SYMBOLS_SQL} SELECT paper_id, symbol, predicate FROM merged JOIN implied USING (domain) UNION SELECT paper_id, symbol, 'complex' FROM merged WHERE began_unknown""")
def _(spark, sf):
    return context.implied_predicates(merged(spark, sf))


@query("asof_context", f"""
WITH {SYMBOLS_SQL} SELECT st.paper_id, st.snippet_id, st.order_idx, st.symbol, coalesce(first_seen < order_idx, false) AS is_known,
 CASE WHEN domain_from < order_idx THEN domain WHEN first_seen < order_idx THEN 'unknown' END AS domain, CASE WHEN defined_from < order_idx THEN definition END AS definition
FROM st LEFT JOIN merged m ON m.paper_id = st.paper_id AND m.symbol = st.symbol""")
def _(spark, sf):
    st = inputs.statements(spark, sf)
    uses = st.select("paper_id", "symbol", "snippet_id", "order_idx")
    return context.context_before(uses, context.merge_declarations(inputs.declarations(st)))


@query("resolve_obligations", f"""
WITH {SYMBOLS_SQL}, ob AS (SELECT paper_id, order_idx, snippet_id || '_cond' AS obligation_id, k % 4 AS c, unnest([symbol, symbol2]) AS symbol FROM st),
need(c, predicate) AS (VALUES (0, 'nonzero'), (0, 'positive'), (1, 'positive'), (2, 'real'), (3, 'integer')),
j AS (SELECT ob.paper_id, obligation_id, ob.symbol, CASE WHEN predicate IS NOT NULL THEN greatest(ob.order_idx, m.domain_from) END AS t_at
 FROM ob LEFT JOIN merged m ON m.paper_id = ob.paper_id AND m.symbol = ob.symbol AND m.domain_from IS NOT NULL LEFT JOIN (SELECT * FROM implied JOIN need USING (predicate)) i ON i.domain = m.domain AND i.c = ob.c)
SELECT paper_id, obligation_id, min(t_at)::BIGINT AS resolved_at, arg_min(symbol, CASE WHEN t_at IS NOT NULL THEN row(t_at, symbol) END) AS resolved_by, CASE WHEN min(t_at) IS NULL THEN 'pending' ELSE 'resolved' END AS status FROM j GROUP BY 1, 2""")
def _(spark, sf):
    st = inputs.statements(spark, sf)
    return context.resolve_obligations(inputs.obligations(st), context.merge_declarations(inputs.declarations(st)))


@query("dependency_edges", f"""
WITH {SYMBOLS_SQL} SELECT DISTINCT st.paper_id, st.snippet_id AS from_snippet, source_snippet AS to_snippet, 'uses_symbol' AS relation
FROM st JOIN merged m ON m.paper_id = st.paper_id AND m.symbol = st.symbol2 AND first_seen <= order_idx""")
def _(spark, sf):
    st = inputs.statements(spark, sf)
    uses = st.select("paper_id", F.col("symbol2").alias("symbol"), "snippet_id", "order_idx")
    return context.dependency_edges(uses, context.merge_declarations(inputs.declarations(st)))


@query("symbol_sources", f"WITH {SYMBOLS_SQL} SELECT paper_id, symbol, source_snippet FROM merged")
def _(spark, sf):
    return context.symbol_sources(merged(spark, sf))


@query("transitive_deps", """
WITH RECURSIVE e AS (SELECT DISTINCT conv_id, turn AS a, unnest([turn - 1, turn // 2]) AS b FROM conversations WHERE turn >= 1),
r AS (SELECT conv_id, a, b FROM e UNION SELECT r.conv_id, r.a, e.b FROM r JOIN e ON e.conv_id = r.conv_id AND e.a = r.b)
SELECT conv_id AS paper_id, a AS snippet_id, b::BIGINT AS depends_on FROM r WHERE a <> b""")
def _(spark, sf):
    c = inputs.table(spark, sf, "conversations").where(F.col("turn") >= 1)
    edges = c.select(
        F.col("conv_id").alias("paper_id"), F.col("turn").alias("from_snippet"),
        F.explode(F.array(F.col("turn") - 1, F.floor(F.col("turn") / 2))).alias("to_snippet"),
    )
    return context.transitive_dependencies(edges)


@query("definitive_layer", """
WITH e AS (SELECT event_id, event_type, value, regexp_extract(props, '[0-9]+')::INT AS k FROM events)
SELECT event_id AS snippet_id, CASE WHEN k % 3 = 0 THEN 'symbolic' WHEN event_type = 'view' THEN 'dimensional' WHEN k % 5 = 0 THEN 'numeric' END AS layer,
 CASE WHEN k % 3 = 0 THEN 'VALID' WHEN event_type = 'view' THEN 'INVALID' WHEN k % 5 = 0 THEN 'VALID' ELSE 'UNVERIFIABLE' END AS status,
 CASE WHEN k % 3 = 0 THEN 0.75::DOUBLE WHEN event_type = 'view' THEN 0.7::DOUBLE WHEN k % 5 = 0 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
 CASE WHEN k % 3 <> 0 AND event_type = 'view' THEN 'Equation / proof' END AS predicted_error_category FROM e""")
def _(spark, sf):
    e = inputs.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")

    def layer(name, status):
        return F.struct(F.lit(name).alias("layer"), status.alias("status"))

    rows = F.array(
        layer("numeric", F.when(k % 5 == 0, "proved").otherwise("unknown")),
        layer("side_condition", F.lit("unknown")),
        layer("dimensional", F.when(F.col("event_type") == "view", "disproved").otherwise("not_applicable")),
        layer("symbolic", F.when(k % 3 == 0, "proved").otherwise("unknown")),
    )
    return context.definitive_layer(e.select(F.col("event_id").alias("snippet_id"), F.inline(rows)))


@query("statement_verdicts", """
WITH e AS (SELECT event_id, event_type, regexp_extract(props, '[0-9]+')::INT AS k FROM events),
x AS (SELECT *, CASE k % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'C' ELSE 'V' END AS c FROM e)
SELECT event_id, CASE WHEN c = 'D' THEN 'VALID' WHEN event_type = 'click' THEN 'VALID' WHEN event_type = 'view' THEN 'INVALID' WHEN event_type = 'signup' THEN 'VALID'
  WHEN event_type = 'error' AND c = 'V' AND k >= 5 THEN 'INVALID' END AS status,
 CASE WHEN c = 'D' THEN 1.0::DOUBLE WHEN event_type = 'click' THEN 0.85::DOUBLE WHEN event_type = 'view' THEN 0.9::DOUBLE WHEN event_type = 'signup' THEN 0.7::DOUBLE WHEN event_type = 'error' AND c = 'V' AND k >= 5 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
 c <> 'D' AND event_type = 'signup' AS has_obligation FROM x""")
def _(spark, sf):
    e = inputs.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    cls = F.get(F.array(*[F.lit(c) for c in ("uncheckable_declaration", "checkable_constraint", "checkable_derivation")]), k % 3)
    verdict = inputs.lookup(
        {"click": "VALID", "view": "INVALID_NUMERIC", "signup": "CONDITIONAL_VALID", "error": "SYMBOLIC_NONZERO", "purchase": "UNVERIFIABLE"},
        F.col("event_type"),
    )
    out = context.statement_verdict(cls, verdict, F.lit(1.0), k)
    return e.select("event_id", out.alias("o")).select("event_id", "o.*")


@query("side_conditions", f"""
WITH {SYMBOLS_SQL}, s AS (SELECT paper_id, snippet_id, unnest(CASE WHEN k % 10 = 0 THEN [NULL] ELSE [symbol, symbol2] END) AS symbol FROM st),
h AS (SELECT s.paper_id, snippet_id, s.symbol, domain IS NOT NULL AND (domain <> 'matrix' OR began_unknown) AS placed FROM s LEFT JOIN merged m ON m.paper_id = s.paper_id AND m.symbol = s.symbol),
g AS (SELECT paper_id, snippet_id, count(symbol) AS n, count(*) FILTER (placed) AS p FROM h GROUP BY 1, 2)
SELECT paper_id, snippet_id, n::BIGINT AS n_symbols, p::BIGINT AS n_known, p::BIGINT AS n_placed, CASE WHEN n = 0 THEN 'no_symbols' WHEN p = 0 THEN 'none_declared' WHEN p = n THEN 'all_declared' ELSE 'some_declared' END AS state FROM g""")
def _(spark, sf):
    st = inputs.statements(spark, sf)
    free = F.when(F.col("k") % 10 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array("symbol", "symbol2"))
    s = st.select("paper_id", "snippet_id", free.alias("free_symbols"))
    return context.side_conditions(s, context.merge_declarations(inputs.declarations(st)))


@query("context_digest", f"""
WITH {SYMBOLS_SQL},
sy AS (SELECT paper_id, 'symbols' AS section, row_number() OVER (PARTITION BY paper_id ORDER BY symbol) AS rank,
  '- ' || symbol || CASE WHEN domain <> 'unknown' AND definition IS NOT NULL THEN '  (domain=' || domain || ', defined_as=' || definition || ')' WHEN domain <> 'unknown' THEN '  (domain=' || domain || ')'
   WHEN definition IS NOT NULL THEN '  (defined_as=' || definition || ')' ELSE '' END AS line FROM merged),
de AS (SELECT paper_id, 'definitions', row_number() OVER (PARTITION BY paper_id ORDER BY defined_from, symbol) AS rank, '- ' || symbol || ' = ' || definition FROM merged WHERE definition IS NOT NULL),
asu AS (SELECT paper_id, 'assumptions', row_number() OVER (PARTITION BY paper_id ORDER BY order_idx DESC) AS rank, '- [' || snippet_id || '] ' || event_type FROM st),
ob AS (SELECT paper_id, 'obligations', row_number() OVER (PARTITION BY paper_id ORDER BY order_idx DESC) AS rank, '- [' || snippet_id || '_cond] ' || {inputs.CONDITIONS!r}[k % 4 + 1] FROM st)
SELECT paper_id, section, rank::BIGINT AS rank, line FROM (SELECT * FROM sy WHERE rank <= 20 UNION ALL SELECT * FROM de WHERE rank <= 10 UNION ALL SELECT * FROM asu WHERE rank <= 10 UNION ALL SELECT * FROM ob WHERE rank <= 5)""")
def _(spark, sf):
    st = inputs.statements(spark, sf)
    assumptions = st.select("paper_id", "snippet_id", "order_idx", F.col("event_type").alias("description"))
    return context.context_digest(context.merge_declarations(inputs.declarations(st)), assumptions, inputs.obligations(st))
