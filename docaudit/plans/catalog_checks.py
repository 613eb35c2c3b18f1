"""Catalog: routing, triage, scoring, findings and roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.constants import VERIFIERS
from docaudit.operators import findings, routing, scorers, triage
from docaudit.plans import flows, inputs
from docaudit.plans.inputs import LINES_SQL, RESULTS_SQL, WS
from docaudit.plans.registry import query

TEXT_KINDS = "('SECTION','SUBSECTION','PARAGRAPH','THEOREM','LEMMA','PROPOSITION','COROLLARY','ALGORITHM','APPENDIX')"
HAS_DIGIT = "regexp_matches(content, '\\p{Nd}|[²³¹⁰⁴-⁹₀-₉]')"
TYPE_ROUTE = (
    "CASE WHEN snippet_type = 'EQUATION' THEN 'math_equation' WHEN snippet_type IN ('FIGURE','TABLE') THEN 'vision' ELSE 'text' END"
)


@query("eligibility", f"""
WITH {LINES_SQL}
SELECT snippet_id, coalesce(length(latex) > 2, false) AS can_math_equation, coalesce(length(latex) > 2, false) AS can_progressive_math,
 snippet_type IN {TEXT_KINDS} AS can_text, snippet_type IN {TEXT_KINDS} AS can_citation, snippet_type IN ('FIGURE','TABLE') AS can_vision,
 {HAS_DIGIT} AS can_statistical, true AS can_triage, true AS can_llm_only FROM scored""")
def _(spark, sf):
    return routing.eligibility(inputs.lines(spark, sf)).select("snippet_id", *[f"can_{v}" for v in VERIFIERS])


@query("route_by_type", f"WITH {LINES_SQL} SELECT snippet_id, snippet_type, {TYPE_ROUTE} AS verifier_name FROM lines")
def _(spark, sf):
    return routing.route(inputs.lines(spark, sf)).select("snippet_id", "snippet_type", "verifier_name")


@query("route_by_label", f"""
SELECT event_id, CASE event_type WHEN 'click' THEN 'math_equation' WHEN 'view' THEN 'citation' WHEN 'signup' THEN NULL WHEN 'error' THEN 'text' ELSE 'statistical' END AS verifier_name FROM events""")
def _(spark, sf):
    e = inputs.table(spark, sf, "events")
    labels = {"click": " Math ", "view": "reference", "signup": "none", "error": "nonsense", "purchase": "NUMERIC"}
    label = inputs.lookup(labels, F.col("event_type"))
    return e.select("event_id", routing.label_route(label, F.lit("SECTION")).alias("verifier_name"))


ABLE = f"""CASE WHEN suggested_route = 'math' AND coalesce(length(latex) > 2, false) THEN 'math_equation'
  WHEN suggested_route = 'text' AND snippet_type IN {TEXT_KINDS} THEN 'text'
  WHEN suggested_route = 'vision' AND snippet_type IN ('FIGURE','TABLE') THEN 'vision'
  WHEN snippet_type = 'EQUATION' THEN CASE WHEN length(latex) > 2 THEN 'math_equation' END
  WHEN snippet_type IN ('FIGURE','TABLE') THEN 'vision' ELSE 'text' END"""


@query("resolve_specialist", f"WITH {LINES_SQL} SELECT snippet_id, suggested_route, {ABLE} AS routed_to FROM scored")
def _(spark, sf):
    s = routing.with_specialist(triage.rule_score(inputs.lines(spark, sf)))
    return s.select("snippet_id", "suggested_route", "routed_to")


@query("prompt_family", f"""
WITH {LINES_SQL}, c AS (SELECT *, len(regexp_extract_all(content, '\\[\\d+(?:,\\s*\\d+)*\\]')) + len(regexp_extract_all(content, '\\([A-Z][a-z]+\\s*(?:et al\\.?)?\\s*,\\s*\\d{{4}}[a-z]?\\)')) AS marks FROM lines)
SELECT snippet_id, CASE WHEN snippet_type = 'EQUATION' THEN 'math' WHEN snippet_type IN ('FIGURE','TABLE') THEN 'figure_table'
 WHEN marks / (length(content) / 500.0) >= 3 THEN 'citation' ELSE 'text' END AS prompt_family FROM c""")
def _(spark, sf):
    return inputs.lines(spark, sf).select("snippet_id", routing.prompt_family("separate-prompts").alias("prompt_family"))


@query("triage_scores", f"WITH {LINES_SQL} SELECT snippet_id, snippet_type, uncertainty, suggested_route FROM scored")
def _(spark, sf):
    return triage.rule_score(inputs.lines(spark, sf)).select("snippet_id", "snippet_type", "uncertainty", "suggested_route")


@query("scorer_outcomes", """
SELECT event_id, CASE event_type WHEN 'click' THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(value / 100, 6))) WHEN 'view' THEN 0.0::DOUBLE WHEN 'signup' THEN 0.5::DOUBLE WHEN 'purchase' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS uncertainty,
 CASE event_type WHEN 'click' THEN 'math' WHEN 'view' THEN 'text' WHEN 'signup' THEN 'proof' WHEN 'purchase' THEN 'none' ELSE 'vision' END AS suggested_route FROM events""")
def _(spark, sf):
    e = inputs.table(spark, sf, "events")
    kind = F.col("event_type")
    shaped = e.select(
        "event_id",
        F.when(kind == "purchase", " ").otherwise("x").alias("content"),
        F.lit(None).cast("string").alias("latex"),
        F.when(kind == "signup", "LEMMA").otherwise("SECTION").alias("snippet_type"),
        F.when(kind == "click", F.round(F.col("value") / 100, 6).cast("string"))
        .when(kind == "view", "high").when(kind == "error", "7").otherwise("0.3").alias("raw"),
        F.when(kind == "click", " Math ").when(kind == "error", "vision").otherwise("").alias("label"),
        (kind == "signup").alias("failed"),
    )
    return triage.scorer_outcome(shaped, "raw", "label", "failed").select("event_id", "uncertainty", "suggested_route")


@query("budget_select", f"""
WITH {LINES_SQL}
SELECT paper_id, snippet_id, uncertainty FROM (
 SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY uncertainty DESC, line_idx) AS r FROM scored WHERE uncertainty >= 0.3) WHERE r <= 5""")
def _(spark, sf):
    s = triage.rule_score(inputs.lines(spark, sf))
    return triage.select_uncertain(s, 0.30, 5).select("paper_id", "snippet_id", "uncertainty")


@query("accept_unselected", f"""
WITH {LINES_SQL}, sel AS (SELECT snippet_id FROM (
 SELECT snippet_id, row_number() OVER (PARTITION BY paper_id ORDER BY uncertainty DESC, line_idx) AS r FROM scored WHERE uncertainty >= 0.3) WHERE r <= 5)
SELECT snippet_id, 'triage' AS verifier_name, 'NO_ERROR' AS status, round(1 - uncertainty, 6) AS confidence FROM scored WHERE snippet_id NOT IN (SELECT snippet_id FROM sel)""")
def _(spark, sf):
    s = triage.rule_score(inputs.lines(spark, sf))
    rest = triage.accepted(s, triage.select_uncertain(s, 0.30, 5))
    return rest.select("snippet_id", "verifier_name", "status", "confidence")


@query("uncertainty_map", f"""
WITH {LINES_SQL}
SELECT paper_id, CASE WHEN snippet_type = 'EQUATION' THEN 'Equation Chain' WHEN snippet_type IN ('FIGURE','TABLE') THEN 'Figures / Tables'
  WHEN snippet_type IN ('THEOREM','LEMMA','PROPOSITION','COROLLARY') THEN 'Theorems / Proofs' ELSE 'Section ' || line_idx END AS region,
 round(avg(uncertainty), 6) AS mean_uncertainty, max(uncertainty) AS max_uncertainty, count(*)::BIGINT AS n FROM scored GROUP BY 1, 2""")
def _(spark, sf):
    return triage.uncertainty_map(triage.rule_score(inputs.lines(spark, sf)), F.col("line_idx"))


@query("escalations", f"""
WITH {LINES_SQL}
SELECT source, snippet_id, rank::BIGINT AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY source ORDER BY uncertainty DESC, snippet_id) AS rank FROM scored WHERE uncertainty >= 0.3) WHERE rank <= 20""")
def _(spark, sf):
    s = triage.select_uncertain(triage.rule_score(inputs.lines(spark, sf)))
    return triage.escalations(s, 20, group="source", order="snippet_id").select("source", "snippet_id", "rank")


@query("threshold_sweep", f"""
WITH {LINES_SQL}, r AS (SELECT *, {ABLE} AS routed_to, length(content) % 3 = 0 AS is_finding FROM scored),
grid(t) AS (VALUES (0.10::DOUBLE),(0.15),(0.20),(0.25),(0.30),(0.35),(0.40),(0.45),(0.50)),
p AS (SELECT DISTINCT paper_id FROM r)
SELECT p.paper_id, round(t, 6) AS threshold, count(r.snippet_id)::BIGINT AS specialist_calls, count(*) FILTER (is_finding)::BIGINT AS errors_detected,
 coalesce(string_agg(DISTINCT routed_to, '|' ORDER BY routed_to), '') AS routes_used
FROM p CROSS JOIN grid LEFT JOIN r ON r.paper_id = p.paper_id AND r.uncertainty >= t GROUP BY 1, 2""")
def _(spark, sf):
    s = routing.with_specialist(triage.rule_score(inputs.lines(spark, sf)))
    s = s.withColumn("is_finding", F.length("content") % 3 == 0)
    return triage.threshold_sweep(s)


@query("sweep_findings", f"""
WITH {LINES_SQL}, grid(t) AS (VALUES (0.10::DOUBLE),(0.15),(0.20),(0.25),(0.30),(0.35),(0.40),(0.45),(0.50))
SELECT snippet_id, t AS threshold FROM scored JOIN grid ON uncertainty >= t WHERE length(content) % 3 = 0""")
def _(spark, sf):
    s = triage.rule_score(inputs.lines(spark, sf)).withColumn("is_finding", F.length("content") % 3 == 0)
    return triage.sweep_findings(s).select("snippet_id", "threshold")


RULE_TEXT = "content || CASE line_idx % 5 WHEN 0 THEN ' It was ALREADY shown.' WHEN 1 THEN ' An inconsistency.' WHEN 2 THEN ' A logical gap in the theorem and its proof.' WHEN 3 THEN ' duplicated panel' ELSE '' END"


def rule_text():
    i = F.col("line_idx") % 5
    return F.concat(
        "content",
        F.when(i == 0, " It was ALREADY shown.").when(i == 1, " An inconsistency.")
        .when(i == 2, " A logical gap in the theorem and its proof.").when(i == 3, " duplicated panel").otherwise(""),
    )


@query("content_rules", f"""
WITH {LINES_SQL}, x AS (SELECT snippet_id, lower({RULE_TEXT}) AS t FROM lines)
SELECT snippet_id,
 CASE WHEN regexp_matches(t, 'already|previously established') THEN 0.85::DOUBLE ELSE 0.9::DOUBLE END AS citation_confidence,
 regexp_matches(t, 'already|previously established') AS citation_error,
 CASE WHEN contains(t, 'duplicat') THEN 'Figure duplication' WHEN contains(t, 'inconsist') THEN 'Data Inconsistency (figure-text)' END AS visual_category,
 CASE WHEN NOT regexp_matches(t, 'contradiction|inconsist|logical') THEN 0.95::DOUBLE WHEN contains(t, 'theorem') AND regexp_matches(t, 'proof|lemma') THEN 0.78::DOUBLE ELSE 0.82::DOUBLE END AS text_confidence,
 regexp_matches(t, 'incorrect|wrong|contradict|flawed') AS review_error FROM x""")
def _(spark, sf):
    s = inputs.lines(spark, sf).select("snippet_id", rule_text().alias("t"))
    t = F.col("t")
    return s.select(
        "snippet_id",
        scorers.citation_rule(t)["confidence"].alias("citation_confidence"),
        scorers.citation_rule(t)["error_detected"].alias("citation_error"),
        scorers.visual_rule(t)["predicted_error_category"].alias("visual_category"),
        scorers.text_rule(t)["confidence"].alias("text_confidence"),
        scorers.review_rule(t).isNotNull().alias("review_error"),
    )


@query("statement_classes", """
SELECT event_id, CASE k % 8 WHEN 0 THEN 'uncheckable_declaration' WHEN 1 THEN 'uncheckable_declaration' WHEN 2 THEN 'uncheckable_declaration' WHEN 3 THEN 'uncheckable_declaration'
  WHEN 4 THEN 'checkable_derivation' WHEN 5 THEN 'uncheckable_declaration' WHEN 6 THEN 'checkable_constraint' ELSE 'checkable_derivation' END AS statement_class,
 CASE k % 8 WHEN 0 THEN 'real' WHEN 1 THEN 'natural' WHEN 2 THEN 'integer' WHEN 3 THEN 'positive_real' WHEN 4 THEN 'real' WHEN 5 THEN 'unknown' WHEN 6 THEN 'real' ELSE 'unknown' END AS domain
FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)""")
def _(spark, sf):
    e = inputs.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    texts = [
        "x \\in \\mathbb{R}", "n \\in \\mathbb{N}", "m \\in \\mathbb{Z}", "x > 0",
        "(a+b)^2 = a^2 + b^2", "Let B = Q / N", "s^2 + t^2 = 1 on the circle", "x^2 = x x",
    ]
    text = F.get(F.array(*[F.lit(t) for t in texts]), k % 8)
    return e.select("event_id", scorers.statement_class(text).alias("c")).select("event_id", "c.*")


@query("chunk_findings", """
WITH c AS (SELECT user_id, event_id AS chunk_idx, event_type = 'error' AS failed, value > 60 AS err, value AS conf, event_type FROM events),
b AS (SELECT user_id, count(*) AS n, count(*) FILTER (failed) AS nf, arg_max(chunk_idx, CASE WHEN NOT failed THEN row(err, conf, -chunk_idx) END) AS i,
 arg_max(err, CASE WHEN NOT failed THEN row(err, conf, -chunk_idx) END) AS e, arg_max(conf, CASE WHEN NOT failed THEN row(err, conf, -chunk_idx) END) AS k,
 arg_max(event_type, CASE WHEN NOT failed THEN row(err, conf, -chunk_idx) END) AS t FROM c GROUP BY 1)
SELECT user_id, n::BIGINT AS n_chunks, nf::BIGINT AS n_failed, CASE WHEN n = nf THEN 'UNVERIFIABLE' WHEN e THEN 'ERROR_DETECTED' ELSE 'NO_ERROR' END AS status,
 coalesce(e, false) AS error_detected, round(CASE WHEN n = nf THEN 0 ELSE k END, 6) AS confidence,
 CASE WHEN n <> nf THEN CASE WHEN n > 1 THEN '[chunk ' || (i + 1) || '/' || n || '] ' ELSE '' END || t END AS reasoning, CASE WHEN n <> nf THEN t END AS predicted_error_category FROM b""")
def _(spark, sf):
    e = inputs.table(spark, sf, "events")
    c = e.select(
        "user_id",
        F.col("event_id").alias("chunk_idx"),
        (F.col("event_type") == "error").alias("failed"),
        (F.col("value") > 60).alias("error_detected"),
        F.col("value").alias("confidence"),
        F.col("event_type").alias("reasoning"),
        F.col("event_type").alias("predicted_error_category"),
    )
    return scorers.best_chunk_finding(c, ["user_id"])


@query("result_status", """
SELECT event_id, CASE WHEN event_type = 'view' OR k % 11 = 0 THEN 'SKIPPED' WHEN k >= 30 THEN 'ERROR_DETECTED' ELSE 'NO_ERROR' END AS status
FROM (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events)""")
def _(spark, sf):
    e = inputs.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", scorers.status_of(F.col("event_type") != "view", k % 11 == 0, k >= 30).alias("status"))


@query("plugged_scorers", f"""
WITH {LINES_SQL}, x AS (SELECT snippet_id, snippet_type, content, lower({RULE_TEXT}) AS t, {TYPE_ROUTE} AS verifier_name FROM lines)
SELECT snippet_id, verifier_name,
 CASE verifier_name WHEN 'vision' THEN CASE WHEN regexp_matches(t, 'duplicat|inconsist') THEN 'ERROR_DETECTED' ELSE 'NO_ERROR' END
  WHEN 'text' THEN CASE WHEN regexp_matches(t, 'contradiction|inconsist|logical') AND contains(t, 'theorem') AND regexp_matches(t, 'proof|lemma') THEN 'ERROR_DETECTED' ELSE 'NO_ERROR' END
  ELSE CASE WHEN length(t) % 2 = 0 THEN 'ERROR_DETECTED' ELSE 'NO_ERROR' END END AS status,
 CASE verifier_name WHEN 'vision' THEN CASE WHEN contains(t, 'duplicat') THEN 0.85::DOUBLE WHEN contains(t, 'inconsist') THEN 0.72::DOUBLE ELSE 0.9::DOUBLE END
  WHEN 'text' THEN CASE WHEN NOT regexp_matches(t, 'contradiction|inconsist|logical') THEN 0.95::DOUBLE WHEN contains(t, 'theorem') AND regexp_matches(t, 'proof|lemma') THEN 0.78::DOUBLE ELSE 0.82::DOUBLE END
  ELSE 0.5::DOUBLE END AS confidence FROM x""")
def _(spark, sf):
    registry = scorers.default_registry()

    def even_length(batches):
        for pdf in batches:
            odd = pdf["content"].str.len() % 2 == 0
            yield pdf.assign(error_detected=odd, confidence=0.5, predicted_error_category=None)

    registry.register_batch("math_equation", even_length)
    s = routing.route(inputs.lines(spark, sf)).select("snippet_id", "verifier_name", F.lower(rule_text()).alias("content"))
    return registry.apply(s).select("snippet_id", "verifier_name", "status", "confidence")


# --- findings ------------------------------------------------------------------------------


FOUND = f"WITH {RESULTS_SQL} SELECT paper_id, snippet_id, order_key, coalesce(predicted_error_category, 'Unknown') AS error_category, location AS error_location, round(confidence, 6) AS confidence, verifier_name"


@query("finding_filter", f"{FOUND} FROM flagged WHERE is_finding")
def _(spark, sf):
    return findings.findings(inputs.results(spark, sf))


@query("finding_filter_lenient", f"""
WITH {RESULTS_SQL} SELECT snippet_id, verifier_name FROM res WHERE error_detected AND confidence >= CASE verifier_name WHEN 'math_equation' THEN 0.7::DOUBLE WHEN 'vision' THEN 0.6::DOUBLE WHEN 'statistical' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END""")
def _(spark, sf):
    return findings.findings(inputs.results(spark, sf), "lenient").select("snippet_id", "verifier_name")


@query("id_locations", f"WITH {RESULTS_SQL} SELECT snippet_id, order_key::VARCHAR AS location FROM res")
def _(spark, sf):
    r = inputs.results(spark, sf)
    return r.select("snippet_id", findings.id_location(F.col("snippet_id")).alias("location"))


@query("ranked_findings", f"{FOUND}, (row_number() OVER (PARTITION BY paper_id ORDER BY confidence DESC, order_key) - 1)::BIGINT AS pred_idx FROM flagged WHERE is_finding")
def _(spark, sf):
    return findings.ranked(findings.findings(inputs.results(spark, sf)))


@query("finding_lists", f"""
WITH {RESULTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY confidence DESC, order_key) - 1 AS i FROM flagged WHERE is_finding)
SELECT paper_id, (i // 10)::BIGINT AS page, string_agg(snippet_id, '|' ORDER BY i) AS snippets FROM r GROUP BY 1, 2""")
def _(spark, sf):
    pages = findings.finding_pages(findings.ranked(findings.findings(inputs.results(spark, sf))), 10)
    return pages.select("paper_id", "page", F.col("predicted_errors.snippet_id").alias("snippets"))


@query("finding_rollup", f"""
WITH {RESULTS_SQL}, per AS (SELECT paper_id, verifier_name, count(*) AS n, count(*) FILTER (is_finding) AS e, max(CASE WHEN is_finding THEN confidence END) AS t FROM flagged GROUP BY 1, 2),
r AS (SELECT paper_id, sum(n) AS n, sum(e) AS e, max(t) AS t, string_agg(verifier_name || '=' || n, '|' ORDER BY verifier_name) AS u FROM per GROUP BY 1)
SELECT c_custkey AS paper_id, coalesce(n, 0)::BIGINT AS total_snippets, coalesce(n, 0)::BIGINT AS snippets_verified, coalesce(e, 0)::BIGINT AS errors_detected, round(t, 6) AS top_confidence, coalesce(u, '') AS verifier_usage
FROM customer LEFT JOIN r ON r.paper_id = c_custkey""")
def _(spark, sf):
    papers = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("paper_id"))
    return findings.rollup(papers, inputs.results(spark, sf))


@query("verifier_usage", f"""
WITH {RESULTS_SQL}, per AS (SELECT paper_id, verifier_name, count(*) AS n FROM res GROUP BY 1, 2 UNION ALL SELECT paper_id, 'triage', count(*) FROM res GROUP BY 1)
SELECT verifier_name, sum(n)::BIGINT AS n_snippets FROM per GROUP BY 1""")
def _(spark, sf):
    r = inputs.results(spark, sf)
    return findings.verifier_usage(r, r)


@query("run_totals", f"""
WITH {RESULTS_SQL}, p AS (SELECT paper_id, count(*) AS n, count(*) FILTER (is_finding) AS e FROM flagged GROUP BY 1)
SELECT count(*)::BIGINT AS papers, coalesce(sum(n), 0)::BIGINT AS total_snippets, coalesce(sum(n), 0)::BIGINT AS snippets_verified, coalesce(sum(e), 0)::BIGINT AS errors_detected
FROM customer LEFT JOIN p ON p.paper_id = c_custkey""")
def _(spark, sf):
    papers = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("paper_id"))
    r = inputs.results(spark, sf)
    return findings.run_totals(flows.predictions(papers, r))


@query("raw_errors", """
WITH e AS (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k FROM events), x AS (
 SELECT event_id, user_id, k, value, event_type, 0 AS i FROM e UNION ALL SELECT event_id, user_id, k, value, event_type, 1 FROM e)
SELECT event_id AS paper_id, i::BIGINT AS order_key, CASE WHEN i = 0 THEN event_type ELSE 'Unknown' END AS error_category, CASE WHEN i = 0 THEN 'Lemma ' || k ELSE 'Unknown' END AS error_location,
 CASE WHEN i = 0 THEN k / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM x WHERE event_type <> 'view'""")
def _(spark, sf):
    e = inputs.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    body = F.concat(
        F.lit('Here:\n```json\n{"errors": [{"error_category": "'), "event_type", F.lit('", "error_location": "Lemma '), k,
        F.lit('", "confidence": '), (k.cast("int") / 100).cast("string"), F.lit('}, {"error_category": "", "confidence": "n/a"}]}\n```'),
    )
    response = F.when(F.col("event_type") == "view", F.lit("I found nothing.")).otherwise(body)
    rows = findings.raw_errors(e.select(F.col("event_id").alias("paper_id"), response.alias("response")))
    return rows.select("paper_id", "order_key", "error_category", "error_location", "confidence")


# --- flows -----------------------------------------------------------------------------------

FLOW_SQL = f"""{LINES_SQL},
chosen AS (SELECT *, CASE WHEN uncertainty >= 0.3 THEN {ABLE} END AS v FROM scored),
done AS (
 SELECT *, lower(content) AS t, coalesce(v, 'triage') AS verifier_name FROM chosen),
verdict AS (
 SELECT *, CASE verifier_name WHEN 'vision' THEN regexp_matches(t, 'duplicat|inconsist')
   WHEN 'text' THEN regexp_matches(t, 'contradiction|inconsist|logical') AND contains(t, 'theorem') AND regexp_matches(t, 'proof|lemma') ELSE false END AS error_detected,
  CASE verifier_name WHEN 'vision' THEN CASE WHEN contains(t, 'duplicat') THEN 0.85::DOUBLE WHEN contains(t, 'inconsist') THEN 0.72::DOUBLE ELSE 0.9::DOUBLE END
   WHEN 'text' THEN CASE WHEN NOT regexp_matches(t, 'contradiction|inconsist|logical') THEN 0.95::DOUBLE WHEN contains(t, 'theorem') AND regexp_matches(t, 'proof|lemma') THEN 0.78::DOUBLE ELSE 0.82::DOUBLE END
   WHEN 'triage' THEN 1 - uncertainty ELSE 0.0::DOUBLE END AS confidence FROM done)"""


@query("triaged_results", f"""
WITH {FLOW_SQL} SELECT paper_id, snippet_id, CASE WHEN verifier_name = 'math_equation' THEN NULL ELSE verifier_name END AS verifier_name,
 CASE WHEN verifier_name = 'math_equation' THEN 'SKIPPED' WHEN error_detected THEN 'ERROR_DETECTED' ELSE 'NO_ERROR' END AS status, round(confidence, 6) AS confidence FROM verdict""")
def _(spark, sf):
    r = flows.triaged(inputs.lines(spark, sf))
    # no deterministic scorer takes equations: those rows are skipped
    name = F.when(F.col("verifier_name") != "math_equation", F.col("verifier_name"))
    return r.select("paper_id", "snippet_id", name.alias("verifier_name"), "status", "confidence")


@query("triaged_rollup", f"""
WITH {FLOW_SQL}, f AS (SELECT *, error_detected AND confidence >= CASE verifier_name WHEN 'vision' THEN 0.75::DOUBLE ELSE 0.8::DOUBLE END AS is_finding FROM verdict),
per AS (SELECT paper_id, verifier_name, count(*) AS n, count(*) FILTER (is_finding) AS e, max(CASE WHEN is_finding THEN confidence END) AS t FROM f GROUP BY 1, 2),
r AS (SELECT paper_id, sum(n) AS n, sum(CASE WHEN verifier_name <> 'triage' THEN n END) AS v, sum(e) AS e, max(t) AS t FROM per GROUP BY 1),
w AS (SELECT paper_id, string_agg(verifier_name || '=' || n, '|' ORDER BY verifier_name) AS u
  FROM (SELECT paper_id, verifier_name, n FROM per WHERE verifier_name <> 'triage' UNION ALL SELECT paper_id, 'triage', n FROM r) GROUP BY 1)
SELECT doc_id AS paper_id, coalesce(n, 0)::BIGINT AS total_snippets, coalesce(v, 0)::BIGINT AS snippets_verified, coalesce(e, 0)::BIGINT AS errors_detected, round(t, 6) AS top_confidence, coalesce(u, '') AS verifier_usage
FROM documents LEFT JOIN r ON r.paper_id = doc_id LEFT JOIN w ON w.paper_id = doc_id""")
def _(spark, sf):
    papers = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"))
    return flows.predictions(papers, flows.triaged(inputs.lines(spark, sf)), triaged=True)


@query("exhaustive_results", f"""
WITH {LINES_SQL}, x AS (SELECT *, lower(content) AS t, {TYPE_ROUTE} AS v FROM scored)
SELECT snippet_id, v AS verifier_name, CASE WHEN v = 'math_equation' THEN 'SKIPPED' WHEN v = 'vision' AND regexp_matches(t, 'duplicat|inconsist') THEN 'ERROR_DETECTED'
 WHEN v = 'text' AND regexp_matches(t, 'contradiction|inconsist|logical') AND contains(t, 'theorem') AND regexp_matches(t, 'proof|lemma') THEN 'ERROR_DETECTED' ELSE 'NO_ERROR' END AS status FROM x""")
def _(spark, sf):
    return flows.exhaustive(inputs.lines(spark, sf)).select("snippet_id", "verifier_name", "status")
