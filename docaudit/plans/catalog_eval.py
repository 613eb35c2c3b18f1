"""Catalog: matching, alignment, metrics, step cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from docaudit.functions.locations import location_score, match_key, with_location
from docaudit.functions.text import compact, similarity
from docaudit.operators import align, metrics
from docaudit.plans import inputs
from docaudit.plans.inputs import ALIGN_SQL, LOCATIONS_SQL, STEPS_SQL, compact_sql, similarity_sql
from docaudit.plans.registry import query

# --- location matching -----------------------------------------------------------------------


@query("string_similarity", f"""
WITH p AS (SELECT p_partkey, {compact_sql('p_name')} AS a, {compact_sql('p_type')} AS b FROM part)
SELECT p_partkey, round({similarity_sql('a', 'b')}, 6) AS score FROM p""")
def _(spark, sf):
    p = inputs.table(spark, sf, "part")
    return p.select("p_partkey", similarity(compact(F.col("p_name")), compact(F.col("p_type"))).alias("score"))


SCORE_SQL = f"""CASE WHEN a.kind = b.kind THEN
   CASE WHEN len(list_intersect(a.ids, b.ids)) = len(list_distinct(list_concat(a.ids, b.ids))) THEN 1.0::DOUBLE
    WHEN len(list_intersect(a.ids, b.ids)) > 0 THEN 0.5::DOUBLE + 0.5::DOUBLE * len(list_intersect(list_distinct(a.ids), b.ids)) / len(list_distinct(list_concat(a.ids, b.ids)))
    ELSE {similarity_sql('an', 'bn')} END
  WHEN a.kind = 'unknown' OR b.kind = 'unknown' THEN ({similarity_sql('an', 'bn')}) * 0.5::DOUBLE
  ELSE greatest({similarity_sql('an', 'bn')}, {similarity_sql('ar', 'br')}) * 0.8::DOUBLE END"""


@query("fuzzy_scores", f"""
WITH {LOCATIONS_SQL}, c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, a, b, {compact_sql('a.norm')} AS an, {compact_sql('b.norm')} AS bn, {compact_sql('a.raw')} AS ar, {compact_sql('b.raw')} AS br FROM loc)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, round({SCORE_SQL}, 6) AS score FROM c""")
def _(spark, sf):
    d = inputs.locations(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "loc_a", "loc_b")
    d = with_location(with_location(d, "loc_a", "_ra"), "loc_b", "_rb")
    d = d.withColumns({"_ka": match_key(F.col("_ra")), "_kb": match_key(F.col("_rb"))})
    score = location_score(F.col("_ka"), F.col("_kb"))
    return d.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", score.alias("score"))


# distinct location strings of both sides, scored once each
PAIR_SQL = f"""locs AS (SELECT DISTINCT error_location AS loc, lower(split_part(error_location, ' ', 1)) AS kind, split_part(error_location, ' ', 2) AS id FROM preds
 UNION SELECT DISTINCT error_location, lower(split_part(error_location, ' ', 1)), split_part(error_location, ' ', 2) FROM anns),
keyed AS (SELECT *, {compact_sql("kind || ' ' || id")} AS n FROM locs),
pair AS (SELECT x.loc AS pl, y.loc AS al, CASE WHEN x.kind = y.kind THEN CASE WHEN x.id = y.id THEN 1.0::DOUBLE ELSE {similarity_sql('x.n', 'y.n')} END
  ELSE ({similarity_sql('x.n', 'y.n')}) * 0.8::DOUBLE END AS s FROM keyed x CROSS JOIN keyed y)"""


@query("candidate_scores", f"""
WITH {ALIGN_SQL}, {PAIR_SQL},
p AS (SELECT paper_id, error_location, error_category, count(*) AS n FROM preds GROUP BY ALL), a AS (SELECT paper_id, error_location, error_category, count(*) AS n FROM anns GROUP BY ALL)
SELECT p.paper_id, p.error_location AS predicted_location, p.error_category AS predicted_category, a.error_location AS annotated_location, a.error_category AS annotated_category,
 p.n::BIGINT AS n_predictions, a.n::BIGINT AS n_annotations, round(CASE WHEN p.error_category = a.error_category THEN least(1, s + 0.25) ELSE s END, 6) AS score
FROM p JOIN a USING (paper_id) JOIN pair ON pl = p.error_location AND al = a.error_location WHERE CASE WHEN p.error_category = a.error_category THEN least(1, s + 0.25) ELSE s END >= 0.6""")
def _(spark, sf):
    return align.candidate_scores(inputs.predictions(spark, sf), inputs.annotations(spark, sf))


# a walk over each paper's predictions that carries the annotations used so far
GREEDY_SQL = f"""{ALIGN_SQL}, {PAIR_SQL},
cand AS (
 SELECT p.paper_id, p.pred_idx, list({{'i': a.ann_idx, 's': CASE WHEN p.error_category = a.error_category THEN least(1, s + 0.25) ELSE s END}}
   ORDER BY CASE WHEN p.error_category = a.error_category THEN least(1, s + 0.25) ELSE s END DESC, a.ann_idx) AS c
 FROM preds p JOIN anns a USING (paper_id) JOIN pair ON pl = p.error_location AND al = a.error_location
 WHERE CASE WHEN p.error_category = a.error_category THEN least(1, s + 0.25) ELSE s END >= 0.6 GROUP BY 1, 2),
prep AS (SELECT p.paper_id, p.pred_idx, coalesce(c, []) AS c FROM preds p LEFT JOIN cand USING (paper_id, pred_idx)),
walk AS (
 SELECT paper_id, -1::BIGINT AS pred_idx, []::BIGINT[] AS used, NULL::BIGINT AS ann_idx, NULL::DOUBLE AS score FROM (SELECT DISTINCT paper_id FROM preds)
 UNION ALL
 SELECT q.paper_id, q.pred_idx, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.i) END, b.i, b.s
 FROM (SELECT w.paper_id, p.pred_idx, w.used, list_filter(p.c, lambda x: NOT list_contains(w.used, x.i))[1] AS b
  FROM walk w JOIN prep p ON p.paper_id = w.paper_id AND p.pred_idx = w.pred_idx + 1) q),
matched AS (SELECT paper_id, pred_idx, ann_idx, score FROM walk WHERE ann_idx IS NOT NULL),
aligned AS (
 SELECT p.paper_id, CASE WHEN m.ann_idx IS NULL THEN 'FP' ELSE 'TP' END AS outcome, p.pred_idx, m.ann_idx, p.error_category, p.error_location,
  a.error_category AS gt_category, a.error_location AS gt_location, a.error_severity AS gt_severity, coalesce(m.score, 0.0::DOUBLE) AS match_quality,
  p.supporting_evidence, a.error_annotation AS gt_annotation
 FROM preds p LEFT JOIN matched m USING (paper_id, pred_idx) LEFT JOIN anns a ON a.paper_id = p.paper_id AND a.ann_idx = m.ann_idx
 UNION ALL
 SELECT a.paper_id, 'FN', NULL, a.ann_idx, '', '', a.error_category, a.error_location, a.error_severity, 1.0::DOUBLE, NULL, a.error_annotation
 FROM anns a WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.paper_id = a.paper_id AND m.ann_idx = a.ann_idx))"""


def aligned(spark, sf):
    return align.align(inputs.predictions(spark, sf), inputs.annotations(spark, sf))


@query("greedy_align", f"""
WITH RECURSIVE {GREEDY_SQL}
SELECT paper_id, outcome, pred_idx, ann_idx, error_category, error_location, gt_category, gt_location, gt_severity, round(match_quality, 6) AS match_quality, supporting_evidence, gt_annotation FROM aligned""")
def _(spark, sf):
    return aligned(spark, sf)


@query("category_filter", f"""
WITH {ALIGN_SQL}
SELECT 'predictions' AS side, paper_id, pred_idx AS idx FROM preds WHERE error_category = 'A' UNION ALL SELECT 'annotations', paper_id, ann_idx FROM anns WHERE error_category = 'A'""")
def _(spark, sf):
    p = align.only_category(inputs.predictions(spark, sf), "A")
    a = align.only_category(inputs.annotations(spark, sf), "A")
    return p.select(F.lit("predictions").alias("side"), "paper_id", F.col("pred_idx").alias("idx")).unionByName(
        a.select(F.lit("annotations").alias("side"), "paper_id", F.col("ann_idx").alias("idx"))
    )


# every document's lines give index pairs; first come, first served on both sides
JUDGE_SQL = """pairs AS (
 SELECT doc_id, ord - 1 AS i, length(line) % 7 - 1 AS a, length(line) % 5 AS p FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)),
w AS (
 SELECT doc_id, -1::BIGINT AS i, []::BIGINT[] AS ua, []::BIGINT[] AS up, false AS ok, NULL::BIGINT AS a, NULL::BIGINT AS p FROM (SELECT DISTINCT doc_id FROM pairs)
 UNION ALL
 SELECT w.doc_id, x.i, CASE WHEN g THEN list_append(ua, x.a) ELSE ua END, CASE WHEN g THEN list_append(up, x.p) ELSE up END, g, x.a, x.p
 FROM w JOIN pairs x ON x.doc_id = w.doc_id AND x.i = w.i + 1, LATERAL (SELECT x.a >= 0 AND x.a < 5 AND x.p < 4 AND NOT list_contains(w.ua, x.a) AND NOT list_contains(w.up, x.p) AS g) t)"""


def _judged(spark, sf):
    d = inputs.table(spark, sf, "documents")
    answer = F.to_json(
        F.transform(
            F.split("text", "\n"),
            lambda line: F.struct(
                (F.length(line) % 7 - 1).alias("annotation_index"), (F.length(line) % 5).alias("prediction_index")
            ),
        )
    )
    return d.select(F.col("doc_id").alias("paper_id"), answer.alias("matches"), F.lit(5).alias("n_annotations"), F.lit(4).alias("n_predictions"))


@query("sanitize_matches", f"WITH RECURSIVE {JUDGE_SQL.replace(', LATERAL (SELECT ', ' CROSS JOIN LATERAL (SELECT ')} SELECT doc_id AS paper_id, p::BIGINT AS pred_idx, a::BIGINT AS ann_idx, 1.0::DOUBLE AS score FROM w WHERE ok")
def _(spark, sf):
    return align.judged_matches(_judged(spark, sf))


JUDGE_ALIGN_SQL = f"""{GREEDY_SQL},
judged AS (SELECT o_orderkey AS paper_id FROM orders WHERE o_orderstatus <> 'F'),
np AS (SELECT paper_id, count(*) AS n FROM preds GROUP BY 1),
jm AS (SELECT np.paper_id, 0::BIGINT AS pred_idx, n - 1 AS ann_idx, 1.0::DOUBLE AS score FROM np JOIN judged USING (paper_id)),
am AS (SELECT * FROM jm UNION ALL SELECT * FROM matched WHERE paper_id NOT IN (SELECT paper_id FROM judged)),
ja AS (
 SELECT p.paper_id, CASE WHEN m.ann_idx IS NULL THEN 'FP' ELSE 'TP' END AS outcome, p.pred_idx, m.ann_idx, coalesce(m.score, 0.0::DOUBLE) AS match_quality
 FROM preds p LEFT JOIN am m USING (paper_id, pred_idx)
 UNION ALL SELECT a.paper_id, 'FN', NULL, a.ann_idx, 1.0::DOUBLE FROM anns a WHERE NOT EXISTS (SELECT 1 FROM am m WHERE m.paper_id = a.paper_id AND m.ann_idx = a.ann_idx))"""


@query("judge_fallback", f"WITH RECURSIVE {JUDGE_ALIGN_SQL} SELECT paper_id, outcome, pred_idx, ann_idx, round(match_quality, 6) AS match_quality FROM ja")
def _(spark, sf):
    p, a = inputs.predictions(spark, sf), inputs.annotations(spark, sf)
    n = p.groupBy("paper_id").agg(F.count("*").cast("int").alias("n_predictions"))
    o = inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), "o_orderstatus")
    answer = F.when(
        F.col("o_orderstatus") != "F",
        F.concat(F.lit('[{"annotation_index": '), (F.col("n_predictions") - 1).cast("string"), F.lit(', "prediction_index": 0}]')),
    )
    judged = n.join(o, "paper_id").select("paper_id", answer.alias("matches"), F.col("n_predictions").alias("n_annotations"), "n_predictions")
    return align.align_judged(p, a, judged).select("paper_id", "outcome", "pred_idx", "ann_idx", "match_quality")


@query("apply_matches", f"""
WITH {ALIGN_SQL}, m AS (SELECT p.paper_id, p.pred_idx, p.pred_idx AS ann_idx FROM preds p WHERE error_category = 'R')
SELECT p.paper_id, CASE WHEN m.ann_idx IS NULL THEN 'FP' ELSE 'TP' END AS outcome, p.pred_idx, a.error_location AS gt_location
FROM preds p LEFT JOIN m USING (paper_id, pred_idx) LEFT JOIN anns a ON a.paper_id = m.paper_id AND a.ann_idx = m.ann_idx
UNION ALL SELECT a.paper_id, 'FN', NULL, a.error_location FROM anns a LEFT JOIN m USING (paper_id, ann_idx) WHERE m.pred_idx IS NULL""")
def _(spark, sf):
    p, a = inputs.predictions(spark, sf), inputs.annotations(spark, sf)
    m = p.where(F.col("error_category") == "R").select(
        "paper_id", "pred_idx", F.col("pred_idx").alias("ann_idx"), F.lit(1.0).alias("score")
    )
    return align.outcomes(p, a, m).select("paper_id", "outcome", "pred_idx", "gt_location")


@query("judge_payloads", f"""
WITH {ALIGN_SQL}
SELECT paper_id, 'annotations' AS side, 0::BIGINT AS page, '[' || string_agg('{{"idx":' || ann_idx || ',"location":"' || error_location || '","description":"' || error_annotation || '"}}', ',' ORDER BY ann_idx) || ']' AS payload FROM anns GROUP BY 1
UNION ALL
SELECT paper_id, 'predictions', 0, '[' || string_agg('{{"idx":' || pred_idx || ',"error_category":"' || error_category || '","error_location":"' || error_location || '","supporting_evidence":"' || supporting_evidence || '"}}', ',' ORDER BY pred_idx) || ']' FROM preds GROUP BY 1""")
def _(spark, sf):
    return align.judge_payloads(inputs.predictions(spark, sf), inputs.annotations(spark, sf))


# --- metrics --------------------------------------------------------------------------------

RATIOS = """round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall,
 round(2 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(1e-9, tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn)), 6) AS f1,
 round(tp / greatest(1, tp + fp + fn), 6) AS accuracy"""
COUNTS = "count(*) FILTER (outcome = 'TP')::BIGINT AS tp, count(*) FILTER (outcome = 'FP')::BIGINT AS fp, count(*) FILTER (outcome = 'FN')::BIGINT AS fn"


@query("metrics_overall", f"WITH RECURSIVE {GREEDY_SQL}, c AS (SELECT {COUNTS} FROM aligned) SELECT tp, fp, fn, 0::BIGINT AS tn, {RATIOS} FROM c")
def _(spark, sf):
    return metrics.overall(aligned(spark, sf))


BREAKDOWN_SQL = f"""{GREEDY_SQL}, pc AS (SELECT paper_id, arg_max(paper_category, ann_idx) AS paper_category FROM anns GROUP BY 1),
k AS (SELECT outcome, coalesce(nullif(gt_category, ''), nullif(error_category, ''), 'Unknown') AS error_category, coalesce(nullif(gt_severity, ''), 'Unknown') AS error_severity,
  coalesce(paper_category, 'Unknown') AS paper_category FROM aligned LEFT JOIN pc USING (paper_id)),
g AS (
 SELECT 'error_category' AS dimension, error_category AS category, {COUNTS} FROM k GROUP BY 2 UNION ALL SELECT 'error_severity', error_severity, {COUNTS} FROM k GROUP BY 2
 UNION ALL SELECT 'paper_category', paper_category, {COUNTS} FROM k GROUP BY 2 UNION ALL SELECT 'overall', 'all', {COUNTS} FROM k),
b AS (SELECT dimension, category, tp, fp, fn, {RATIOS}, tp + fn AS support FROM g)"""


def breakdown(spark, sf):
    a = inputs.annotations(spark, sf)
    return metrics.breakdown(align.align(inputs.predictions(spark, sf), a), metrics.paper_categories(a))


@query("metrics_breakdown", f"WITH RECURSIVE {BREAKDOWN_SQL} SELECT * FROM b")
def _(spark, sf):
    return breakdown(spark, sf)


@query("worst_categories", f"WITH RECURSIVE {BREAKDOWN_SQL} SELECT * FROM b WHERE dimension IN ('error_category', 'error_severity') ORDER BY f1, dimension, category LIMIT 5")
def _(spark, sf):
    return metrics.worst(breakdown(spark, sf))


@query("dataset_totals", f"""
WITH RECURSIVE {GREEDY_SQL} SELECT (SELECT count(DISTINCT paper_id) FROM anns)::BIGINT AS n_papers, (SELECT count(*) FROM anns)::BIGINT AS n_annotations, count(*)::BIGINT AS n_aligned,
 count(*) FILTER (outcome <> 'FN')::BIGINT AS n_predictions, count(*) FILTER (outcome = 'TP')::BIGINT AS n_matched FROM aligned""")
def _(spark, sf):
    a = inputs.annotations(spark, sf)
    return metrics.dataset_totals(align.align(inputs.predictions(spark, sf), a), a)


@query("paper_breakdown", f"WITH RECURSIVE {GREEDY_SQL} SELECT paper_id, {COUNTS} FROM aligned GROUP BY 1")
def _(spark, sf):
    return metrics.per_paper(aligned(spark, sf))


@query("matched_papers", f"WITH RECURSIVE {GREEDY_SQL} SELECT DISTINCT paper_id FROM aligned WHERE outcome = 'TP'")
def _(spark, sf):
    return metrics.matched_papers(aligned(spark, sf))


@query("micro_macro", f"""
WITH RECURSIVE {GREEDY_SQL}, p AS (SELECT paper_id, {COUNTS} FROM aligned GROUP BY 1)
SELECT round(sum(tp) / greatest(1, sum(tp + fp)), 6) AS precision_micro, round(sum(tp) / greatest(1, sum(tp + fn)), 6) AS recall_micro,
 round(avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END), 6) AS precision_macro, round(avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END), 6) AS recall_macro,
 round(avg(CASE WHEN tp + fp > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS ppr FROM p""")
def _(spark, sf):
    return metrics.micro_macro(aligned(spark, sf))


LABEL_SQL = "lab AS (SELECT doc_id, quality, toxic, CASE WHEN n_chars % 3 > 0 THEN 1 ELSE 0 END AS guess, CASE WHEN n_chars % 5 > 1 THEN 1 ELSE 0 END AS guess2 FROM labels JOIN documents USING (doc_id))"


def labelled(spark, sf):
    d = inputs.table(spark, sf, "documents").select("doc_id", "n_chars")
    return inputs.table(spark, sf, "labels").join(d, "doc_id").withColumns(
        {"guess": (F.col("n_chars") % 3 > 0).cast("int"), "guess2": (F.col("n_chars") % 5 > 1).cast("int")}
    )


@query("confusion", f"""
WITH {LABEL_SQL} SELECT q::BIGINT AS actual, count(doc_id) FILTER (guess = 0)::BIGINT AS predicted_0, count(doc_id) FILTER (guess = 1)::BIGINT AS predicted_1
FROM (VALUES (0), (1)) v(q) LEFT JOIN lab ON quality = q GROUP BY 1""")
def _(spark, sf):
    return metrics.confusion(labelled(spark, sf), "quality", "guess")


@query("class_report", f"""
WITH {LABEL_SQL}, t AS (SELECT q, count(*) FILTER (quality = q AND guess = q) AS h, count(*) FILTER (quality = q) AS s, count(*) FILTER (guess = q) AS g, count(*) AS n FROM lab CROSS JOIN (VALUES (0), (1)) v(q) GROUP BY 1),
r AS (SELECT q, h, s, n, CASE WHEN g = 0 THEN 0 ELSE h / g END AS p, CASE WHEN s = 0 THEN 0 ELSE h / s END AS r FROM t), f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM r)
SELECT CASE WHEN q = 0 THEN 'No Error' ELSE 'Error' END AS label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s::BIGINT AS support FROM f
UNION ALL SELECT 'accuracy', round(sum(h) / max(n), 6), round(sum(h) / max(n), 6), round(sum(h) / max(n), 6), max(n)::BIGINT FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), max(n)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * s) / max(n), 6), round(sum(r * s) / max(n), 6), round(sum(f * s) / max(n), 6), max(n)::BIGINT FROM f""")
def _(spark, sf):
    return metrics.class_report(labelled(spark, sf), "quality", "guess")


OUTCOME = "CASE WHEN quality = 1 AND {g} = 1 THEN 'TP' WHEN {g} = 1 THEN 'FP' WHEN quality = 1 THEN 'FN' ELSE 'TN' END"
SYSTEM_SQL = f"""{LABEL_SQL}, o AS (SELECT 'first' AS system, doc_id % 50 AS paper_id, {OUTCOME.format(g='guess')} AS outcome FROM lab
 UNION ALL SELECT 'second', doc_id % 50, {OUTCOME.format(g='guess2')} FROM lab)"""


def _systems(spark, sf):
    def outcome(guess):
        hit, true = F.col(guess) == 1, F.col("quality") == 1
        return F.when(true & hit, "TP").when(hit, "FP").when(true, "FN").otherwise("TN")

    lab = labelled(spark, sf)
    return {
        name: lab.select((F.col("doc_id") % 50).alias("paper_id"), outcome(g).alias("outcome"))
        for name, g in (("first", "guess"), ("second", "guess2"))
    }


@query("system_compare", f"WITH {SYSTEM_SQL}, c AS (SELECT system, {COUNTS} FROM o GROUP BY 1) SELECT system, tp, fp, fn, {RATIOS} FROM c")
def _(spark, sf):
    return metrics.compare_systems(_systems(spark, sf))


@query("system_compare_papers", f"""
WITH {SYSTEM_SQL} SELECT paper_id, count(*) FILTER (system = 'first' AND outcome = 'TP') > 0 AS a_hit, count(*) FILTER (system = 'first' AND outcome IN ('TP', 'FP'))::BIGINT AS a_findings,
 count(*) FILTER (system = 'second' AND outcome = 'TP') > 0 AS b_hit, count(*) FILTER (system = 'second' AND outcome IN ('TP', 'FP'))::BIGINT AS b_findings FROM o GROUP BY 1""")
def _(spark, sf):
    s = _systems(spark, sf)
    return metrics.compare_papers(s["first"], s["second"])


# --- step cases ------------------------------------------------------------------------------


@query("first_error_step", f"WITH {STEPS_SQL} SELECT paper_id, predicted_label, n_steps FROM cs")
def _(spark, sf):
    return metrics.first_error_step(inputs.steps(spark, sf))


def step_results(spark, sf):
    # one pass: both labels come from the same turns
    s = inputs.steps(spark, sf)
    wrong = F.min(F.when(F.col("truly_wrong"), F.col("step_index")))
    guess = F.min(F.when(F.col("checkable") & F.col("is_error"), F.col("step_index")))
    return s.groupBy("paper_id").agg(
        F.coalesce(wrong, F.lit(-1)).alias("true_label"), F.coalesce(guess, F.lit(-1)).alias("predicted_label")
    )


@query("step_metrics", f"""
WITH {STEPS_SQL} SELECT count(*)::BIGINT AS total_cases, count(*) FILTER (true_label = predicted_label)::BIGINT AS correct_predictions,
 round(count(*) FILTER (true_label = predicted_label) / count(*), 6) AS accuracy, count(*) FILTER (true_label = predicted_label AND true_label >= 0)::BIGINT AS correct_with_error,
 count(*) FILTER (true_label = predicted_label AND true_label = -1)::BIGINT AS correct_all_correct, count(*) FILTER (true_label <> predicted_label AND true_label = -1)::BIGINT AS false_positives,
 count(*) FILTER (true_label <> predicted_label AND true_label >= 0)::BIGINT AS false_negatives, 'all' AS split_name FROM cs""")
def _(spark, sf):
    return metrics.step_metrics(step_results(spark, sf), "all")


@query("position_accuracy", f"WITH {STEPS_SQL} SELECT true_label, round(avg(CASE WHEN true_label = predicted_label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy, count(*)::BIGINT AS n_cases FROM cs GROUP BY 1")
def _(spark, sf):
    return metrics.position_accuracy(step_results(spark, sf))
