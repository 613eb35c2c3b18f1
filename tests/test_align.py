"""Greedy matching against a brute-force walk."""

import random

import pytest
from pyspark.sql import functions as F

from docaudit.functions.locations import location_score, match_key, with_location
from docaudit.operators import align, metrics, rounds

GT = "paper_id string, ann_idx long, error_category string, error_location string, error_severity string"
PR = "paper_id string, pred_idx long, error_category string, error_location string"


def score_table(spark, locations):
    d = spark.createDataFrame([(a, b) for a in locations for b in locations], "a string, b string")
    d = with_location(with_location(d, "a", "ra"), "b", "rb")
    d = d.withColumns({"ka": match_key(F.col("ra")), "kb": match_key(F.col("rb"))})
    return {(r.a, r.b): r.s for r in d.select("a", "b", location_score(F.col("ka"), F.col("kb")).alias("s")).collect()}


def brute(preds, anns, scores):
    out, used = set(), set()
    for pid, i, cat, loc in sorted(preds, key=lambda p: (p[0], p[1])):
        best, best_j = 0.0, None
        for qid, j, gcat, gloc, _ in sorted(anns, key=lambda a: (a[0], a[1])):
            if qid != pid or (pid, j) in used:
                continue
            s = scores[(loc, gloc)]
            if cat == gcat:
                s = min(1.0, s + 0.25)
            if s > best:
                best, best_j = s, j
        if best >= 0.6:
            used.add((pid, best_j))
            out.add((pid, i, best_j, round(best, 9)))
    return out


@pytest.fixture(scope="module")
def crowd(spark):
    rng = random.Random(5)
    locs = [f"{k} {n}" for k in ("Lemma", "Figure", "Section") for n in ("1", "2,3", "7.1")] + ["Overall", "odd spot"]
    preds, anns = [], []
    for pid, np_, na in [("hot", 60, 40), ("few", 50, 5), ("a", 3, 4), ("b", 4, 1), ("c", 2, 0)]:
        preds += [(pid, i, rng.choice("xyz"), rng.choice(locs)) for i in range(np_)]
        anns += [(pid, j, rng.choice("xyz"), rng.choice(locs), "errata") for j in range(na)]
    anns += [("only_truth", 0, "x", "Lemma 1", "retract")]
    return preds, anns, brute(preds, anns, score_table(spark, locs))


def test_greedy_matches_walk(spark, crowd):
    preds, anns, expected = crowd
    p, a = spark.createDataFrame(preds, PR), spark.createDataFrame(anns, GT)
    got = {(r.paper_id, r.pred_idx, r.ann_idx, round(r.score, 9)) for r in align.greedy_matches(p, a).collect()}
    assert got == expected


@pytest.mark.parametrize(("at_once", "most"), [(0, 30), (0, 0), (0, 1), (60, 30)])
def test_rounds_match_walk(spark, crowd, at_once, most):
    """All documents in rounds; rounds given up at once or after one; only the large documents in rounds."""
    preds, anns, expected = crowd
    p, a = spark.createDataFrame(preds, PR), spark.createDataFrame(anns, GT)
    found = align.greedy_matches(p, a, at_once=at_once, most_rounds=most).collect()
    assert len(found) == len(expected)
    assert {(r.paper_id, r.pred_idx, r.ann_idx, round(r.score, 9)) for r in found} == expected


def walk(preds, anns, choices):
    """The meaning: predictions in order, each takes the best free annotation, the first among equals."""
    free, out = sorted(anns), []
    for p, value in sorted(preds):
        able = [(-choices[value, other], idx, other) for idx, other in free if (value, other) in choices]
        if able:
            score, idx, other = min(able)
            free.remove((idx, other))
            out.append((p, idx, -score))
    return out


def test_rounds_on_random_choices(spark):
    """Few scores, so ties abound; values of equal choices; a document with over a third of all rows."""
    rng = random.Random(8)
    preds, anns, choices, expected = [], [], [], set()
    for paper in range(25):
        size = 150 if paper == 7 else rng.randint(0, 25)
        values, others = [f"v{i}" for i in range(1 + size // 3)], [f"w{i}" for i in range(1 + size // 4)]
        some = {(v, w): rng.choice([0.6, 0.75, 0.75, 1.0]) for v in values for w in others if rng.random() < 0.5}
        for w in others:  # v0 and the last value choose alike
            some.pop((values[-1], w), None)
            if ("v0", w) in some:
                some[values[-1], w] = some["v0", w]
        own = [(i, rng.choice(values)) for i in rng.sample(range(1000), size)]
        truth = [(i, rng.choice(others)) for i in rng.sample(range(1000), rng.randint(0, size))]
        expected |= {(paper, *m) for m in walk(own, truth, some)}
        preds += [(paper, *r) for r in own]
        anns += [(paper, *r) for r in truth]
        choices += [(paper, v, w, s) for (v, w), s in some.items()]
    sides = [spark.createDataFrame(r, s).repartition(4) for r, s in ((preds, "paper_id int, idx long, value string"), (anns, "paper_id int, idx long, value string"), (choices, "paper_id int, value string, other string, score double"))]
    matched, open_ = rounds.in_rounds(*sides)
    assert open_ is None
    assert sorted(map(tuple, matched.collect())) == sorted(expected)


def test_one_class_needs_one_round(spark):
    """Any number of predictions of equal choices make all their offers at once."""
    n = 100_000
    preds = spark.range(n).selectExpr("1 AS paper_id", "id AS idx", "concat('v', id % 3) AS value")
    anns = spark.range(n // 2).selectExpr("1 AS paper_id", "id AS idx", "concat('w', id % 2) AS value")
    choices = spark.createDataFrame([(1, f"v{i}", f"w{j}", 0.8) for i in range(3) for j in range(2)], "paper_id int, value string, other string, score double")
    matched, open_ = rounds.in_rounds(preds, anns, choices, most=0)
    assert open_ is None
    assert matched.where("pred_idx = ann_idx").count() == matched.count() == n // 2


def test_metric_identities(spark, crowd):
    preds, anns, expected = crowd
    out = align.align(spark.createDataFrame(preds, PR), spark.createDataFrame(anns, GT))
    m = metrics.overall(out).first()
    assert m.tp == len(expected)
    assert m.tp + m.fp == len(preds) and m.tp + m.fn == len(anns)
    b = {(r.dimension, r.category): r for r in metrics.breakdown(out).collect()}
    for dim in ("error_category", "error_severity", "paper_category"):
        assert sum(r.tp for (d, _), r in b.items() if d == dim) == m.tp
    assert b[("overall", "all")].f1 == pytest.approx(m.f1)


def test_two_papers(spark):
    p = [("paper1", 0, "Equation / proof", "Lemma 3"), ("paper2", 0, "Figure duplication", "Fig 5")]
    a = [("paper1", 0, "Equation / proof", "Lemma 3,4", "retract"), ("paper2", 0, "Figure duplication", "Fig 5", "errata")]
    m = metrics.overall(align.align(spark.createDataFrame(p, PR), spark.createDataFrame(a, GT))).first()
    assert (m.tp, m.fp, m.fn, m.precision, m.recall) == (2, 0, 0, 1.0, 1.0) and m.f1 == pytest.approx(1.0)


def test_no_predictions_or_no_truth(spark):
    p, a = spark.createDataFrame([], PR), spark.createDataFrame([("p", 0, "x", "Lemma 1", "errata")], GT)
    assert [r.outcome for r in align.align(p, a).collect()] == ["FN"]
    p, a = spark.createDataFrame([("p", 0, "x", "Lemma 1")], PR), spark.createDataFrame([], GT)
    assert [r.outcome for r in align.align(p, a).collect()] == ["FP"]
    m = metrics.overall(align.align(p, a)).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)


def test_category_filter_and_confusion(spark):
    p = spark.createDataFrame([("p", 0, "x", "Lemma 1"), ("p", 1, "y", "Lemma 2")], PR)
    a = spark.createDataFrame([("p", 0, "x", "Lemma 1", "errata"), ("q", 0, "y", "Fig 1", "errata")], GT)
    assert [(r.outcome, r.paper_id) for r in align.align(p, a, category="x").collect()] == [("TP", "p")]
    labels = metrics.aligned_labels(align.align(p, a))
    cm = {r.actual: (r.predicted_0, r.predicted_1) for r in metrics.confusion(labels, "truth", "guess").collect()}
    assert cm == {0: (0, 1), 1: (1, 1)}


def test_judge_answers(spark):
    raw = '[{"annotation_index": 0, "prediction_index": 1, "reasoning": "same"}, {"annotation_index": 0, "prediction_index": 0},' \
        ' {"annotation_index": 9, "prediction_index": 0}, {"annotation_index": "1", "prediction_index": 1}, {"annotation_index": 1, "prediction_index": 0}, {"x": 1}]'
    j = spark.createDataFrame([("p", raw, 2, 2), ("bad", None, 1, 1), ("odd", "{}", 1, 1)], "paper_id string, matches string, n_annotations int, n_predictions int")
    got = {(r.paper_id, r.pred_idx, r.ann_idx) for r in align.judged_matches(j).collect()}
    assert got == {("p", 1, 0), ("p", 0, 1)}


def test_documents_are_walked_once(spark):
    from docaudit.operators import align

    walks = spark.sparkContext.accumulator(0)
    preds = spark.createDataFrame([(1, i, "A", "Lemma 1") for i in range(3)], "paper_id long, pred_idx long, error_category string, error_location string")
    anns = spark.createDataFrame([(1, i, "A", "Lemma 1", "errata") for i in range(5)], "paper_id long, ann_idx long, error_category string, error_location string, error_severity string")

    def counted(batches):
        for b in batches:
            walks.add(b.num_rows)
            yield b

    matches = align.greedy_matches(preds, anns)
    rows = align.outcomes(preds, anns, matches.mapInArrow(counted, matches.schema)).collect()
    assert sorted(r.outcome for r in rows) == ["FN", "FN", "TP", "TP", "TP"]
    assert walks.value == 3
