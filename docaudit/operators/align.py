"""One-to-one matching of predicted errors with annotated ones.

Predictions carry (paper_id, pred_idx, error_category, error_location), annotations
(paper_id, ann_idx, error_category, error_location, error_severity). Predictions are
served in order of pred_idx: each takes the best annotation still free (first by
ann_idx among equals) if that scores at least ``accept``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.constants import MATCH_ACCEPT, MATCH_CATEGORY_BONUS
from docaudit.functions.locations import location_score, match_key, with_location
from docaudit.operators.ranking import pages
from docaudit.operators.rounds import MOST_ROUNDS, in_rounds
from docaudit.session import stored
from docaudit.schemas import MATCHES


def with_bonus(base: Column, predicted: Column, annotated: Column) -> Column:
    """Location score plus the bonus for an equal category, at most 1."""
    same = F.coalesce(predicted == annotated, F.lit(False))
    return F.when(same, F.least(F.lit(1.0), base + MATCH_CATEGORY_BONUS)).otherwise(base)


def scored_locations(pairs: DataFrame) -> DataFrame:
    """(one, two, base): the score of each distinct pair of location texts, parsed and compared once."""
    texts = pairs.select(F.col("predicted_location").alias("one"), F.col("annotated_location").alias("two")).distinct()
    keyed = with_location(with_location(texts, "one", "_r1"), "two", "_r2")
    keyed = keyed.withColumns({"_k1": match_key(F.col("_r1")), "_k2": match_key(F.col("_r2"))})
    return stored(keyed.select("one", "two", location_score(F.col("_k1"), F.col("_k2")).alias("base")), "location-scores")


def candidate_scores(preds: DataFrame, anns: DataFrame, accept: float = MATCH_ACCEPT) -> DataFrame:
    """Scores of acceptable pairs of distinct (location, category) values per document.

    Rows with equal values score alike, so copies of a value, however many, are counted and not
    paired; and locations of many documents read alike, so their texts are scored once for all.
    """
    keys = ["paper_id", "error_location", "error_category"]

    def values(df: DataFrame, side: str, count: str) -> DataFrame:
        named = df.groupBy(*keys).agg(F.count("*").alias(count))
        return named.withColumnsRenamed({"error_location": f"{side}_location", "error_category": f"{side}_category"})

    pairs = values(preds, "predicted", "n_predictions").join(values(anns, "annotated", "n_annotations"), "paper_id")
    base = scored_locations(pairs)
    met = F.col("predicted_location").eqNullSafe(F.col("one")) & F.col("annotated_location").eqNullSafe(F.col("two"))
    scored = pairs.join(base, met).withColumn("score", with_bonus(F.col("base"), F.col("predicted_category"), F.col("annotated_category")))
    return scored.where(F.col("score") >= accept).select(
        "paper_id", "predicted_location", "predicted_category", "annotated_location", "annotated_category",
        "n_predictions", "n_annotations", "score",
    )


GROUND_TRUTH = {"error_category": "gt_category", "error_location": "gt_location", "error_severity": "gt_severity"}


def _value() -> Column:
    """A row's (location, category) as text; nulls stay apart from empty texts."""
    return F.to_json(F.struct("error_location", "error_category"), {"ignoreNullFields": "false"})


class _Document:
    """Serves one document: each prediction takes the first free annotation of its best value.

    Annotations of one value score alike, so a value is a queue; a prediction looks at the heads of the
    queues it may use, best score first, and among equal scores takes the least head.
    """

    def __init__(self) -> None:
        self.free: dict[str, deque[int]] = {}
        self.choices: dict[str, list[tuple[float, str]]] = {}

    def annotate(self, value: str, idx: int) -> None:
        self.free.setdefault(value, deque()).append(idx)

    def allow(self, value: str, other: str, score: float) -> None:
        self.choices.setdefault(value, []).append((-score, other))

    def serve(self, value: str) -> tuple[int, float] | None:
        listed = sorted(c for c in self.choices.get(value, ()) if self.free.get(c[1]))
        self.choices[value] = listed  # used up values never come back
        if not listed:
            return None
        best = min((other for score, other in listed if score == listed[0][0]), key=lambda other: self.free[other][0])
        return self.free[best].popleft(), -listed[0][0]


def _served(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of document, then annotations, choices, predictions; one document is held at a time."""
    paper, document = None, _Document()
    for b in batches:
        out = []
        for key, kind, idx, value, other, score in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != paper:
                paper, document = key, _Document()
            if kind == 0:
                document.annotate(value, idx)
            elif kind == 1:
                document.allow(value, other, score)
            elif found := document.serve(value):
                out.append((key, idx, *found))
        columns = [[r[i] for r in out] for i in range(4)]
        types = [b.schema.field("paper_id").type, pa.int64(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["paper_id", "pred_idx", "ann_idx", "score"])


AT_ONCE = 200_000  # rows of a document (annotations, value scores, predictions) that one task serves


def served_in_order(rows: DataFrame) -> DataFrame:
    """The matching of whole documents by a walk in order of pred_idx; a task holds one document's annotations and scores."""
    ordered = rows.repartition("paper_id").sortWithinPartitions("paper_id", "kind", "idx")
    kind = rows.schema["paper_id"].dataType.simpleString()
    return ordered.mapInArrow(_served, f"paper_id {kind}, pred_idx bigint, ann_idx bigint, score double")


def greedy_matches(preds: DataFrame, anns: DataFrame, accept: float = MATCH_ACCEPT, at_once: int = AT_ONCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """The greedy matching as (paper_id, pred_idx, ann_idx, score).

    Scores are computed once for each pair of distinct values of a document, by all tasks. A document
    with n annotations can match only its first n predictions of each value, since equal predictions
    have equal choices and the choices only shrink: predictions are cut to these before anything
    else, by a group limit that runs ahead of the shuffle. Documents of up to ``at_once`` rows are then served
    by a walk, a document a task; larger ones by all tasks in rounds (``rounds.in_rounds``), with equal results. What
    ``most_rounds`` rounds leave open is walked as well.
    """
    p = preds.select("paper_id", F.col("pred_idx").cast("bigint").alias("idx"), _value().alias("value"))
    a = anns.select("paper_id", F.col("ann_idx").cast("bigint").alias("idx"), _value().alias("value"))

    def named(location: str, category: str) -> Column:
        return F.to_json(F.struct(F.col(location).alias("error_location"), F.col(category).alias("error_category")), {"ignoreNullFields": "false"})

    scores = candidate_scores(preds, anns, accept).where(F.col("score") > 0)
    scores = scores.select("paper_id", named("predicted_location", "predicted_category").alias("value"), named("annotated_location", "annotated_category").alias("other"), "score")
    n_anns = anns.groupBy("paper_id").agg(F.count("*").alias("n_anns"))
    first = Window.partitionBy("paper_id", "value").orderBy("idx")
    cut = p.join(n_anns, "paper_id").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= F.col("n_anns"))
    no_score, no_text, no_idx = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("bigint")
    rows = (
        a.select("paper_id", F.lit(0).alias("kind"), "idx", "value", no_text.alias("other"), no_score.alias("score"))
        .unionByName(scores.select("paper_id", F.lit(1).alias("kind"), no_idx.alias("idx"), "value", "other", "score"))
        .unionByName(cut.select("paper_id", F.lit(2).alias("kind"), "idx", "value", no_text.alias("other"), no_score.alias("score")))
    )
    rows = stored(rows.where(F.col("paper_id").isNotNull()), "matching")
    large = stored(rows.groupBy("paper_id").agg(F.count("*").alias("n")).where(F.col("n") > at_once).select("paper_id"), "large-documents")
    if large.isEmpty():
        return served_in_order(rows)
    walked, rest = rows.join(large, "paper_id", "left_anti"), rows.join(large, "paper_id", "left_semi")
    sides = [rest.where(F.col("kind") == k).select("paper_id", *c) for k, c in ((2, ["idx", "value"]), (0, ["idx", "value"]), (1, ["value", "other", "score"]))]
    matched, open_ = in_rounds(*sides, most=most_rounds)
    if open_ is not None:
        walked = walked.unionByName(rows.join(open_, "paper_id", "left_semi"))
    return served_in_order(walked).unionByName(matched)


# What a row tells beside its place in the matching, where its side has it.
TOLD = ("confidence", "supporting_evidence", "verifier_name", "snippet_id")


def outcomes(preds: DataFrame, anns: DataFrame, matches: DataFrame) -> DataFrame:
    """Every prediction as TP or FP and every unmatched annotation as FN, with what each side tells.

    The matches are saved, since both sides read them and the walk through the documents is dear.
    """
    m = stored(matches.withColumns({c: F.col(c).cast("bigint") for c in ("pred_idx", "ann_idx")}), "matches")
    truth = dict(GROUND_TRUTH) | ({"error_annotation": "gt_annotation"} if "error_annotation" in anns.columns else {})
    gt = anns.select("paper_id", F.col("ann_idx").cast("bigint").alias("ann_idx"), *[F.col(column).alias(name) for column, name in truth.items()])
    told = [c for c in TOLD if c in preds.columns]
    p = preds.select(
        "paper_id", F.col("pred_idx").cast("bigint").alias("pred_idx"), "error_category", "error_location", *told
    ).join(m.join(gt, ["paper_id", "ann_idx"]), ["paper_id", "pred_idx"], "left")
    served = p.select(
        "paper_id",
        F.when(F.col("ann_idx").isNotNull(), "TP").otherwise("FP").alias("outcome"),
        "pred_idx", "ann_idx", "error_category", "error_location", *truth.values(),
        F.coalesce("score", F.lit(0.0)).alias("match_quality"),
        *told,
    )
    missed = gt.join(m.select("paper_id", "ann_idx"), ["paper_id", "ann_idx"], "left_anti").select(
        "paper_id",
        F.lit("FN").alias("outcome"),
        F.lit(None).cast("bigint").alias("pred_idx"),
        "ann_idx",
        F.lit("").alias("error_category"),
        F.lit("").alias("error_location"),
        *truth.values(),
        F.lit(1.0).alias("match_quality"),
        *[F.lit(None).cast(preds.schema[c].dataType).alias(c) for c in told],
    )
    return served.unionByName(missed)


def align(preds: DataFrame, anns: DataFrame, category: str | None = None, accept: float = MATCH_ACCEPT) -> DataFrame:
    """Outcomes of the fuzzy matching, optionally for one error category."""
    if category is not None:
        preds, anns = only_category(preds, category), only_category(anns, category)
    return outcomes(preds, anns, greedy_matches(preds, anns, accept))


def only_category(df: DataFrame, category: str) -> DataFrame:
    return df.where(F.col("error_category") == category)


def valid_pairs(raw: Column, n_annotations: Column, n_predictions: Column) -> Column:
    """A judge's pairs with both indices in range, as listed."""
    parsed = F.coalesce(F.from_json(raw, MATCHES), F.from_json(F.lit("[]"), MATCHES))
    pairs = F.transform(
        parsed,
        lambda m: F.struct(
            m["annotation_index"].try_cast("int").alias("ann_idx"),
            m["prediction_index"].try_cast("int").alias("pred_idx"),
            F.coalesce(m["reasoning"], F.lit("")).alias("reasoning"),
        ),
    )
    return F.filter(
        pairs,
        lambda m: m["ann_idx"].isNotNull() & m["pred_idx"].isNotNull()
        & (m["ann_idx"] >= 0) & (m["ann_idx"] < n_annotations)
        & (m["pred_idx"] >= 0) & (m["pred_idx"] < n_predictions),
    )


def first_wins(pairs: DataFrame, key: str, one: str, two: str, order: str) -> DataFrame:
    """The pairs that stay if, in ``order`` (different numbers within a key), each takes its two indices unless one is taken.

    In each round a pair that comes first among the open pairs of both its indices is taken, since nothing open can
    precede it, and the pairs that share an index with one taken are closed. Only open pairs enter the next
    round; a round is saved. No task holds the pairs of a document, and no list is searched: minima and joins only.
    """
    open_, won = stored(pairs, "pairs"), None
    while not open_.isEmpty():
        firsts = [open_.groupBy(key, i).agg(F.min(order).alias(order)).select(key, order) for i in (one, two)]
        taken = stored(open_.join(firsts[0], [key, order], "left_semi").join(firsts[1], [key, order], "left_semi"), "pairs")
        won = taken if won is None else won.unionByName(taken)
        for i in (one, two):
            open_ = open_.join(taken.select(key, i), [key, i], "left_anti")
        open_ = stored(open_.select(*pairs.columns), "pairs")
    return open_ if won is None else won


def judged_pairs(judged: DataFrame) -> DataFrame:
    """paper_id, ann_idx, pred_idx, reasoning of sanitized judge answers: columns paper_id, matches, n_annotations,
    n_predictions, one row per document. A document whose answer failed has null matches and gives no rows."""
    ok = judged.where(F.col("matches").isNotNull())
    each = ok.select("paper_id", F.posexplode_outer(valid_pairs(F.col("matches"), F.col("n_annotations"), F.col("n_predictions"))).alias("listed", "m"))
    pairs = each.where(F.col("m").isNotNull()).select("paper_id", "listed", "m.*")
    return first_wins(pairs, "paper_id", "ann_idx", "pred_idx", "listed").drop("listed")


def judged_matches(judged: DataFrame) -> DataFrame:
    """The pairs of sanitized judge answers as matches."""
    return judged_pairs(judged).select(
        "paper_id",
        F.col("pred_idx").cast("bigint").alias("pred_idx"),
        F.col("ann_idx").cast("bigint").alias("ann_idx"),
        F.lit(1.0).alias("score"),
    )


def align_judged(preds: DataFrame, anns: DataFrame, judged: DataFrame, accept: float = MATCH_ACCEPT) -> DataFrame:
    """Judge matches where the judge answered, fuzzy matching for the other documents."""
    answered = judged.where(F.col("matches").isNotNull()).select("paper_id")
    fuzzy = greedy_matches(
        preds.join(answered, "paper_id", "left_anti"), anns.join(answered, "paper_id", "left_anti"), accept
    )
    return outcomes(preds, anns, judged_matches(judged).unionByName(fuzzy))


def judge_payloads(preds: DataFrame, anns: DataFrame, size: int = 500) -> DataFrame:
    """What a judge reads, as JSON arrays per document and side, in pages of bounded length.

    Items carry their index in the document. A judge answers with these for any pair of pages; the
    answers of a document, put together, go through ``judged_pairs`` as one.
    """
    a = pages(
        anns, ["paper_id"], "ann_idx",
        F.struct(F.col("ann_idx").alias("idx"), F.col("error_location").alias("location"), F.col("error_annotation").alias("description")), "_l", size,
    )
    p = pages(
        preds, ["paper_id"], "pred_idx", F.struct(F.col("pred_idx").alias("idx"), "error_category", "error_location", "supporting_evidence"), "_l", size
    )
    sides = [
        side.select("paper_id", F.lit(name).alias("side"), "page", F.to_json("_l").alias("payload"))
        for name, side in (("annotations", a), ("predictions", p))
    ]
    return sides[0].unionByName(sides[1])
