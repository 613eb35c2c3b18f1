"""Greedy matching of large documents in rounds, all classes of predictions at once.

Serving predictions in order, each taking the best annotation still free, is the one stable matching in which
every annotation prefers the earliest prediction. Offers reach it in any order: all predictions offer at
once, an annotation keeps its earliest offer, and who is turned down offers further down its list.

Predictions of one class, which have the same choices, end at rising places of their common list, so a class
makes all its offers in one walk along that list beside its predictions.
"""

from __future__ import annotations

import logging
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.session import stored

LOG = logging.getLogger(__name__)
CLASS = ["paper_id", "one", "two"]
MOST_ROUNDS = 30


def classes(choices: DataFrame) -> DataFrame:
    """(paper_id, value, one, two): two 64-bit hashes of the set of a value's choices, whose order does not matter."""
    return choices.groupBy("paper_id", "value").agg(
        F.bit_xor(F.xxhash64("other", "score")).alias("one"), F.bit_xor(F.xxhash64("score", "other", F.lit(1))).alias("two")
    )


def _offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of class, then its predictions, then its list; only the numbers of one class's predictions are held."""
    key, waiting, at = None, array("q"), 0
    for b in batches:
        out = []
        for paper, one, two, kind, idx, score, bar in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (paper, one, two) != key:
                key, waiting, at = (paper, one, two), array("q"), 0
            if kind == 0:
                waiting.append(idx)
            elif at < len(waiting) and (bar is None or bar >= waiting[at]):
                out.append((*key, waiting[at], idx, score))
                at += 1
        columns = [[r[i] for r in out] for i in range(6)]
        types = [b.schema.field("paper_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*CLASS, "pred_idx", "ann_idx", "score"])


def offers(predictions: DataFrame, listed: DataFrame) -> DataFrame:
    """Each prediction's offer: along the list of its class, the k-th prediction takes the first place after the
    one before it whose bar (the earliest offer made to that annotation) it does not exceed."""
    rows = predictions.select(*CLASS, F.lit(0).alias("kind"), "idx", F.lit(None).cast("double").alias("score"), F.lit(None).cast("bigint").alias("bar"))
    rows = rows.unionByName(listed.select(*CLASS, F.lit(1).alias("kind"), "idx", "score", "bar"))
    ordered = rows.repartition(*CLASS).sortWithinPartitions(*CLASS, "kind", F.desc("score"), "idx")
    kind = predictions.schema["paper_id"].dataType.simpleString()
    return ordered.mapInArrow(_offers, f"paper_id {kind}, one bigint, two bigint, pred_idx bigint, ann_idx bigint, score double")


def in_rounds(predictions: DataFrame, annotations: DataFrame, choices: DataFrame, most: int = MOST_ROUNDS) -> tuple[DataFrame, DataFrame | None]:
    """The matching as (paper_id, pred_idx, ann_idx, score), and the documents not settled after ``most`` rounds, if any.

    predictions and annotations: paper_id, idx (its own number in the document), value; choices: paper_id, value,
    other, score. Only classes with an offer turned down offer again; each round's offers are saved. A document
    may need as many rounds as it has classes, where each is turned down by the one before; the
    second table names such documents, and the first leaves them out.
    """
    of = stored(classes(choices), "classes")
    predictions = stored(predictions.join(of, ["paper_id", "value"]).select(*CLASS, "idx"), "predictions")
    lists = choices.join(of, ["paper_id", "value"]).select(*CLASS, "other", "score").distinct()
    named = annotations.withColumnRenamed("value", "other")
    lists = stored(lists.join(named, ["paper_id", "other"]).select(*CLASS, "idx", "score"), "lists")
    made = stored(offers(predictions, lists.withColumn("bar", F.lit(None).cast("bigint"))), "offers")
    for done in range(most + 1):
        bars = made.groupBy("paper_id", "ann_idx").agg(F.min("pred_idx").alias("bar"))
        down = made.join(bars, ["paper_id", "ann_idx"]).where(F.col("pred_idx") > F.col("bar"))
        down = stored(down.select(*CLASS).distinct(), "turned-down")
        matched = made.select("paper_id", "pred_idx", "ann_idx", "score")
        if down.isEmpty():
            LOG.info("matching settled after %d rounds", done + 1)
            return matched, None
        if done == most:
            open_ = stored(down.select("paper_id").distinct(), "open")
            LOG.info("matching of some documents open after %d rounds", done + 1)
            return matched.join(open_, "paper_id", "left_anti"), open_
        barred = lists.join(down, CLASS, "left_semi").join(bars.withColumnRenamed("ann_idx", "idx"), ["paper_id", "idx"], "left")
        again = offers(predictions.join(down, CLASS, "left_semi"), barred)
        made = stored(made.join(down, CLASS, "left_anti").select(*again.columns).unionByName(again), "offers")
