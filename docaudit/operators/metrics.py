"""Precision, recall and F1, whole and by dimension; step-case accuracy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.constants import STEP_SPLITS



def _counts() -> list[Column]:
    return [
        F.count_if(F.col("outcome") == "TP").alias("tp"),
        F.count_if(F.col("outcome") == "FP").alias("fp"),
        F.count_if(F.col("outcome") == "FN").alias("fn"),
    ]


def _ratios(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    one = F.lit(1)
    df = df.withColumns(
        {"precision": tp / F.greatest(one, tp + fp), "recall": tp / F.greatest(one, tp + fn)}
    )
    p, r = F.col("precision"), F.col("recall")
    return df.withColumns(
        {"f1": 2 * p * r / F.greatest(F.lit(1e-9), p + r), "accuracy": tp / F.greatest(one, tp + fp + fn)}
    )


def overall(aligned: DataFrame) -> DataFrame:
    return _ratios(aligned.agg(*_counts())).withColumn("tn", F.lit(0).cast("bigint"))


def paper_categories(annotations: DataFrame) -> DataFrame:
    """One category per document: that of its last annotation row."""
    return annotations.groupBy("paper_id").agg(F.max_by("paper_category", "ann_idx").alias("paper_category"))


def breakdown(aligned: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Metrics by error category, severity and document category, and overall, in one pass."""
    if categories is not None:
        aligned = aligned.join(categories, "paper_id", "left")
    elif "paper_category" not in aligned.columns:
        aligned = aligned.withColumn("paper_category", F.lit(None).cast("string"))

    def filled(*cols: Column) -> Column:
        return F.coalesce(*[F.when(c != "", c) for c in cols], F.lit("Unknown"))

    keyed = aligned.select(
        "outcome",
        filled(F.col("gt_category"), F.col("error_category")).alias("error_category"),
        filled(F.col("gt_severity")).alias("error_severity"),
        F.coalesce("paper_category", F.lit("Unknown")).alias("paper_category"),
    )
    dims = ["error_category", "error_severity", "paper_category"]
    grouped = keyed.groupingSets([["error_category"], ["error_severity"], ["paper_category"], []], *dims).agg(
        *_counts(), F.grouping_id(*dims).alias("_g")
    )
    named = grouped.select(
        F.when(F.col("_g") == 3, "error_category")
        .when(F.col("_g") == 5, "error_severity")
        .when(F.col("_g") == 6, "paper_category")
        .otherwise("overall")
        .alias("dimension"),
        F.coalesce(*dims, F.lit("all")).alias("category"),
        "tp", "fp", "fn",
    )
    return _ratios(named).withColumn("support", F.col("tp") + F.col("fn"))


def confusion(labelled: DataFrame, truth: str, guess: str) -> DataFrame:
    """2x2 counts of binary labels, with zeros for absent cells."""
    t, g = F.col(truth), F.col(guess)
    cells = labelled.agg(*[F.count_if((t == i) & (g == j)).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)])
    return cells.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("actual"), F.col(f"c{i}0").alias("predicted_0"), F.col(f"c{i}1").alias("predicted_1"))
                    for i in (0, 1)
                ]
            )
        )
    )


def aligned_labels(aligned: DataFrame) -> DataFrame:
    """Binary labels of aligned rows: is there a true error, was one predicted."""
    return aligned.select(
        F.coalesce(F.col("gt_category") != "", F.lit(False)).cast("int").alias("truth"),
        F.coalesce(F.col("error_category") != "", F.lit(False)).cast("int").alias("guess"),
    )


def class_report(labelled: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted rows.

    Empty if the truth holds a single class.
    """
    t, g = F.col(truth), F.col(guess)
    names = ["No Error", "Error"]
    counts = labelled.agg(
        *[F.count_if((t == i) & (g == i)).alias(f"hit{i}") for i in (0, 1)],
        *[F.count_if(t == i).alias(f"true{i}") for i in (0, 1)],
        *[F.count_if(g == i).alias(f"said{i}") for i in (0, 1)],
    ).where((F.col("true0") > 0) & (F.col("true1") > 0))
    cols = {}
    for i in (0, 1):
        hit = F.col(f"hit{i}")
        cols[f"p{i}"] = F.coalesce(F.try_divide(hit, f"said{i}"), F.lit(0.0))
        cols[f"r{i}"] = F.coalesce(F.try_divide(hit, f"true{i}"), F.lit(0.0))
    counts = counts.withColumns(cols)
    counts = counts.withColumns(
        {
            f"f{i}": F.coalesce(
                F.try_divide(2 * F.col(f"p{i}") * F.col(f"r{i}"), F.col(f"p{i}") + F.col(f"r{i}")), F.lit(0.0)
            )
            for i in (0, 1)
        }
    )
    n = F.col("true0") + F.col("true1")

    def row(label: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support")
        )

    def both(stat: str, weighted: bool) -> Column:
        a, b = F.col(f"{stat}0"), F.col(f"{stat}1")
        return (a * F.col("true0") + b * F.col("true1")) / n if weighted else (a + b) / 2

    acc = (F.col("hit0") + F.col("hit1")) / n
    rows = [row(names[i], F.col(f"p{i}"), F.col(f"r{i}"), F.col(f"f{i}"), F.col(f"true{i}")) for i in (0, 1)]
    rows.append(row("accuracy", acc, acc, acc, n))
    rows += [row(name, both("p", w), both("r", w), both("f", w), n) for name, w in (("macro avg", False), ("weighted avg", True))]
    return counts.select(F.inline(F.array(*rows)))


def dataset_totals(aligned: DataFrame, annotations: DataFrame) -> DataFrame:
    """Documents and annotations of the truth, predictions, aligned rows and matches."""
    a = aligned.agg(
        F.count("*").alias("n_aligned"),
        F.count_if(F.col("outcome").isin("TP", "FP")).alias("n_predictions"),
        F.count_if(F.col("outcome") == "TP").alias("n_matched"),
    )
    g = annotations.groupBy("paper_id").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("n_papers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_annotations")
    )
    # two single rows side by side
    return g.withColumn("_k", F.lit(1)).join(a.withColumn("_k", F.lit(1)), "_k").drop("_k")


def per_paper(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("paper_id").agg(*_counts())


def worst(metrics: DataFrame, k: int = 5) -> DataFrame:
    """The k lowest F1 values over error category and severity."""
    rows = metrics.where(F.col("dimension").isin("error_category", "error_severity"))
    return rows.orderBy("f1", "dimension", "category").limit(k)


def compare_systems(systems: dict[str, DataFrame]) -> DataFrame:
    """Metrics per system, from outcomes tagged with its name."""
    return _ratios(_tagged(systems).groupBy("system").agg(*_counts()))


def compare_papers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per document: was an annotated error hit, and how many findings, by either system.

    A union and one aggregation, not a full outer join: each side reduces first.
    """
    both = _tagged({"a": a, "b": b})
    aggs = []
    for s in ("a", "b"):
        mine = F.col("system") == s
        aggs += [
            (F.count_if(mine & (F.col("outcome") == "TP")) > 0).alias(f"{s}_hit"),
            F.count_if(mine & F.col("outcome").isin("TP", "FP")).alias(f"{s}_findings"),
        ]
    return both.groupBy("paper_id").agg(*aggs)


def _tagged(systems: dict[str, DataFrame]) -> DataFrame:
    parts = [df.select("paper_id", "outcome", F.lit(name).alias("system")) for name, df in systems.items()]
    return reduce(DataFrame.unionByName, parts)


def matched_papers(aligned: DataFrame) -> DataFrame:
    return aligned.where(F.col("outcome") == "TP").select("paper_id").distinct()


def micro_macro(aligned: DataFrame) -> DataFrame:
    """Micro: ratio of sums. Macro: mean of the documents' own ratios, where defined.
    PPR: share of documents with at least one prediction."""
    p = per_paper(aligned)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return p.agg(
        (F.sum("tp") / F.greatest(F.lit(1), F.sum(tp + fp))).alias("precision_micro"),
        (F.sum("tp") / F.greatest(F.lit(1), F.sum(tp + fn))).alias("recall_micro"),
        F.avg(F.try_divide(tp, tp + fp)).alias("precision_macro"),
        F.avg(F.try_divide(tp, tp + fn)).alias("recall_macro"),
        F.avg(F.when(tp + fp > 0, 1.0).otherwise(0.0)).alias("ppr"),
    )


# --- step cases ------------------------------------------------------------------------


def first_error_step(steps: DataFrame, case: str = "paper_id") -> DataFrame:
    """Predicted label per case: first step with an error, -1 without one.

    Steps without math are skipped; cases without checkable steps are kept.
    """
    return steps.groupBy(case).agg(
        F.coalesce(F.min(F.when(F.col("checkable") & F.col("is_error"), F.col("step_index"))), F.lit(-1))
        .cast("bigint")
        .alias("predicted_label"),
        F.count("*").alias("n_steps"),
    )


def step_metrics(results: DataFrame, split: str = "") -> DataFrame:
    """Columns in: true_label, predicted_label. Zeros for an empty split."""
    ok = F.col("true_label") == F.col("predicted_label")
    bad = F.col("true_label") >= 0
    return results.agg(
        F.count("*").alias("total_cases"),
        F.count_if(ok).alias("correct_predictions"),
        F.coalesce(F.try_divide(F.count_if(ok), F.count("*")), F.lit(0.0)).alias("accuracy"),
        F.count_if(ok & bad).alias("correct_with_error"),
        F.count_if(ok & (F.col("true_label") == -1)).alias("correct_all_correct"),
        F.count_if(~ok & (F.col("true_label") == -1)).alias("false_positives"),
        F.count_if(~ok & bad).alias("false_negatives"),
    ).withColumn("split_name", F.lit(split))


def position_accuracy(results: DataFrame) -> DataFrame:
    ok = (F.col("true_label") == F.col("predicted_label")).cast("double")
    return results.groupBy("true_label").agg(F.avg(ok).alias("accuracy"), F.count("*").alias("n_cases"))


def describe_split(split: str) -> dict:
    """Name, difficulty and published size of a step-case split; empty if unknown."""
    for key, name, difficulty, n in STEP_SPLITS:
        if key == split:
            return {"name": name, "difficulty": difficulty, "n_cases": n}
    return {}
