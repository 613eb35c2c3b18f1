"""Scans of corpora, predictions, step cases and saved reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.constants import REPORT_SKIP_FILES, STEP_SPLITS
from docaudit.schemas import CORPUS_FILE, PREDICTIONS, REPORTS, STEP_CASES
from docaudit.sources.arrays import scan_arrays


def scan_corpus(spark: SparkSession, path: str, schema: str = CORPUS_FILE) -> DataFrame:
    """One row per annotation. The declared schema spares the footer read and lets Catalyst
    prune nested fields such as ``image_url``; columns that a file lacks are null. The id may
    stand under either of its names."""
    df = spark.read.schema(schema).parquet(path)
    if "doi/arxiv_id" not in df.columns:
        return df
    named = F.col("`doi/arxiv_id`")
    paper_id = F.coalesce(F.col("paper_id"), named) if "paper_id" in df.columns else named
    return df.select(paper_id.alias("paper_id"), *[c for c in df.columns if c not in ("paper_id", "doi/arxiv_id")])


def scan_predictions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Saved paper predictions: one JSON array per file, of any length, or JSON lines."""
    return spark.read.schema(PREDICTIONS).json(path) if lines else scan_arrays(spark, path, PREDICTIONS)


def scan_cases(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Step cases of one split (partition column or data column ``split``)."""
    known = [name for name, *_ in STEP_SPLITS]
    if split is not None and split not in known:
        raise ValueError(f"unknown split {split!r}; use one of {known}")
    df = spark.read.schema(STEP_CASES).parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """Saved per-paper reports of a folder, matched by the id inside the file.

    Run-level files are skipped by name; of several reports for one id the one with
    the last file name stays. ``max_by`` aggregates before the shuffle, no sort needed.
    """
    files = spark.read.schema(REPORTS).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    name = F.col("_metadata.file_name")
    named = files.select("*", name.alias("file_name")).where(
        (name.like("%report%") | name.like("verification%"))
        & name.like("%.json")
        & ~name.isin(REPORT_SKIP_FILES)
        & F.col("paper_id").isNotNull()
        & (F.col("paper_id") != "")
    )
    body = F.struct(*[c for c in named.columns if c != "paper_id"])
    return (
        named.groupBy("paper_id").agg(F.max_by(body, "file_name").alias("r")).select("paper_id", "r.*")
    )
