"""Writers. Each one is a single distributed write; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    metrics.write.mode(mode).json(path)


def write_predictions(predictions: DataFrame, path: str, run: str, mode: str = "overwrite", format: str = "json") -> None:
    """Predictions (or aligned rows) under ``path/run=<run>``."""
    predictions.write.mode(mode).format(format).save(f"{path.rstrip('/')}/run={run}")


def write_confusion(matrix: DataFrame, path: str, mode: str = "overwrite") -> None:
    matrix.write.mode(mode).option("header", True).csv(path)


def write_step_results(results: DataFrame, metrics: DataFrame, path: str, split: str, mode: str = "overwrite") -> None:
    base = f"{path.rstrip('/')}/split={split}"
    results.write.mode(mode).json(f"{base}/results")
    metrics.write.mode(mode).json(f"{base}/metrics")


def write_images(images: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Decoded image bytes as a binary column; millions of small files would not scale."""
    images.select(
        "paper_id", "image_idx", "caption", F.expr("try_to_binary(base64_data, 'base64')").alias("image")
    ).write.mode(mode).parquet(path)
