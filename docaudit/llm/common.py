"""Shared tables, vectorised word hashes and frequent-key tables of the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.session import ensure_checkpoint_dir

SLICE_BYTES = 4 << 20  # text that a task turns into word arrays at a time

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared checkpoint folder and read back: short lineage, computed once."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def text_key(text: Column) -> Column:
    """Two hashes of a text: rows with equal texts share their hits."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * K1
    x = (x ^ (x >> np.uint64(29))) * K2
    return x ^ (x >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray, salt: np.uint64 = K3) -> np.ndarray:
    """Hash of two hashes, in order."""
    return mix(a * K1 + b * K2 + salt)


def slices(texts: pa.Array, size: int = SLICE_BYTES):
    """Ranges of rows with about ``size`` bytes of text each, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + size, "right")))
        yield begin, end
        begin = end


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after another, and the offset of each row."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array, blank: np.ndarray = BLANKS, to: np.ndarray | None = None, head: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all rows, and how many words each row has.

    A word is a run of bytes that are not ``blank``; ``to`` maps bytes first (lower case), and
    only the first ``head`` bytes of a word count, if given.
    Nulls have no words. Eight bytes of all words are taken in per step, so the work is numpy's.
    """
    data, offsets = raw(texts)
    if to is not None:
        data = to[data]
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~blank[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    counts = np.diff(np.searchsorted(starts, offsets))
    view = np.ndarray((n + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    length = ends - starts if head is None else np.minimum(ends - starts, head)
    out = mix(length.astype(np.uint64) + K3)
    live, at = np.arange(len(starts)), 0
    while len(live):
        left = np.minimum(length[live] - at, 8)
        out[live] = pair(out[live], mix(view[starts[live] + at] & KEEP[left]))
        at += 8
        live = live[length[live] > at]
    return out, counts


def spanned(x: np.ndarray, n: int, salt: np.uint64 = K3) -> np.ndarray:
    """Hash of each ``n`` consecutive values, by doubling: about log2(n) passes."""
    if len(x) < n:
        return np.zeros(0, np.uint64)
    size = 1
    while size * 2 <= n:
        x = pair(x[: len(x) - size], x[size:], salt)
        size *= 2
    return pair(x[: len(x) - (n - size)], x[n - size :], salt) if size < n else x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def frequent(local: DataFrame, total: str = "total", share: int = 20_000) -> DataFrame:
    """Keys that may hold more than 1/``share`` of all occurrences.

    ``local`` has, per task, each (kind, key) with at least a ``share``-th of that task's
    occurrences: n of them, of ``total`` in the task. Summing those n never exceeds the true count,
    so at most 2 * share keys per kind can reach half of the limit, and a key left out holds
    less than 1.5 / share of everything. The result is thus small enough to broadcast at any size.
    """
    sums = local.filter("key is not null").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    all_rows = local.filter("key is null").groupBy("kind").agg(F.sum(total).alias("all_n"))
    return sums.join(all_rows, "kind").filter(F.col("n") * (2 * share) >= F.col("all_n")).select("kind", "key")
