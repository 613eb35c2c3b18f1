"""Exact positions within groups, also where one group holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.session import stored


def position(df: DataFrame, keys: list[str], order: list[Column], name: str, drop: Sequence[str] = ()) -> DataFrame:
    """Add the 0-based position of each row in its group under ``order`` (a total order,
    written ascending: negate a number for descending). Columns named in ``drop`` serve the order only.

    Rows are dealt out in ranges of (keys, order), sorted there and saved with their place in their group's
    part of the range, so the input is computed and shuffled once. Of a range, only the first group can
    have begun in earlier ones; what it has there is added from a table of a row a range. No task
    sees more of a group than one range.
    """
    kept = [c for c in df.columns if c not in drop]
    by = [*map(F.col, keys), *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).select(*kept)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = stored(rows.mapInArrow(_placed(keys), f"{types}, _place bigint, _first int, _end int"), "ranges")
    opened = rows.where(F.col("_first").isNotNull() & (F.col("_place") == 0)).select(*keys, F.col("_first").alias("_p"), F.lit(None).cast("bigint").alias("_n"))
    closed = rows.where(F.col("_end").isNotNull()).select(*keys, F.col("_end").alias("_p"), (F.col("_place") + 1).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rangeBetween(Window.unboundedPreceding, -1)
    before = opened.unionByName(closed).withColumn("_before", F.sum("_n").over(earlier)).where(F.col("_n").isNull() & (F.col("_before") > 0))
    placed = rows.join(F.broadcast(before.select("_p", "_before")), F.col("_first") == F.col("_p"), "left")
    return placed.select(*kept, (F.col("_place") + F.coalesce("_before", F.lit(0))).alias(name))


def _placed(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to sorted rows: _place in the run of equal keys, _first, the number of the range in its first run, and
    _end, the same in its last row."""

    def told(b: pa.RecordBatch, place: np.ndarray, first: np.ndarray, piece: int, last: bool) -> pa.RecordBatch:
        end = np.zeros(b.num_rows, bool)
        end[-1] = last
        numbers = np.full(b.num_rows, piece, np.int32)
        added = [pa.array(place), pa.array(numbers, mask=~first), pa.array(numbers, mask=~end)]
        return pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, "_place", "_first", "_end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held, seen, runs = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for k in keys:
                values = b.column(k) if held is None else pa.concat_arrays([held[0].column(k).slice(held[0].num_rows - 1), b.column(k)])
                other = np.diff(values.dictionary_encode("encode").indices.to_numpy()) != 0
                new[len(new) - len(other) :] |= other
            if held is not None:
                yield told(*held, piece, False)
            at = np.arange(b.num_rows)
            place = at - np.maximum.accumulate(np.where(new, at, -seen))
            held = b, place, runs + np.cumsum(new) == 0
            seen, runs = int(place[-1]) + 1, runs + int(new.sum())
        if held is not None:
            yield told(*held, piece, True)

    return run


def pages(df: DataFrame, keys: list[str], index: str, item: Column, name: str, size: int = 1000) -> DataFrame:
    """Lists per group, cut into pages of ``size`` by the row's own index.

    A group of up to ``size`` rows gives one row; a larger one gives several, so no
    row and no task has to hold an unbounded list.
    """
    return (
        df.withColumn("page", F.floor(F.col(index) / size).cast("bigint"))
        .groupBy(*keys, "page")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("_i"), item.alias("_v")))).alias(name))
        .withColumn(name, F.transform(name, lambda x: x["_v"]))
    )
