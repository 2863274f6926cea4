"""Keys that hold very many rows, found without a shuffle of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.runtime import maybe_broadcast, small_enough, stage

#: Rows of a key within one batch of ``_ROWS`` keys from which the batch reports it.
LOCAL = 16
_ROWS = 1 << 20


def heavy_keys(df: DataFrame, column: str, least: int, local: int | None = None) -> DataFrame:
    """``key, n``: values of a bigint column (or of the elements of an array<bigint> column) of which more than ``least`` rows were counted.

    Each task counts its own keys in batches of a million and reports those with ``local`` rows or more; the reports are
    added up. So only heavy keys are shuffled, and at most rows / least come out. A key that is missed has under ``local``
    rows in most batches, which no task feels: counts are lower bounds. Nulls are skipped; an empty table gives no keys.
    """
    local = min(LOCAL if local is None else local, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def report() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key[n >= local]), pa.array(n[n >= local])], ["key", "n"])

        for b in batches:
            c = b.column(0)
            c = (c.flatten() if pa.types.is_list(c.type) else c).drop_null()
            held.append(c.to_numpy(zero_copy_only=False).astype(np.int64))
            size += len(c)
            if size >= _ROWS:
                yield report()
                size = 0
        if held:
            yield report()

    counted = df.select(column).mapInArrow(run, "key long, n long")
    return stage(counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > least), "heavy")


def split_join(rows: DataFrame, side: DataFrame, key: str, heavy: int) -> DataFrame:
    """Inner join on one bigint or int column, in which keys of very many ``rows`` are found beforehand and joined by broadcast of their rows of ``side``.

    ``rows`` is read twice. The broadcast is bounded by rows and bytes; beyond that these keys are shuffled as well.
    """
    hot = heavy_keys(rows.select(F.col(key).cast("long").alias(key)), key, heavy)
    if small_enough(hot, 0):
        return rows.join(side, key)
    names = stage(hot.select(F.col("key").cast(rows.schema[key].dataType).alias(key)), "hot")
    warm = side.join(maybe_broadcast(names), key, "left_semi")
    both = rows.join(maybe_broadcast(names), key, "left_anti").join(side, key)
    return both.unionByName(rows.join(maybe_broadcast(names), key, "left_semi").join(maybe_broadcast(warm), key))
