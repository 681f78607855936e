"""Streaming over rows that a shuffle has put together by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_blocks(df: DataFrame, blocks: Column, by: str) -> DataFrame:
    """Deal a group over ``blocks`` blocks and send each row to every pair of blocks it is in.

    Adds ``lo``, ``hi`` (the pair of blocks) and ``block`` (the row's own).  A
    group of n rows in b blocks becomes b * n rows, in b * (b + 1) / 2 tasks'
    worth of groups that each hold two blocks at most.
    """
    df = df.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64(by, F.lit(17)), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return df.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups of rows sorted by their first ``keys`` integer columns.

    Yields (rows, bounds); group i is rows[bounds[i]:bounds[i + 1]].  Only a
    group that runs over the end of an Arrow batch is held back for the next.
    """
    held: list[pa.RecordBatch] = []

    def bounds_of(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, dtype=bool)
        for i in range(keys):
            x = batch.column(i).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        return np.concatenate(([0], np.flatnonzero(new), [batch.num_rows]))

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.concat_batches(parts)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[-1].column(i)[-1].as_py() == batch.column(i)[0].as_py() for i in range(keys)):
            first = bounds_of(batch)[1]
            held.append(batch.slice(0, first))
            batch = batch.slice(first)
            if not batch.num_rows:
                continue
        if held:
            whole = joined(held)
            yield whole, np.array([0, whole.num_rows])
            held = []
        at = bounds_of(batch)
        if at[-2] > 0:
            yield batch.slice(0, at[-2]), at[:-1]
        held = [batch.slice(at[-2])]
    if held:
        whole = joined(held)
        yield whole, np.array([0, whole.num_rows])
