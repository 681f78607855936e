"""Connected components by alternating large and small stars, in DataFrames.

Each round is two grouped minima and two joins over the edges; nothing about
the graph reaches the driver but one number a round.  Edges are written to the
shared folder every round, so a lost executor costs a re-read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, write_table


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges(a, b)``; component is the smallest id reachable."""
    now = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    was = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = write_table(small, "edges")
        drop_table(now)
        now = after
        state = now.agg(F.count("*").alias("n"), sign).first()
        if state == was or not state["n"]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        was = state


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the edges (a[i], b[i]) connect: one at most for each node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:  # hook the larger root to the smaller, then shorten paths
        rx, ry = root[x], root[y]
        open_ = rx != ry
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(root, np.maximum(rx, ry)[open_], np.minimum(rx, ry)[open_])
        while True:
            short = root[root]
            if (short == root).all():
                break
            root = short
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def linked_state(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(key, class_id, n_links) of ``nodes(key, min_id, mult)``.

    ``found(a, b, links)`` holds edges (links null) and counts of rows linked to
    a node (b null); a node's own copies link to each other.  ``class_id`` is
    the least ``min_id`` of a component.
    """
    links = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("id").alias("key"), "component")
    named = nodes.select("key", "min_id", "mult").join(joined, "key", "left").join(links, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("min_id").alias("class_id"))
    return named.join(least, "component").select("key", "class_id", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def link_rows(counted: list[tuple[np.ndarray, np.ndarray]], edges: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A batch of ``found`` rows from (keys, links) and (a, b) arrays."""
    keys = np.concatenate([k for k, _ in counted] or [np.empty(0, np.int64)])
    links = np.concatenate([n for _, n in counted] or [np.empty(0, np.int64)])
    a = np.concatenate([x for x, _ in edges] or [np.empty(0, np.int64)])
    b = np.concatenate([x for _, x in edges] or [np.empty(0, np.int64)])
    none = lambda x: pa.nulls(len(x), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((keys, a)), pa.int64()), pa.concat_arrays([none(keys), pa.array(b, pa.int64())]), pa.concat_arrays([pa.array(links.astype(np.int64)), none(a)])], names=["a", "b", "links"]
    )
