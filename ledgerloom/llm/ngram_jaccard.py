"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (a text of one to four words is one
shingle: all its words).  Two texts link when the Jaccard similarity of their
sets is at least ``threshold``.

1. Equal sets become one node with a multiplicity, so copies never pair up.
2. MinHash bands (32 of 4 values) put nodes into buckets; a pair at 0.8 misses
   all of them with a chance of 5e-8.
3. Pairs of a bucket are compared 32 MinHash values at a time and dropped as soon
   as the posterior probability of reaching the threshold falls below
   ``tolerance``.  Each node meets the bucket's least one first; those that stay are
   connected by it and needn't meet each other, so only the others are compared
   with the whole bucket, in blocks.  Only connecting edges leave a task; their
   components are the candidate clusters.
4. The shingles of clustered nodes are sent to their cluster once (large
   clusters in pairs of blocks), all pairs of it are pruned the same way, and
   the rest is verified exactly.  Tasks return link counts and connecting
   edges, never the pairs.

Defined results: null, empty and blank texts have no shingles, link with
nothing and are their own class; rows that repeat an id and a text are copies
of each other and link; an empty table gives no rows; the smallest id of a
class names it; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import list_array, texts_of
from .components import components, forest, link_rows, linked_state
from .groups import runs, with_blocks
from .shared import drop_table, write_table
from .words import chunks, mix, split_words, whole, window_names

SHINGLE = 5
VALUES = 128
BANDS, BAND_VALUES = 32, 4
STEP = 32
BUCKET_BLOCK = 4096
CLUSTER_BLOCK, CLUSTER_SHINGLES = 2048, 1_500_000

_U = np.uint64


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    return seeds[:VALUES] | _U(1), seeds[VALUES:]


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle names of each text: (values, offsets)."""
    w = split_words(texts)
    counts = w.counts
    at = whole(w.offsets, size)
    names = window_names(w.names, size)[at] if len(at) else np.empty(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.maximum(counts - size + 1, 0))
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        own = [mix(window_names(w.names[w.offsets[i] : w.offsets[i + 1]], int(counts[i])) + _U(counts[i])) for i in few]
        names, doc = np.concatenate([names, *own]), np.concatenate([doc, few])
    order = np.lexsort((names, doc))
    names, doc = names[order], doc[order]
    new = np.ones(len(names), dtype=bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    names, doc = names[new], doc[new]
    return names, np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts))))).astype(np.int64)


def set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A name of each whole set (signed, for Spark)."""
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(values ^ _U(0x5851F42D4C957F2D)), dtype=np.uint64)))
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values [sets, VALUES] (uint64); no set may be empty."""
    up, plus = _multipliers()
    out = np.empty((VALUES, len(offsets) - 1), dtype=np.uint64)
    for i in range(VALUES):
        out[i] = np.minimum.reduceat(values * up[i] + plus[i], offsets[:-1])
    return out.T


@cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For 32, 64, ... compared values, the fewest matches a pair must have to stay.

    The similarity has a uniform prior; values are compared by eight bits, so
    two of different shingles agree by chance once in 256 times.
    """
    grid = (np.arange(2000) + 0.5) / 2000
    chance = grid + (1 - grid) / 256
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            like = np.exp(lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(chance) + (n - m) * np.log1p(-chance))
            if like[grid >= threshold].sum() / like.sum() >= tolerance:
                out.append(m)
                break
    return tuple(out)


def surviving(left: np.ndarray, right: np.ndarray | None, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of signatures that no step prunes; within ``left`` (i < j) where ``right`` is None."""
    ii, jj = [], []
    for i in range(len(left)):
        rows = left[i + 1 :] if right is None else right
        if not len(rows):
            continue
        same = (rows[:, :STEP] == left[i, :STEP]).sum(axis=1)
        at = np.flatnonzero(same >= least[0])
        same = same[at]
        for k in range(1, VALUES // STEP):
            if not len(at):
                break
            cut = slice(k * STEP, (k + 1) * STEP)
            same = same + (rows[at, cut] == left[i, cut]).sum(axis=1)
            stays = same >= least[k]
            at, same = at[stays], same[stays]
        if len(at):
            ii.append(np.full(len(at), i))
            jj.append(at + (i + 1 if right is None else 0))
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(ii), np.concatenate(jj)) if ii else (none, none)


def common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact size of the intersection of sets i[k] and j[k] (sorted, distinct)."""
    if not len(i):
        return np.empty(0, dtype=np.int64)
    lengths = np.array([len(s) for s in sets])
    names, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    rank = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), lengths)
    keep = shared[inverse]
    row, col, width = row[keep], rank[inverse[keep]], int(shared.sum())
    one_by_one = len(i) * (2e-5 + 4e-8 * lengths.mean())
    if one_by_one < 2 * len(sets) ** 2 * width / 1e10 + len(row) * 1e-7:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for first in range(0, width, 2048):
        a, b = np.searchsorted(col, (first, first + 2048))
        there = np.zeros((len(sets), min(2048, width - first)), dtype=np.float32)
        there[row[a:b], col[a:b] - first] = 1
        total += there @ there.T
    return total[i, j].astype(np.int64)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, tolerance: float = 1e-7) -> DataFrame:
    """One row per document: id, ``class_id``, ``n_links`` (documents linked directly), ``kept``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    least = least_matches(threshold, tolerance)
    ninths = (round(threshold * 1000), round(threshold * 1000) + 1000)  # J >= t  <=>  I * (1 + t) >= t * (|A| + |B|)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in chunks([len(t) for t in texts]):
                values, offsets = shingle_sets(texts[a:b])
                key, n = set_keys(values, offsets), np.diff(offsets)
                has = np.flatnonzero(n)
                sig = np.zeros((b - a, VALUES), dtype=np.uint8)
                bands = np.zeros((b - a, BANDS), dtype=np.int64)
                if len(has):
                    full = signatures(values, np.concatenate((offsets[:-1][has], [len(values)])))
                    sig[has] = (full >> _U(56)).astype(np.uint8) ^ (full >> _U(24)).astype(np.uint8)
                    mixed = np.zeros((len(has), BANDS), dtype=np.uint64)
                    for k in range(BAND_VALUES):
                        mixed = mix(mixed + full[:, k::BAND_VALUES][:, :BANDS] + _U(k))
                    bands[has] = mix(mixed + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(key), pa.array(n.astype(np.int32)), pa.array([s.tobytes() for s in sig], pa.binary()), list_array(bands.ravel(), np.arange(b - a + 1) * BANDS, pa.int64())],
                    names=["id", "key", "n", "sig", "bands"],
                )

    signed = write_table(own.mapInArrow(sign, f"id {id_type}, key bigint, n int, sig binary, bands array<bigint>"), "jaccard-signed")
    nodes = write_table(signed.where("n > 0").groupBy("key").agg(F.min("n").alias("n"), F.min("id").alias("min_id"), F.count("*").alias("mult"), F.min(F.struct("sig", "bands")).alias("s")).select("key", "n", "min_id", "mult", "s.sig", "s.bands"), "jaccard-nodes")

    # buckets of two nodes or more: each node first meets the bucket's least one
    banded = nodes.select("key", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("key").alias("pivot")).where("size > 1")
    placed = banded.join(full, "bucket").where("key <> pivot").join(nodes.select("key", "sig"), "key")
    placed = placed.join(nodes.select(F.col("key").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, VALUES) for k in (4, 5))
            same = np.cumsum((one == other).reshape(len(one), -1, STEP).sum(axis=2), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array((same >= np.array(least)).all(axis=1))], names=["bucket", "size", "key", "pivot", "sig", "near"])

    met = write_table(placed.select("bucket", "size", "key", "pivot", "sig", "pivot_sig").mapInArrow(meet, "bucket bigint, size bigint, key bigint, pivot bigint, sig binary, near boolean"), "jaccard-met")
    # what is near the pivot is connected by it; only what isn't has to meet the whole bucket
    apart = met.where("NOT near AND size > 2")
    rest = apart.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET_BLOCK).cast("int").alias("rest_blocks"))
    block = lambda n: F.pmod(F.xxhash64("key", F.lit(17)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = met.where("size > 2").join(rest, "bucket").withColumn("all_blocks", F.ceil(F.col("size") / BUCKET_BLOCK).cast("int"))
    columns = ["bucket", "lo", "hi", "far", "key", "sig"]
    some = blocks.where("NOT near").withColumn("far", F.lit(True)).withColumn("lo", block("rest_blocks")).withColumn("hi", every("all_blocks")).select(columns)
    all_ = blocks.withColumn("far", F.lit(False)).withColumn("hi", block("all_blocks")).withColumn("lo", every("rest_blocks")).select(columns)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in runs(batches, 3):
            far, key = _numbers(rows.column(3)), _numbers(rows.column(4))
            sig = np.frombuffer(b"".join(rows.column(5).to_pylist()), dtype=np.uint8).reshape(-1, VALUES)
            aa, bb = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                x, y = a + np.flatnonzero(far[a:b]), a + np.flatnonzero(~far[a:b])
                i, j = surviving(sig[x], sig[y], least)
                i, j = x[i], y[j]
                other = key[i] != key[j]
                if other.any():
                    p, q = forest(key[i[other]], key[j[other]])
                    aa.append(p)
                    bb.append(q)
            if aa:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(aa)), pa.array(np.concatenate(bb))], names=["a", "b"])

    keyed = some.unionByName(all_).repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    links = met.where("near").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct().unionByName(keyed.mapInArrow(prune, "a bigint, b bigint"))
    clusters = write_table(components(links).select(F.col("id").alias("key"), F.col("component").alias("cluster")), "jaccard-clusters")
    drop_table(met)

    # exact verification within clusters
    sized = clusters.join(nodes.select("key", "n", "min_id", "mult", "sig"), "key")
    blocks = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / CLUSTER_BLOCK), F.ceil(F.sum("n") / CLUSTER_SHINGLES)).alias("n_blocks"))
    members = sized.join(blocks, "cluster").select("key", "cluster", "n_blocks", "mult", "sig", F.col("min_id").alias("id"))
    texts = own.join(members.hint("shuffle_hash"), "id").select("cluster", "n_blocks", "key", "mult", "sig", "text")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, key = texts_of(batch.column(5)), _numbers(batch.column(2))
            for a, b in chunks([len(t) for t in texts]):
                values, offsets = shingle_sets(texts[a:b])
                right = np.flatnonzero(set_keys(values, offsets) == key[a:b])  # an id may have other texts too
                if len(right):
                    part = batch.slice(a, b - a).take(pa.array(right))
                    sets = pa.array([values[offsets[k] : offsets[k + 1]].tobytes() for k in right], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns[:5], sets], names=["cluster", "n_blocks", "key", "mult", "sig", "shingles"])

    sets = texts.mapInArrow(shingle, "cluster bigint, n_blocks bigint, key bigint, mult bigint, sig binary, shingles binary")
    dealt = with_blocks(sets, F.col("n_blocks"), "key").select("cluster", "lo", "hi", "block", "key", "mult", "sig", "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in runs(batches, 3):
            counted, edges = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                group = rows.slice(a, b - a)
                lo, hi, block, key, mult = (_numbers(group.column(k)) for k in (1, 2, 3, 4, 5))
                _, first = np.unique(key, return_index=True)  # repeated rows of one text came more than once
                block, key, mult = block[first], key[first], mult[first]
                sig = np.frombuffer(b"".join(group.column(6).take(pa.array(first)).to_pylist()), dtype=np.uint8).reshape(-1, VALUES)
                own = [np.frombuffer(s, dtype=np.uint64) for s in group.column(7).take(pa.array(first)).to_pylist()]
                size = np.array([len(s) for s in own])
                if lo[0] == hi[0]:
                    i, j = surviving(sig, None, least)
                else:
                    x, y = np.flatnonzero(block == lo[0]), np.flatnonzero(block == hi[0])
                    i, j = surviving(sig[x], sig[y], least)
                    i, j = x[i], y[j]
                near = np.minimum(size[i], size[j]) * 1000 >= ninths[0] * np.maximum(size[i], size[j])
                i, j = i[near], j[near]
                linked = common(own, i, j) * ninths[1] >= ninths[0] * (size[i] + size[j])
                i, j = i[linked], j[linked]
                if len(i):
                    n = np.bincount(i, weights=mult[j], minlength=len(key)) + np.bincount(j, weights=mult[i], minlength=len(key))
                    counted.append((key[n > 0], n[n > 0]))
                    edges.append(forest(key[i], key[j]))
            if counted:
                yield link_rows(counted, edges)

    found = write_table(dealt.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi").mapInArrow(verify, "a bigint, b bigint, links bigint"), "jaccard-links")
    state = linked_state(nodes, found)
    drop_table(clusters)
    out = signed.select("id", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(state, "key", "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce(F.col("class_id") == F.col("id"), F.lit(True)).alias("kept")
    )


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, but for members of a class that don't name it.

    Rows that repeat an id stand or fall together.
    """
    lost = ngram_jaccard(docs, id_col, text_col, threshold).where("NOT kept").select(F.col(id_col).alias("lost_id")).distinct()
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"))
    return row.join(lost.hint("shuffle_hash"), row["own_id"] == lost["lost_id"], "left_anti").select("row.*")
