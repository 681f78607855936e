"""Embedding near-dedup by product quantisation.

Vectors of one label are compared by cosine.  On unit vectors a cosine of at
least ``threshold`` is a distance of at most tau = sqrt(2 - 2 * threshold).

1. Equal vectors of a label become one node with a multiplicity.
2. A bounded sample (``SAMPLE``) fits coarse centroids and, on the residuals, one
   codebook for each subspace.  Every vector is indexed: its cell (an inverted
   list for each label and cell), its residual's codes and the length of what
   the codes miss.  Beyond ``COARSE`` cells a cell is a coarse centroid plus one of
   a second, shared codebook of residuals, so the number of cells goes on
   growing with the vectors and lists keep their size.
3. *Sufficient probes.*  A vector is a member of its own cell and a query to its
   nearest cells.  How many that are is measured, not set: on pairs planted at
   exactly the threshold (the hardest that count), the fewest probes at which
   ``RECALL`` of them meet, either vector probing the other's cell.  With
   ``exact``, probes are instead all cells whose bisector with the own one is
   at most tau away, which can't lose a pair but is nearly all of them.
4. *Asymmetric distances.*  A query's tables hold its products with all
   codewords; with what a cell's centroid and a member's codes add, a member's
   approximate distance is a sum of table entries.  It differs from the true one
   by what the member's codes miss at most, so a member stays if the approximate
   distance minus that is at most tau: no pair that meets is lost.
5. The rest is reranked by exact cosine in double precision.

A pair that meets in both cells counts in the larger one only, so every link
counts once.  Lists are dealt in blocks of members and of queries, so a task
holds one block of each; tasks return counts and connecting edges, never pairs.
(Vectors travel with the rows: fetching them for surviving pairs only would
mean writing all pairs of a dense group down.)

Defined results: null, empty or zero vectors, vectors with a null or non-finite
component and rows without a label link with nothing; a shorter vector is
compared as if padded with zeros; rows that repeat an id are vectors of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import list_array
from .components import forest, link_rows, linked_state
from .groups import runs
from .shared import drop_table, write_table

#: Vectors that centroids and codebooks are fitted on, at most.
SAMPLE = 8192
SUBSPACES, CODEWORDS = 8, 128
#: Vectors for each cell that the number of cells aims at; coarse centroids, and entries of the second codebook, at most.
CELL_SIZE, COARSE, FINE = 800, 2048, 1024
#: Coarse centroids around a vector whose cells are ranked.
NEAR = 16
#: Share of pairs at the threshold that meet, and pairs planted to measure it.
RECALL, PLANTED = 0.999, 4096
MEMBER_BLOCK, QUERY_BLOCK = 2048, 8192
_QUERIES_AT_ONCE, _PAIRS_AT_ONCE = 256, 1 << 15


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 5) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centroids = x[draw.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centroids)
        total = np.zeros_like(centroids)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centroids))
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    norms = (centroids**2).sum(axis=1)
    return np.concatenate([np.argmin(norms - 2 * (x[i : i + 4096] @ centroids.T), axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


class Quantiser:
    """Cells and residual codebooks for unit vectors."""

    def __init__(self, sample: np.ndarray, cells: int):
        width = sample.shape[1]
        self.coarse = kmeans(sample, min(cells, COARSE, max(1, len(sample) // 4)), 10) if len(sample) else np.zeros((1, width))
        left = sample - self.coarse[nearest(sample, self.coarse)] if len(sample) else np.zeros((1, width))
        fine = min(FINE, -(-cells // len(self.coarse))) if len(self.coarse) == COARSE else 1
        self.fine = kmeans(left, fine, 6, seed=7) if fine > 1 else np.zeros((1, width))
        parts = min(SUBSPACES, width)
        self.cuts = np.linspace(0, width, parts + 1).astype(int)
        left = sample - self.centroids(self.ranked(sample, 1)[:, 0]) if len(sample) else left
        self.books = [kmeans(left[:, a:b], CODEWORDS, 6, seed=11 + a) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    @property
    def cells(self) -> int:
        return len(self.coarse) * len(self.fine)

    def centroids(self, cell: np.ndarray) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def ranked(self, x: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` nearest cells of each vector, the nearest first."""
        most, out = min(most, self.cells), []
        norms = (self.coarse**2).sum(axis=1)
        for i in range(0, len(x), 256):
            some = x[i : i + 256]
            far = norms - 2 * some @ self.coarse.T
            if len(self.fine) == 1:
                cells = np.broadcast_to(np.arange(len(self.coarse)), far.shape)
            else:  # cells of the nearest coarse centroids
                near = np.argsort(far, axis=1, kind="stable")[:, : max(NEAR, -(-most // len(self.fine)))]
                left = some[:, None] - self.coarse[near]
                far = ((left**2).sum(axis=2)[:, :, None] + (self.fine**2).sum(axis=1) - 2 * left @ self.fine.T).reshape(len(some), -1)
                cells = (near[:, :, None] * len(self.fine) + np.arange(len(self.fine))).reshape(len(some), -1)
            first = np.argpartition(far, most - 1, axis=1)[:, :most] if most < far.shape[1] else np.broadcast_to(np.arange(far.shape[1]), far.shape)
            order = np.lexsort((np.take_along_axis(cells, first, 1), np.take_along_axis(far, first, 1)), axis=1)
            out.append(np.take_along_axis(cells, np.take_along_axis(first, order, 1), 1))
        return np.concatenate(out) if out else np.empty((0, most), dtype=np.int64)

    def enough(self, sample: np.ndarray, threshold: float, recall: float, seed: int = 3) -> tuple[int, float]:
        """The fewest probes with which pairs planted at the threshold meet, and the share that does."""
        x = sample[:PLANTED]
        if not len(x) or x.shape[1] < 2 or self.cells == 1:
            return 1, 1.0
        way = np.random.default_rng(seed).normal(size=x.shape)
        way -= (way * x).sum(axis=1, keepdims=True) * x
        way /= np.maximum(np.linalg.norm(way, axis=1, keepdims=True), 1e-12)
        y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * way
        most = 1
        while True:
            most = min(2 * most, self.cells)
            near_x, near_y = self.ranked(x, most), self.ranked(y, most)
            met = np.minimum(*(np.where((a == b[:, :1]).any(axis=1), (a == b[:, :1]).argmax(axis=1), most) for a, b in ((near_x, near_y), (near_y, near_x))))
            share = np.cumsum(np.bincount(met, minlength=most + 1))[:most] / len(x)
            good = np.flatnonzero(share >= recall)
            if len(good):
                return int(good[0]) + 1, float(share[good[0]])
            if most == self.cells:
                return most, float(share[-1])

    def index(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the length that the codes miss."""
        left = x - self.centroids(cell)
        codes = np.empty((len(x), len(self.books)), dtype=np.uint8)
        missed = np.zeros(len(x))
        for k, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            codes[:, k] = nearest(left[:, a:b], self.books[k])
            missed += ((left[:, a:b] - self.books[k][codes[:, k]]) ** 2).sum(axis=1)
        return codes, np.sqrt(missed)

    def within(self, x: np.ndarray, cell: np.ndarray, tau: float) -> list[np.ndarray]:
        """For each vector all cells that may hold a vector within tau (cells are nearest centroids here)."""
        all_cells = self.centroids(np.arange(self.cells))
        far = ((all_cells**2).sum(axis=1) - 2 * x @ all_cells.T) + (x**2).sum(axis=1)[:, None]
        apart = np.linalg.norm(all_cells[cell][:, None] - all_cells[None], axis=2)
        near = far - far[np.arange(len(x)), cell][:, None] <= 2 * (tau + 1e-6) * apart + 1e-9
        return [np.flatnonzero(row) for row in near]

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each subspace, twice the product of the queries with all codewords; good for every cell."""
        return [(2 * queries[:, a:b] @ self.books[k].T).astype(np.float32) for k, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True))]

    def lengths(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """What codes add to a squared distance from a cell's centroid whatever the query."""
        out, middle = np.zeros(len(codes)), self.centroids(np.array([cell]))[0]
        for k, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            book = self.books[k]
            out += ((book**2).sum(axis=1) + 2 * book @ middle[a:b])[codes[:, k]]
        return out

    def distances(self, queries: np.ndarray, tables: list[np.ndarray], cell: int, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Approximate distances [queries, members] to members of a cell: table sums by code."""
        far = ((queries - self.centroids(np.array([cell]))) ** 2).sum(axis=1)
        total = (far[:, None] + lengths[None]).astype(np.float32)
        for k, table in enumerate(tables):
            total -= table.take(codes[:, k], axis=1)
        return np.sqrt(np.maximum(total, 0))


def unit(packed: list[bytes], width: int, kind: str = "<f8") -> np.ndarray:
    """Unit vectors in double precision from packed components, padded with zeros."""
    size = np.dtype(kind).itemsize
    if all(len(p) == size * width for p in packed):
        out = np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), width).astype(np.float64)
    else:
        out = np.zeros((len(packed), width))
        for i, p in enumerate(packed):
            out[i, : len(p) // size] = np.frombuffer(p, dtype=kind)
    out = out / np.abs(out).max(axis=1, keepdims=True, initial=1e-300)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows x[i[k]] and y[j[k]], always summed the same way."""
    step = range(0, len(i), _PAIRS_AT_ONCE)
    return np.concatenate([np.einsum("ij,ij->i", x[i[k : k + _PAIRS_AT_ONCE]], y[j[k : k + _PAIRS_AT_ONCE]]) for k in step] or [np.empty(0)])


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = RECALL, exact: bool = False) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``."""
    spark = vectors.sparkSession
    tau = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"  # single precision travels as it is; all sums are in double
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("vec"), F.col(label_col).alias("label"))
    sound = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    own = own.withColumn("key", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("label", "vec")))
    nodes = own.where("key IS NOT NULL").groupBy("key").agg(F.xxhash64(F.any_value("label")).alias("label"), F.any_value("vec").alias("vec"), F.min("id").alias("min_id"), F.count("*").alias("mult"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.asarray(v, dtype=kind).tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary()), *batch.columns[3:]], names=["key", "label", "vec", "min_id", "mult"])

    id_type = vectors.schema[id_col].dataType.simpleString()
    nodes = write_table(nodes.mapInArrow(pack, f"key bigint, label bigint, vec binary, min_id {id_type}, mult bigint"), "vector-nodes")
    size = nodes.agg(F.count("*").alias("n"), F.max(F.length("vec")).alias("bytes")).first()
    width, cells = (size["bytes"] or 8) // np.dtype(kind).itemsize, max(1, round(size["n"] / CELL_SIZE))
    sample = unit([bytes(r["vec"]) for r in nodes.select("vec", "key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()], width, kind)
    quantiser = Quantiser(sample, min(cells, COARSE) if exact else cells)
    probes = None if exact else quantiser.enough(sample, threshold, recall)[0]
    model = spark.sparkContext.broadcast(quantiser)  # at most COARSE + FINE centroids and the codebooks

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                x = unit(part.column(2).to_pylist(), width, kind)
                near = q.ranked(x, probes or 1)
                cell = near[:, 0]
                codes, missed = q.index(x, cell)
                asked = list(near) if probes else q.within(x, cell, tau)
                lists = list_array(np.concatenate(asked), np.cumsum([0] + [len(a) for a in asked]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed), part.column(4), part.column(2), lists],
                    names=["key", "label", "cell", "codes", "missed", "mult", "vec", "probes"],
                )

    indexed = write_table(nodes.mapInArrow(index, "key bigint, label bigint, cell int, codes binary, missed double, mult bigint, vec binary, probes array<int>"), "vector-index")
    asked = indexed.select("key", "label", F.col("cell").alias("own_cell"), "mult", "vec", F.explode("probes").alias("cell"))
    plan = indexed.groupBy("label", "cell").agg(F.ceil(F.count("*") / MEMBER_BLOCK).cast("int").alias("blocks"))
    plan = plan.join(asked.groupBy("label", "cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks")), ["label", "cell"])
    own_block = lambda n: F.pmod(F.xxhash64("key", F.lit(23)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["label", "cell", "block", "query_block", "own_cell", "key", "mult", "codes", "missed", "vec", "probes"]
    none = lambda kind: F.lit(None).cast(kind)
    members = indexed.join(plan, ["label", "cell"]).withColumn("block", own_block("blocks")).withColumn("query_block", every("query_blocks")).withColumn("own_cell", F.lit(-1)).select(columns)
    queries = asked.join(plan, ["label", "cell"]).withColumn("query_block", own_block("query_blocks")).withColumn("block", every("blocks")).withColumns({"codes": none("binary"), "missed": none("double"), "probes": none("array<int>")}).select(columns)
    keys = ["label", "cell", "block", "query_block"]
    dealt = members.unionByName(queries).repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        for rows, bounds in runs(batches, 4):
            counted, edges = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                group = rows.slice(a, b - a)
                cell = group.column(1)[0].as_py()
                own_cell, key, mult = (group.column(k).to_numpy() for k in (4, 5, 6))
                at, ask = np.flatnonzero(own_cell < 0), np.flatnonzero(own_cell >= 0)
                if not len(at) or not len(ask):
                    continue
                codes = np.frombuffer(b"".join(group.column(7).take(pa.array(at)).to_pylist()), dtype=np.uint8).reshape(len(at), -1)
                missed = group.column(8).take(pa.array(at)).to_numpy()
                x = unit(group.column(9).take(pa.array(at)).to_pylist(), width, kind)
                probed = [set(p) for p in group.column(10).take(pa.array(at)).to_pylist()]
                lengths = q.lengths(cell, codes)
                ii, jj = [], []
                for first in range(0, len(ask), _QUERIES_AT_ONCE):
                    some = ask[first : first + _QUERIES_AT_ONCE]
                    y = unit(group.column(9).take(pa.array(some)).to_pylist(), width, kind)
                    close = q.distances(y, q.tables(y), cell, codes, lengths) - missed[None] <= tau + 1e-4
                    # within a cell by order of keys; a pair whose other cell is smaller counts here, or wherever it meets at all
                    close &= (own_cell[some] != cell)[:, None] | (key[some][:, None] < key[at][None])
                    i, j = np.nonzero(close)
                    right = cosines(y, x, i, j) >= threshold
                    i, j = i[right], j[right]
                    other = own_cell[some[i]]
                    once = other <= cell
                    left = np.flatnonzero(~once)
                    once[left] = [c not in probed[k] for c, k in zip(other[left].tolist(), j[left].tolist(), strict=True)]
                    ii.append(some[i[once]])
                    jj.append(at[j[once]])
                i, j = np.concatenate(ii), np.concatenate(jj)
                if len(i):
                    n = np.bincount(i, weights=mult[j], minlength=len(key)) + np.bincount(j, weights=mult[i], minlength=len(key))
                    counted.append((key[n > 0], n[n > 0]))
                    edges.append(forest(key[i], key[j]))
            if counted:
                yield link_rows(counted, edges)

    found = write_table(dealt.mapInArrow(compare, "a bigint, b bigint, links bigint"), "vector-links")
    drop_table(indexed)
    state = linked_state(nodes, found)
    linked = own.where("key IS NOT NULL").select("id", "key").join(state, "key").select("id", "class_id", "n_links")
    alone = own.where("key IS NULL").select("id", F.col("id").alias("class_id"), F.lit(0).alias("n_links"))
    out = linked.unionByName(alone)
    component = F.coalesce("class_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
