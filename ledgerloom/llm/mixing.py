"""Mixing sources to target weights by entropy balancing.

The mix takes each document at a rate.  Of all rates, those nearest (in relative
entropy, a word counting one) to taking everything once under the constraints
are exponential tilts, rate = exp(multiplier of the source + multiplier of the
class), up to ``cap``.  Two families of constraints bind: every source's words
meet its target exactly, and the shares of classes (the language, by hash in
``CLASSES`` groups) stay as near to those of the input as a ridge of ``RIDGE``
makes them, since targets of sources can rule exact ones out.

The multipliers solve a convex dual.  Its gradient, words taken minus target,
and its Hessian are sums over documents; documents of one source and class share
a rate, so one aggregation of their words is all that the sums need.  Each
Newton round runs distributed over the sources: a task finds its sources'
multipliers for the classes' present ones, and returns the gradient and the
Schur complement of its part of the Hessian, ``CLASSES`` squared numbers whatever
the sources are.  The driver adds them and takes the step.

Rates are rounded to whole copies, floor or ceiling, largest documents first
and passing the rounding error on, in groups of about ``GROUP`` documents of a
source dealt by a hash of id and text: a source of any size spreads over tasks,
and each group's taken words end within its smallest documents' size of its
target.  Rows alike in id, text and source are one row with a count there.

Defined results: sources rank by code point, null is a source and ranks last;
weights repeat along that order; targets share all words by weight, stop at
``cap`` times their source's words and reshare the excess; null and blank
texts have no words and zero copies; a null class is a class; rows that repeat
an id are documents of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import texts_of
from .shared import drop_table, write_table
from .words import count_words

GROUP = 4096
CLASSES, RIDGE = 32, 0.05
#: Newton converges quadratically; targets down to e**-60 of a source are reached.
NEWTON_ROUNDS, CLASS_ROUNDS = 80, 40
#: Sources up to which their rates are broadcast (some hundred bytes each).
BROADCAST_SOURCES = 50_000


def source_targets(totals: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """``totals(source, source_size, ...)`` with ``target``."""
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = write_table(ranked.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")), "mix-ranks")
    level = 0.0
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while True:  # sources whose share at this level is above their most are full; the rest share what is left
        full = F.col("most") < F.col("weight") * level
        sums = table.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not sums[1]:
            break
        after = (total - (sums[0] or 0.0)) / sums[1]
        if after <= level:
            break
        level = after
    return table.withColumn("target", F.least(F.col("most"), F.col("weight") * level)).drop("rank", "weight", "most")


def source_multipliers(words: np.ndarray, target: np.ndarray, classes: np.ndarray, cap: float) -> np.ndarray:
    """For each source, the multiplier with which its words [sources, CLASSES] meet its target under the classes' multipliers."""
    at = np.log(np.maximum(target, 1e-300) / np.maximum((words * np.exp(classes)).sum(axis=1), 1e-300))
    low, high = at - 1e-9, np.full(len(at), np.log(cap) + np.abs(classes).max(initial=0) + 1)  # without the cap too little may be taken, never too much
    for _ in range(NEWTON_ROUNDS):
        rate = np.exp(np.minimum(at[:, None] + classes, np.log(cap)))
        taken = (words * rate).sum(axis=1)
        slope = (words * rate * (at[:, None] + classes < np.log(cap))).sum(axis=1)
        low, high = np.where(taken < target, at, low), np.where(taken > target, at, high)
        step = at + (target - taken) / np.maximum(slope, 1e-300)
        at = np.where((step > low) & (step < high), step, np.where(taken == target, at, (low + high) / 2))
    return at


def class_multipliers(wide: DataFrame, goal: np.ndarray, cap: float) -> np.ndarray:
    """The classes' multipliers, by Newton rounds over all sources of ``wide(source, target, words)``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, hessian = np.zeros(CLASSES), np.zeros((CLASSES, CLASSES))
        for batch in batches:
            words = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(-1, CLASSES)
            own = source_multipliers(words, batch.column(0).to_numpy(), now, cap)
            rate = np.exp(np.minimum(own[:, None] + now, np.log(cap)))
            bend = words * rate * (own[:, None] + now < np.log(cap))
            gradient += (words * rate).sum(axis=0)
            hessian += np.diag(bend.sum(axis=0)) - (bend / np.maximum(bend.sum(axis=1), 1e-300)[:, None]).T @ bend
        yield pa.RecordBatch.from_arrays([pa.array([gradient.tolist()], pa.list_(pa.float64())), pa.array([hessian.ravel().tolist()], pa.list_(pa.float64()))], names=["g", "h"])

    now, there = np.zeros(CLASSES), goal > 0
    for _ in range(CLASS_ROUNDS):
        rows = wide.select("target", "words").mapInArrow(sums, "g array<double>, h array<double>").collect()  # a row for each task
        gradient = sum((np.array(r["g"]) for r in rows), np.zeros(CLASSES))
        hessian = sum((np.array(r["h"]).reshape(CLASSES, CLASSES) for r in rows), np.zeros((CLASSES, CLASSES)))
        short = goal - gradient - RIDGE * goal * now
        if np.abs(short).max(initial=0) <= 1e-9 * max(goal.sum(), 1.0):
            break
        step = np.linalg.solve((hessian + np.diag(np.where(there, RIDGE * goal, 1.0))), np.where(there, short, 0.0))
        now = now + step / max(1.0, np.abs(step).max(initial=0))
    return now


def copies_of(sizes: np.ndarray, rates: np.ndarray, cap: float, rows: np.ndarray | None = None) -> np.ndarray:
    """Whole copies of documents in the order given, passing the error on; ``rows`` alike count as one, with all their copies."""
    rows = np.ones(len(sizes), dtype=np.int64) if rows is None else rows
    low = np.floor(rates + 1e-9).astype(np.int64) * rows
    high = np.minimum(np.ceil(rates - 1e-9), int(cap)).astype(np.int64) * rows
    out, owed = np.zeros(len(sizes), dtype=np.int64), 0.0
    for i, (size, rate, m, least, most) in enumerate(zip(sizes.tolist(), rates.tolist(), rows.tolist(), low.tolist(), high.tolist(), strict=True)):
        if size:
            owed += rate * size * m
            n = min(max(round(owed / size), least), most)
            out[i] = n
            owed -= n * size
    return out


def allotted(docs: DataFrame, weights: Sequence[float], cap: float, id_col: str, text_col: str, source_col: str, class_col: str | None) -> DataFrame:
    """One row for all rows alike in id, text and source: ``rows`` of them and ``all_copies`` of them together."""
    id_type, source_type = docs.schema[id_col].dataType.simpleString(), docs.schema[source_col].dataType.simpleString()
    group = F.pmod(F.xxhash64(F.col(class_col).cast("string")), F.lit(CLASSES)).cast("int") if class_col else F.lit(0)
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_mark(F.col(text_col)).alias("mark"), group.alias("class"), F.col(text_col).cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(count_words(texts_of(batch.column(4))))], names=["id", "source", "mark", "class", "size"])

    sizes = own.mapInArrow(measure, f"id {id_type}, source {source_type}, mark bigint, class int, size bigint")
    sizes = write_table(sizes.groupBy("id", "source", "mark").agg(F.min("class").alias("class"), F.min("size").alias("size"), F.count("*").alias("rows")), "mix-sizes")
    cells = sizes.groupBy("source", "class").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.sum("rows").alias("n"))
    cells = write_table(cells, "mix-cells")
    totals = cells.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs"), F.map_from_entries(F.collect_list(F.struct("class", "words"))).alias("by_class"))
    words = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.coalesce(F.element_at("by_class", k), F.lit(0)).cast("double"))
    targets = source_targets(totals.withColumn("words", words).drop("by_class"), weights, cap)
    targets = write_table(targets.repartition("source").sortWithinPartitions("source"), "mix-targets")
    # a full source takes everything at the cap, an empty one nothing: neither has a multiplier
    open_ = (F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))
    goal = np.zeros(CLASSES)
    for r in cells.groupBy("class").agg(F.sum("words").alias("words")).collect():  # a row for each class
        goal[r["class"]] = r["words"]
    full = targets.where(~open_ & (F.col("target") > 0)).select(F.posexplode("words").alias("class", "words")).groupBy("class").agg(F.sum("words").alias("words")).collect()
    for r in full:
        goal[r["class"]] -= cap * r["words"]
    left = targets.where(open_).agg(F.sum("target")).first()[0] or 0.0
    goal = np.maximum(goal, 0.0)
    goal *= left / goal.sum() if goal.sum() else 0.0
    multipliers = class_multipliers(targets.where(open_), goal, cap)

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = source_multipliers(np.array(batch.column(4).to_pylist(), dtype=np.float64).reshape(-1, CLASSES), batch.column(3).to_numpy(), multipliers, cap)
            rate = np.round(np.exp(np.minimum(own[:, None] + multipliers, np.log(cap))), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rate.tolist(), pa.list_(pa.float64()))], names=["source", "source_size", "n_docs", "target", "rates"])

    kind = f"source {source_type}, source_size bigint, n_docs bigint, target double, rates array<double>"
    solved = targets.where(open_).select("source", "source_size", "n_docs", "target", "words").mapInArrow(rates, kind)
    fixed = targets.where(~open_).select("source", "source_size", "n_docs", "target", F.array_repeat(F.when(F.col("target") > 0, float(cap)).otherwise(0.0), CLASSES).alias("rates"))
    sources = write_table(solved.unionByName(fixed), "mix-sources")
    sources = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    drop_table(cells)
    drop_table(targets)
    joined = sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "id", "d.source", "mark", "size", "rows", "source_size", "target", F.element_at("rates", F.col("class") + 1).alias("rate"), F.pmod(F.xxhash64("id", "mark"), F.ceil(F.col("n_docs") / GROUP)).alias("part")
    )

    def round_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "id", "mark"], ascending=[False, True, True], kind="stable")
        rows["all_copies"] = copies_of(rows["size"].to_numpy(), rows["rate"].to_numpy(), cap, rows["rows"].to_numpy())
        return rows.drop(columns="part")

    return joined.groupBy("source", "part").applyInPandas(round_group, f"id {id_type}, source {source_type}, mark bigint, size bigint, rows bigint, source_size bigint, target double, rate double, all_copies bigint")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", class_col: str | None = "lang") -> DataFrame:
    """One row per document: id, ``source``, ``mark``, ``size``, ``source_size``, ``target``, ``rate``, ``copies``, ``taken``.

    ``mark`` is a hash of the text.  Without ``class_col`` the targets of sources are the only constraints.
    """
    found = allotted(docs, weights, cap, id_col, text_col, source_col, class_col)
    each = found.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1))).withColumn("copies", own_copies(F.col("k")))
    return each.select(F.col("id").alias(id_col), "source", "mark", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def own_copies(k):
    """Copies of the k-th of rows alike."""
    return (F.floor(F.col("all_copies") / F.col("rows")) + (k < F.col("all_copies") % F.col("rows")).cast("int")).cast("int")


def text_mark(text):
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def take(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", class_col: str | None = "lang") -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, each as often as the mix takes it.

    Of rows alike in id, text and source the first by their other columns get the odd copies.
    """
    chosen = allotted(docs, weights, cap, id_col, text_col, source_col, class_col).where("all_copies > 0").select(F.col("id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("mark").alias("mix_mark"), "rows", "all_copies")
    chosen = write_table(chosen, "mix-chosen")
    marked = docs.select(F.struct("*").alias("mix_row"), F.col(id_col).alias("own_id"), F.col(source_col).alias("own_source"), text_mark(F.col(text_col)).alias("own_mark"))
    same = F.col("own_id").eqNullSafe(F.col("mix_id")) & F.col("own_source").eqNullSafe(F.col("mix_source")) & (F.col("own_mark") == F.col("mix_mark"))
    out = marked.join(chosen.where("rows = 1").hint("shuffle_hash"), same).select("mix_row", F.col("all_copies").cast("int").alias("mix_copies"))
    repeated = chosen.where("rows > 1")
    n = repeated.count()
    if n:  # documents move a second time only where rows alike are too many to broadcast
        place = F.row_number().over(Window.partitionBy("mix_id", "mix_source", "mix_mark").orderBy(F.xxhash64("mix_row"))) - 1
        found = marked.join(F.broadcast(repeated) if n <= BROADCAST_SOURCES else repeated.hint("shuffle_hash"), same)
        out = out.unionByName(found.withColumn("k", place).withColumn("mix_copies", own_copies(F.col("k"))).where("mix_copies > 0").select("mix_row", "mix_copies"))
    return out.select("mix_row", F.explode(F.sequence(F.lit(1), "mix_copies")).alias("mix_copy")).select("mix_row.*")
