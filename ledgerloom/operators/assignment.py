"""Assignment of leftovers: components of candidate pairs, pair costs, and a solver for each component."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.predicates import Rule
from ..sources.sinks import drop_kept, kept
from .matching import candidate_pairs
from .rules import expected_net, expected_window, explaining_rule
from .solvers import disambiguate, solve_edges, subset_sums


#: Edges that one task joins up in memory (16 bytes each); beyond that rounds over tables do the same.
ONE_TASK = 2_000_000


def _least_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a task as (node, root) pairs, the root being the least node that they connect."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    nodes, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    x, y = np.split(at, 2)
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    far = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges(a, b)``, strings: the least node reachable.

    Nodes become 64-bit names.  Each task first joins up the edges it has; a
    counted remainder of at most ``ONE_TASK`` edges is joined up in one task,
    a larger one in rounds of stars: every node is linked to the least of its
    neighbours until only stars are left (one number a round goes to the driver).
    """
    named = kept(edges.select("a", "b", F.xxhash64("a").alias("x"), F.xxhash64("b").alias("y")), "named-edges")
    star = kept(named.where("x <> y").select("x", "y").mapInArrow(_least_roots, "a bigint, b bigint"), "stars")
    if star.count() <= ONE_TASK:
        star = star.coalesce(1).mapInArrow(_least_roots, "a bigint, b bigint")
    else:
        star, was = star.distinct(), None
        while True:
            both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
            star, old = kept(small, "stars"), star
            state = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            drop_kept(old)
            if state == was:
                break
            was = state
    nodes = named.select(F.col("a").alias("node"), F.col("x").alias("name")).unionByName(named.select(F.col("b").alias("node"), F.col("y").alias("name"))).distinct()
    rooted = nodes.join(star.select(F.col("a").alias("name"), F.col("b").alias("root")), "name", "left").withColumn("root", F.coalesce("root", "name"))
    # the least name isn't the least node: each component takes the least of its nodes
    return rooted.join(rooted.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def component_members(orders: DataFrame, settlements: DataFrame, candidates: DataFrame) -> DataFrame:
    """(side, id, component) of all leftovers; those without a candidate stand alone."""
    edges = candidates.select(F.concat(F.lit("o:"), "o_order_id").alias("a"), F.concat(F.lit("s:"), "s_id").alias("b"))
    nodes = orders.select(F.concat(F.lit("o:"), "order_id").alias("node")).unionByName(settlements.select(F.concat(F.lit("s:"), "settlement_txn_id").alias("node")))
    return nodes.join(components(edges), "node", "left").select(F.substring("node", 1, 1).alias("side"), F.expr("substring(node, 3)").alias("id"), F.coalesce("component", "node").alias("component"))


def component_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


def pair_cost(rules: Sequence[Rule], config: Config) -> Column:
    """Cost of a candidate pair; the expected net is of the order's gross under the settlement's instrument."""
    net = expected_net(rules, F.col("o_gross"), F.col("s_instrument"))
    low, high = expected_window(rules, F.col("s_instrument"))
    mismatch = config.weight_instrument * config.mismatch_cost
    amount = F.when(net.isNotNull() & (F.col("o_gross") != 0), config.weight_amount * F.least(F.abs(net - F.col("s_net")) / F.abs("o_gross"), F.lit(1.0)))
    late = F.when(low.isNotNull(), config.weight_date * F.greatest(low - F.col("lag_days"), F.col("lag_days") - high, F.lit(0)))
    return (
        F.when(F.col("o_instrument") != F.col("s_instrument"), mismatch).otherwise(0.0)
        + F.when(F.col("o_status") == "refunded_full", mismatch).otherwise(0.0)
        + F.coalesce(amount, F.lit(0.0))
        + F.coalesce(late, F.lit(0.0))
        + F.when(explaining_rule(rules).isNull(), config.weight_rule * config.unexplained_cost).otherwise(0.0)
    )


def costed(candidates: DataFrame, rules: Sequence[Rule], config: Config) -> DataFrame:
    return candidates.withColumn("cost", F.round(pair_cost(rules, config), 6))


def with_component(pairs: DataFrame, members: DataFrame) -> DataFrame:
    own = members.where("side = 's'").select(F.col("id").alias("s_id"), "component")
    size = members.groupBy("component").agg(F.count_if(F.col("side") == "o").alias("n_orders"), F.count_if(F.col("side") == "s").alias("n_settlements"))
    return pairs.join(own, "s_id").join(size, "component")


def star_bindings(pairs: DataFrame, config: Config) -> DataFrame:
    """Components with one order or one settlement, solved in closed form.

    One of each binds below twice the sink's cost; otherwise an edge must be
    below the sink's cost, the order takes its cheapest ones up to its capacity
    and a single settlement takes its cheapest order.
    """
    star = pairs.where("n_orders = 1 OR n_settlements = 1")
    single = F.expr("n_orders = 1 AND n_settlements = 1")
    rank = F.row_number().over(Window.partitionBy("component").orderBy("cost", "o_order_id", "s_id"))
    most = F.when(F.col("n_settlements") > 1, config.max_bindings).otherwise(1)
    limit = F.when(single, 2 * config.sink_cost).otherwise(config.sink_cost)
    return star.where(F.col("cost") < limit).withColumn("rank", rank).where(F.col("rank") <= most)


def usable_pairs(orders: DataFrame, settlements: DataFrame, rules: Sequence[Rule], config: Config) -> DataFrame:
    """Candidate pairs that can bind: (block, component, even, o_order_id, s_id, cost).

    Orders alike in date, amount, instrument and status have the same candidates
    at the same costs, and so do settlements alike, so candidates, costs and
    components are found between such classes.  A pair from the sink's cost on
    (twice that in an even component) never binds; without those, components
    fall into blocks whose solutions don't touch.
    """

    def in_classes(rows: DataFrame, key: str, side: str, alike: Sequence[str]) -> DataFrame:
        """A class goes by its least node, so that the least class of a component is its least node, too."""
        return kept(rows.select(F.concat(F.lit(f"{side}:"), F.min(key).over(Window.partitionBy(*alike))).alias("class"), F.col(key).alias("id"), *alike), "classes")

    def classes(rows: DataFrame, key: str) -> DataFrame:
        return rows.drop("id").distinct().withColumnRenamed("class", key)

    o = in_classes(orders, "order_id", "o", ["batch_id", "order_date", "gross_amount_paise", "instrument", "status"])
    s = in_classes(settlements, "settlement_txn_id", "s", ["batch_id", "settled_date", "gross_amount_paise", "net_amount_paise", "instrument"])
    near = candidate_pairs(classes(o, "order_id"), classes(s, "settlement_txn_id").withColumn("order_id_claimed", F.lit(None).cast("string")), config)
    # costs are sums of parts that aren't negative: where instrument and status already cost too much, the others don't matter
    mismatch, limit = config.weight_instrument * config.mismatch_cost, 2 * config.sink_cost
    told = F.when(F.col("o_instrument") != F.col("s_instrument"), mismatch).otherwise(0.0) + F.when(F.col("o_status") == "refunded_full", mismatch).otherwise(0.0)
    near = kept(near.select(F.col("o_order_id").alias("a"), F.col("s_id").alias("b"), F.when(told <= limit, F.round(pair_cost(rules, config), 6)).alias("cost")), "class-pairs")
    members = o.select("class", "id").unionByName(s.select("class", "id"))
    # an id in two classes ties them together
    known = members.select("class", F.concat(F.substring("class", 1, 2), "id").alias("node")).distinct()
    tied = known.join(known.groupBy("node").agg(F.min("class").alias("b"), F.count("*").alias("n")).where("n > 1"), "node").select(F.col("class").alias("a"), "b").where("a <> b")
    own = kept(components(near.select("a", "b").unionByName(tied)), "class-components")
    side = F.substring("class", 1, 1)
    size = members.join(own.withColumnRenamed("node", "class"), "class").groupBy("component").agg((F.count_if(side == "o") == F.count_if(side == "s")).alias("even"))
    open_ = near.where(F.col("cost") <= limit).join(own.withColumnRenamed("node", "a"), "a").join(size, "component").where(F.col("even") | (F.col("cost") < config.sink_cost))
    open_ = kept(open_, "usable")
    block = components(open_.select("a", "b").unionByName(tied)).select(F.col("node").alias("a"), F.col("component").alias("block"))
    out = open_.join(block, "a").join(o.select(F.col("class").alias("a"), F.col("id").alias("o_order_id")), "a").join(s.select(F.col("class").alias("b"), F.col("id").alias("s_id")), "b")
    return out.select("block", "component", "even", "o_order_id", "s_id", "cost")


def solved_bindings(pairs: DataFrame, config: Config) -> DataFrame:
    """Bindings of every component by the Hungarian method or min-cost flow, block by block over the pairs of ``usable_pairs`` alone."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        orders, o = np.unique(rows["o_order_id"].to_numpy(dtype=str), return_inverse=True)
        settlements, s = np.unique(rows["s_id"].to_numpy(dtype=str), return_inverse=True)
        edges = list(zip(o.tolist(), s.tolist(), rows["cost"].tolist(), strict=True))
        method, bound = solve_edges(len(orders), len(settlements), edges, config.sink_cost, config.max_bindings, bool(rows["even"].iloc[0]))
        cost = {(i, j): c for i, j, c in edges}
        return pd.DataFrame([(rows["component"].iloc[0], str(orders[i]), str(settlements[j]), cost[i, j], method) for i, j in bound], columns=["component", "o_order_id", "s_id", "cost", "method"])

    return pairs.groupBy("block").applyInPandas(solve, "component string, o_order_id string, s_id string, cost double, method string")


def solved_subsets(rows: DataFrame, keys: Sequence[str], target: str, amount: str, delta: int, most: int) -> DataFrame:
    """Each group's subsets of ``amount`` that reach its ``target``: how many (``most`` at most), the fewest members, and by which method."""
    lists = rows.groupBy(*keys, F.col(target).alias("target")).agg(F.array_sort(F.collect_list(amount)).alias("amounts"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [subset_sums(a, t, delta, most) for t, a in zip(batch.column("target").to_pylist(), batch.column("amounts").to_pylist(), strict=True)]
            columns = [pa.array([len(f.solutions) for f in found], pa.int64()), pa.array([min(map(len, f.solutions), default=None) for f in found], pa.int64()), pa.array([f.truncated for f in found]), pa.array([f.method for f in found])]
            yield pa.RecordBatch.from_arrays([*batch.select(list(keys)).columns, *columns], names=[*keys, "solutions", "fewest", "truncated", "method"])

    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("solutions", T.LongType()), T.StructField("fewest", T.LongType()), T.StructField("truncated", T.BooleanType()), T.StructField("method", T.StringType())])
    return lists.mapInArrow(solve, schema)


def bank_subsets(pool: DataFrame, config: Config) -> DataFrame:
    """Subset-sum matches of credits that no payout group explains: members or the reason why not."""
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("s_id")
        ids = rows["s_id"].tolist()
        found = subset_sums([int(x) for x in rows["s_net"]], int(rows["credit_amount_paise"].iloc[0]), config.subset_delta, config.max_solutions)
        chosen, confidence, reason = disambiguate(found, rows["s_group"].tolist(), pd.to_datetime(rows["s_date"]).tolist())
        members = [ids[i] for i in chosen] if chosen else []
        return pd.DataFrame([(rows["batch_id"].iloc[0], rows["utr"].iloc[0], members, confidence, reason, found.method)], columns=["batch_id", "utr", "members", "confidence", "reason", "method"])

    return pool.groupBy("utr").applyInPandas(solve, "batch_id string, utr string, members array<string>, confidence double, reason string, method string")
