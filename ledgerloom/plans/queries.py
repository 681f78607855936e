"""Named queries over the derived ledgers, each with the SQL that should give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions.calendar import add_working_days, calendar, with_lag
from ..functions.predicates import Rule, valid_predicate
from ..operators import assignment as A
from ..operators import audit, catalog, learning, matching, rules, scoring, summary
from ..sources.derive import DERIVED_CONFIG, derive
from ..sources.export import fold_export
from .batch import LIBRARY, Reconciliation
from .oracle_base import BASE, lag_sql, rate_sql

C = DERIVED_CONFIG
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Register a query under its function's name; integers come out as bigint."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(n).cast("bigint").alias(n) if t in ("int", "smallint", "tinyint") else F.col(n) for n, t in df.dtypes])

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = BASE + sql if base else sql
        return f

    return register


def recon(spark: SparkSession, sf_dir: str) -> Reconciliation:
    found = derive(spark, sf_dir)
    return Reconciliation(found.orders, found.settlements, found.credits, LIBRARY, C)


def fee_sql(gross: str, instrument: str) -> str:
    """Contract fee with tax."""
    part = lambda fee: f"({fee}) + {rate_sql(f'({fee})', chr(39) + '0.18' + chr(39))}"
    return f"CASE {instrument} WHEN 'UPI' THEN 0 WHEN 'CARD_DEBIT' THEN {part(rate_sql(gross, chr(39) + '0.009' + chr(39)))} WHEN 'CARD_CREDIT' THEN {part(rate_sql(gross, chr(39) + '0.02' + chr(39)))} WHEN 'NETBANKING' THEN {part('1200')} END"


def explain_sql(o_gross: str, s_gross: str, net: str, instrument: str, status: str) -> str:
    """First rule of the library that explains the amount."""
    own = f"CASE {instrument} WHEN 'UPI' THEN 2 WHEN 'CARD_DEBIT' THEN 3 WHEN 'CARD_CREDIT' THEN 4 ELSE 5 END"
    return (
        f"CASE WHEN {o_gross} = {s_gross} AND abs({net} - ({o_gross} - ({fee_sql(o_gross, instrument)}))) <= 2 THEN {own} "
        f"WHEN {status} = 'refunded_partial' AND {net} < {s_gross} - ({fee_sql(s_gross, instrument)}) THEN 8 END"
    )


PAIRS = f""", pairs AS (
  SELECT o.batch_id, o.order_id AS o_order_id, o.order_date AS o_date, o.gross_amount_paise AS o_gross, o.instrument AS o_instrument, o.status AS o_status,
    s.settlement_txn_id AS s_id, s.order_id_claimed AS s_claimed, s.settled_date AS s_date, s.gross_amount_paise AS s_gross, s.net_amount_paise AS s_net, s.instrument AS s_instrument,
    {lag_sql("o.order_date", "s.settled_date")} AS lag_days
  FROM ledger o JOIN settlements s ON o.batch_id = s.batch_id AND o.order_id = s.order_id_claimed)"""
#: Legs of split orders: exactly one subset of an order's claims pays it, and that one has two legs or more, each explained by its own fee.
SPLITS = (
    PAIRS
    + f""", legs AS (SELECT *, {explain_sql("s_gross", "s_gross", "s_net", "s_instrument", "'captured'")} AS leg_rule FROM pairs),
listed AS (SELECT batch_id, o_order_id, o_gross, list({{'s_id': s_id, 'g': s_gross, 'r': leg_rule}} ORDER BY s_id) AS all_legs FROM legs GROUP BY batch_id, o_order_id, o_gross HAVING count(*) BETWEEN 2 AND 12),
masked AS (SELECT *, unnest(range(1, 1 << len(all_legs))) AS mask FROM listed),
picked AS (SELECT batch_id, o_order_id, o_gross, list_filter(all_legs, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS part_of FROM masked),
paying AS (SELECT batch_id, o_order_id, part_of FROM picked WHERE list_sum(list_transform(part_of, lambda x: x.g)) = o_gross),
only_way AS (SELECT batch_id, o_order_id, any_value(part_of) AS part_of FROM paying GROUP BY batch_id, o_order_id HAVING count(*) = 1),
splits AS (SELECT batch_id, o_order_id, leg.s_id AS s_id, leg.g AS s_gross, leg.r AS rule_id FROM (
  SELECT batch_id, o_order_id, unnest(part_of) AS leg FROM only_way WHERE len(part_of) >= 2 AND len(list_filter(part_of, lambda x: x.r IS NULL)) = 0))"""
)
OUTCOMES = (
    SPLITS
    + f""", explained AS (SELECT *, {explain_sql("o_gross", "s_gross", "s_net", "s_instrument", "o_status")} AS rule_id,
    CASE WHEN s_instrument = 'UPI' THEN lag_days = 1 ELSE lag_days = 2 END AS timing FROM pairs WHERE s_id NOT IN (SELECT s_id FROM splits)),
outcomes AS (SELECT *, CASE WHEN rule_id IS NULL THEN 'FEE_UNEXPLAINED' WHEN NOT timing THEN 'TIMING_UNEXPLAINED' ELSE 'MATCH' END AS outcome FROM explained),
order_matches AS (SELECT batch_id, o_order_id, s_id, CAST(NULL AS INTEGER) AS rule_id, 'assignment' AS match_kind, 'subset_sum' AS resolved_by FROM splits
  UNION ALL SELECT batch_id, o_order_id, s_id, rule_id, 'exact', 'deterministic' FROM outcomes WHERE outcome = 'MATCH'),
groups AS (SELECT batch_id, settlement_batch_id, CAST(sum(net_amount_paise) AS BIGINT) AS net_total, min(settled_date) AS group_date, count(*) AS members FROM settlements GROUP BY ALL),
hits AS (SELECT c.batch_id, c.utr, c.credit_amount_paise, g.settlement_batch_id, g.members, count(*) OVER (PARTITION BY c.utr) AS hits
  FROM credits c JOIN groups g ON c.batch_id = g.batch_id AND c.credit_amount_paise = g.net_total AND abs(datediff('day', g.group_date, c.credit_date)) <= 1),
bank_matches AS (SELECT s.batch_id, h.utr, s.settlement_txn_id AS s_id, s.settlement_batch_id FROM settlements s JOIN hits h ON h.hits = 1 AND h.batch_id = s.batch_id AND h.settlement_batch_id = s.settlement_batch_id),
open_orders AS (SELECT * FROM ledger o WHERE NOT EXISTS (SELECT 1 FROM settlements s WHERE s.batch_id = o.batch_id AND s.order_id_claimed = o.order_id)),
open_settlements AS (SELECT * FROM settlements s WHERE NOT EXISTS (SELECT 1 FROM ledger o WHERE s.batch_id = o.batch_id AND s.order_id_claimed = o.order_id)),
exceptions AS (
  SELECT batch_id, 'settlement' AS record_type, s_id AS record_id, outcome AS reason_code, CAST(abs(CASE WHEN outcome = 'FEE_UNEXPLAINED' THEN s_gross - s_net ELSE s_net END) AS BIGINT) AS money_at_risk_paise FROM outcomes WHERE outcome <> 'MATCH'
  UNION ALL SELECT batch_id, 'order', order_id, 'NO_SETTLEMENT', abs(gross_amount_paise) FROM open_orders
  UNION ALL SELECT batch_id, 'settlement', settlement_txn_id, 'ORPHAN_SETTLEMENT', abs(net_amount_paise) FROM open_settlements)"""
)
AUDIT = f""", sole AS (
  SELECT batch_id, order_id_claimed, count(*) AS n, any_value(settlement_txn_id) AS settlement_txn_id, any_value(gross_amount_paise) AS g, any_value(net_amount_paise) AS net, any_value(instrument) AS instrument
  FROM settlements GROUP BY batch_id, order_id_claimed),
audited AS (SELECT s.* FROM sole s JOIN ledger o ON o.batch_id = s.batch_id AND o.order_id = s.order_id_claimed WHERE s.n = 1 AND s.g > 0 AND o.status = 'captured'),
priced AS (SELECT *, g - net AS charged, {fee_sql("g", "instrument")} AS agreed FROM audited),
leaks AS (SELECT *, CASE WHEN abs(charged - agreed) <= 5 THEN 0 ELSE charged - agreed END AS leaked FROM priced)"""
_LEAK_SUMS = """count(*) AS transactions, CAST(sum(charged) AS BIGINT) AS charged_paise, CAST(sum(agreed) AS BIGINT) AS agreed_paise, CAST(sum(leaked) AS BIGINT) AS leaked_paise,
  count(*) FILTER (leaked > 0) AS overcharged, count(*) FILTER (leaked < 0) AS undercharged, CAST(sum(greatest(leaked, 0)) AS BIGINT) AS gross_leaked_paise"""

# -- functions


@query(f" SELECT order_id, {rate_sql('gross_amount_paise', chr(39) + '0.0195' + chr(39))} AS fee, {rate_sql('-gross_amount_paise', chr(39) + '0.02' + chr(39))} AS reversed FROM ledger")
def money_apply_rate(spark, sf_dir):
    gross = F.col("gross_amount_paise")
    return derive(spark, sf_dir).orders.select("order_id", M.apply_rate(gross, M.rate_literal("0.0195")).alias("fee"), M.apply_rate(-gross, M.rate_literal("0.02")).alias("reversed"))


_W = "CAST(abs(amount) // 100 AS VARCHAR)"


@query(f""", amounts AS (SELECT order_id, CASE WHEN k % 2 = 0 THEN gross_amount_paise * (1 + k % 1000) ELSE -gross_amount_paise END AS amount FROM keyed)
SELECT order_id, CASE WHEN amount < 0 THEN '-' ELSE '' END || '₹' ||
  CASE WHEN length({_W}) <= 3 THEN {_W} ELSE
    trim(CASE WHEN length({_W}) > 9 THEN left({_W}, length({_W}) - 9) || ',' ELSE '' END || CASE WHEN length({_W}) > 7 THEN right(left({_W}, length({_W}) - 7), least(2, length({_W}) - 7)) || ',' ELSE '' END
      || CASE WHEN length({_W}) > 5 THEN right(left({_W}, length({_W}) - 5), least(2, length({_W}) - 5)) || ',' ELSE '' END || right(left({_W}, length({_W}) - 3), least(2, length({_W}) - 3)) || ',', '') || right({_W}, 3) END
  || '.' || lpad(CAST(abs(amount) % 100 AS VARCHAR), 2, '0') AS shown FROM amounts""")  # fmt: skip
def money_format(spark, sf_dir):
    k = F.expr("cast(substring(order_id, 5) as bigint)")
    amount = F.when(k % 2 == 0, F.col("gross_amount_paise") * (1 + k % 1000)).otherwise(-F.col("gross_amount_paise"))
    return derive(spark, sf_dir).orders.select("order_id", M.format_paise(amount).alias("shown"))


@query(f" SELECT order_id, gross_amount_paise - ({fee_sql('gross_amount_paise', 'instrument')}) AS expected FROM ledger")
def fee_expected_net(spark, sf_dir):
    return derive(spark, sf_dir).orders.select("order_id", rules.expected_net(LIBRARY, F.col("gross_amount_paise"), F.col("instrument")).alias("expected"))


@query(f" SELECT order_id, instrument, {fee_sql('gross_amount_paise', 'instrument')} AS fee FROM ledger")
def contract_fee(spark, sf_dir):
    return derive(spark, sf_dir).orders.select("order_id", "instrument", M.contract_fee(F.col("gross_amount_paise"), F.col("instrument"), C).alias("fee"))


@query(PAIRS + " SELECT o_order_id, s_id, lag_days FROM pairs")
def working_day_lag(spark, sf_dir):
    found = derive(spark, sf_dir)
    return with_lag(matching.pairs_of(found.orders, found.settlements), calendar(spark, C), "o_date", "s_date").select("o_order_id", "s_id", "lag_days")


_ROLLED = "(order_date + CAST(CASE WHEN wd = 5 THEN 2 WHEN wd = 6 THEN 1 ELSE 0 END AS INTEGER))"
_ROLLED_WD = "(CASE WHEN wd >= 5 THEN 0 ELSE wd END)"


@query(f" SELECT order_id, CAST(k % 9 AS BIGINT) AS n, CAST({_ROLLED} + CAST(k % 9 + 2 * (({_ROLLED_WD} + k % 9) // 5) AS INTEGER) AS DATE) AS due FROM keyed")
def working_days_added(spark, sf_dir):
    rows = derive(spark, sf_dir).orders.select("order_id", "order_date", (F.expr("cast(substring(order_id, 5) as bigint)") % 9).alias("n"))
    return add_working_days(rows, calendar(spark, C), "order_date", "n", "due").select("order_id", "n", "due")


#: A predicate made of each order's key: types, fields and values that go in and out of the vocabulary.
_MADE = """CASE k % 7
    WHEN 0 THEN '{"type":"exact_id","tolerance_paise":' || (k % 5 - 1) || '}'
    WHEN 1 THEN '{"type":"fee_formula","params":{"rate":' || (k % 13) || '.5,"gst":0.18},"tolerance_paise":2}'
    WHEN 2 THEN '{"type":"fee_formula","params":{"flat_paise":' || ((k % 11 - 2) * 100) || ',"rate":7}}'
    WHEN 3 THEN '{"type":"timing_window","min_working_days":' || (k % 4) || ',"max_working_days":' || (k % 5) || '}'
    WHEN 4 THEN '{"type":"refund_pattern","condition":"net ' || CASE WHEN k % 3 = 0 THEN '<' ELSE '>' END || ' expected_net","tolerance_paise":' || (k % 5 - 2) || '}'
    WHEN 5 THEN '{"type":"fee_formula","params":{"rate":0.0' || (k % 10) || ',"gst":' || (k % 3) || '},"expr":"net = gross - ' || CASE WHEN k % 2 = 0 THEN 'round(gross * {rate}) - round(round(gross * {rate}) * {gst})' ELSE '{flat_paise} - round({flat_paise} * {gst})' END || '"}'
    ELSE CASE k % 4 WHEN 0 THEN '{"type":"magic"}' WHEN 1 THEN 'no json' WHEN 2 THEN '{"type":"fee_formula","params":{"gst":0.18}}' ELSE '{"type":"fee_formula","params":{"rate":true}}' END END"""


@query(f""", made AS (SELECT order_id, k, {_MADE} AS predicate FROM keyed)
SELECT order_id, predicate, CASE k % 7 WHEN 0 THEN k % 5 > 0 WHEN 1 THEN k % 13 = 0 WHEN 2 THEN k % 11 >= 2 WHEN 3 THEN k % 5 >= k % 4 WHEN 4 THEN k % 3 = 0 AND k % 5 >= 2 WHEN 5 THEN k % 2 = 0 AND k % 3 <= 1 ELSE false END AS valid FROM made""")
def predicate_validate(spark, sf_dir):
    keyed = derive(spark, sf_dir).orders.select("order_id", F.expr("cast(substring(order_id, 5) as bigint)").alias("k"))
    return keyed.select("order_id", F.expr(_MADE).alias("predicate")).withColumn("valid", valid_predicate(F.col("predicate")))


# -- ingest: an export made of the derived settlements, folded back


@query(" SELECT settlement_txn_id, order_id_claimed, gross_amount_paise, mdr_paise, gst_on_mdr_paise, net_amount_paise, settlement_batch_id, instrument FROM settlements")
def ingest_fold_refunds(spark, sf_dir):
    from ..sources.export import as_export

    folded = fold_export(as_export(derive(spark, sf_dir).settlements), "derived")
    return folded.select("settlement_txn_id", "order_id_claimed", "gross_amount_paise", "mdr_paise", "gst_on_mdr_paise", "net_amount_paise", "settlement_batch_id", "instrument")


# -- joins


@query(PAIRS + " SELECT batch_id, o_order_id, s_id, o_gross, s_gross, s_net FROM pairs")
def identity_join(spark, sf_dir):
    found = derive(spark, sf_dir)
    return matching.pairs_of(found.orders, found.settlements).select("batch_id", "o_order_id", "s_id", "o_gross", "s_gross", "s_net")


@query(OUTCOMES + " SELECT batch_id, order_id, gross_amount_paise FROM open_orders")
def unsettled_orders(spark, sf_dir):
    return recon(spark, sf_dir).open_orders.select("batch_id", "order_id", "gross_amount_paise")


@query(OUTCOMES + " SELECT batch_id, settlement_txn_id, net_amount_paise FROM open_settlements")
def orphan_settlements(spark, sf_dir):
    return recon(spark, sf_dir).open_settlements.select("batch_id", "settlement_txn_id", "net_amount_paise")


_NEAR = f""", near AS (
  SELECT o.batch_id, o.order_id AS o_order_id, s.settlement_txn_id AS s_id, o.gross_amount_paise AS o_gross, o.instrument AS o_instrument, o.status AS o_status,
    s.gross_amount_paise AS s_gross, s.net_amount_paise AS s_net, s.instrument AS s_instrument, {lag_sql("o.order_date", "s.settled_date")} AS lag_days
  FROM open_orders o JOIN open_settlements s ON o.batch_id = s.batch_id
    AND s.net_amount_paise BETWEEN o.gross_amount_paise - (3 * o.gross_amount_paise) // 5 - 2 AND o.gross_amount_paise + 2
    AND {lag_sql("o.order_date", "s.settled_date")} BETWEEN 0 AND 6),
costed AS (
  SELECT *, round(CASE WHEN o_instrument <> s_instrument THEN 1000.0 ELSE 0.0 END + CASE WHEN o_status = 'refunded_full' THEN 1000.0 ELSE 0.0 END
    + least(CAST(abs(o_gross - ({fee_sql("o_gross", "s_instrument")}) - s_net) AS DOUBLE) / o_gross, 1.0)
    + 0.5 * greatest(CASE WHEN s_instrument = 'UPI' THEN 1 ELSE 2 END - lag_days, lag_days - CASE WHEN s_instrument = 'UPI' THEN 1 ELSE 2 END, 0)
    + CASE WHEN {explain_sql("o_gross", "s_gross", "s_net", "s_instrument", "o_status")} IS NULL THEN 120.0 ELSE 0.0 END, 6) AS cost FROM near)"""


@query(OUTCOMES + _NEAR + " SELECT batch_id, o_order_id, s_id, o_gross, s_net, lag_days FROM near")
def candidate_pairs(spark, sf_dir):
    return recon(spark, sf_dir).candidates.select("batch_id", "o_order_id", "s_id", "o_gross", "s_net", "lag_days")


@query(OUTCOMES + _NEAR + " SELECT o_order_id, s_id, CAST(round(cost * 1000) AS BIGINT) AS cost_thousandths FROM costed")
def pair_cost(spark, sf_dir):
    return recon(spark, sf_dir).candidates.select("o_order_id", "s_id", F.round(F.col("cost") * 1000).cast("bigint").alias("cost_thousandths"))


_COMPONENTS = """, edges AS (SELECT 'o:' || o_order_id AS a, 's:' || s_id AS b FROM near UNION SELECT 's:' || s_id, 'o:' || o_order_id FROM near),
nodes AS (SELECT 'o:' || order_id AS node FROM open_orders UNION ALL SELECT 's:' || settlement_txn_id FROM open_settlements),
reach AS (SELECT node, node AS label FROM nodes UNION SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.node),
labelled AS (SELECT node, min(label) AS component FROM reach GROUP BY node)"""


def _recursive(sql: str) -> str:
    return (BASE + OUTCOMES + _NEAR + _COMPONENTS + sql).replace("WITH keyed", "WITH RECURSIVE keyed", 1)


@query()
def components(spark, sf_dir):
    return recon(spark, sf_dir).members.select(F.concat("side", F.lit(":"), "id").alias("node"), "component")


@query()
def component_sizes(spark, sf_dir):
    return A.component_sizes(recon(spark, sf_dir).members)


ORACLE_SQL["components"] = _recursive(" SELECT node, component FROM labelled")
ORACLE_SQL["component_sizes"] = _recursive(" SELECT size, count(*) AS components FROM (SELECT count(*) AS size FROM labelled GROUP BY component) GROUP BY size")
_STAR = """, sized AS (SELECT component, count(*) FILTER (node LIKE 'o:%') AS n_o, count(*) FILTER (node LIKE 's:%') AS n_s FROM labelled GROUP BY component),
ranked AS (SELECT c.o_order_id, c.s_id, c.cost, z.n_o, z.n_s, row_number() OVER (PARTITION BY z.component ORDER BY c.cost, c.o_order_id, c.s_id) AS place
  FROM costed c JOIN labelled l ON l.node = 's:' || c.s_id JOIN sized z ON z.component = l.component
  WHERE (z.n_o = 1 OR z.n_s = 1) AND c.cost < CASE WHEN z.n_o = 1 AND z.n_s = 1 THEN 100 ELSE 50 END)
SELECT o_order_id, s_id, CAST(round(cost * 1000) AS BIGINT) AS cost_thousandths FROM ranked WHERE place <= CASE WHEN n_s > 1 THEN 2 ELSE 1 END"""
ORACLE_SQL["assignment_star"] = _recursive(_STAR)


@query()
def assignment_star(spark, sf_dir):
    r = recon(spark, sf_dir)
    return A.star_bindings(A.with_component(r.candidates, r.members), C).select("o_order_id", "s_id", F.round(F.col("cost") * 1000).cast("bigint").alias("cost_thousandths"))


@query()
def assignment_full(spark, sf_dir):
    """Every component by its solver; ties make other engines choose other pairs, so tests compare total costs."""
    return recon(spark, sf_dir).assigned.select("component", "o_order_id", "s_id", "method")


# -- bank


@query(OUTCOMES + " SELECT batch_id, settlement_batch_id, net_total, members FROM groups")
def payout_sums(spark, sf_dir):
    return matching.payout_sums(derive(spark, sf_dir).settlements).select("batch_id", "settlement_batch_id", "net_total", "members")


@query(OUTCOMES + " SELECT batch_id, utr, s_id FROM bank_matches")
def bank_group_match(spark, sf_dir):
    return recon(spark, sf_dir).bank_matches(subsets=False).select("batch_id", "utr", "s_id")


#: Every payout group of the 20th of a month gets a twin of the same sum and date.
_TWINS = """, twinned AS (SELECT batch_id, settlement_batch_id, settled_date, net_amount_paise FROM settlements
  UNION ALL SELECT batch_id, 'TW-' || settlement_batch_id, settled_date, net_amount_paise FROM settlements WHERE day(settled_date) = 20),
twin_groups AS (SELECT batch_id, settlement_batch_id, CAST(sum(net_amount_paise) AS BIGINT) AS net_total, min(settled_date) AS group_date FROM twinned GROUP BY ALL)
SELECT c.batch_id, c.utr, count(*) AS hits FROM credits c JOIN twin_groups g ON c.batch_id = g.batch_id AND c.credit_amount_paise = g.net_total AND abs(datediff('day', g.group_date, c.credit_date)) <= 1 GROUP BY ALL HAVING count(*) > 1"""


@query(_TWINS)
def bank_ambiguous(spark, sf_dir):
    found = derive(spark, sf_dir)
    twins = found.settlements.where(F.dayofmonth("settled_date") == 20).withColumn("settlement_batch_id", F.concat(F.lit("TW-"), "settlement_batch_id"))
    return matching.bank_group_hits(found.settlements.unionByName(twins), found.credits, C).where("hits > 1").select("batch_id", "utr", "hits").distinct()


_POOL = """, pool AS (SELECT c.batch_id, c.utr, c.credit_amount_paise, s.settlement_txn_id AS s_id, s.net_amount_paise AS s_net, s.settlement_batch_id AS s_group FROM credits c
  JOIN settlements s ON s.batch_id = c.batch_id AND abs(datediff('day', s.settled_date, c.credit_date)) <= 1 WHERE c.utr NOT IN (SELECT utr FROM hits))"""


@query(OUTCOMES + _POOL + " SELECT batch_id, utr, count(*) AS pool, CAST(sum(s_net) AS BIGINT) AS pool_net FROM pool GROUP BY ALL")
def bank_pool(spark, sf_dir):
    r = recon(spark, sf_dir)
    pool = matching.bank_pool(matching.bank_leftovers(r.credits, r.bank_hits), r.settlements, C)
    return pool.groupBy("batch_id", "utr").agg(F.count("*").alias("pool"), F.sum("s_net").alias("pool_net"))


@query(SPLITS + """, claims AS (SELECT batch_id, o_order_id, o_gross, list(s_gross ORDER BY s_id) AS gs FROM pairs GROUP BY ALL),
tried AS (SELECT batch_id, o_order_id, o_gross, gs, unnest(range(1, 1 << len(gs))) AS mask FROM claims),
sums AS (SELECT batch_id, o_order_id, o_gross, bit_count(mask) AS members, list_sum(list_filter(gs, lambda x, i: (mask >> (i - 1)) & 1 = 1)) AS total FROM tried)
SELECT batch_id, o_order_id, least(count(*), 5) AS solutions, CAST(min(members) AS BIGINT) AS fewest FROM sums WHERE total = o_gross GROUP BY ALL""")
def subset_sum_claims(spark, sf_dir):
    """For every claimed order, by the solver: how many subsets of its claims pay it exactly, and the fewest members."""
    found = derive(spark, sf_dir)
    return A.solved_subsets(matching.pairs_of(found.orders, found.settlements), ["batch_id", "o_order_id"], "o_gross", "s_gross", 0, C.max_solutions).where("solutions > 0").select("batch_id", "o_order_id", "solutions", "fewest")


@query()
def subset_sum_pools(spark, sf_dir):
    """For every credit without a payout group, whatever its pool's size, what the solver finds."""
    r = recon(spark, sf_dir)
    pool = matching.bank_pool(matching.bank_leftovers(r.credits, r.bank_hits), r.settlements, C)
    return A.solved_subsets(pool, ["batch_id", "utr"], "credit_amount_paise", "s_net", C.subset_delta, C.max_solutions)


@query()
def disambiguate(spark, sf_dir):
    """Every credit without a payout group: members chosen, confidence and reason; the solver runs in Python."""
    return recon(spark, sf_dir).bank_found.select("utr", F.size("members").alias("members"), "confidence", "reason", "method")


# -- verdicts


@query(SPLITS + " SELECT batch_id, o_order_id, s_id, s_gross, CAST(rule_id AS BIGINT) AS rule_id FROM splits")
def split_payouts(spark, sf_dir):
    return recon(spark, sf_dir).splits


@query(PAIRS + f""" SELECT o_order_id, s_id, CAST({explain_sql("o_gross", "s_gross", "s_net", "s_instrument", "o_status")} AS BIGINT) AS rule_id FROM pairs""")
def explain_amount(spark, sf_dir):
    found = derive(spark, sf_dir)
    return matching.pairs_of(found.orders, found.settlements).withColumn("lag_days", F.lit(None).cast("bigint")).select("o_order_id", "s_id", rules.explaining_rule(LIBRARY).alias("rule_id"))


def _verdict_sql(fee: str) -> str:
    return f"CASE WHEN o_gross = s_gross THEN abs(s_net - (o_gross - ({fee}))) <= 2 END"


@query(PAIRS + f""" SELECT o_order_id, s_id, o_order_id = s_claimed AS r1,
  CASE WHEN s_instrument = 'UPI' THEN {_verdict_sql("0")} END AS r2, CASE WHEN s_instrument = 'NETBANKING' THEN {_verdict_sql("1416")} END AS r5,
  CASE WHEN s_instrument = 'UPI' THEN lag_days = 1 END AS r6, lag_days = 2 AS r7,
  CASE WHEN o_status = 'refunded_partial' THEN s_net < s_gross - ({fee_sql("s_gross", "s_instrument")}) END AS r8 FROM pairs""")  # fmt: skip
def rule_verdicts(spark, sf_dir):
    found = derive(spark, sf_dir)
    pairs = with_lag(matching.pairs_of(found.orders, found.settlements), calendar(spark, C), "o_date", "s_date")
    by_id = {r.rule_id: r for r in LIBRARY}
    return pairs.select("o_order_id", "s_id", *[rules.verdict(by_id[i], LIBRARY).alias(f"r{i}") for i in (1, 2, 5, 6, 7, 8)])


@query(OUTCOMES + " SELECT batch_id, s_id, outcome FROM outcomes")
def identity_outcome(spark, sf_dir):
    return recon(spark, sf_dir).identity.select("batch_id", "s_id", "outcome")


#: A rule for each supplier: type, scope, priority, window and tolerance out of the key.
_RULED = """CAST(s_suppkey AS INT) AS rule_id, CASE WHEN s_suppkey % 3 = 0 THEN 'fee_formula' ELSE 'timing_window' END AS rule_type,
  CASE s_suppkey % 5 WHEN 0 THEN 'UPI' WHEN 1 THEN 'CARD_DEBIT' WHEN 2 THEN 'CARD_CREDIT' WHEN 3 THEN 'NETBANKING' ELSE 'ALL' END AS scope,
  CAST(CASE WHEN s_suppkey % 5 = 4 THEN 80 + s_suppkey % 9 ELSE 50 + s_suppkey % 37 END AS INT) AS priority,
  CAST(s_suppkey % 7 AS INT) AS lo, CAST(s_suppkey % 7 + s_suppkey % 3 AS INT) AS hi, CAST(s_suppkey % 2000 AS BIGINT) AS flat, CAST(s_suppkey % 4 AS INT) AS tolerance"""
_RULED_SQL = f"WITH library AS (SELECT {_RULED} FROM supplier)"


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(*[x.strip() for x in re.split(r",\s+(?=CASE|CAST)", _RULED)])


def _library(spark: SparkSession, sf_dir: str) -> list[Rule]:
    """A library of a rule for each supplier; libraries are driver-side data of some hundred rules by what they are."""
    rows = _ruled(spark, sf_dir).collect()
    fee = lambda r: r.rule_type == "fee_formula"
    return [Rule(r.rule_id, r.rule_type, r.scope, r.priority, flat_paise=r.flat if fee(r) else None, tolerance=r.tolerance, min_days=None if fee(r) else r.lo, max_days=None if fee(r) else r.hi) for r in rows]


@query(f"{_RULED_SQL} SELECT CAST(rule_id AS BIGINT) AS rule_id, row_number() OVER (ORDER BY priority, scope = 'ALL', rule_id) AS place FROM library WHERE NOT (scope <> 'ALL' AND priority > 79)", base=False)
def rule_order(spark, sf_dir):
    """Precedence of a library without contradictions: scoped rules stay below the general ones."""
    found = [r for r in _library(spark, sf_dir) if r.scope == "ALL" or r.priority < 80]
    return spark.createDataFrame([(r.rule_id, i + 1) for i, r in enumerate(rules.ordered(found))], "rule_id bigint, place bigint")


@query(f"{_RULED_SQL} SELECT CAST(s.rule_id AS BIGINT) AS scoped, CAST(a.rule_id AS BIGINT) AS general FROM library s JOIN library a ON s.scope <> 'ALL' AND a.scope = 'ALL' AND s.rule_type = a.rule_type AND s.priority > a.priority", base=False)
def rule_cycles(spark, sf_dir):
    return spark.createDataFrame(rules.cycles(_library(spark, sf_dir)), "scoped bigint, general bigint")


@query(f"""{_RULED_SQL} SELECT CAST(x.rule_id AS BIGINT) AS a, CAST(y.rule_id AS BIGINT) AS b FROM library x JOIN library y ON x.rule_id < y.rule_id AND x.rule_type = y.rule_type AND x.scope = y.scope
  AND CASE WHEN x.rule_type = 'fee_formula' THEN abs(x.flat - y.flat) <= x.tolerance + y.tolerance ELSE x.lo <= y.hi AND y.lo <= x.hi END""", base=False)
def rule_overlaps(spark, sf_dir):
    """Pairs grow with the square of the rules that share a window, so neither they nor the rules go through the driver."""
    fee = F.col("rule_type") == "fee_formula"
    columns = {"scope_instrument": F.col("scope"), "status": F.lit("active"), "rate": F.lit(None).cast("string"), "gst": F.lit("0"), "flat_paise": F.when(fee, F.col("flat")), "tolerance_paise": F.col("tolerance"), "min_days": F.when(~fee, F.col("lo")), "max_days": F.when(~fee, F.col("hi"))}
    return rules.overlapping(_ruled(spark, sf_dir).withColumns(columns))


# -- learning

_EVIDENCE = """, parts AS (SELECT batch_id, order_id_claimed AS o_order_id FROM settlements GROUP BY ALL HAVING count(*) > 1),
evidence AS (SELECT p.*, (p.batch_id, p.o_order_id) IN (SELECT batch_id, o_order_id FROM parts) AS in_parts FROM pairs p
  WHERE p.s_id IN (SELECT s_id FROM bank_matches) OR (p.o_order_id, p.s_id) IN (SELECT o_order_id, s_id FROM order_matches))"""
_CANDIDATES = (Rule(11, "fee_formula", "CARD_CREDIT", rate="0.02", gst="0.18", tolerance=2), Rule(12, "fee_formula", "CARD_CREDIT", rate="0.021", gst="0.18", tolerance=2), Rule(13, "timing_window", "CARD_DEBIT", min_days=2, max_days=3))


def _evidence(r: Reconciliation) -> DataFrame:
    return learning.evidence(r.orders, r.settlements, r.order_matches(assigned=False), r.bank_matches(subsets=False), C)


@query(OUTCOMES + _EVIDENCE + " SELECT o_order_id, s_id, lag_days, in_parts FROM evidence")
def backtest_evidence(spark, sf_dir):
    return _evidence(recon(spark, sf_dir)).select("o_order_id", "s_id", "lag_days", "in_parts")


def _test_sql(rule_id: int, scope: str, usable: str, says: str, off: str) -> str:
    return f"""SELECT CAST({rule_id} AS BIGINT) AS rule_id, count(*) AS support, count(*) FILTER ({says}) AS correct, count(*) FILTER (NOT ({says})) AS wrong, (SELECT count(*) FROM evidence) - count(*) AS skipped, coalesce(CAST(max({off}) AS BIGINT), 0) AS max_deviation
  FROM evidence WHERE NOT in_parts AND o_status = 'captured' AND s_instrument = '{scope}' AND {usable}"""


def _rate_off(rate: str) -> str:
    fee = rate_sql("s_gross", f"'{rate}'")
    return f"abs(s_net - (s_gross - {fee} - {rate_sql(fee, chr(39) + '0.18' + chr(39))}))"


@query(OUTCOMES + _EVIDENCE + " " + " UNION ALL ".join([_test_sql(11, "CARD_CREDIT", "o_gross = s_gross", _rate_off("0.02") + " <= 2", _rate_off("0.02")), _test_sql(12, "CARD_CREDIT", "o_gross = s_gross", _rate_off("0.021") + " <= 2", _rate_off("0.021")), _test_sql(13, "CARD_DEBIT", "true", "lag_days BETWEEN 2 AND 3", "0")]))
def backtest(spark, sf_dir):
    return learning.backtest(_evidence(recon(spark, sf_dir)), _CANDIDATES, LIBRARY).select("rule_id", "support", "correct", "wrong", "skipped", "max_deviation")


#: A proposal out of each order: what it claims, how sure, how tolerant.
_PROPOSED = """, proposed AS (SELECT instrument || '/' || (k % 24) AS fingerprint, CAST(k % 5 AS DOUBLE) / 10 + 0.5 AS confidence, k % 15 AS tolerance FROM keyed)"""


def _proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.expr("cast(substring(order_id, 5) as bigint)")
    return derive(spark, sf_dir).orders.select(F.concat("instrument", F.lit("/"), (k % 24).cast("string")).alias("fingerprint"), ((k % 5).cast("double") / 10 + 0.5).alias("confidence"), (k % 15).alias("tolerance"))


@query(_PROPOSED + " SELECT fingerprint, count(*) AS occurrences, round(avg(confidence), 6) AS confidence, CAST(CASE WHEN count(*) > 1 THEN least(max(tolerance), 10) ELSE max(tolerance) END AS BIGINT) AS tolerance FROM proposed GROUP BY fingerprint")
def proposal_intake(spark, sf_dir):
    return learning.intake_table(_proposed(spark, sf_dir), C)


#: What stands in the gate: a proposal for each part with its evidence out of the part's key.
_GATED = """CAST(p_partkey AS STRING) AS fingerprint, CAST(1 + p_partkey % 5 AS INT) AS occurrences, CAST(0.6 + (p_partkey % 9) * 0.05 AS DOUBLE) AS confidence, CAST((p_partkey % 3) * 40 AS BIGINT) AS support,
  CAST((p_partkey % 3) * 40 - (CASE WHEN p_partkey % 4 = 1 AND p_partkey % 3 > 0 THEN p_partkey % 6 ELSE 0 END) AS BIGINT) AS correct,
  CAST(CASE WHEN p_partkey % 4 = 1 AND p_partkey % 3 > 0 THEN p_partkey % 6 ELSE 0 END AS BIGINT) AS wrong, CAST(p_partkey % 11 AS BIGINT) AS max_deviation, CAST(CASE WHEN p_partkey % 8 = 1 THEN 0 ELSE 5000 END AS BIGINT) AS wrong_money,
  CAST(CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS INT) AS conflicts"""
_GATE_SQL = f"""SELECT fingerprint, CAST(occurrences AS BIGINT) AS occurrences, CASE WHEN failed = '' THEN 'promoted' WHEN failed IN ('occurrence', 'confidence', 'support', 'occurrence+confidence', 'occurrence+support', 'confidence+support', 'occurrence+confidence+support') THEN 'pending' ELSE 'rejected' END AS decision, failed FROM (
  SELECT fingerprint, occurrences, concat_ws('+', CASE WHEN occurrences < 3 THEN 'occurrence' END, CASE WHEN confidence < 0.8 THEN 'confidence' END, CASE WHEN support < 3 AND NOT fatal THEN 'support' END,
    CASE WHEN fatal OR (support >= 3 AND p < 0.98) THEN 'backtest' END, CASE WHEN conflicts > 0 THEN 'conflict' END) AS failed
  FROM (SELECT *, wrong > 0 AND wrong_money > 0 AND NOT (wrong > 0 AND max_deviation <= 5) AS fatal, CASE WHEN wrong > 0 AND max_deviation <= 5 THEN 1.0 WHEN support > 0 THEN correct / support ELSE 0.0 END AS p FROM (SELECT {_GATED} FROM part)))"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(*[x.strip() for x in re.split(r",\s+(?=CAST)", _GATED)])
    return learning.gate(rows, C).select("fingerprint", "occurrences", "decision", "failed")


@query(_GATE_SQL, base=False)
def promotion_gate(spark, sf_dir):
    return _decided(spark, sf_dir)


@query(f"SELECT fingerprint, CAST(occurrences AS BIGINT) AS occurrences, failed FROM ({_GATE_SQL}) WHERE decision = 'rejected' ORDER BY occurrences DESC, fingerprint LIMIT 10", base=False)
def rejected_proposals(spark, sf_dir):
    """The ten rejected proposals that were made most often."""
    return learning.most_frequent(_decided(spark, sf_dir).where("decision = 'rejected'"), 10).select("fingerprint", "occurrences", "failed")


@query(f"SELECT fingerprint, CAST(occurrences AS BIGINT) AS occurrences, decision FROM ({_GATE_SQL}) ORDER BY occurrences DESC, fingerprint LIMIT 5", base=False)
def prior_proposals(spark, sf_dir):
    """The five most frequent proposals of any status, as a case shows them."""
    return learning.most_frequent(_decided(spark, sf_dir), 5).select("fingerprint", "occurrences", "decision")


#: Links with planted contests: some orders' settlements are bound to a neighbour, too, some orders take all of ten, and a rule's links go to nobody.
_BOUND = """, bound AS (SELECT batch_id, o_order_id, s_id, rule_id FROM order_matches
  UNION ALL SELECT m.batch_id, 'ORD-' || (k.k - k.k % 2), m.s_id, m.rule_id FROM order_matches m JOIN keyed k ON k.order_id = m.o_order_id WHERE k.c IN (21, 23) OR k.k % 50 = 0
  UNION ALL SELECT m.batch_id, 'ORD-' || (k.k - k.k % 10), m.s_id, m.rule_id FROM order_matches m JOIN keyed k ON k.order_id = m.o_order_id WHERE k.c BETWEEN 30 AND 39
  UNION ALL SELECT m.batch_id, 'ORD-none', m.s_id, m.rule_id FROM order_matches m JOIN keyed k ON k.order_id = m.o_order_id WHERE m.rule_id = 5 AND k.c >= 60),
contested AS (SELECT s_id FROM bound GROUP BY s_id HAVING count(DISTINCT o_order_id) > 1),
overbound AS (SELECT o_order_id FROM bound GROUP BY o_order_id HAVING count(DISTINCT s_id) > 2),
stats AS (SELECT CAST(rule_id AS BIGINT) AS rule_id, count(*) AS times_applied, count(*) FILTER (s_id NOT IN (SELECT s_id FROM contested) AND o_order_id NOT IN (SELECT o_order_id FROM overbound)) AS times_correct FROM bound WHERE rule_id IS NOT NULL GROUP BY rule_id)"""


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recon(spark, sf_dir).order_matches(assigned=False).select("batch_id", "o_order_id", "s_id", "rule_id")
    k = F.regexp_extract("o_order_id", r"\d+", 0).try_cast("bigint")
    to = lambda key: F.concat(F.lit("ORD-"), key.cast("string"))
    bound_to = F.array_compact(F.array(
        F.col("o_order_id"), F.when((k % 100).isin(21, 23) | (k % 50 == 0), to(k - k % 2)), F.when((k % 100).between(30, 39), to(k - k % 10)), F.when((F.col("rule_id") == 5) & (k % 100 >= 60), F.lit("ORD-none")),
    ))
    return rows.withColumn("o_order_id", F.explode(bound_to))


@query(OUTCOMES + _BOUND + " SELECT s_id, count(DISTINCT o_order_id) AS orders FROM bound GROUP BY s_id HAVING count(DISTINCT o_order_id) > 1")
def contested_settlements(spark, sf_dir):
    return learning.contested_settlements(_bound(spark, sf_dir))


@query(OUTCOMES + _BOUND + " SELECT o_order_id, count(DISTINCT s_id) AS settlements FROM bound GROUP BY o_order_id HAVING count(DISTINCT s_id) > 2")
def overbound_orders(spark, sf_dir):
    return learning.overbound_orders(_bound(spark, sf_dir))


@query(OUTCOMES + _BOUND + " SELECT rule_id, times_applied, times_correct FROM stats")
def rule_stats(spark, sf_dir):
    return learning.rule_stats(_bound(spark, sf_dir))


_GONE = " WHERE times_applied >= 10 AND times_correct / times_applied < 0.95"


@query(OUTCOMES + _BOUND + " SELECT rule_id, times_applied, times_correct FROM stats" + _GONE)
def retirement(spark, sf_dir):
    return learning.retired(learning.rule_stats(_bound(spark, sf_dir)), C).select("rule_id", "times_applied", "times_correct")


@query(OUTCOMES + _BOUND + " SELECT m.batch_id, 'settlement' AS record_type, m.s_id AS record_id, 'RULE_RETIRED' AS reason_code, abs(s.net_amount_paise) AS money_at_risk_paise FROM order_matches m JOIN settlements s ON s.settlement_txn_id = m.s_id WHERE m.rule_id IN (SELECT rule_id FROM stats" + _GONE + ")")
def retired_matches(spark, sf_dir):
    """Exceptions that the links of retired rules become."""
    r = recon(spark, sf_dir)
    return learning.reopened(r.order_matches(assigned=False), learning.retired(learning.rule_stats(_bound(spark, sf_dir)), C), r.settlements)[1]


_CASES = """, filed AS (SELECT e.batch_id, e.record_id, e.reason_code, s.order_id_claimed AS claimed, s.settled_date, s.gross_amount_paise AS gross FROM exceptions e JOIN settlements s ON e.record_type = 'settlement' AND s.batch_id = e.batch_id AND s.settlement_txn_id = e.record_id),
nearby AS (SELECT f.batch_id, f.record_id, o.order_id, LAG_SQL AS lag FROM filed f JOIN ledger o ON o.batch_id = f.batch_id AND (o.order_id = f.claimed OR (o.gross_amount_paise = f.gross AND o.order_date <= f.settled_date))),
inside AS (SELECT * FROM nearby WHERE lag BETWEEN 0 AND 6)
SELECT e.batch_id, e.record_type, e.record_id, e.reason_code, coalesce(c.n, 0) AS candidates, c.nearest, c.lag FROM exceptions e
LEFT JOIN (SELECT batch_id, record_id, least(count(*), 5) AS n, arg_min(order_id, (lag, order_id)) AS nearest, min(lag) AS lag FROM inside GROUP BY ALL) c USING (batch_id, record_id)""".replace("LAG_SQL", lag_sql("o.order_date", "f.settled_date"))


@query(OUTCOMES + _CASES)
def proposer_cases(spark, sf_dir):
    """What a proposer is shown of each exception: how many candidates, the nearest one and its lag."""
    r = recon(spark, sf_dir)
    cases = learning.build_cases(r.exceptions(assigned=False, bank=False), r.orders, r.settlements, (), C)
    first = F.get("candidates", F.lit(0))
    return cases.select("batch_id", "record_type", "record_id", "reason_code", F.size("candidates").alias("candidates"), first["order_id"].alias("nearest"), first["lag_days"].alias("lag"))


@query(OUTCOMES + " SELECT batch_id, record_id, reason_code, money_at_risk_paise, row_number() OVER (PARTITION BY batch_id ORDER BY money_at_risk_paise DESC, record_id) AS place FROM exceptions WHERE reason_code IN ('FEE_UNEXPLAINED', 'TIMING_UNEXPLAINED', 'AMBIGUOUS_SUBSET', 'NO_SUBSET_FOUND')")
def escalation_queue(spark, sf_dir):
    return learning.escalation_queue(recon(spark, sf_dir).exceptions(assigned=False, bank=False)).select("batch_id", "record_id", "reason_code", "money_at_risk_paise", "place")


@query(PAIRS + """, alone AS (SELECT *, count(*) OVER (PARTITION BY batch_id, o_order_id) AS n FROM pairs WHERE o_status = 'captured'),
placed AS (SELECT *, row_number() OVER (PARTITION BY batch_id, s_instrument ORDER BY o_order_id, s_id) AS place FROM alone WHERE n = 1),
sampled AS (SELECT *, (place - 1) // 5 AS sample FROM placed WHERE place <= 15)
SELECT batch_id, s_instrument, o_order_id, sample FROM (SELECT *, count(*) OVER (PARTITION BY batch_id, s_instrument, sample) AS m FROM sampled) WHERE m >= 3""")  # fmt: skip
def discovery_pool(spark, sf_dir):
    found = derive(spark, sf_dir)
    return learning.discovery_pool(matching.pairs_of(found.orders, found.settlements), C).select("batch_id", "s_instrument", "o_order_id", "sample")


# -- audit


@query(AUDIT + f" SELECT instrument, {_LEAK_SUMS} FROM leaks GROUP BY instrument")
def leakage_by_instrument(spark, sf_dir):
    found = derive(spark, sf_dir)
    return audit.leakage_by_instrument(found.orders, found.settlements, C)


@query(AUDIT + f" SELECT batch_id, {_LEAK_SUMS} FROM leaks GROUP BY batch_id")
def leakage_total(spark, sf_dir):
    found = derive(spark, sf_dir)
    return audit.leakage_total(found.orders, found.settlements, C)


@query(AUDIT + " SELECT settlement_txn_id, instrument, g AS gross_amount_paise, charged, agreed, leaked FROM leaks WHERE leaked > 0 ORDER BY leaked DESC, settlement_txn_id LIMIT 10")
def worst_offenders(spark, sf_dir):
    found = derive(spark, sf_dir)
    return audit.worst_offenders(found.orders, found.settlements, C)


_OBSERVED = """, measured AS (SELECT batch_id, instrument, count(*) AS n, stddev_pop(CAST(charged AS DOUBLE) / g) AS rs, stddev_pop(charged) / avg(g) AS fs, median(CAST(charged AS DOUBLE) / g) AS ratio, median(charged) AS ded FROM priced GROUP BY ALL HAVING count(*) >= 3),
observed AS (SELECT batch_id, instrument, n, CASE WHEN rs <= fs THEN round(ratio / 1.18, 6) END AS rate, CASE WHEN rs > fs THEN CAST(round(ded / 1.18) AS BIGINT) END AS flat_paise FROM measured)"""


@query(AUDIT + _OBSERVED + " SELECT batch_id, instrument, n, rate, flat_paise FROM observed")
def observed_schedule(spark, sf_dir):
    found = derive(spark, sf_dir)
    return audit.observed_schedule(found.orders, found.settlements, C)


@query(AUDIT + _OBSERVED + """ SELECT b.batch_id, k.instrument, o.n, k.agreed_rate, k.agreed_flat, o.rate, o.flat_paise,
  CASE WHEN o.n IS NULL THEN NULL WHEN coalesce(o.rate, o.flat_paise, 1) = 0 AND coalesce(k.agreed_rate, k.agreed_flat, 1) = 0 THEN true
    WHEN NOT ((o.rate IS NOT NULL AND k.agreed_rate IS NOT NULL) OR (o.flat_paise IS NOT NULL AND k.agreed_flat IS NOT NULL)) THEN false
    WHEN k.agreed_flat IS NOT NULL THEN abs(o.flat_paise - k.agreed_flat) <= 2 ELSE abs(o.rate - k.agreed_rate) <= 0.0001 END AS agrees
FROM (SELECT DISTINCT batch_id FROM ledger) b CROSS JOIN (VALUES ('UPI', CAST(0 AS DOUBLE), CAST(NULL AS BIGINT)), ('CARD_DEBIT', 0.009, NULL), ('CARD_CREDIT', 0.02, NULL), ('NETBANKING', NULL, 1200)) k(instrument, agreed_rate, agreed_flat)
LEFT JOIN observed o ON o.batch_id = b.batch_id AND o.instrument = k.instrument""")  # fmt: skip
def compare_to_contract(spark, sf_dir):
    found = derive(spark, sf_dir)
    return audit.compare_to_contract(found.orders, found.settlements, C)


# -- scores and totals


@query(" SELECT DISTINCT batch_id, 'order' AS kind, order_id AS left_id, settlement_txn_id AS right_id FROM truth WHERE order_id <> 'ORPHAN' AND settlement_txn_id <> 'UNSETTLED' UNION ALL SELECT DISTINCT batch_id, 'bank', utr, settlement_txn_id FROM truth WHERE utr IS NOT NULL")
def truth_pairs(spark, sf_dir):
    return scoring.truth_pairs(derive(spark, sf_dir).truth)


def scored_matches(r: Reconciliation) -> DataFrame:
    net = r.settlements.select(F.col("settlement_txn_id").alias("s_id"), F.abs("net_amount_paise").alias("money"))
    links = r.order_matches(assigned=False).select("batch_id", F.lit("order").alias("kind"), F.col("o_order_id").alias("left_id"), "s_id").unionByName(
        r.bank_matches(subsets=False).select("batch_id", F.lit("bank").alias("kind"), F.col("utr").alias("left_id"), "s_id")
    )
    return links.join(net, "s_id").withColumnRenamed("s_id", "right_id")


@query(OUTCOMES + """, claimed AS (SELECT batch_id, 'order' AS kind, o_order_id AS l, s_id AS r FROM order_matches UNION ALL SELECT batch_id, 'bank', utr, s_id FROM bank_matches),
true_pairs AS (SELECT DISTINCT batch_id, 'order' AS kind, order_id AS l, settlement_txn_id AS r FROM truth WHERE order_id <> 'ORPHAN' AND settlement_txn_id <> 'UNSETTLED' UNION ALL SELECT DISTINCT batch_id, 'bank', utr, settlement_txn_id FROM truth WHERE utr IS NOT NULL),
t AS (SELECT batch_id, count(*) AS n FROM true_pairs GROUP BY 1), c AS (SELECT batch_id, count(*) AS n FROM (SELECT DISTINCT * FROM claimed) GROUP BY 1),
g AS (SELECT batch_id, count(*) AS n FROM (SELECT * FROM claimed INTERSECT SELECT * FROM true_pairs) GROUP BY 1),
e AS (SELECT batch_id, count(*) AS n, CAST(sum(money_at_risk_paise) AS BIGINT) AS m FROM exceptions GROUP BY 1),
f AS (SELECT x.batch_id, count(*) AS n, CAST(sum(abs(s.net_amount_paise)) AS BIGINT) AS m FROM claimed x JOIN settlements s ON s.settlement_txn_id = x.r WHERE (x.batch_id, x.kind, x.l, x.r) NOT IN (SELECT batch_id, kind, l, r FROM true_pairs) GROUP BY 1)
SELECT t.batch_id, CASE WHEN coalesce(c.n, 0) > 0 THEN round(coalesce(g.n, 0) / c.n, 6) ELSE 0.0 END AS precision, round(coalesce(g.n, 0) / t.n, 6) AS recall, coalesce(f.n, 0) AS false_positives, coalesce(e.n, 0) AS open_exceptions,
  50 * coalesce(f.n, 0) + coalesce(e.n, 0) AS cost, coalesce(e.m, 0) + coalesce(f.m, 0) AS money_at_risk_paise
FROM t LEFT JOIN c USING (batch_id) LEFT JOIN g USING (batch_id) LEFT JOIN e USING (batch_id) LEFT JOIN f USING (batch_id)""")  # fmt: skip
def score_batch(spark, sf_dir):
    r = recon(spark, sf_dir)
    return scoring.score_batches(scored_matches(r), r.exceptions(assigned=False, bank=False), derive(spark, sf_dir).truth, C)


@query(OUTCOMES + " SELECT batch_id, match_kind, resolved_by, count(*) AS matches FROM order_matches GROUP BY ALL")
def matches_by_resolver(spark, sf_dir):
    return recon(spark, sf_dir).order_matches(assigned=False).groupBy("batch_id", "match_kind", "resolved_by").agg(F.count("*").alias("matches"))


@query(OUTCOMES + """ SELECT l.batch_id, l.n AS orders, s.n AS settlements, c.n AS credits, coalesce(m.n, 0) AS order_matches, coalesce(m.o, 0) AS orders_matched, coalesce(b.n, 0) AS bank_matches,
  coalesce(x.n, 0) AS settlements_matched, coalesce(e.n, 0) AS exceptions, coalesce(e.m, 0) AS money_at_risk_paise, round((coalesce(m.o, 0) + coalesce(x.n, 0)) / (l.n + s.n + c.n), 6) AS match_rate
FROM (SELECT batch_id, count(*) AS n FROM ledger GROUP BY 1) l
LEFT JOIN (SELECT batch_id, count(*) AS n FROM settlements GROUP BY 1) s USING (batch_id) LEFT JOIN (SELECT batch_id, count(*) AS n FROM credits GROUP BY 1) c USING (batch_id)
LEFT JOIN (SELECT batch_id, count(*) AS n, count(DISTINCT o_order_id) AS o FROM order_matches GROUP BY 1) m USING (batch_id) LEFT JOIN (SELECT batch_id, count(*) AS n FROM bank_matches GROUP BY 1) b USING (batch_id)
LEFT JOIN (SELECT batch_id, count(*) AS n FROM (SELECT batch_id, s_id FROM order_matches UNION SELECT batch_id, s_id FROM bank_matches) GROUP BY 1) x USING (batch_id)
LEFT JOIN (SELECT batch_id, count(*) AS n, CAST(sum(money_at_risk_paise) AS BIGINT) AS m FROM exceptions GROUP BY 1) e USING (batch_id)""")  # fmt: skip
def run_metrics(spark, sf_dir):
    r = recon(spark, sf_dir)
    return summary.run_metrics(r.orders, r.settlements, r.credits, r.order_matches(assigned=False), r.bank_matches(subsets=False), r.exceptions(assigned=False, bank=False))


_TOTALS = """, money AS (SELECT batch_id, instrument, CAST(sum(gross_amount_paise) AS BIGINT) AS gross, CAST(sum(mdr_paise) AS BIGINT) AS fees, CAST(sum(gst_on_mdr_paise) AS BIGINT) AS gst, CAST(sum(net_amount_paise) AS BIGINT) AS net, count(*) AS settlements
  FROM settlements GROUP BY GROUPING SETS ((batch_id, instrument), (batch_id))),
counts AS (SELECT o.batch_id, o.instrument, count(*) AS orders, count(m.o_order_id) AS orders_reconciled FROM ledger o LEFT JOIN (SELECT DISTINCT batch_id, o_order_id FROM order_matches) m ON m.batch_id = o.batch_id AND m.o_order_id = o.order_id GROUP BY GROUPING SETS ((o.batch_id, o.instrument), (o.batch_id)))
SELECT c.batch_id, COLUMNS gross, fees, gst, net, settlements, orders, orders_reconciled FROM counts c LEFT JOIN money m ON m.batch_id = c.batch_id AND m.instrument IS NOT DISTINCT FROM c.instrument WHERE c.instrument IS """


@query(OUTCOMES + _TOTALS.replace("COLUMNS ", "") + "NULL")
def summary_totals(spark, sf_dir):
    r = recon(spark, sf_dir)
    return summary.totals(r.orders, r.settlements, r.order_matches(assigned=False)).where("instrument IS NULL").drop("instrument")


@query(OUTCOMES + _TOTALS.replace("COLUMNS ", "c.instrument, ") + "NOT NULL")
def summary_by_method(spark, sf_dir):
    r = recon(spark, sf_dir)
    return summary.totals(r.orders, r.settlements, r.order_matches(assigned=False)).where("instrument IS NOT NULL")


@query(""", claims AS (SELECT DISTINCT batch_id, order_id_claimed AS order_id FROM settlements WHERE gross_amount_paise > 0),
a AS (SELECT batch_id, CAST(sum(gross_amount_paise) AS BIGINT) AS total_sales, CAST(coalesce(sum(gross_amount_paise) FILTER ((batch_id, order_id) NOT IN (SELECT batch_id, order_id FROM claims)), 0) AS BIGINT) AS never_settled FROM ledger GROUP BY 1),
b AS (SELECT s.batch_id, CAST(sum(CASE WHEN s.gross_amount_paise < 0 THEN -s.gross_amount_paise ELSE 0 END) AS BIGINT) AS chargebacks,
  CAST(sum(CASE WHEN o.status = 'refunded_partial' THEN s.gross_amount_paise - mdr_paise - gst_on_mdr_paise - net_amount_paise ELSE 0 END) AS BIGINT) AS refunds,
  CAST(sum(mdr_paise) AS BIGINT) AS fees, CAST(sum(gst_on_mdr_paise) AS BIGINT) AS gst,
  CAST(sum(CASE WHEN o.status = 'refunded_partial' THEN 0 ELSE s.gross_amount_paise - mdr_paise - gst_on_mdr_paise - net_amount_paise END) AS BIGINT) AS rounding_drift,
  CAST(sum(CASE WHEN s.gross_amount_paise > 0 AND o.status IS NULL THEN s.gross_amount_paise ELSE 0 END) AS BIGINT) AS orphans, CAST(sum(net_amount_paise) AS BIGINT) AS net_settled
  FROM settlements s LEFT JOIN ledger o ON o.batch_id = s.batch_id AND o.order_id = s.order_id_claimed GROUP BY 1)
SELECT a.*, b.* EXCLUDE (batch_id), net_settled - (total_sales - never_settled - chargebacks - refunds - fees - gst - rounding_drift + orphans) AS other FROM a LEFT JOIN b USING (batch_id)""")  # fmt: skip
def money_bridge(spark, sf_dir):
    found = derive(spark, sf_dir)
    return summary.money_bridge(found.orders, found.settlements)


def _summary_sql(orders: str, settlements: str, leaks: str | None, bank: bool) -> str:
    over = f"""x.*, {'coalesce(l.over, 0)' if leaks else 'CAST(NULL AS BIGINT)'} AS overcharge, {'coalesce(l.gross_over, 0)' if leaks else 'CAST(NULL AS BIGINT)'} AS gross_overcharge, {'CASE WHEN x.instrument IS NULL THEN b.bank END' if bank else 'CAST(NULL AS BIGINT)'} AS bank_received"""
    return f""", ko AS (SELECT o.*, EXISTS (SELECT 1 FROM order_matches m WHERE m.batch_id = o.batch_id AND m.o_order_id = o.order_id) AS matched FROM ledger o),
ks AS (SELECT s.*, o.order_date, o.status, EXISTS (SELECT 1 FROM order_matches m WHERE m.batch_id = s.batch_id AND m.s_id = s.settlement_txn_id) AS matched FROM settlements s LEFT JOIN ledger o ON o.batch_id = s.batch_id AND o.order_id = s.order_id_claimed),
os AS (SELECT batch_id, instrument, count(*) AS orders_total, count(*) FILTER (matched) AS orders_reconciled, CAST(sum(gross_amount_paise) AS BIGINT) AS gross_sales FROM ko WHERE {orders} GROUP BY GROUPING SETS ((batch_id, instrument), (batch_id))),
ss AS (SELECT batch_id, instrument, CAST(sum(mdr_paise) AS BIGINT) AS fees, CAST(sum(gst_on_mdr_paise) AS BIGINT) AS gst, CAST(sum(net_amount_paise) AS BIGINT) AS net_settled FROM ks WHERE {settlements} GROUP BY GROUPING SETS ((batch_id, instrument), (batch_id))),
ls AS (SELECT batch_id, instrument, CAST(sum(leaked) AS BIGINT) AS over, CAST(sum(greatest(leaked, 0)) AS BIGINT) AS gross_over FROM leaks WHERE {leaks or 'true'} GROUP BY GROUPING SETS ((batch_id, instrument), (batch_id))),
bs AS (SELECT batch_id, CAST(sum(credit_amount_paise) AS BIGINT) AS bank FROM credits GROUP BY 1),
xs AS (SELECT coalesce(o.batch_id, s.batch_id) AS batch_id, CASE WHEN o.batch_id IS NULL THEN s.instrument ELSE o.instrument END AS instrument, coalesce(orders_total, 0) AS orders_total, coalesce(orders_reconciled, 0) AS orders_reconciled,
  coalesce(gross_sales, 0) AS gross_sales, coalesce(fees, 0) AS fees, coalesce(gst, 0) AS gst, coalesce(net_settled, 0) AS net_settled FROM os o FULL JOIN ss s ON s.batch_id = o.batch_id AND coalesce(s.instrument, '') = coalesce(o.instrument, ''))
SELECT {over} FROM xs x LEFT JOIN ls l ON l.batch_id = x.batch_id AND l.instrument IS NOT DISTINCT FROM x.instrument LEFT JOIN bs b ON b.batch_id = x.batch_id"""


def _summary(spark: SparkSession, sf_dir: str, filters: summary.Filters) -> DataFrame:
    r = recon(spark, sf_dir)
    leaks = audit.with_leakage(audit.audited(r.orders, r.settlements), C).select("batch_id", "instrument", "leaked")
    return summary.summary(r.orders, r.settlements, r.credits, r.order_matches(assigned=False), leaks, filters)


_LEAKS = AUDIT.removeprefix(", ")
_METHODS, _DATES = "instrument IN ('UPI', 'CARD_CREDIT')", "order_date BETWEEN DATE '1995-03-01' AND DATE '1999-06-30'"


@query(OUTCOMES + ", " + _LEAKS + _summary_sql("true", "true", "true", True))
def summary_whole(spark, sf_dir):
    """Totals with the bank's total and the overcharge, no filter."""
    return _summary(spark, sf_dir, summary.Filters())


@query(OUTCOMES + ", " + _LEAKS + _summary_sql(_METHODS, _METHODS, _METHODS, False))
def summary_of_methods(spark, sf_dir):
    """Under a filter by method the bank's total is unknown."""
    return _summary(spark, sf_dir, summary.Filters(instruments=("UPI", "CARD_CREDIT")))


@query(OUTCOMES + ", " + _LEAKS + _summary_sql(f"{_DATES} AND NOT matched", f"{_DATES} AND NOT matched", None, False))
def summary_of_open(spark, sf_dir):
    """Under a filter by date and status the overcharge is unknown, too, and orphans drop out."""
    return _summary(spark, sf_dir, summary.Filters(date_from="1995-03-01", date_to="1999-06-30", statuses=(summary.EXCEPTION,)))


@query(""", ks AS (SELECT s.*, o.order_date, o.status FROM settlements s LEFT JOIN ledger o ON o.batch_id = s.batch_id AND o.order_id = s.order_id_claimed),
fo AS (SELECT * FROM ledger WHERE F), fs AS (SELECT * FROM ks WHERE F),
claims AS (SELECT DISTINCT batch_id, order_id_claimed AS order_id FROM fs WHERE gross_amount_paise > 0),
a AS (SELECT batch_id, CAST(sum(gross_amount_paise) AS BIGINT) AS total_sales, CAST(coalesce(sum(gross_amount_paise) FILTER ((batch_id, order_id) NOT IN (SELECT batch_id, order_id FROM claims)), 0) AS BIGINT) AS never_settled FROM fo GROUP BY 1),
b AS (SELECT batch_id, CAST(sum(CASE WHEN gross_amount_paise < 0 THEN -gross_amount_paise ELSE 0 END) AS BIGINT) AS chargebacks,
  CAST(sum(CASE WHEN status = 'refunded_partial' THEN gross_amount_paise - mdr_paise - gst_on_mdr_paise - net_amount_paise ELSE 0 END) AS BIGINT) AS refunds, CAST(sum(mdr_paise) AS BIGINT) AS fees, CAST(sum(gst_on_mdr_paise) AS BIGINT) AS gst,
  CAST(sum(CASE WHEN status = 'refunded_partial' THEN 0 ELSE gross_amount_paise - mdr_paise - gst_on_mdr_paise - net_amount_paise END) AS BIGINT) AS rounding_drift,
  CAST(sum(CASE WHEN gross_amount_paise > 0 AND status IS NULL THEN gross_amount_paise ELSE 0 END) AS BIGINT) AS orphans, CAST(sum(net_amount_paise) AS BIGINT) AS net_settled FROM fs GROUP BY 1),
z AS (SELECT l.batch_id, COLUMNS(* EXCLUDE batch_id) FROM (SELECT DISTINCT batch_id FROM ledger) l LEFT JOIN a USING (batch_id) LEFT JOIN b USING (batch_id))
SELECT batch_id, coalesce(total_sales, 0) AS total_sales, coalesce(never_settled, 0) AS never_settled, coalesce(chargebacks, 0) AS chargebacks, coalesce(refunds, 0) AS refunds, coalesce(fees, 0) AS fees, coalesce(gst, 0) AS gst, coalesce(rounding_drift, 0) AS rounding_drift,
  coalesce(orphans, 0) AS orphans, coalesce(net_settled, 0) AS net_settled, coalesce(net_settled - (total_sales - never_settled - chargebacks - refunds - fees - gst - rounding_drift + orphans), 0) AS other FROM z""".replace("WHERE F", f"WHERE {_METHODS} AND {_DATES}").replace("l.batch_id, COLUMNS(* EXCLUDE batch_id)", "*"))
def money_bridge_filtered(spark, sf_dir):
    """The bridge of two methods and some years; it still closes."""
    found = derive(spark, sf_dir)
    return summary.money_bridge(found.orders, found.settlements, None, summary.Filters(instruments=("UPI", "CARD_CREDIT"), date_from="1995-03-01", date_to="1999-06-30"))


# -- lookups


def tools(spark: SparkSession, sf_dir: str) -> catalog.ReconCatalog:
    r = recon(spark, sf_dir)
    return catalog.ReconCatalog(r.orders, r.settlements, r.credits, r.order_matches(assigned=False), r.bank_matches(subsets=False), r.exceptions(assigned=False, bank=False), LIBRARY, C)


@query(OUTCOMES + " SELECT record_type, record_id, reason_code, money_at_risk_paise FROM exceptions WHERE batch_id = '1997' AND money_at_risk_paise >= 100000 ORDER BY money_at_risk_paise DESC, record_id LIMIT 20")
def list_exceptions(spark, sf_dir):
    return tools(spark, sf_dir).list_exceptions("1997", least=100_000, top=20)


@query(OUTCOMES + " SELECT 'order' AS record_type, order_id AS record_id, gross_amount_paise AS amount, (SELECT count(*) FROM order_matches m WHERE m.o_order_id = l.order_id) AS matches, (SELECT count(*) FROM exceptions e WHERE e.record_id = l.order_id) AS exceptions FROM ledger l WHERE order_id = 'ORD-42'")
def get_transaction(spark, sf_dir):
    return tools(spark, sf_dir).get_transaction("ORD-42")


@query(OUTCOMES + " SELECT o_order_id, s_id, match_kind, resolved_by, CAST(rule_id AS BIGINT) AS rule_id, (SELECT count(*) FROM exceptions e WHERE e.record_id = m.s_id) AS exceptions FROM order_matches m WHERE o_order_id = (SELECT min(o_order_id) FROM splits)")
def explain_match(spark, sf_dir):
    """The links of the first order that was paid in parts."""
    r = recon(spark, sf_dir)
    first = r.splits.agg(F.min("o_order_id")).first()[0] or ""
    return tools(spark, sf_dir).explain_match(first).select("o_order_id", "s_id", "match_kind", "resolved_by", "rule_id", "exceptions")


@query(OUTCOMES + " SELECT count(*) AS count_matching, CAST(coalesce(sum(money_at_risk_paise), 0) AS BIGINT) AS total_money_at_risk FROM exceptions WHERE batch_id = '1997' AND money_at_risk_paise >= 100000")
def exception_totals(spark, sf_dir):
    return tools(spark, sf_dir).exception_totals("1997", least=100_000)


@query(OUTCOMES + """ SELECT c.utr, c.credit_amount_paise, coalesce(t.n, 0) AS constituents, coalesce(t.total, 0) AS constituents_total, coalesce(t.total, 0) = c.credit_amount_paise AS reconciles_exactly
FROM credits c LEFT JOIN (SELECT b.utr, count(*) AS n, CAST(sum(s.net_amount_paise) AS BIGINT) AS total FROM bank_matches b JOIN settlements s ON s.settlement_txn_id = b.s_id GROUP BY b.utr) t USING (utr)""")
def traced_credits(spark, sf_dir):
    return tools(spark, sf_dir).traced_totals()


@query(" SELECT batch_id, max(k) AS run_id, arg_max(gross_amount_paise, k) AS money FROM keyed GROUP BY batch_id")
def latest_runs(spark, sf_dir):
    """The last of each batch's runs, an order standing for a run."""
    runs = derive(spark, sf_dir).orders.select("batch_id", F.expr("cast(substring(order_id, 5) as bigint)").alias("run_id"), F.col("gross_amount_paise").alias("money"))
    return scoring.latest_runs(runs)


@query(" SELECT count(*) AS transactions, CAST(coalesce(sum(mdr_paise), 0) AS BIGINT) AS mdr, CAST(coalesce(sum(gst_on_mdr_paise), 0) AS BIGINT) AS gst, CAST(coalesce(sum(gross_amount_paise), 0) AS BIGINT) AS gross, CAST(coalesce(sum(net_amount_paise), 0) AS BIGINT) AS net FROM settlements WHERE settled_date BETWEEN DATE '1997-03-01' AND DATE '1997-05-31' AND instrument = 'CARD_CREDIT'")
def sum_fees(spark, sf_dir):
    return tools(spark, sf_dir).sum_fees("1997-03-01", "1997-05-31", "CARD_CREDIT")


@query(OUTCOMES + " SELECT b.utr, s.settlement_txn_id, s.order_id_claimed, s.net_amount_paise FROM bank_matches b JOIN settlements s ON s.settlement_txn_id = b.s_id WHERE b.utr = (SELECT min(utr) FROM bank_matches)")
def trace_bulk_credit(spark, sf_dir):
    found = tools(spark, sf_dir)
    first = found.bank_matches.agg(F.min("utr").alias("utr"))
    return found.trace_all().join(F.broadcast(first), "utr", "left_semi")  # one row


@query(f"{_RULED_SQL} SELECT CAST(rule_id AS BIGINT) AS rule_id, rule_type, scope AS scope_instrument, CAST(priority AS BIGINT) AS priority, CASE WHEN rule_type = 'fee_formula' THEN 'For ' || CASE scope WHEN 'ALL' THEN 'every instrument' ELSE scope END || ', the fee is a flat ' || flat || ' paise plus 0% tax, within ' || tolerance || ' paise.' ELSE 'For ' || CASE scope WHEN 'ALL' THEN 'every instrument' ELSE scope END || ', money arrives ' || lo || ' to ' || hi || ' working days after the order.' END AS meaning FROM library", base=False)
def learned_rules(spark, sf_dir):
    found = tools(spark, sf_dir)
    found.rules = _library(spark, sf_dir)
    return found.list_learned_rules().select("rule_id", "rule_type", "scope_instrument", "priority", "meaning")


@query(OUTCOMES + " SELECT batch_id, reason_code, count(*) AS events, CAST(sum(money_at_risk_paise) AS BIGINT) AS money, row_number() OVER (PARTITION BY batch_id ORDER BY count(*) DESC, reason_code) AS place FROM exceptions GROUP BY batch_id, reason_code")
def exception_activity(spark, sf_dir):
    rows = recon(spark, sf_dir).exceptions(assigned=False, bank=False).groupBy("batch_id", "reason_code").agg(F.count("*").alias("events"), F.sum("money_at_risk_paise").alias("money"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("events"), "reason_code")))


@query(f"SELECT decision AS event, count(*) AS events FROM ({ORACLE_SQL['promotion_gate']}) GROUP BY decision", base=False)
def rule_activity(spark, sf_dir):
    """Audit events by kind, of all the gate's decisions."""
    return _decided(spark, sf_dir).groupBy(F.col("decision").alias("event")).agg(F.count("*").alias("events"))


@query(ORACLE_SQL["score_batch"].removeprefix(BASE).replace("SELECT t.batch_id, CASE", "SELECT t.batch_id, row_number() OVER (ORDER BY CAST(t.batch_id AS INTEGER)) AS place, CASE"))
def learning_curve(spark, sf_dir):
    """Scores of the numbered batches in order."""
    curve = scoring.learning_curve(QUERIES["score_batch"](spark, sf_dir))
    return curve.withColumn("place", F.row_number().over(Window.orderBy(F.col("batch_id").cast("int"))))  # a row for each batch


@query(OUTCOMES + """, wrong AS (SELECT m.s_id FROM order_matches m JOIN keyed k ON k.order_id = m.o_order_id WHERE k.k % 50 = 20)
SELECT t.case_type, count(*) AS false_positives FROM wrong w LEFT JOIN (SELECT DISTINCT settlement_txn_id, case_type FROM truth) t ON t.settlement_txn_id = w.s_id GROUP BY t.case_type""")
def false_positives_by_case(spark, sf_dir):
    """Wrong links planted on every fiftieth order, counted by what they really are."""
    r = recon(spark, sf_dir)
    k = F.regexp_extract("o_order_id", r"\d+", 0).try_cast("bigint")
    planted = r.order_matches(assigned=False).where(k % 50 == 20).select("batch_id", F.lit("order").alias("kind"), F.lit("ORD-none").alias("left_id"), F.col("s_id").alias("right_id"))
    return scoring.false_positives_by_case(planted, derive(spark, sf_dir).truth)


@query(" SELECT batch_id, min(order_date) AS first_order, max(order_date) AS last_order, count(DISTINCT instrument) AS instruments FROM ledger GROUP BY batch_id")
def order_ranges(spark, sf_dir):
    rows = derive(spark, sf_dir).orders
    return rows.groupBy("batch_id").agg(F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"), F.count_distinct("instrument").alias("instruments"))
