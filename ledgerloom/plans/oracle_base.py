"""The derivation recipe of ``sources/derive.py`` as SQL, to put before an oracle query."""


def rate_sql(amount: str, rate: str) -> str:
    return f"CAST(round_even(CAST({amount} AS DECIMAL(19,0)) * CAST({rate} AS DECIMAL(18,12)), 0) AS BIGINT)"


def before_sql(day: str) -> str:
    """Weekdays from Monday 1990-01-01 to the day before."""
    n = f"datediff('day', DATE '1990-01-01', {day})"
    return f"(5 * ({n} // 7) + least({n} % 7, 5))"


def lag_sql(start: str, end: str) -> str:
    return f"({before_sql(end)} - {before_sql(start)})"


BASE = f"""
WITH keyed AS (
  SELECT o_orderkey AS k, o_orderkey % 100 AS c, CAST(year(o_orderdate) AS VARCHAR) AS batch_id, 'ORD-' || o_orderkey AS order_id,
    CAST(o_custkey AS VARCHAR) AS customer_name, CAST(o_orderdate AS DATE) AS order_date, CAST(round(o_totalprice * 100) AS BIGINT) AS gross_amount_paise,
    ['UPI', 'CARD_DEBIT', 'CARD_CREDIT', 'NETBANKING'][o_custkey % 4 + 1] AS instrument,
    CASE WHEN o_orderkey % 100 BETWEEN 5 AND 6 THEN 'refunded_full' WHEN o_orderkey % 100 BETWEEN 7 AND 10 THEN 'refunded_partial' ELSE 'captured' END AS status,
    isodow(o_orderdate) - 1 AS wd
  FROM orders),
ledger AS (SELECT order_id, batch_id, customer_name, order_date, gross_amount_paise, instrument, status FROM keyed),
legged AS (
  SELECT *, 'A' AS leg, (2 * gross_amount_paise) // 5 AS g, 0 AS extra, 1 AS sgn FROM keyed WHERE c BETWEEN 11 AND 14
  UNION ALL SELECT *, 'B', CASE WHEN c = 14 THEN gross_amount_paise // 4 ELSE gross_amount_paise - (2 * gross_amount_paise) // 5 END, 7, 1 FROM keyed WHERE c BETWEEN 11 AND 14
  UNION ALL SELECT *, 'C', gross_amount_paise - (2 * gross_amount_paise) // 5 - gross_amount_paise // 4, 14, 1 FROM keyed WHERE c = 14
  UNION ALL SELECT *, 'O', gross_amount_paise, CASE WHEN c = 19 THEN 7 ELSE 0 END, 1 FROM keyed WHERE c BETWEEN 7 AND 10 OR c > 14
  UNION ALL SELECT *, 'CB', gross_amount_paise, 14, -1 FROM keyed WHERE c = 17),
charged AS (
  SELECT *, CASE instrument WHEN 'UPI' THEN 0
    WHEN 'CARD_DEBIT' THEN {rate_sql("g", "CASE WHEN batch_id = '2001' THEN '0.0095' ELSE '0.009' END")}
    WHEN 'CARD_CREDIT' THEN {rate_sql("g", "CASE WHEN batch_id = '2001' THEN '0.021' ELSE '0.02' END")}
    ELSE CASE WHEN batch_id = '2001' THEN 1300 ELSE 1200 END END AS mdr,
    order_date + CAST(extra + CASE WHEN instrument = 'UPI' THEN CASE WHEN wd <= 3 THEN 1 WHEN wd <= 5 THEN 3 ELSE 2 END
      ELSE CASE WHEN wd <= 2 THEN 2 WHEN wd <= 5 THEN 4 ELSE 3 END END AS INTEGER) AS settled_date
  FROM legged),
taxed AS (SELECT *, {rate_sql("mdr", "'0.18'")} AS gst FROM charged),
settlements AS (
  SELECT CASE WHEN leg = 'CB' THEN 'CB-' || k ELSE 'STL-' || k || '-' || leg END AS settlement_txn_id, batch_id,
    CASE WHEN c = 18 THEN 'GHOST-' || k ELSE order_id END AS order_id_claimed, settled_date,
    CAST(sgn * g AS BIGINT) AS gross_amount_paise, CAST(sgn * mdr AS BIGINT) AS mdr_paise, CAST(sgn * gst AS BIGINT) AS gst_on_mdr_paise,
    CAST(sgn * (g - mdr - gst - CASE WHEN c BETWEEN 7 AND 10 THEN gross_amount_paise // 4 ELSE 0 END - CASE WHEN c BETWEEN 15 AND 16 THEN 2 ELSE 0 END) AS BIGINT) AS net_amount_paise,
    'SB-' || batch_id || '-' || strftime(settled_date, '%Y%m%d') AS settlement_batch_id, instrument, k, c
  FROM taxed),
credits AS (
  SELECT 'UTR-' || settlement_batch_id AS utr, batch_id, min(settled_date) AS credit_date,
    CAST(sum(net_amount_paise) - CASE WHEN day(min(settled_date)) = 13 THEN arg_max(net_amount_paise, settlement_txn_id) ELSE 0 END AS BIGINT) AS credit_amount_paise
  FROM settlements GROUP BY batch_id, settlement_batch_id),
cases AS (
  SELECT *, CASE WHEN c <= 4 THEN 'missing_settlement' WHEN c <= 6 THEN 'full_refund' WHEN c <= 10 THEN 'partial_refund' WHEN c <= 14 THEN 'split_settlement'
    WHEN c <= 16 THEN 'rounding_drift' WHEN c = 17 THEN 'chargeback_reversal' WHEN c = 18 THEN 'orphan_settlement' ELSE 'clean' END AS case_type FROM keyed),
truth AS (
  SELECT s.batch_id, CASE WHEN s.c = 18 THEN 'ORPHAN' ELSE o.order_id END AS order_id, s.settlement_txn_id, 'UTR-' || s.settlement_batch_id AS utr, o.case_type
  FROM settlements s JOIN cases o ON o.k = s.k
  UNION ALL SELECT batch_id, order_id, 'UNSETTLED', NULL, case_type FROM cases WHERE c <= 6 OR c = 18)
"""
