"""Registered loyalty queries with their oracle SQL."""

from __future__ import annotations

from comanda.operators import customers
from comanda.operators import loyalty as ops
from comanda.plans.base import BEFORE, NOW, TODAY, add, inside, pct

SOURCES = (" 2-HIGH ", "", "all", "5-LOW", "2-HIGH")
F_ = ops.Filters(*NOW, *BEFORE)
F_SOURCES = ops.Filters(*NOW, back_days=60, sources=SOURCES)
F_RETAIN = ops.Filters(*NOW, *BEFORE, min_orders=1)
_60 = F_SOURCES.lookback


def _counts(back: tuple[str, str], where: str = "true") -> str:
    return f"""k AS (SELECT customer_id, min(name) AS name, count(*) FILTER (WHERE {inside(NOW)}) AS n, count(*) FILTER (WHERE {inside(back)}) AS b, round(coalesce(sum(total) FILTER (WHERE {inside(NOW)}), 0.0), 2) AS spend,
CAST(min(bd) FILTER (WHERE {inside(NOW)}) AS VARCHAR) AS first_day, CAST(max(bd) FILTER (WHERE {inside(NOW)}) AS VARCHAR) AS last_day FROM vo WHERE {where} GROUP BY 1)"""


_TWO = "order_from IN ('2-HIGH', '5-LOW')"
_RETURN = """SELECT customer_id, name, n AS evaluation_orders, b AS lookback_orders, spend AS evaluation_spend, first_day, last_day, CAST(n >= 2 AS INTEGER) AS by_repeat, CAST(b > 0 AS INTEGER) AS by_lookback, CAST(n >= 2 OR b > 0 AS INTEGER) AS is_returning,
CASE WHEN n >= 2 OR b > 0 THEN 'Returning' ELSE 'New' END AS status, CASE WHEN n >= 2 AND b > 0 THEN 'Repeat in evaluation window and ordered in lookback window' WHEN n >= 2 THEN 'Repeat in evaluation window' WHEN b > 0 THEN 'Ordered in lookback window' ELSE 'First-time within selected windows' END AS reason FROM k WHERE n > 0"""
_RETURN_SUM = f"""SELECT count(*) AS customers, count(*) FILTER (WHERE n >= 2 OR b > 0) AS returning, {pct('count(*) FILTER (WHERE n >= 2 OR b > 0)', 'count(*)')} AS return_rate, count(*) FILTER (WHERE NOT (n >= 2 OR b > 0)) AS new,
count(*) FILTER (WHERE n >= 2) AS by_repeat, count(*) FILTER (WHERE b > 0) AS by_lookback, count(*) FILTER (WHERE n >= 2 AND b > 0) AS by_both FROM k WHERE n > 0"""
add("A20_return_rows", lambda s: ops.return_analysis(s, F_), f", {_counts(BEFORE)} {_RETURN}")
add("A20_return_rows_by_source", lambda s: ops.return_analysis(s, F_SOURCES), f", {_counts(_60, _TWO)} {_RETURN}")
add("A20_return_summary", lambda s: ops.return_summary(s, F_), f", {_counts(BEFORE)} {_RETURN_SUM}")
add("F4_return_summary_by_source", lambda s: ops.return_summary(s, F_SOURCES), f", {_counts(_60, _TWO)} {_RETURN_SUM}")
add(
    "A20_retention_rows", lambda s: ops.retention_analysis(s, F_RETAIN),
    f""", {_counts(BEFORE)} SELECT customer_id, name, b AS lookback_orders, n AS evaluation_orders, spend AS evaluation_spend, first_day, last_day, CAST(n >= 1 AS INTEGER) AS is_retained, CASE WHEN n >= 1 THEN 'Retained' ELSE 'Not Retained' END AS status,
CASE WHEN n = 0 THEN 'No orders in evaluation window' ELSE 'Met the 1+ order threshold' END AS reason FROM k WHERE b > 0""",
)
add("A20_retention_summary", lambda s: ops.retention_summary(s, F_RETAIN), f", {_counts(BEFORE)} SELECT count(*) AS cohort, count(*) FILTER (WHERE n >= 1) AS retained, {pct('count(*) FILTER (WHERE n >= 1)', 'count(*)')} AS retention_rate, count(*) FILTER (WHERE n = 0) AS not_retained FROM k WHERE b > 0")
add(
    "A20_repeat_rows", lambda s: ops.repeat_analysis(s, F_),
    f""", {_counts(BEFORE)} SELECT customer_id, name, n AS evaluation_orders, spend AS evaluation_spend, first_day, last_day, CAST(n >= 2 AS INTEGER) AS is_repeat, CASE WHEN n >= 2 THEN 'Repeat' ELSE 'Single Order' END AS status,
CASE WHEN n >= 2 THEN 'Met the 2+ order threshold' ELSE 'Below the selected repeat-order threshold' END AS reason FROM k WHERE n > 0""",
)
add("A20_repeat_summary", lambda s: ops.repeat_summary(s, F_), f", {_counts(BEFORE)} SELECT count(*) AS customers, count(*) FILTER (WHERE n >= 2) AS repeating, {pct('count(*) FILTER (WHERE n >= 2)', 'count(*)')} AS repeat_rate, count(*) FILTER (WHERE n < 2) AS single FROM k WHERE n > 0")
add("A15_orders_in_window", lambda s: ops.orders_per_customer(s, *NOW), f"SELECT customer_id, count(*) AS num_orders FROM vo WHERE {inside(NOW)} GROUP BY 1")
add(
    "A2_customer_estimate", ops.estimated_customers,
    """, z AS (SELECT count(*) AS orders, count(*) FILTER (WHERE is_verified) AS verified_orders, count(DISTINCT customer_id) FILTER (WHERE is_verified) AS verified_customers FROM ok LEFT JOIN c USING (customer_id))
SELECT orders, verified_orders, verified_customers, CAST(round_even(verified_customers + (orders - verified_orders) / (1.0::DOUBLE * verified_orders / verified_customers), 0) AS BIGINT) AS low, CAST(round_even(verified_customers + (orders - verified_orders) / (0.8::DOUBLE * verified_orders / verified_customers), 0) AS BIGINT) AS high FROM z""",
)
add("A31_returning_lookup", lambda s: ops.was_customer_before(s, 17, TODAY), f"SELECT count(*) > 0 AS returning FROM ok WHERE customer_id = 17 AND bd < DATE '{TODAY}'")


def _seg(prior: str, start: str) -> str:
    return f"CASE WHEN {prior} IS NULL OR datediff('day', {prior}, {start}) >= 365 THEN 'New' WHEN datediff('day', {prior}, {start}) <= 60 THEN 'Repeat' ELSE 'Lapsed' END"


_SEGS = ", ".join([f"count(*) FILTER (WHERE segment = '{s}') AS {s.lower()}" for s in ("New", "Repeat", "Lapsed")] + [f"{pct(f'''count(*) FILTER (WHERE segment = '{s}')''', 'count(*)')} AS {s.lower()}_pct" for s in ("New", "Repeat", "Lapsed")])
_AFF = lambda p: f"af AS (SELECT customer_id, min(name) AS name, count(*) FILTER (WHERE {inside(p)}) AS n, round(sum(total) FILTER (WHERE {inside(p)}), 2) AS spend, min(bd) FILTER (WHERE {inside(p)}) AS a, max(bd) FILTER (WHERE {inside(p)}) AS z, max(bd) FILTER (WHERE bd < DATE '{p[0]}') AS prior FROM vo GROUP BY 1), sg AS (SELECT *, {_seg('prior', f'''DATE '{p[0]}' ''')} AS segment FROM af WHERE n > 0)"
add("A21_affinity_rows", lambda s: ops.affinity_rows(s, *NOW), f", {_AFF(NOW)} SELECT customer_id, name, segment, n AS evaluation_orders, spend AS evaluation_spend, CAST(a AS VARCHAR) AS first_day, CAST(z AS VARCHAR) AS last_day, CAST(prior AS VARCHAR) AS prior_day, CAST(datediff('day', prior, DATE '{NOW[0]}') AS INTEGER) AS gap_days FROM sg")
_LAST = ops.month_of(TODAY, 1)
add("A22_last_month_affinity", lambda s: ops.last_month_affinity(s, TODAY), f", {_AFF(_LAST)} SELECT '{_LAST[0][:7]}' AS period, count(*) AS customers, {_SEGS} FROM sg")
_M0, _M1, _M2 = (ops.month_of(TODAY, k) for k in range(3))
_RET = {k: f"n > 0 AND (n >= 2 OR {c} > 0)" for k, c in (("one_month", "n1"), ("two_month", "n2"), ("lifetime", "ever"))}
_n = lambda c: f"count(*) FILTER (WHERE {c})"
add(
    "A25_customer_quick_view", lambda s: ops.quick_view(s, TODAY),
    f""", e AS (SELECT customer_id, count(*) FILTER (WHERE {inside(_M0)}) AS n, count(*) FILTER (WHERE {inside(_M1)}) AS n1, count(*) FILTER (WHERE bd BETWEEN DATE '{_M2[0]}' AND DATE '{_M1[1]}') AS n2, count(*) FILTER (WHERE bd < DATE '{_M0[0]}') AS ever,
max(bd) FILTER (WHERE bd < DATE '{_M1[0]}') AS prior FROM vo GROUP BY 1), g AS (SELECT *, {_seg('prior', f'''DATE '{_M1[0]}' ''')} AS segment FROM e)
SELECT {_n('n > 0')} AS customers_this_month, {_n('n1 > 0')} AS customers_last_month, {_n('n2 > 0')} AS customers_two_months, {', '.join(f'{_n(c)} AS returning_{k}, {pct(_n(c), _n("n > 0"))} AS return_rate_{k}' for k, c in _RET.items())},
{_n('n > 0 AND n1 > 0')} AS retained_one_month, {_n('n > 0 AND n2 > 0')} AS retained_two_month, {pct(_n('n > 0 AND n1 > 0'), _n('n1 > 0'))} AS retention_rate_one_month, {pct(_n('n > 0 AND n2 > 0'), _n('n2 > 0'))} AS retention_rate_two_month,
{pct(_n('n >= 2'), _n('n > 0'))} AS repeat_rate_this_month, {pct(_n('n1 >= 2'), _n('n1 > 0'))} AS repeat_rate_last_month,
{', '.join(f'''{_n(f"n1 > 0 AND segment = '{x}'")} AS affinity_{x.lower()}, {pct(_n(f"n1 > 0 AND segment = '{x}'"), _n('n1 > 0'))} AS affinity_{x.lower()}_pct''' for x in ('New', 'Repeat', 'Lapsed'))} FROM g""",
)
_MONTHS = f"mo AS (SELECT start, strftime(start, '%Y-%m') AS month, least(last_day(start), DATE '{TODAY}') AS fin FROM (SELECT CAST(unnest(generate_series(DATE '1997-10-01', DATE '1998-03-01', INTERVAL 1 MONTH)) AS DATE) AS start))"
_EACH = f"ea AS (SELECT start, month, fin, customer_id, count(*) FILTER (WHERE bd BETWEEN start AND fin) AS n, max(bd) FILTER (WHERE bd < start) AS prior FROM mo, vo WHERE bd <= fin GROUP BY 1, 2, 3, 4)"
_HEAD = "month, CAST(start AS VARCHAR) AS first_day, CAST(fin AS VARCHAR) AS last_day"
_BACK = {"30d": "datediff('day', prior, start) <= 30", "60d": "datediff('day', prior, start) <= 60", "lifetime": "prior IS NOT NULL"}
add("A26_affinity_trend", lambda s: ops.affinity_trend(s, TODAY), f", {_MONTHS}, {_EACH}, sg AS (SELECT *, {_seg('prior', 'start')} AS segment FROM ea WHERE n > 0) SELECT {_HEAD}, count(*) AS customers, {_SEGS} FROM sg GROUP BY month, start, fin")
add("A26_return_trend", lambda s: ops.return_trend(s, TODAY), f", {_MONTHS}, {_EACH} SELECT {_HEAD}, count(*) AS customers, {', '.join(f'{_n(f"n >= 2 OR {b}")} AS returning_{k}, {pct(_n(f"n >= 2 OR {b}"), "count(*)")} AS return_rate_{k}' for k, b in _BACK.items())} FROM ea WHERE n > 0 GROUP BY month, start, fin")
add("A26_retention_trend", lambda s: ops.retention_trend(s, TODAY), f", {_MONTHS}, {_EACH} SELECT {_HEAD}, {', '.join(f'{_n(b)} AS cohort_{k}, {_n(f"n >= 1 AND {b}")} AS retained_{k}, {pct(_n(f"n >= 1 AND {b}"), _n(b))} AS retention_rate_{k}' for k, b in _BACK.items())} FROM ea GROUP BY month, start, fin")
add("A26_repeat_trend", lambda s: ops.repeat_trend(s, TODAY), f", {_MONTHS}, {_EACH} SELECT {_HEAD}, count(*) AS customers, {_n('n >= 2')} AS repeating, {pct(_n('n >= 2'), 'count(*)')} AS repeat_rate FROM ea WHERE n > 0 GROUP BY month, start, fin")
_LOYAL = "lo AS (SELECT strftime(bd, '%Y-%m') AS month, count(DISTINCT customer_id) AS customers, count(DISTINCT customer_id) FILTER (WHERE r > 1) AS again FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_on, order_id) AS r FROM vo) GROUP BY 1 ORDER BY 1 DESC LIMIT 3)"
add("A24_trailing_customers", lambda s: ops.trailing_reorder(s, customers.monthly_loyalty(s)), f", {_LOYAL} SELECT CAST(round(avg(customers)) AS BIGINT) AS customers, CAST(round(avg(again)) AS BIGINT) AS returning, {pct('sum(again)', 'sum(customers)')} AS reorder_rate, (SELECT count(*) FROM c WHERE is_verified) AS verified_customers FROM lo")
