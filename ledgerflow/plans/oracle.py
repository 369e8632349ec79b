"""SQL equivalents of the registered queries, runnable by DuckDB.

The tables of the test folder are visible as views under their own names.
Money (doubles) is cast to DECIMAL(38,8) per row and totals are rounded to
DECIMAL(38,2), as in the Spark operators; NULL placement is written out because the engines'
defaults differ.
"""

from __future__ import annotations

_MONEY_TOTAL = "CAST(ROUND(SUM(CAST({col} AS DECIMAL(38,8))), 2) AS DECIMAL(38,2))"

# Replica of the synced tables: keys up to the middle of the key range.
_MIDDLE = "(SELECT (MIN(event_id) + MAX(event_id)) // 2 FROM events)"
_REPLICA_EVENTS = f"(SELECT * FROM events WHERE event_id <= {_MIDDLE})"
_REPLICA_ORDERS = (
    "(SELECT * FROM orders WHERE o_orderkey <= (SELECT (MIN(o_orderkey) + MAX(o_orderkey)) // 2 FROM orders))"
)

_MONTHLY_REVENUE = f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month,
       {_MONEY_TOTAL.format(col="o_totalprice")} AS revenue,
       COUNT(o_orderkey) AS payment_count
FROM orders
GROUP BY 1
ORDER BY month ASC NULLS LAST
"""

_TOP_CUSTOMERS = f"""
SELECT c.c_name || ' ' || c.c_mktsegment AS customer_name,
       {_MONEY_TOTAL.format(col="o.o_totalprice")} AS total_spent,
       COUNT(o.o_orderkey) AS rental_count,
       c.c_name AS email
FROM customer c
JOIN orders o ON c.c_custkey = o.o_custkey
GROUP BY c.c_custkey, c.c_name, c.c_mktsegment
ORDER BY total_spent DESC NULLS FIRST, c.c_custkey ASC NULLS LAST, c.c_name ASC NULLS LAST,
         c.c_mktsegment ASC NULLS LAST
LIMIT 10
"""

_WATERMARK = f"(SELECT COALESCE(MAX(event_id), -1) FROM {_REPLICA_EVENTS} r)"

_EVENTS_ALL = "SELECT event_id, ts, user_id, event_type, value, props FROM events"

# A target that keeps the replica's rows, with the given value for new keys.
_SYNCED = (
    "SELECT event_id, ts, user_id, CASE WHEN event_id <= {middle} THEN 'replica' ELSE event_type END AS event_type, "
    "CASE WHEN event_id <= {middle} THEN value + 1000 ELSE {new} END AS value, props FROM events"
)

_STATUS_COUNTS = f"""
SELECT 'online' AS source_status,
       (SELECT COUNT(*) FROM customer) AS source_customers,
       (SELECT COUNT(*) FROM events) AS source_rentals,
       (SELECT COUNT(*) FROM orders) AS source_payments,
       (SELECT COUNT(*) FROM part) AS source_films,
       'online' AS replica_status,
       (SELECT COUNT(*) FROM customer) AS replica_customers,
       (SELECT COUNT(*) FROM {_REPLICA_EVENTS} e) AS replica_rentals,
       (SELECT COUNT(*) FROM {_REPLICA_ORDERS} o) AS replica_payments,
       (SELECT COUNT(*) FROM part) AS replica_films,
       CAST(NULL AS VARCHAR) AS source_error,
       CAST(NULL AS VARCHAR) AS replica_error
"""

ORACLE_SQL: dict[str, str] = {
    "overview_totals": f"""
SELECT (SELECT COUNT(*) FROM customer) AS total_customers,
       (SELECT COUNT(*) FROM part) AS total_films,
       (SELECT COUNT(*) FROM lineitem) AS total_rentals,
       (SELECT {_MONEY_TOTAL.format(col="o_totalprice")} FROM orders) AS total_revenue,
       (SELECT COUNT(*) FROM supplier) AS total_actors,
       (SELECT COUNT(*) FROM orders) AS total_inventory,
       'primary' AS data_source
""",
    "top_items": """
SELECT c.c_name AS film_title,
       r.r_name AS category,
       COUNT(l.l_orderkey) AS rental_count,
       c.c_acctbal AS rental_rate
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN orders o ON c.c_custkey = o.o_custkey
JOIN lineitem l ON o.o_orderkey = l.l_orderkey
GROUP BY c.c_custkey, c.c_name, r.r_name, c.c_acctbal
ORDER BY rental_count DESC NULLS FIRST, c.c_custkey ASC NULLS LAST, r.r_name ASC NULLS LAST,
         c.c_name ASC NULLS LAST, c.c_acctbal ASC NULLS LAST
LIMIT 10
""",
    "top_customers": _TOP_CUSTOMERS,
    "monthly_revenue": _MONTHLY_REVENUE,
    "monthly_revenue_partitioned": _MONTHLY_REVENUE,
    "monthly_revenue_refreshed": _MONTHLY_REVENUE,
    "high_watermark": f"SELECT {_WATERMARK} AS high_watermark",
    "incremental_batch": f"""
{_EVENTS_ALL}
WHERE event_id > {_WATERMARK}
ORDER BY event_id
LIMIT 100
""",
    "parameterised_batch": f"""
{_EVENTS_ALL}
WHERE event_id > {_WATERMARK}
ORDER BY event_id
LIMIT 100
""",
    "insert_if_absent": _SYNCED.format(middle=_MIDDLE, new="CASE WHEN event_id % 3 = 0 THEN value - 1 ELSE value END"),
    "insert_keyed": _SYNCED.format(middle=_MIDDLE, new="CASE WHEN event_id % 3 = 0 THEN value - 1 ELSE value END"),
    "batch_edges": f"""
WITH backlog AS (
    SELECT event_id, COUNT(*) * CASE WHEN event_id % 3 < 2 THEN 2 ELSE 1 END AS n
    FROM events WHERE event_id > {_WATERMARK} GROUP BY event_id
),
placed AS (
    SELECT event_id, n, COALESCE(SUM(n) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 100 AS batch
    FROM backlog
)
SELECT CAST(batch AS BIGINT) AS batch, MIN(event_id) AS first_key, MAX(event_id) AS last_key, CAST(SUM(n) AS BIGINT) AS "rows"
FROM placed GROUP BY batch
""",
    "sync_converged": _SYNCED.format(middle=_MIDDLE, new="value"),
    "sync_log": f"""
WITH span AS (SELECT MIN(event_id) AS low, MAX(event_id) AS high FROM events),
landed AS (
    SELECT event_id, event_id > {_MIDDLE} AS fresh,
           CASE WHEN event_id < low + (high + 1 - low) // 3 THEN 0
                WHEN event_id < low + (high + 1 - low) * 2 // 3 THEN 1 ELSE 2 END AS cycle
    FROM events, span
),
batches AS (
    SELECT cycle, COUNT(*) AS found, MIN(event_id) AS first_key, MAX(event_id) AS last_key,
           COUNT(*) FILTER (WHERE fresh) AS inserted
    FROM landed GROUP BY cycle
),
counted AS (
    SELECT *, CAST(SUM(found) OVER (ORDER BY cycle) AS BIGINT) AS source_count,
           CAST((SELECT COUNT(*) FROM {_REPLICA_EVENTS} r) + SUM(inserted) OVER (ORDER BY cycle) AS BIGINT) AS target_count
    FROM batches
)
SELECT CAST(cycle AS BIGINT) AS cycle, found, first_key, last_key, inserted, last_key AS watermark,
       source_count, target_count, source_count - target_count AS remaining_lag
FROM counted
""",
    "sync_retried": """
SELECT event_id % 3 AS cycle, MAX(event_id) AS last_key,
       CAST(CASE WHEN event_id % 3 = 1 THEN 2 ELSE 0 END AS BIGINT) AS failures,
       CASE WHEN event_id % 3 = 1 THEN 'ConnectionError: source is away' END AS error,
       (SELECT COUNT(*) FROM events) AS target_rows
FROM events GROUP BY event_id % 3
""",
    "sync_cycles": f"""
SELECT CAST(1 AS BIGINT) AS cycle,
       COUNT(*) AS found,
       MIN(event_id) AS first_key,
       MAX(event_id) AS last_key,
       COUNT(*) AS inserted,
       MAX(event_id) AS watermark,
       (SELECT COUNT(*) FROM events) AS source_count,
       (SELECT COUNT(*) FROM events) AS target_count,
       CAST(0 AS BIGINT) AS remaining_lag
FROM events
WHERE event_id > (SELECT MAX(event_id) FROM {_REPLICA_EVENTS} r)
UNION ALL
SELECT CAST(2 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT),
       (SELECT MAX(event_id) FROM events), (SELECT COUNT(*) FROM events), (SELECT COUNT(*) FROM events),
       CAST(0 AS BIGINT)
""",
    "sync_status": f"""
SELECT s.*,
       source_customers - replica_customers AS lag_customers,
       source_rentals - replica_rentals AS lag_rentals,
       source_payments - replica_payments AS lag_payments,
       source_films - replica_films AS lag_films,
       CASE WHEN source_customers = replica_customers AND source_rentals = replica_rentals
                 AND source_payments = replica_payments AND source_films = replica_films
            THEN 'IN_SYNC' ELSE 'LAG_DETECTED' END AS overall_status
FROM ({_STATUS_COUNTS}) s
""",
    "status_document": f"""
SELECT CAST(to_json({{
           'source': {{'status': source_status, 'customers': source_customers, 'rentals': source_rentals,
                       'payments': source_payments, 'films': source_films, 'error': source_error}},
           'replica': {{'status': replica_status, 'customers': replica_customers, 'rentals': replica_rentals,
                        'payments': replica_payments, 'films': replica_films, 'error': replica_error}},
           'sync_lag': {{'customers': source_customers - replica_customers, 'rentals': source_rentals - replica_rentals,
                         'payments': source_payments - replica_payments, 'films': source_films - replica_films}},
           'overall_status': CASE WHEN source_customers = replica_customers AND source_rentals = replica_rentals
                                       AND source_payments = replica_payments AND source_films = replica_films
                                  THEN 'IN_SYNC' ELSE 'LAG_DETECTED' END}}) AS VARCHAR) AS value
FROM ({_STATUS_COUNTS}) s
""",
    "ha_status": f"SELECT *, 'NORMAL' AS ha_status FROM ({_STATUS_COUNTS}) s",
    "fallback_source": f"""
SELECT m.*, 'fallback' AS data_source FROM ({_MONTHLY_REVENUE}) m
""",
    "json_rows": f"""
SELECT CAST(json_object('month', month, 'revenue', CAST(revenue AS VARCHAR),
                        'payment_count', payment_count) AS VARCHAR) AS value
FROM ({_MONTHLY_REVENUE}) m
""",
    "json_document": f"""
SELECT CAST(to_json({{
           'data': list({{'customer_name': customer_name,
                         'email': email,
                         'total_spent': CAST(total_spent AS VARCHAR),
                         'rental_count': rental_count}} ORDER BY place),
           'data_source': 'primary'}}) AS VARCHAR) AS value
FROM (SELECT *, row_number() OVER () AS place FROM ({_TOP_CUSTOMERS}) t) t
""",
}
