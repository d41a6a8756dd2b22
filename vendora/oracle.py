"""DuckDB oracle SQL for every registered report.

Each oracle query is the report written plainly in SQL over the same nine
tables, derived from the raw testdata views by the CTE prefix below (the SQL
twin of ``vendora.sources.adapter``; the marketplace orders table is named
``orders_m`` because ``orders`` is the raw table). Rounding uses the same exact
integer formula as ``vendora.functions.exact`` so both engines agree digit for
digit.
"""

from __future__ import annotations

ADAPTER_CTES = """
customers AS (
  SELECT concat('C', CAST(o.o_orderkey AS VARCHAR)) AS customer_id,
    concat('U', CAST(CASE WHEN o.o_orderkey % 4 = 0 THEN o.o_custkey ELSE 1000000000 + o.o_orderkey END AS VARCHAR)) AS customer_unique_id,
    lpad(CAST(c.c_custkey % 1000 AS VARCHAR), 5, '0') AS customer_zip_code,
    c.c_mktsegment AS customer_city, lpad(CAST(c.c_nationkey AS VARCHAR), 2, '0') AS customer_state
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
geolocation AS (
  SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS geolocation_zip_code,
    CAST(n_nationkey * -1 AS DECIMAL(10,6)) AS geolocation_lat, CAST(n_nationkey * -2 AS DECIMAL(10,6)) AS geolocation_lng,
    n_name AS geolocation_city, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS geolocation_state
  FROM nation),
sellers AS (
  SELECT concat('S', CAST(s_suppkey AS VARCHAR)) AS seller_id, lpad(CAST(s_suppkey % 1000 AS VARCHAR), 5, '0') AS seller_zip_code,
    concat('CITY_', CAST(s_suppkey % 10 AS VARCHAR)) AS seller_city, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS seller_state
  FROM supplier),
product_category_translation AS (
  SELECT DISTINCT p_brand AS product_category_name, lower(replace(p_brand, '#', '_')) AS product_category_name_english
  FROM part WHERE p_brand <> 'Brand#7'),
products AS (
  SELECT concat('P', CAST(p_partkey AS VARCHAR)) AS product_id,
    CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE p_brand END AS product_category_name,
    CAST(length(p_name) AS INT) AS product_name_length, CAST(length(p_name) * 10 AS INT) AS product_description_length,
    CAST(p_partkey % 6 AS INT) AS product_photos_qty,
    CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_size * 100 END AS product_weight_g,
    p_size AS product_length_cm, p_size + 1 AS product_height_cm, p_size + 2 AS product_width_cm
  FROM part),
orders_base AS (
  SELECT o_orderkey AS k, concat('O', CAST(o_orderkey AS VARCHAR)) AS order_id, concat('C', CAST(o_orderkey AS VARCHAR)) AS customer_id,
    CASE WHEN o_orderkey % 40 = 0 THEN 'canceled' WHEN o_orderkey % 41 = 0 THEN 'unavailable'
         WHEN o_orderstatus = 'P' THEN 'shipped' ELSE 'delivered' END AS order_status,
    (o_orderdate + to_seconds(CAST(o_orderkey * 7919 % 86400 AS INT))) AS pts, o_orderpriority AS pr
  FROM orders),
orders_m AS (
  SELECT order_id, customer_id, order_status, pts AS order_purchase_timestamp,
    CASE WHEN k % 101 = 0 THEN NULL ELSE (pts + to_hours(CAST(k % 48 AS INT))) END AS order_approved_at,
    CASE WHEN order_status IN ('delivered', 'shipped') AND k % 107 <> 0 THEN (pts + to_hours(CAST(24 + k * 17 % 96 AS INT))) END AS order_delivered_carrier_date,
    CASE WHEN order_status = 'delivered' AND k % 103 <> 0 THEN (pts + to_hours(CAST(130 + k * 37 % 900 + (CASE WHEN k % 100 > 90 THEN 310 ELSE 0 END) AS INT))) END AS order_delivered_customer_date,
    (CAST(CAST(pts AS DATE) AS TIMESTAMP) + to_days(CAST(40 AS INT))) AS order_estimated_delivery_date
  FROM orders_base),
order_items AS (
  SELECT concat('O', CAST(l_orderkey AS VARCHAR)) AS order_id, l_linenumber AS order_item_id, concat('P', CAST(l_partkey AS VARCHAR)) AS product_id,
    concat('S', CAST(l_suppkey % (1 + l_orderkey % 100) AS VARCHAR)) AS seller_id, l_shipdate AS shipping_limit_date,
    CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
    CAST(CAST(CAST(l_quantity AS INT) AS DECIMAL(10,2)) * CAST(0.37 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS freight_value
  FROM lineitem),
pay_base AS (
  SELECT order_id, CAST(substr(order_id, 2) AS BIGINT) AS k, CAST(sum(price + freight_value) AS DECIMAL(18,2)) AS tot
  FROM order_items GROUP BY order_id),
order_payments AS (
  SELECT order_id, 1 AS payment_sequential, CASE WHEN k % 4 = 0 THEN 'boleto' ELSE 'credit_card' END AS payment_type,
    CAST(1 + k % 10 AS INT) AS payment_installments,
    CAST(tot - (CASE WHEN k % 10 = 0 THEN 5 ELSE 0 END) + (CASE WHEN k % 300 = 7 THEN 1 ELSE 0 END) AS DECIMAL(10,2)) AS payment_value
  FROM pay_base WHERE k % 499 <> 0
  UNION ALL
  SELECT order_id, 2, 'voucher', 1, CAST(5 AS DECIMAL(10,2)) FROM pay_base WHERE k % 10 = 0 AND k % 499 <> 0),
order_reviews AS (
  SELECT concat('R', CAST(k AS VARCHAR)) AS review_id, order_id,
    CAST(CASE WHEN k % 7 = 0 THEN 1 WHEN k % 2 = 0 THEN 5 ELSE 3 + k * 13 % 3 END AS INT) AS review_score, CAST(NULL AS VARCHAR) AS review_comment_title,
    CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN '  ' ELSE 'ok' END AS review_comment_message,
    (pts + to_days(CAST(40 AS INT))) AS review_creation_date, (pts + to_days(CAST(42 AS INT))) AS review_answer_timestamp
  FROM orders_base WHERE k % 9 <> 0
  UNION ALL
  SELECT concat('R', CAST(k AS VARCHAR), 'b'), order_id, CAST(1 + k % 5 AS INT), NULL, NULL, (pts + to_days(CAST(45 AS INT))), (pts + to_days(CAST(46 AS INT)))
  FROM orders_base WHERE k % 25 = 0)
"""


def with_tables(body: str) -> str:
    """Prefix a report body with the adapter CTEs (body may add its own CTEs
    by starting with ``, name AS (...)``)."""
    body = body.strip()
    if body.startswith(","):
        return "WITH" + ADAPTER_CTES + body
    return "WITH" + ADAPTER_CTES + "\n" + body


# Grains that several oracles start from (the folds of SURVEY 1.5): delivered
# orders, item lines in cents, one basket per order, delivered orders with their
# basket, delivered orders with their buyer, (seller, order) and reviews per order.
FOLDS = """, done AS (FROM orders_m WHERE order_status = 'delivered'),
line AS (SELECT order_id, order_item_id, product_id, seller_id, CAST(price * 100 AS HUGEINT) AS p_c,
  CAST(freight_value * 100 AS HUGEINT) AS f_c, CAST((price + freight_value) * 100 AS HUGEINT) AS v_c FROM order_items),
basket AS (SELECT order_id, sum(v_c) AS rev_c, count(v_c) AS n_val, count(order_item_id) AS n_items FROM line GROUP BY order_id),
sold AS (FROM done JOIN basket USING (order_id)),
buyer AS (SELECT customer_unique_id AS person, order_id, order_purchase_timestamp AS bought_at FROM done JOIN customers USING (customer_id)),
seller_order AS (SELECT seller_id, order_id, sum(v_c) AS rev_c, count(v_c) AS n_val, sum(f_c) AS f_c, count(f_c) AS n_f, count(*) AS n_rows
  FROM line SEMI JOIN done USING (order_id) SEMI JOIN sellers USING (seller_id) GROUP BY seller_id, order_id),
review AS (SELECT order_id, count(*) AS k, sum(review_score) AS s, count(review_score) AS n FROM order_reviews GROUP BY order_id)"""


# --- SQL twins of vendora.functions --------------------------------------------------

def RD(n: str, d: str, s: int = 2) -> str:
    """round(n / d, s) half away from zero, exact, as DOUBLE (NULL if d = 0)."""
    p = 10 ** s
    hn, hd = f"CAST(({n}) AS HUGEINT)", f"NULLIF(CAST(({d}) AS HUGEINT), 0)"
    q = f"((2 * {p} * abs({hn}) + {hd}) // (2 * {hd}))"
    return f"(CAST(CASE WHEN ({hn}) < 0 THEN -{q} ELSE {q} END AS DOUBLE) / {float(p)})"


def PCT(part: str, whole: str, s: int = 2) -> str:
    return RD(f"CAST(({part}) AS HUGEINT) * 100", whole, s)


def CENTS(x: str) -> str:
    return f"CAST(({x}) * 100 AS HUGEINT)"


def US(t0: str, t1: str) -> str:
    """t1 - t0 in microseconds."""
    return f"(epoch_us({t1}) - epoch_us({t0}))"


DAY_US = 86_400_000_000


def MONTH(ts: str) -> str:
    return f"CAST(date_trunc('month', {ts}) AS TIMESTAMP)"


def pct_x_sql(col: str, pn: int, src: str) -> str:
    """Oracle twin of ``exact_percentiles``: PERCENTILE_CONT(pn/100) of an
    integral column, times 100, in the plain rank form (exact integers)."""
    lo_r = f"(n - 1) * {pn} // 100"
    hi_r = f"((n - 1) * {pn} // 100 + CASE WHEN (n - 1) * {pn} % 100 > 0 THEN 1 ELSE 0 END)"
    return f"""(SELECT 100 * lo + (hi - lo) * rem FROM (
  SELECT MAX(CASE WHEN rn = {lo_r} THEN v END) AS lo, MAX(CASE WHEN rn = {hi_r} THEN v END) AS hi,
         MAX((n - 1) * {pn} % 100) AS rem
  FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rn, COUNT(*) OVER () AS n
        FROM (SELECT CAST({col} AS HUGEINT) AS v FROM {src} WHERE {col} IS NOT NULL) s0) s1) s2)"""


def pct_sql(col: str, pn: int, src: str, scale: int, unit: int = 100) -> str:
    return RD(pct_x_sql(col, pn, src), str(100 * unit), scale)


def body_of(sql: str) -> str:
    """The report SQL without the adapter CTEs: runs on any database that has
    the nine tables (the marketplace orders table named ``orders_m``)."""
    head = "WITH" + ADAPTER_CTES
    if not sql.startswith(head):
        return sql
    rest = sql[len(head):].lstrip()
    return "WITH " + rest[1:].lstrip() if rest.startswith(",") else rest
