"""SQL twin of the fixture adapter, written independently for DuckDB.

Every oracle query is ``WITH <BASE_CTES>, <its own CTEs> SELECT ...``.
The CTE names mirror the basket tables:

    b_orders   orders                    b_orderp  prior order items
    b_ordert   train order items         b_prior   orders JOIN b_orderp
    b_train    train items + user_id     b_products, b_aisles,
                                         b_departments, b_product_dim

DuckDB types are cast to what Spark produces (row_number, date_diff,
isodow and % return BIGINT in DuckDB; Spark gives INT for these).
"""

BASE_CTES = """
b_pairs AS (
    SELECT DISTINCT p_brand, p_type FROM part
),
b_named AS (
    SELECT CAST(row_number() OVER (ORDER BY p_brand, p_type) AS BIGINT) AS product_id,
           p_brand || ' ' || p_type AS product_name,
           p_brand AS aisle, p_type AS department
    FROM b_pairs
),
b_aisles AS (
    SELECT CAST(row_number() OVER (ORDER BY aisle) AS INTEGER) AS aisle_id, aisle
    FROM (SELECT DISTINCT p_brand AS aisle FROM part)
),
b_departments AS (
    SELECT CAST(row_number() OVER (ORDER BY department) AS INTEGER) AS department_id, department
    FROM (SELECT DISTINCT p_type AS department FROM part)
),
b_products AS (
    SELECT n.product_id, n.product_name, a.aisle_id, d.department_id
    FROM b_named n JOIN b_aisles a ON n.aisle = a.aisle
                   JOIN b_departments d ON n.department = d.department
),
b_product_dim AS (
    SELECT p.product_id, p.product_name, a.aisle, d.department
    FROM b_products p JOIN b_aisles a ON p.aisle_id = a.aisle_id
                      JOIN b_departments d ON p.department_id = d.department_id
),
b_lines AS (
    SELECT l.l_orderkey AS order_id, n.product_id, min(l.l_linenumber) AS first_line
    FROM lineitem l
    JOIN part p ON l.l_partkey = p.p_partkey
    JOIN b_named n ON p.p_brand = n.aisle AND p.p_type = n.department
    GROUP BY l.l_orderkey, n.product_id
),
b_orders_numbered AS (
    SELECT o.o_orderkey AS order_id, o.o_custkey AS user_id, o.o_orderdate,
           row_number() OVER w AS rn,
           lag(o.o_orderdate) OVER w AS prev_date,
           count(*) OVER (PARTITION BY o.o_custkey) AS n_orders
    FROM orders o
    WHERE o.o_orderkey IN (SELECT l_orderkey FROM lineitem)
    WINDOW w AS (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey)
),
b_orders AS (
    SELECT order_id, user_id,
           CASE WHEN rn < n_orders THEN 'prior'
                WHEN user_id % 11 < 7 THEN 'train'
                ELSE 'test' END AS eval_set,
           CAST(rn AS INTEGER) AS order_number,
           CAST(isodow(o_orderdate) % 7 AS INTEGER) AS order_dow,
           CAST(order_id % 24 AS INTEGER) AS order_hour_of_day,
           CAST(date_diff('day', CAST(prev_date AS DATE), CAST(o_orderdate AS DATE)) AS DOUBLE)
               AS days_since_prior_order
    FROM b_orders_numbered
),
b_items AS (
    SELECT o.order_id, o.user_id, o.eval_set, o.order_number, o.order_dow,
           o.order_hour_of_day, o.days_since_prior_order, l.product_id,
           CAST(row_number() OVER (PARTITION BY l.order_id ORDER BY l.first_line, l.product_id)
                AS INTEGER) AS add_to_cart_order,
           CASE WHEN o.order_number >
                     min(o.order_number) OVER (PARTITION BY o.user_id, l.product_id)
                THEN 1 ELSE 0 END AS reordered
    FROM b_lines l JOIN b_orders o ON l.order_id = o.order_id
),
b_orderp AS (
    SELECT order_id, product_id, add_to_cart_order, reordered
    FROM b_items WHERE eval_set = 'prior'
),
b_ordert AS (
    SELECT order_id, product_id, add_to_cart_order, reordered
    FROM b_items WHERE eval_set = 'train'
),
b_prior AS (
    SELECT o.order_id, o.user_id, o.eval_set, o.order_number, o.order_dow,
           o.order_hour_of_day, o.days_since_prior_order,
           p.product_id, p.add_to_cart_order, p.reordered
    FROM b_orders o JOIN b_orderp p ON o.order_id = p.order_id
),
b_train AS (
    SELECT o.user_id, t.order_id, t.product_id, t.add_to_cart_order, t.reordered,
           1 AS ordered
    FROM b_ordert t LEFT JOIN b_orders o ON t.order_id = o.order_id
)
"""


def with_base(body: str) -> str:
    """Prefix a query body (``name AS (...), ... SELECT ...`` or a bare
    ``SELECT``) with the adapter CTEs."""
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return "WITH " + BASE_CTES.strip() + "\n" + body
    return "WITH " + BASE_CTES.strip() + ",\n" + body
