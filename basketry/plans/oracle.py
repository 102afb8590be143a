"""DuckDB SQL twins of the catalogue queries (the correctness oracle).

The SQL is written the way the reference computes things -- windows for
"last order" and occurrence numbers, left joins for recency flags, one block
per N or per cutoff -- so it checks the single-pass Spark rewrites instead
of repeating them.  Each entry is (body, double columns); ``oracle_sql``
prefixes the adapter CTEs and rounds the double columns exactly as
``catalog.round6`` does.
"""

from __future__ import annotations

from basketry.plans.oracle_base import with_base

MET = "tp, cp, pcp, precision, recall, f1"
MET_D = ["precision", "recall", "f1"]
CUT_KS = list(range(10, 24))
HOLD_HASH = (
    "((((user_id % 2147483647) * 48271 + 17) % 2147483647) * 48271) % 2147483647 % 100"
)


def metrics_cte(name: str, src: str, key: str, act: str, hat: str, guarded: bool = True) -> str:
    """CTE ``name`` with key, tp, cp, pcp, precision, recall, f1 over ``src``."""
    if guarded:
        p = "CASE WHEN pcp = 0 THEN 0.0::DOUBLE ELSE tp / pcp END"
        r = "CASE WHEN cp = 0 THEN 0.0::DOUBLE ELSE tp / cp END"
        f = (
            "CASE WHEN precision = 0 OR recall = 0 THEN 0.0::DOUBLE "
            "ELSE 2 * precision * recall / (precision + recall) END"
        )
    else:
        p = "CASE WHEN pcp = 0 THEN NULL ELSE tp / pcp END"
        r = "CASE WHEN cp = 0 THEN NULL ELSE tp / cp END"
        f = (
            "CASE WHEN precision IS NULL OR recall IS NULL OR precision + recall = 0 THEN NULL "
            "ELSE 2 * precision * recall / (precision + recall) END"
        )
    return f"""
{name}_c AS (
    SELECT {key}, count(*) FILTER (WHERE {act} * {hat} = 1) AS tp,
           CAST(coalesce(sum({act}), 0) AS BIGINT) AS cp,
           CAST(coalesce(sum({hat}), 0) AS BIGINT) AS pcp
    FROM {src} GROUP BY {key}
),
{name}_r AS (
    SELECT *, CAST({p} AS DOUBLE) AS precision, CAST({r} AS DOUBLE) AS recall FROM {name}_c
),
{name} AS (
    SELECT {key}, tp, cp, pcp, precision, recall, CAST({f} AS DOUBLE) AS f1 FROM {name}_r
)"""


def full_join_cte(name: str, pred: str, truth: str, hat: str = "y_hat", act: str = "y_act",
                  truth_col: str = "reordered") -> str:
    return f"""
{name} AS (
    SELECT coalesce(p.user_id, t.user_id) AS user_id,
           coalesce(p.product_id, t.product_id) AS product_id,
           coalesce(p.y_hat, 0) AS {hat}, coalesce(t.{truth_col}, 0) AS {act}
    FROM {pred} p FULL OUTER JOIN {truth} t
      ON p.user_id = t.user_id AND p.product_id = t.product_id
)"""


def summary_select(src: str, cols: list[str], lead: str = "") -> str:
    """Six UNION ALL rows (R's summary) over ``src``; ``lead`` prefixes
    extra leading select items (e.g. a cutoff literal)."""
    stats = [
        ("Min.", "min({c})"),
        ("1st Qu.", "quantile_cont({c}, 0.25)"),
        ("Median", "quantile_cont({c}, 0.5)"),
        ("Mean", "avg({c})"),
        ("3rd Qu.", "quantile_cont({c}, 0.75)"),
        ("Max.", "max({c})"),
    ]
    blocks = []
    for label, expr in stats:
        items = ", ".join(f"CAST({expr.format(c=c)} AS DOUBLE) AS {c}" for c in cols)
        blocks.append(f"SELECT {lead}'{label}' AS stat, {items} FROM {src}")
    return "\nUNION ALL\n".join(blocks)


# ------------------------------------------------------------- shared CTEs

LAST = """
b_pl AS (
    SELECT *, max(order_number) OVER (PARTITION BY user_id) AS user_max FROM b_prior
)"""

TRAIN_USERS = """
b_tu AS (SELECT user_id FROM b_orders WHERE eval_set = 'train'),
b_tpl AS (
    SELECT *, max(order_number) OVER (PARTITION BY user_id) AS user_max
    FROM b_prior WHERE user_id IN (SELECT user_id FROM b_tu)
)"""

HOLDOUT = f"""
b_holdout AS (
    SELECT user_id, CASE WHEN {HOLD_HASH} < 20 THEN 'in' ELSE 'ud' END AS part
    FROM b_orders
    WHERE eval_set = 'train'
      AND user_id IN (SELECT user_id FROM b_orders WHERE eval_set = 'prior')
),
b_vu AS (SELECT user_id FROM b_holdout WHERE part = 'ud'),
b_vtruth AS (
    SELECT user_id, product_id, ordered FROM b_train WHERE user_id IN (SELECT user_id FROM b_vu)
),
b_vpl AS (
    SELECT *, max(order_number) OVER (PARTITION BY user_id) AS user_max
    FROM b_prior WHERE user_id IN (SELECT user_id FROM b_vu)
)"""

FEATURES = """
b_pt AS (
    SELECT product_id, reordered,
           row_number() OVER (PARTITION BY user_id, product_id ORDER BY order_number) AS product_time
    FROM b_prior
),
b_prd AS (
    SELECT product_id, count(*) AS prod_orders, sum(reordered) AS prod_reorders,
           count(*) FILTER (WHERE product_time = 1) AS prod_first_orders,
           count(*) FILTER (WHERE product_time = 2) AS prod_second_orders
    FROM b_pt GROUP BY product_id
),
b_product_features AS (
    SELECT product_id, prod_orders,
           prod_second_orders / prod_first_orders AS prod_reorder_probability,
           1 + prod_reorders / prod_first_orders AS prod_reorder_times,
           prod_reorders / prod_orders AS prod_reorder_ratio
    FROM b_prd
),
b_uof AS (
    SELECT user_id, max(order_number) AS user_orders,
           coalesce(sum(days_since_prior_order), 0.0::DOUBLE) AS user_period,
           avg(days_since_prior_order) AS user_mean_days_since_prior,
           avg(order_dow) AS user_mean_dow,
           avg(order_hour_of_day) AS user_mean_hod
    FROM b_orders WHERE eval_set = 'prior' GROUP BY user_id
),
b_uif AS (
    SELECT user_id, count(*) AS user_total_products,
           CASE WHEN count(*) FILTER (WHERE order_number > 1) = 0 THEN NULL
                ELSE count(*) FILTER (WHERE reordered = 1)
                     / count(*) FILTER (WHERE order_number > 1) END AS user_reorder_ratio,
           count(DISTINCT product_id) AS user_distinct_products
    FROM b_prior GROUP BY user_id
),
b_ctx AS (
    SELECT user_id, order_id, eval_set,
           days_since_prior_order AS post_days_since_last_order,
           order_dow AS post_dow, order_hour_of_day AS post_hod
    FROM b_orders WHERE eval_set <> 'prior'
),
b_users AS (
    SELECT o.user_id, o.user_orders, o.user_period, o.user_mean_days_since_prior,
           o.user_mean_dow, o.user_mean_hod,
           i.user_total_products, i.user_reorder_ratio, i.user_distinct_products,
           i.user_total_products / o.user_orders AS user_average_basket,
           c.order_id, c.eval_set, c.post_days_since_last_order, c.post_dow, c.post_hod
    FROM b_uof o JOIN b_uif i ON o.user_id = i.user_id JOIN b_ctx c ON o.user_id = c.user_id
),
b_up AS (
    SELECT user_id, product_id, count(*) AS up_orders,
           min(order_number) AS up_first_order, max(order_number) AS up_last_order,
           avg(add_to_cart_order) AS up_average_cart_position
    FROM b_prior GROUP BY user_id, product_id
),
b_fl AS (
    SELECT *, max(order_number) OVER (PARTITION BY user_id) AS user_max FROM b_prior
),
b_o AS (SELECT user_id, product_id, 1 AS f FROM b_fl WHERE order_number = user_max),
b_ro1 AS (SELECT user_id, product_id, 1 AS f FROM b_fl WHERE order_number = user_max AND reordered = 1),
b_ro2 AS (SELECT user_id, product_id, 1 AS f FROM b_fl WHERE order_number = user_max - 1 AND reordered = 1),
b_ro3 AS (SELECT user_id, product_id, 1 AS f FROM b_fl WHERE order_number = user_max - 2 AND reordered = 1),
b_data AS (
    SELECT u.*,
           coalesce(o.f, 0) AS up_ordered_one_order_ago,
           coalesce(r1.f, 0) AS up_re_ordered_one_order_ago,
           coalesce(r2.f, 0) AS up_re_ordered_two_order_ago,
           coalesce(r3.f, 0) AS up_re_ordered_tri_order_ago
    FROM b_up u
    LEFT JOIN b_o o ON u.user_id = o.user_id AND u.product_id = o.product_id
    LEFT JOIN b_ro1 r1 ON u.user_id = r1.user_id AND u.product_id = r1.product_id
    LEFT JOIN b_ro2 r2 ON u.user_id = r2.user_id AND u.product_id = r2.product_id
    LEFT JOIN b_ro3 r3 ON u.user_id = r3.user_id AND u.product_id = r3.product_id
),
b_cand AS (
    SELECT d.user_id, d.product_id, d.up_orders, d.up_first_order, d.up_last_order,
           d.up_average_cart_position,
           d.up_ordered_one_order_ago, d.up_re_ordered_one_order_ago,
           d.up_re_ordered_two_order_ago, d.up_re_ordered_tri_order_ago,
           ln(p.prod_orders) AS prod_orders, p.prod_reorder_probability,
           p.prod_reorder_times, p.prod_reorder_ratio,
           u.user_orders,
           CASE WHEN u.user_period > 0 THEN ln(u.user_period) END AS user_period,
           u.user_mean_days_since_prior, u.user_mean_dow, u.user_mean_hod,
           u.user_total_products, u.user_reorder_ratio, u.user_distinct_products,
           u.user_average_basket, u.order_id, u.eval_set,
           u.post_days_since_last_order, u.post_dow, u.post_hod,
           d.up_orders / u.user_orders AS up_order_rate,
           u.user_orders - d.up_last_order AS up_orders_since_last_order,
           d.up_orders / (u.user_orders - d.up_first_order + 1) AS up_order_rate_since_first_order,
           coalesce(t.reordered, 0) AS reordered
    FROM b_data d
    JOIN b_product_features p ON d.product_id = p.product_id
    JOIN b_users u ON d.user_id = u.user_id
    LEFT JOIN b_train t ON d.user_id = t.user_id AND d.product_id = t.product_id
)"""

CAND_D = [
    "up_average_cart_position", "prod_orders", "prod_reorder_probability",
    "prod_reorder_times", "prod_reorder_ratio", "user_period",
    "user_mean_days_since_prior", "user_mean_dow", "user_mean_hod",
    "user_reorder_ratio", "user_average_basket", "post_days_since_last_order",
    "up_order_rate", "up_order_rate_since_first_order",
]

VALID = """
b_vc AS (
    SELECT *, up_order_rate_since_first_order AS score FROM b_cand
    WHERE eval_set = 'train' AND user_id IN (SELECT user_id FROM b_vu)
)"""

TEST_SUB = """
b_test AS (SELECT user_id, order_id FROM b_orders WHERE eval_set = 'test'),
b_tepl AS (
    SELECT *, max(order_number) OVER (PARTITION BY user_id) AS user_max
    FROM b_prior WHERE user_id IN (SELECT user_id FROM b_test)
),
b_tepred AS (
    SELECT DISTINCT user_id, product_id FROM b_tepl
    WHERE (order_number = user_max OR order_number = user_max - 1 OR order_number = user_max - 2)
      AND reordered = 1
),
b_sub0 AS (
    SELECT t.order_id, string_agg(CAST(p.product_id AS VARCHAR), ' ' ORDER BY p.product_id) AS products
    FROM b_tepred p JOIN b_test t ON p.user_id = t.user_id
    GROUP BY t.order_id
)"""


def _ctes(*parts: str) -> str:
    return ",\n".join(p.strip() for p in parts)


def _last_k_pred(name: str, src: str, k: int, reordered_only: bool) -> str:
    cond = " OR ".join(
        ["order_number = user_max"] + [f"order_number = user_max - {i}" for i in range(1, k)]
    )
    extra = " AND reordered = 1" if reordered_only else ""
    return f"""
{name} AS (
    SELECT DISTINCT user_id, product_id, 1 AS y_hat FROM {src} WHERE ({cond}){extra}
)"""


def _family1(name: str, pred_cte: str) -> str:
    return _ctes(
        TRAIN_USERS,
        pred_cte,
        full_join_cte(f"{name}_z", f"{name}_p", "b_train"),
        metrics_cte(name, f"{name}_z", "user_id", "y_act", "y_hat"),
    )


def _b1(name: str) -> str:
    return _family1(name, _last_k_pred(f"{name}_p", "b_tpl", 1, False))


def _b2(name: str) -> str:
    pred = f"""
{name}_p AS (
    SELECT user_id, product_id, reordered AS y_hat FROM b_tpl WHERE order_number = user_max
)"""
    return _family1(name, pred)


def _bk(name: str, k: int) -> str:
    return _family1(name, _last_k_pred(f"{name}_p", "b_tpl", k, True))


def _topn_blocks(name: str, ranked_src: str, truth: str, truth_col: str, users_ctes: str) -> str:
    """CTE ``name`` with n, user_id, metrics: one block per N = 1..10."""
    parts = [users_ctes]
    selects = []
    for n in range(1, 11):
        parts.append(f"""
{name}_p{n} AS (SELECT user_id, product_id, 1 AS y_hat FROM {ranked_src} WHERE rnk <= {n})""")
        parts.append(full_join_cte(f"{name}_z{n}", f"{name}_p{n}", truth, truth_col=truth_col))
        parts.append(metrics_cte(f"{name}_m{n}", f"{name}_z{n}", "user_id", "y_act", "y_hat"))
        selects.append(f"SELECT {n} AS n, user_id, {MET} FROM {name}_m{n}")
    parts.append(f"{name} AS (\n" + "\nUNION ALL\n".join(selects) + "\n)")
    return _ctes(*parts)


def _b5(name: str) -> str:
    ranked = f"""
{name}_t AS (
    SELECT user_id, product_id, count(*) AS times FROM b_tpl GROUP BY user_id, product_id
),
{name}_rk AS (
    SELECT user_id, product_id,
           CASE WHEN times = 1 THEN 100
                ELSE dense_rank() OVER (PARTITION BY user_id ORDER BY times DESC) END AS rnk
    FROM {name}_t
)"""
    return _topn_blocks(name, f"{name}_rk", "b_train", "reordered", _ctes(TRAIN_USERS, ranked))


def _b7(name: str) -> str:
    ranked = f"""
{name}_rk AS (
    SELECT user_id, product_id,
           dense_rank() OVER (PARTITION BY user_id ORDER BY up_order_rate_since_first_order DESC) AS rnk
    FROM b_cand WHERE eval_set = 'train' AND user_id IN (SELECT user_id FROM b_vu)
)"""
    return _topn_blocks(name, f"{name}_rk", "b_vtruth", "ordered", _ctes(FEATURES, HOLDOUT, ranked))


def _b6(name: str) -> str:
    pred = f"""
{name}_p AS (
    SELECT user_id, product_id, 1 AS y_hat FROM b_cand
    WHERE eval_set = 'train' AND user_id IN (SELECT user_id FROM b_vu)
)"""
    return _ctes(
        FEATURES, HOLDOUT, pred,
        full_join_cte(f"{name}_z", f"{name}_p", "b_vtruth", truth_col="ordered"),
        metrics_cte(name, f"{name}_z", "user_id", "y_act", "y_hat"),
    )


def _b89(name: str, k: int) -> str:
    return _ctes(
        HOLDOUT,
        _last_k_pred(f"{name}_p", "b_vpl", k, False),
        full_join_cte(f"{name}_z", f"{name}_p", "b_vtruth", truth_col="ordered"),
        metrics_cte(name, f"{name}_z", "user_id", "y_act", "y_hat"),
    )


def _dedupe_ctes(text: str) -> str:
    """Drop repeated top-level CTE definitions (same name) keeping the
    first, so composed blocks can each declare what they need."""
    out, seen, depth, cur = [], set(), 0, ""
    for ch in text:
        cur += ch
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "," and depth == 0:
            out.append(cur[:-1])
            cur = ""
    if cur.strip():
        out.append(cur)
    kept = []
    for chunk in out:
        name = chunk.strip().split()[0] if chunk.strip() else ""
        if name and name not in seen:
            seen.add(name)
            kept.append(chunk.strip())
    return ",\n".join(kept)


def _q(ctes: str, select: str) -> str:
    return _dedupe_ctes(ctes) + "\n" + select


# ------------------------------------------------------------------ queries

ORACLE: dict[str, tuple[str, list[str]]] = {}


def _reg(name: str, sql: str, doubles: list[str]) -> None:
    ORACLE[name] = (sql, doubles)


_reg("scan_orders", "SELECT * FROM b_orders", ["days_since_prior_order"])
_reg(
    "preview_items",
    "SELECT user_id, order_id, product_id FROM b_prior ORDER BY user_id, order_id, product_id LIMIT 100",
    [],
)
_reg("filter_eval_set", "SELECT user_id, order_id FROM b_orders WHERE eval_set = 'train'", [])
_reg(
    "category_levels",
    """SELECT DISTINCT kind, level FROM (
        SELECT 'aisle' AS kind, aisle AS level FROM b_aisles
        UNION ALL SELECT 'department', department FROM b_departments
        UNION ALL SELECT 'product_name', product_name FROM b_products
        UNION ALL SELECT 'eval_set', eval_set FROM b_orders)""",
    [],
)
_reg("product_dim", "SELECT * FROM b_product_dim", [])
_reg("prior_items", "SELECT * FROM b_prior", ["days_since_prior_order"])
_reg("train_items", "SELECT user_id, order_id, product_id, reordered, ordered FROM b_train", [])
_reg(
    "train_first_bought",
    """SELECT t.order_id, t.user_id, t.product_id, p.order_number AS first_order_number, p.order_id AS first_order_id
       FROM b_train t LEFT JOIN (
         SELECT * FROM b_prior QUALIFY row_number() OVER (PARTITION BY user_id, product_id ORDER BY order_number, order_id) = 1
       ) p ON t.user_id = p.user_id AND t.product_id = p.product_id""",
    [],
)
_reg(
    "train_order_items",
    """SELECT o.*, t.product_id, t.reordered FROM b_orders o
       JOIN b_train t ON o.order_id = t.order_id AND o.user_id = t.user_id""",
    ["days_since_prior_order"],
)
_reg(
    "last_order_items",
    _q(LAST, "SELECT user_id, product_id, order_number, reordered FROM b_pl WHERE order_number = user_max"),
    [],
)
_reg(
    "kth_last_order_items",
    _q(
        LAST,
        """SELECT CAST(user_max - order_number AS INTEGER) AS k, user_id, product_id, reordered
           FROM b_pl WHERE order_number = user_max - 1 OR order_number = user_max - 2""",
    ),
    [],
)
_reg(
    "semi_join_train_users",
    """SELECT user_id, order_id, product_id FROM b_prior
       WHERE user_id IN (SELECT user_id FROM b_orders WHERE eval_set = 'train')""",
    [],
)
_reg(
    "anti_join_validation_users",
    _q(
        _ctes(FEATURES, HOLDOUT),
        """SELECT user_id, product_id FROM b_cand WHERE eval_set = 'train'
           AND user_id NOT IN (SELECT user_id FROM b_holdout WHERE part = 'in')""",
    ),
    [],
)
_reg(
    "threshold_scores",
    _q(
        FEATURES,
        """SELECT user_id, product_id, up_order_rate_since_first_order AS score,
                  CAST(up_order_rate_since_first_order > 0.21::DOUBLE AS INTEGER) AS y_hat
           FROM b_cand""",
    ),
    ["score"],
)
_reg(
    "label_candidates",
    """SELECT c.user_id, c.product_id, coalesce(t.reordered, 0) AS reordered
       FROM (SELECT DISTINCT user_id, product_id FROM b_prior) c
       LEFT JOIN b_train t ON c.user_id = t.user_id AND c.product_id = t.product_id""",
    [],
)
_reg(
    "prediction_truth_full_join",
    _q(
        _ctes(TRAIN_USERS, _last_k_pred("z_p", "b_tpl", 3, True), full_join_cte("z", "z_p", "b_train")),
        "SELECT user_id, product_id, y_hat, y_act FROM z",
    ),
    [],
)
_reg(
    "candidates_with_new_products",
    """SELECT coalesce(c.user_id, t.user_id) AS user_id,
              coalesce(c.product_id, t.product_id) AS product_id,
              coalesce(t.reordered, 0) AS reordered, coalesce(t.ordered, 0) AS ordered
       FROM (SELECT DISTINCT user_id, product_id FROM b_prior) c
       FULL OUTER JOIN b_train t ON c.user_id = t.user_id AND c.product_id = t.product_id""",
    [],
)
_reg(
    "orders_without_prediction",
    _q(TEST_SUB, "SELECT DISTINCT order_id FROM b_test WHERE order_id NOT IN (SELECT order_id FROM b_sub0)"),
    [],
)
_reg("distinct_reordered_products", "SELECT DISTINCT product_id FROM b_train WHERE reordered = 1", [])
_reg(
    "products_by_times_bought",
    "SELECT user_id, product_id, count(*) AS times FROM b_prior GROUP BY user_id, product_id",
    [],
)
_reg(
    "unique_products_per_user",
    "SELECT user_id, count(DISTINCT product_id) AS n_products FROM b_prior GROUP BY user_id",
    [],
)
_reg(
    "unique_products_frequency",
    """SELECT n_products, count(*) AS users FROM (
         SELECT user_id, count(DISTINCT product_id) AS n_products FROM b_prior GROUP BY user_id)
       GROUP BY n_products""",
    [],
)
BS = """
b_bs AS (
    SELECT user_id, order_number, order_dow, order_hour_of_day, count(*) AS basket_size
    FROM b_prior GROUP BY user_id, order_number, order_dow, order_hour_of_day
)"""
_reg(
    "basket_size_mean_q95",
    _q(
        BS,
        """SELECT avg(ave_basket_size) AS "mean", quantile_cont(ave_basket_size, 0.95) AS q95
           FROM (SELECT user_id, avg(basket_size) AS ave_basket_size FROM b_bs GROUP BY user_id)""",
    ),
    ["mean", "q95"],
)
RS_USER = """
b_rsu AS (
    SELECT user_id, avg(reordered) AS ave_reorder_share FROM b_prior
    WHERE order_number > 1 GROUP BY user_id
)"""
_reg(
    "reorder_share_summary",
    _q(
        _ctes(RS_USER, "b_rsv AS (SELECT ave_reorder_share AS value FROM b_rsu)"),
        summary_select("b_rsv", ["value"]),
    ),
    ["value"],
)
_reg(
    "metric_summary",
    _q(_bk("m4", 3), summary_select("m4", MET.split(", "))),
    MET.split(", "),
)
for _bucket, _name in (("order_dow", "order_share_by_dow"), ("order_hour_of_day", "order_share_by_hod")):
    _reg(
        _name,
        _q(
            BS,
            f"""SELECT {_bucket}, orders, orders * 100.0::DOUBLE / sum(orders) OVER () AS pct
                FROM (SELECT {_bucket}, count(*) AS orders FROM b_bs GROUP BY {_bucket})""",
        ),
        ["pct"],
    )
_reg(
    "product_occurrence_number",
    """SELECT user_id, product_id, order_number,
              CAST(row_number() OVER (PARTITION BY user_id, product_id ORDER BY order_number) AS INTEGER)
                  AS product_time
       FROM b_prior""",
    [],
)
_reg(
    "dense_rank_times_bought",
    """SELECT user_id, product_id, times,
              CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY times DESC) AS INTEGER) AS "rank"
       FROM (SELECT user_id, product_id, count(*) AS times FROM b_prior GROUP BY user_id, product_id)""",
    [],
)
_reg("reorder_share_per_user", _q(RS_USER, "SELECT * FROM b_rsu"), ["ave_reorder_share"])
_reg(
    "reorder_share_second_order",
    """SELECT user_id, avg(reordered) AS ave_reorder_share FROM b_prior
       WHERE order_number = 2 GROUP BY user_id""",
    ["ave_reorder_share"],
)
_reg(
    "reorder_share_last_order",
    _q(
        LAST,
        """SELECT user_id, avg(reordered) AS ave_reorder_share FROM b_pl
           WHERE order_number = user_max GROUP BY user_id""",
    ),
    ["ave_reorder_share"],
)
for _bucket, _name in (("order_dow", "reorder_share_by_dow"), ("order_hour_of_day", "reorder_share_by_hod")):
    _reg(
        _name,
        f"""SELECT {_bucket}, avg(s) AS ave_reorder_share FROM (
              SELECT user_id, {_bucket}, avg(reordered) AS s FROM b_prior
              WHERE order_number > 1 GROUP BY user_id, {_bucket})
            GROUP BY {_bucket}""",
        ["ave_reorder_share"],
    )
_reg(
    "reorder_share_by_hod_last_order",
    _q(
        LAST,
        """SELECT order_hour_of_day, avg(s) AS ave_reorder_share FROM (
             SELECT user_id, order_hour_of_day, avg(reordered) AS s FROM b_pl
             WHERE order_number = user_max GROUP BY user_id, order_hour_of_day)
           GROUP BY order_hour_of_day""",
    ),
    ["ave_reorder_share"],
)
for _bucket, _name in (("order_dow", "basket_size_by_dow"), ("order_hour_of_day", "basket_size_by_hod")):
    _reg(
        _name,
        _q(
            BS,
            f"""SELECT {_bucket}, count(*) AS obs, avg(basket_size) AS "mean",
                       stddev_samp(basket_size) / sqrt(count(*)) AS se,
                       min(basket_size) AS "min", max(basket_size) AS "max"
                FROM b_bs GROUP BY {_bucket}""",
        ),
        ["mean", "se"],
    )
_reg(
    "basket_size_by_hod_last_order",
    _q(
        LAST,
        """SELECT order_hour_of_day, avg(basket_size) AS "mean",
                  quantile_cont(basket_size, 0.5) AS median
           FROM (SELECT user_id, order_number, order_hour_of_day, count(*) AS basket_size
                 FROM b_pl WHERE order_number = user_max
                 GROUP BY user_id, order_number, order_hour_of_day)
           GROUP BY order_hour_of_day""",
    ),
    ["mean", "median"],
)
_reg(
    "basket_size_per_user",
    _q(BS, "SELECT user_id, avg(basket_size) AS ave_basket_size FROM b_bs GROUP BY user_id"),
    ["ave_basket_size"],
)
_reg(
    "reorder_share_per_order",
    """SELECT user_id, order_number, avg(reordered) AS reorder_share FROM b_prior
       WHERE order_number > 1 GROUP BY user_id, order_number""",
    ["reorder_share"],
)
for _bucket, _name in (("order_dow", "reorder_share_by_dow_se"), ("order_hour_of_day", "reorder_share_by_hod_se")):
    _reg(
        _name,
        f"""SELECT {_bucket}, avg(s) AS "mean", stddev_samp(s) / sqrt(count(*)) AS se FROM (
              SELECT user_id, {_bucket}, avg(reordered) AS s FROM b_prior
              WHERE order_number > 1 GROUP BY user_id, {_bucket})
            GROUP BY {_bucket}""",
        ["mean", "se"],
    )
_reg(
    "basket_size_by_dow_ci",
    _q(
        BS,
        """SELECT order_dow, m AS "mean", m - 1.96::DOUBLE * se AS lower, m + 1.96::DOUBLE * se AS upper
           FROM (SELECT order_dow, avg(basket_size) AS m,
                        stddev_samp(basket_size) / sqrt(count(*)) AS se
                 FROM b_bs GROUP BY order_dow)""",
    ),
    ["mean", "lower", "upper"],
)
_reg(
    "reorder_share_histogram",
    _q(
        _ctes(
            RS_USER,
            """b_hb AS (
                SELECT least(greatest(CAST(ceil((ave_reorder_share - 0.0::DOUBLE) / 0.01::DOUBLE
                                                 - 0.000000001::DOUBLE) AS INTEGER), 1), 100) AS bin,
                       count(*) AS cnt
                FROM b_rsu GROUP BY 1
            )""",
            """b_hg AS (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 101))""",
            """b_hf AS (
                SELECT g.bin, CAST(coalesce(h.cnt, 0) AS BIGINT) AS cnt
                FROM b_hg g LEFT JOIN b_hb h ON g.bin = h.bin
            )""",
        ),
        """SELECT bin,
                  0.0::DOUBLE + (bin - 1) * 1.0::DOUBLE / 100 AS lower,
                  0.0::DOUBLE + bin * 1.0::DOUBLE / 100 AS upper,
                  cnt AS "count",
                  cnt / (sum(cnt) OVER () * 0.01::DOUBLE) AS density
           FROM b_hf""",
    ),
    ["lower", "upper", "density"],
)
_reg(
    "dataset_cardinalities",
    """SELECT 'products' AS metric, count(DISTINCT product_id) AS value FROM b_products
       UNION ALL SELECT 'aisles', count(DISTINCT aisle) FROM b_aisles
       UNION ALL SELECT 'departments', count(DISTINCT department) FROM b_departments
       UNION ALL SELECT 'users', count(DISTINCT user_id) FROM b_orders
       UNION ALL SELECT 'orders', count(DISTINCT order_id) FROM b_orders
       UNION ALL SELECT 'train_users', count(DISTINCT user_id) FROM b_train""",
    [],
)
_reg("order_counts_by_eval_set", "SELECT eval_set, count(*) AS orders FROM b_orders GROUP BY eval_set", [])
_reg(
    "products_in_category",
    "SELECT product_id, product_name FROM b_product_dim WHERE aisle = 'Brand#13'",
    [],
)
_reg(
    "orders_of_product",
    "SELECT order_id, add_to_cart_order, reordered FROM b_orderp WHERE product_id = 42",
    [],
)
_reg(
    "train_products_by_reordered",
    """SELECT reordered, count(*) AS "rows", count(DISTINCT product_id) AS products
       FROM b_train GROUP BY reordered""",
    [],
)
SAME = """
b_po AS (
    SELECT user_id, order_id, count(*) AS tpo, avg(product_id) AS pro
    FROM b_prior GROUP BY user_id, order_id
),
b_same AS (
    SELECT user_id, avg(tpo) AS mean_tpo, min(tpo) AS min_tpo, max(tpo) AS max_tpo,
           min(pro) AS min_pro, max(pro) AS max_pro
    FROM b_po GROUP BY user_id
    HAVING max(tpo) = min(tpo) AND min(pro) = max(pro)
)"""
_reg("always_same_basket_users", _q(SAME, "SELECT * FROM b_same"), ["mean_tpo", "min_pro", "max_pro"])
_reg(
    "always_same_basket_users_exact",
    """SELECT user_id, avg(tpo) AS mean_tpo, min(tpo) AS min_tpo, max(tpo) AS max_tpo, min(pro) AS min_pro, max(pro) AS max_pro
       FROM (SELECT user_id, order_id, count(*) AS tpo, avg(product_id) AS pro, list(product_id ORDER BY product_id) AS basket
             FROM b_prior GROUP BY user_id, order_id)
       GROUP BY user_id HAVING count(DISTINCT basket) = 1""",
    ["mean_tpo", "min_pro", "max_pro"],
)
_reg(
    "same_basket_train_reorder_rate",
    _q(
        SAME,
        """SELECT count(DISTINCT t.user_id) AS users, avg(t.reordered) AS mean_reordered
           FROM b_orders o JOIN b_train t ON o.order_id = t.order_id AND o.user_id = t.user_id
           WHERE t.user_id IN (SELECT user_id FROM b_same)""",
    ),
    ["mean_reordered"],
)
_reg(
    "always_reordering_orders",
    _q(
        FEATURES,
        """SELECT order_id, avg(up_order_rate) AS mean_up_order_rate FROM b_cand
           GROUP BY order_id HAVING avg(up_order_rate) = 1""",
    ),
    ["mean_up_order_rate"],
)
_reg(
    "user_history",
    "SELECT order_number, order_id, product_id, reordered FROM b_prior WHERE user_id = 7",
    [],
)
_reg(
    "product_features",
    _q(FEATURES, "SELECT * FROM b_product_features"),
    ["prod_reorder_probability", "prod_reorder_times", "prod_reorder_ratio"],
)
_reg(
    "user_order_features",
    _q(FEATURES, "SELECT * FROM b_uof"),
    ["user_period", "user_mean_days_since_prior", "user_mean_dow", "user_mean_hod"],
)
_reg("user_item_features", _q(FEATURES, "SELECT * FROM b_uif"), ["user_reorder_ratio"])
_reg(
    "user_features",
    _q(FEATURES, "SELECT * FROM b_users"),
    [
        "user_period", "user_mean_days_since_prior", "user_mean_dow", "user_mean_hod",
        "user_reorder_ratio", "user_average_basket", "post_days_since_last_order",
    ],
)
_reg("target_order_context", _q(FEATURES, "SELECT * FROM b_ctx"), ["post_days_since_last_order"])
_reg("user_product_features", _q(FEATURES, "SELECT * FROM b_up"), ["up_average_cart_position"])
_reg(
    "recency_flags",
    _q(
        FEATURES,
        """SELECT user_id, product_id, up_ordered_one_order_ago, up_re_ordered_one_order_ago,
                  up_re_ordered_two_order_ago, up_re_ordered_tri_order_ago FROM b_data""",
    ),
    [],
)
_reg("candidate_features", _q(FEATURES, "SELECT * FROM b_cand"), CAND_D)
_reg(
    "candidate_features_base",
    _q(
        _ctes(
            FEATURES,
            """b_ctx0 AS (
                SELECT user_id, order_id, eval_set, days_since_prior_order AS time_since_last_order
                FROM b_orders WHERE eval_set <> 'prior'
            )""",
        ),
        """SELECT u.user_id, u.product_id, u.up_orders, u.up_first_order, u.up_last_order,
                  u.up_average_cart_position,
                  p.prod_orders, p.prod_reorder_probability, p.prod_reorder_times, p.prod_reorder_ratio,
                  o.user_orders, o.user_period, o.user_mean_days_since_prior,
                  i.user_total_products, i.user_reorder_ratio, i.user_distinct_products,
                  i.user_total_products / o.user_orders AS user_average_basket,
                  c.order_id, c.eval_set, c.time_since_last_order,
                  u.up_orders / o.user_orders AS up_order_rate,
                  o.user_orders - u.up_last_order AS up_orders_since_last_order,
                  u.up_orders / (o.user_orders - u.up_first_order + 1) AS up_order_rate_since_first_order,
                  t.reordered
           FROM b_up u
           JOIN b_product_features p ON u.product_id = p.product_id
           JOIN b_uof o ON u.user_id = o.user_id
           JOIN b_uif i ON u.user_id = i.user_id
           JOIN b_ctx0 c ON u.user_id = c.user_id
           LEFT JOIN b_train t ON u.user_id = t.user_id AND u.product_id = t.product_id""",
    ),
    [
        "up_average_cart_position", "prod_reorder_probability", "prod_reorder_times",
        "prod_reorder_ratio", "user_period", "user_mean_days_since_prior", "user_reorder_ratio",
        "user_average_basket", "time_since_last_order", "up_order_rate",
        "up_order_rate_since_first_order",
    ],
)
_reg(
    "candidate_split_counts",
    _q(
        FEATURES,
        """SELECT eval_set, count(*) AS candidates, count(DISTINCT user_id) AS users
           FROM b_cand GROUP BY eval_set""",
    ),
    [],
)
_reg("user_holdout_split", _q(HOLDOUT, "SELECT user_id, part FROM b_holdout"), [])

_reg("repeat_last_order", _q(_b1("m1"), f"SELECT user_id, {MET} FROM m1"), MET_D)
_reg("repeat_last_reorders", _q(_b2("m2"), f"SELECT user_id, {MET} FROM m2"), MET_D)
_reg("repeat_last_2_reorders", _q(_bk("m3", 2), f"SELECT user_id, {MET} FROM m3"), MET_D)
_reg("repeat_last_3_reorders", _q(_bk("m4", 3), f"SELECT user_id, {MET} FROM m4"), MET_D)
_reg("topn_baseline", _q(_b5("m5"), f"SELECT n, user_id, {MET} FROM m5"), MET_D)
_reg("all_ordered_baseline", _q(_b6("m6"), f"SELECT user_id, {MET} FROM m6"), MET_D)
_reg("topn_by_rate_baseline", _q(_b7("m7"), f"SELECT n, user_id, {MET} FROM m7"), MET_D)
_reg("last_order_ordered_baseline", _q(_b89("m8", 1), f"SELECT user_id, {MET} FROM m8"), MET_D)
_reg("last_two_orders_baseline", _q(_b89("m9", 2), f"SELECT user_id, {MET} FROM m9"), MET_D)

_LB_PARTS = [
    ("I", "repeat_last_order", "m1", False),
    ("I", "repeat_last_re_order", "m2", False),
    ("I", "repeat_last_2_re_order", "m3", False),
    ("I", "repeat_last_3_re_order", "m4", False),
    ("I", "top_n", "m5", True),
    ("II", "all_ordered", "m6", False),
    ("II", "top_n_by_rate", "m7", True),
    ("II", "last_order", "m8", False),
    ("II", "last_two_orders", "m9", False),
]
_lb_union = "\nUNION ALL\n".join(
    f"SELECT '{fam}' AS family, '{bench}' AS benchmark, "
    + ("n" if with_n else "CAST(NULL AS INTEGER) AS n")
    + f", {MET} FROM {src}"
    for fam, bench, src, with_n in _LB_PARTS
)
_reg(
    "baseline_leaderboard",
    _q(
        _ctes(
            _b1("m1"), _b2("m2"), _bk("m3", 2), _bk("m4", 3), _b5("m5"), _b6("m6"), _b7("m7"),
            _b89("m8", 1), _b89("m9", 2),
        ),
        f"""SELECT family, benchmark, n, count(*) AS users,
                   avg(tp) AS mean_tp, avg(cp) AS mean_cp, avg(pcp) AS mean_pcp,
                   avg(precision) AS mean_precision, avg(recall) AS mean_recall, avg(f1) AS mean_f1
            FROM ({_lb_union}) GROUP BY family, benchmark, n""",
    ),
    ["mean_tp", "mean_cp", "mean_pcp", "mean_precision", "mean_recall", "mean_f1"],
)

_reg("user_metrics", _q(_bk("m4", 3), f"SELECT user_id, {MET} FROM m4"), MET_D)
_reg("mean_f1", _q(_bk("m4", 3), "SELECT count(*) AS users, avg(f1) AS mean_f1 FROM m4"), ["mean_f1"])

VS_TRUTH = """
b_vst AS (
    SELECT coalesce(s.user_id, t.user_id) AS user_id,
           coalesce(s.product_id, t.product_id) AS product_id,
           s.score, coalesce(t.ordered, 0) AS ordered
    FROM (SELECT user_id, product_id, score FROM b_vc) s
    FULL OUTER JOIN b_vtruth t ON s.user_id = t.user_id AND s.product_id = t.product_id
)"""
_reg("scores_vs_truth", _q(_ctes(FEATURES, HOLDOUT, VALID, VS_TRUTH), "SELECT * FROM b_vst"), ["score"])
_reg(
    "user_metrics_ordered",
    _q(
        _ctes(
            FEATURES, HOLDOUT, VALID, VS_TRUTH,
            """b_vsth AS (
                SELECT user_id, ordered AS y_act,
                       coalesce(CAST(score > 0.21::DOUBLE AS INTEGER), 0) AS y_hat FROM b_vst
            )""",
            metrics_cte("mo", "b_vsth", "user_id", "y_act", "y_hat"),
        ),
        f"SELECT user_id, {MET} FROM mo",
    ),
    MET_D,
)
_ORDER_LAB = """
b_olab AS (
    SELECT order_id, reordered AS y_act, CAST(score > 0.21::DOUBLE AS INTEGER) AS y_hat FROM b_vc
)"""
_reg(
    "order_metrics",
    _q(
        _ctes(FEATURES, HOLDOUT, VALID, _ORDER_LAB, metrics_cte("om", "b_olab", "order_id", "y_act", "y_hat")),
        f"SELECT order_id, {MET} FROM om",
    ),
    MET_D,
)
_reg(
    "order_metrics_unguarded",
    _q(
        _ctes(
            FEATURES, HOLDOUT, VALID, _ORDER_LAB,
            metrics_cte("ou", "b_olab", "order_id", "y_act", "y_hat", guarded=False),
        ),
        f"SELECT order_id, {MET} FROM ou",
    ),
    MET_D,
)


def _sweep_ctes(prefix: str, src: str, key: str, score_expr: str) -> tuple[str, list[str]]:
    """Per-cutoff metric CTEs (one per cutoff) and their names."""
    parts, names = [], []
    for k in CUT_KS:
        lab = f"{prefix}_l{k}"
        parts.append(
            f"""{lab} AS (
                SELECT {key}, reordered AS y_act,
                       CAST({score_expr} > {k} / 100 AS INTEGER) AS y_hat FROM {src}
            )"""
        )
        parts.append(metrics_cte(f"{prefix}_m{k}", lab, key, "y_act", "y_hat"))
        names.append(f"{prefix}_m{k}")
    return _ctes(*parts), names


_sw, _sw_names = _sweep_ctes("sw", "b_vc", "order_id", "score")
_reg(
    "cutoff_sweep",
    _q(
        _ctes(FEATURES, HOLDOUT, VALID, _sw),
        "\nUNION ALL\n".join(
            f"SELECT {k} / 100 AS cutoff, avg(f1) AS mean_f1 FROM {n}" for k, n in zip(CUT_KS, _sw_names)
        ),
    ),
    ["cutoff", "mean_f1"],
)
_ss, _ss_names = _sweep_ctes("ss", "b_vc", "user_id", "score")
_reg(
    "cutoff_sweep_summary",
    _q(
        _ctes(FEATURES, HOLDOUT, VALID, _ss),
        "\nUNION ALL\n".join(
            summary_select(n, MET.split(", "), lead=f"{k} / 100 AS cutoff, ")
            for k, n in zip(CUT_KS, _ss_names)
        ),
    ),
    ["cutoff"] + MET.split(", "),
)
_cfg_parts, _cfg_sel = [], []
for _cfg, _col in (
    ("order_rate_since_first", "up_order_rate_since_first_order"),
    ("order_rate", "up_order_rate"),
    ("product_reorder_ratio", "prod_reorder_ratio"),
):
    _c, _ns = _sweep_ctes(f"cfg_{_cfg}", "b_vc", "order_id", _col)
    _cfg_parts.append(_c)
    _cfg_sel += [
        f"SELECT '{_cfg}' AS config, {k} / 100 AS cutoff, avg(f1) AS mean_f1 FROM {n}"
        for k, n in zip(CUT_KS, _ns)
    ]
_reg(
    "config_comparison",
    _q(
        _ctes(FEATURES, HOLDOUT, VALID, *_cfg_parts),
        """SELECT config, cutoff AS best_cutoff, mean_f1 AS best_f1 FROM (
             SELECT *, row_number() OVER (PARTITION BY config ORDER BY mean_f1 DESC, cutoff) AS rn
             FROM (""" + "\nUNION ALL\n".join(_cfg_sel) + """)) WHERE rn = 1""",
    ),
    ["best_cutoff", "best_f1"],
)



# ------------------------------------------- further histograms and summaries


def _histogram(ctes: str, source: str, col: str, bins: int, hi: float) -> str:
    """Every bin's count over ``source``, by a bin's edges."""
    width = hi / bins
    return _q(
        _ctes(
            *([ctes] if ctes else []),
            f"b_hval AS (SELECT CAST({col} AS DOUBLE) AS v FROM {source} WHERE {col} IS NOT NULL)",
            f"""b_hbin AS (
                SELECT least(greatest(CAST(ceil(v / {width!r}::DOUBLE - 0.000000001::DOUBLE) AS INTEGER), 1), {bins}) AS bin,
                       count(*) AS cnt
                FROM b_hval GROUP BY 1
            )""",
            f"b_hgrid AS (SELECT CAST(range AS INTEGER) AS bin FROM range(1, {bins + 1}))",
            """b_hall AS (
                SELECT g.bin, CAST(coalesce(h.cnt, 0) AS BIGINT) AS cnt
                FROM b_hgrid g LEFT JOIN b_hbin h ON g.bin = h.bin
            )""",
        ),
        f"""SELECT bin, 0.0::DOUBLE + (bin - 1) * {hi!r}::DOUBLE / {bins} AS lower,
                  0.0::DOUBLE + bin * {hi!r}::DOUBLE / {bins} AS upper, cnt AS "count",
                  CASE WHEN sum(cnt) OVER () = 0 THEN NULL
                       ELSE cnt / (sum(cnt) OVER () * {width!r}::DOUBLE) END AS density
           FROM b_hall""",
    )


RS_SECOND = """
b_rs2 AS (
    SELECT user_id, avg(reordered) AS ave_reorder_share FROM b_prior
    WHERE order_number = 2 GROUP BY user_id
)"""
RS_LAST = LAST + """,
b_rsl AS (
    SELECT user_id, avg(reordered) AS ave_reorder_share FROM b_pl
    WHERE order_number = user_max GROUP BY user_id
)"""
RS_ORDER = """
b_rso AS (
    SELECT user_id, order_number, avg(reordered) AS reorder_share FROM b_prior
    WHERE order_number > 1 GROUP BY user_id, order_number
)"""
BS_USER = BS + """,
b_bsu AS (SELECT user_id, avg(basket_size) AS ave_basket_size FROM b_bs GROUP BY user_id)"""
N_PRODUCTS = """
b_np AS (SELECT user_id, count(DISTINCT product_id) AS n_products FROM b_prior GROUP BY user_id)"""
_VALID = _ctes(FEATURES, HOLDOUT, VALID)
for _name, _src in {
    "reorder_share_second_order_histogram": (RS_SECOND, "b_rs2", "ave_reorder_share", 100, 1.0),
    "reorder_share_last_order_histogram": (RS_LAST, "b_rsl", "ave_reorder_share", 100, 1.0),
    "reorder_share_per_order_histogram": (RS_ORDER, "b_rso", "reorder_share", 100, 1.0),
    "basket_size_histogram": (BS_USER, "b_bsu", "ave_basket_size", 100, 100.0),
    "average_basket_histogram": (FEATURES, "b_cand", "user_average_basket", 100, 100.0),
    "score_histogram": (_VALID, "b_vc", "score", 100, 1.0),
    "reorder_ratio_histogram": (_VALID, "b_vc", "user_reorder_ratio", 100, 1.0),
    "order_rate_histogram": (_VALID, "b_vc", "up_order_rate", 100, 1.0),
}.items():
    _reg(_name, _histogram(*_src), ["lower", "upper", "density"])
for _name, (_cte, _tab, _col) in {
    "reorder_share_second_order_summary": (RS_SECOND, "b_rs2", "ave_reorder_share"),
    "reorder_share_last_order_summary": (RS_LAST, "b_rsl", "ave_reorder_share"),
    "unique_products_summary": (N_PRODUCTS, "b_np", "n_products"),
}.items():
    _reg(
        _name,
        _q(_ctes(_cte, f"b_sval AS (SELECT {_col} AS value FROM {_tab})"), summary_select("b_sval", ["value"])),
        ["value"],
    )
_reg(
    "row_sample",
    _q(
        FEATURES,
        """SELECT user_id, product_id FROM (
             SELECT user_id, product_id,
                    (((user_id % 2147483647) * 48271 + 17) % 2147483647 + product_id % 2147483647)
                      % 2147483647 * 48271 % 2147483647 AS h
             FROM b_cand)
           WHERE h * 48271 % 2147483647 % 10000 < 1000""",
    ),
    [],
)

_reg("submission_last3", _q(TEST_SUB, "SELECT order_id, products FROM b_sub0"), [])
_reg(
    "submission_last3_none",
    _q(
        TEST_SUB,
        """SELECT order_id, products FROM b_sub0
           UNION ALL
           SELECT DISTINCT order_id, 'None' AS products FROM b_test
           WHERE order_id NOT IN (SELECT order_id FROM b_sub0)""",
    ),
    [],
)
_reg(
    "submission_cascade",
    _q(
        _ctes(
            TEST_SUB,
            """b_miss AS (
                SELECT DISTINCT user_id, order_id FROM b_test
                WHERE order_id NOT IN (SELECT order_id FROM b_sub0)
            )""",
            """b_sub1 AS (
                SELECT m.order_id,
                       string_agg(CAST(x.product_id AS VARCHAR), ' ' ORDER BY x.product_id) AS products
                FROM (SELECT DISTINCT user_id, product_id FROM b_prior WHERE reordered = 1) x
                JOIN b_miss m ON x.user_id = m.user_id
                GROUP BY m.order_id
            )""",
            """b_miss1 AS (
                SELECT DISTINCT user_id, order_id FROM b_test
                WHERE order_id NOT IN (SELECT order_id FROM b_sub0)
                  AND order_id NOT IN (SELECT order_id FROM b_sub1)
            )""",
            """b_sub3 AS (
                SELECT m.order_id,
                       string_agg(CAST(x.product_id AS VARCHAR), ' ' ORDER BY x.product_id) AS products
                FROM (SELECT DISTINCT user_id, product_id FROM b_prior) x
                JOIN b_miss1 m ON x.user_id = m.user_id
                GROUP BY m.order_id
            )""",
        ),
        """SELECT order_id, products FROM b_sub0
           UNION ALL SELECT order_id, products FROM b_sub1
           UNION ALL SELECT order_id, products FROM b_sub3""",
    ),
    [],
)


def _rounded(body: str, doubles: list[str]) -> str:
    sql = with_base(body)
    if not doubles:
        return sql
    repl = ", ".join(
        f'CASE WHEN abs("{c}") < 1e12::DOUBLE '
        f'THEN floor("{c}" * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE '
        f'ELSE "{c}" END AS "{c}"'
        for c in doubles
    )
    return f"SELECT * REPLACE ({repl}) FROM ({sql}) AS q"


def oracle_sql() -> dict[str, str]:
    return {name: _rounded(body, doubles) for name, (body, doubles) in ORACLE.items()}


def oracle_doubles() -> dict[str, list[str]]:
    return {name: list(doubles) for name, (_, doubles) in ORACLE.items()}
