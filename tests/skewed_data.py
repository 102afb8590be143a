"""A driver-format dataset (part, orders, lineitem) where one customer owns
about a third of all orders and lines, and one part appears on a large
share of lines.  Deterministic; written as parquet to a scratch folder."""

from __future__ import annotations

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq

BRANDS = [f"Brand#{i}" for i in range(1, 6)]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def write_skewed(root: str, customers: int = 120, hot_orders: int = 400, seed: int = 7) -> str:
    rnd = random.Random(seed)
    os.makedirs(root, exist_ok=True)
    parts = list(range(1, 61))
    pq.write_table(
        pa.table(
            {
                "p_partkey": pa.array(parts, pa.int64()),
                "p_brand": [BRANDS[p % len(BRANDS)] for p in parts],
                "p_type": [TYPES[(p // len(BRANDS)) % len(TYPES)] for p in parts],
            }
        ),
        os.path.join(root, "part.parquet"),
    )
    o_key, o_cust, o_date = [], [], []
    l_order, l_part, l_line = [], [], []
    key = 1
    start = dt.datetime(1995, 1, 1)
    plan = [(0, hot_orders)] + [(c, rnd.randint(1, 6)) for c in range(1, customers)]
    for cust, n_orders in plan:
        favourites = rnd.sample(parts, 8)
        for _ in range(n_orders):
            o_key.append(key)
            o_cust.append(cust)
            # several orders of the hot customer share a day
            o_date.append(start + dt.timedelta(days=rnd.randint(0, 200 if cust == 0 else 900)))
            n_lines = rnd.randint(0 if cust else 1, 7)
            for line in range(1, n_lines + 1):
                pool = favourites if rnd.random() < 0.7 else parts
                part = 1 if rnd.random() < 0.25 else rnd.choice(pool)  # a hot part
                l_order.append(key)
                l_part.append(part)
                l_line.append(line)
            key += 1
    pq.write_table(
        pa.table(
            {
                "o_orderkey": pa.array(o_key, pa.int64()),
                "o_custkey": pa.array(o_cust, pa.int64()),
                "o_orderdate": pa.array(o_date, pa.timestamp("us")),
            }
        ),
        os.path.join(root, "orders.parquet"),
    )
    pq.write_table(
        pa.table(
            {
                "l_orderkey": pa.array(l_order, pa.int64()),
                "l_partkey": pa.array(l_part, pa.int64()),
                "l_linenumber": pa.array(l_line, pa.int32()),
            }
        ),
        os.path.join(root, "lineitem.parquet"),
    )
    return root
