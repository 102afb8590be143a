"""Train/validation splits and sampling (L1-L4).

The reference draws a random 10-30% of train users with R's generator
(seed 17).  That stream cannot be reproduced, so the split is a
deterministic arithmetic hash of user_id: rerun-stable, computed row-local
(no shuffle, no driver-side id list), and reproducible in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.sources.tables import BasketTables

# Fixed values of the split hash: a Lehmer generator step (modulus 2^31 - 1,
# multiplier 48271) applied twice to the user id.
HASH_MODULUS = 2147483647
HASH_MULTIPLIER = 48271
DEFAULT_SEED = 17
DEFAULT_IN_PCT = 20  # share of train users used for fitting ("in")


def user_bucket(user_id: Column, seed: int = DEFAULT_SEED) -> Column:
    """0..99, stable per user and seed."""
    h = user_id % HASH_MODULUS
    h = (h * HASH_MULTIPLIER + seed) % HASH_MODULUS
    h = (h * HASH_MULTIPLIER) % HASH_MODULUS
    return (h % 100).cast("int")


def train_users(t: BasketTables) -> DataFrame:
    """Users with a train order and at least one prior order (the users
    that have candidate rows): one grouped pass over orders."""
    return (
        t.orders.groupBy("user_id")
        .agg(
            F.bool_or(F.col("eval_set") == "train").alias("has_train"),
            F.bool_or(F.col("eval_set") == "prior").alias("has_prior"),
        )
        .where(F.col("has_train") & F.col("has_prior"))
        .select("user_id")
    )


def user_holdout_split(
    t: BasketTables, pct: int = DEFAULT_IN_PCT, seed: int = DEFAULT_SEED
) -> DataFrame:
    """L2: user_id, part = 'in' (fit) or 'ud' (validation)."""
    return train_users(t).select(
        "user_id",
        F.when(user_bucket(F.col("user_id"), seed) < pct, F.lit("in"))
        .otherwise(F.lit("ud"))
        .alias("part"),
    )


def users_in_part(t: BasketTables, part: str, pct: int = DEFAULT_IN_PCT, seed: int = DEFAULT_SEED) -> DataFrame:
    return user_holdout_split(t, pct, seed).where(F.col("part") == part).select("user_id")


def anti_join_validation_users(candidates: DataFrame, t: BasketTables) -> DataFrame:
    """Train candidates of users NOT drawn into the fitting part."""
    fit_users = users_in_part(t, "in")
    return (
        candidates.where(F.col("eval_set") == "train")
        .join(fit_users, "user_id", "left_anti")
        .select("user_id", "product_id")
    )


def row_bucket(user_id: Column, product_id: Column, seed: int = DEFAULT_SEED) -> Column:
    """0..9999, stable per (user, product) and seed: a Lehmer step of the
    user, then one of its sum with the product."""
    h = (user_id % HASH_MODULUS * HASH_MULTIPLIER + seed) % HASH_MODULUS
    h = ((h + product_id % HASH_MODULUS) % HASH_MODULUS * HASH_MULTIPLIER) % HASH_MODULUS
    return ((h * HASH_MULTIPLIER) % HASH_MODULUS % 10000).cast("int")


def row_sample(candidates: DataFrame, fraction: float = 0.1, seed: int = DEFAULT_SEED) -> DataFrame:
    """L3: a row-level sample (not user-level, as in the reference) by a hash
    of the row's key: the same rows on every run, whatever the partitioning."""
    keep = row_bucket(F.col("user_id"), F.col("product_id"), seed) < round(fraction * 10000)
    return candidates.select("user_id", "product_id").where(keep)
