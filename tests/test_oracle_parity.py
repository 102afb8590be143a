"""Every SQL-expressible query equals its DuckDB twin (sf0.001 here; the
driver runs the same comparison at sf0.01 and scripts/check_parity.py
reproduces it)."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_mod
from conftest import SF_SMALL
from parity import compare, duck_connection

SQLS = entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_matches_oracle(spark, con, name):
    df = entry_mod.queries()[name](spark, SF_SMALL)
    res = compare(df, con, SQLS[name])
    assert res["ok"], res


def test_every_query_has_oracle_or_is_rows_only():
    optional = re.compile(r"op\d+_|pipeline$")  # the text operators, where present
    rows_only = {n for n in set(entry_mod.queries()) - set(SQLS) if not optional.match(n)}
    assert rows_only == {
        "model_scores",
        "model_config_best_cutoff",
        "model_config_scores",
        "feature_importance",
        "model_logloss",
        "model_cv",
        "submission_model",
        "submission_tuning",
    }
    assert set(SQLS) <= set(entry_mod.queries())


def test_oracle_double_lists_match_spark_schema(spark):
    from basketry.plans.oracle import oracle_doubles

    qs = entry_mod.queries()
    for name, doubles in oracle_doubles().items():
        schema = qs[name](spark, SF_SMALL).schema
        spark_doubles = sorted(f.name for f in schema.fields if f.dataType.simpleString() == "double")
        assert spark_doubles == sorted(doubles), name
