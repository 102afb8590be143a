"""How the candidate table is put together over the written fact."""

from __future__ import annotations

import re

import pytest

from basketry.functions.lineage import cut_lineage
from basketry.operators import features as FE


def dealt_by(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"hashpartitioning\(([^()]*(?:\([^()]*\)[^()]*)*), \d+\)", plan)]


@pytest.mark.parametrize("make", [FE.candidate_features, FE.candidate_features_base])
def test_candidates_are_not_dealt_by_product(small_tables, make):
    found = make(small_tables, FE.written_product_features(small_tables))
    assert "product_id" not in dealt_by(found) and "product_id" in dealt_by(make(small_tables))
    want = make(small_tables).collect()
    assert sorted(map(str, found.collect())) == sorted(map(str, want)) and want


def test_written_fact_is_reduced_to_pairs_once_for_features_and_flags(small_tables):
    plan = FE.candidate_features(small_tables, FE.written_product_features(small_tables))._jdf.queryExecution().optimizedPlan().toString()
    # the candidates' own aggregation, and the one that users are made from
    assert len(re.findall(r"Aggregate \[user_id#\d+L?, product_id#\d+L?\]", plan)) == 2

def test_cut_lineage_writes_encoded_files(spark):
    rows = spark.range(100_000).selectExpr("id % 3 as a", "0.5 as b")
    cut = cut_lineage(rows)
    assert cut.inputFiles() and cut.count() == 100_000
    assert cut.schema.simpleString() == rows.schema.simpleString()
