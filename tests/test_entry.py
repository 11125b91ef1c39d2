"""The driver contract."""

from __future__ import annotations

import __spark_entry__ as contract
from catalog import QUERIES


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "reference_id" and df.count() > 0


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())
    assert set(QUERIES) - set(contract.oracle_sql()) == {
        "oof_scores", "fold_r2", "importance_table", "test_scores"}
