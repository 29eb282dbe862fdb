"""Every query against its check on the shared tables."""

import re

import __spark_entry__ as entry_module
import compare
import pytest

CHECKS = entry_module.oracle_sql()


# Queries of the operators for training text have their own tests.
LLM = re.compile(r"op\d+_|pipeline$")
KEYS = [key for key in entry_module.queries() if not LLM.match(key)]


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_check(spark, sf_dir, duck, key):
    columns, rows = compare.spark_table(entry_module.queries()[key](spark, sf_dir))
    want_columns, want_rows = compare.duck_table(duck, CHECKS[key])
    assert columns == want_columns
    assert len(rows) == len(want_rows)
    assert rows == want_rows


def test_every_query_has_a_check():
    assert set(KEYS) <= set(CHECKS)


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).take(1)
