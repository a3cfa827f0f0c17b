"""Every registered query against its SQL twin on the smallest data set."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL

import __spark_entry__ as contract
from compare import connect, differences
from veilframe.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["doc_id", "redacted", "token_count"]
    assert df.count() == 200


def test_all_have_a_twin():
    assert set(QUERIES) <= set(contract.oracle_sql())
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_twin(spark, con, name):
    assert differences(spark, con, SF_SMALL, name) is None
