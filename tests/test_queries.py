"""Every registered query against its SQL, and the driver's contract."""

from __future__ import annotations

import pytest

import __spark_entry__
import oracle
from hydroloom.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    oracle.compare(spark, QUERIES[name], ORACLES[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
