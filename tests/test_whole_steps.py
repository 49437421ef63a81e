"""Merging by time takes every step of the events, counted without the grid's views."""

from __future__ import annotations

import pytest

import oracle
from hydroloom.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["merge_time_every_step", "merge_time_every_step_with_terrain"])
def test_every_step_is_merged(spark, name):
    merged = QUERIES[name](spark, oracle.SF).filter("var != 'terrain'").collect()
    cells, steps = oracle.duck().execute("SELECT count(DISTINCT (event_type, date_trunc('hour', ts), user_id)), count(DISTINCT date_trunc('hour', ts)) FROM events").fetchone()
    assert len(merged) == cells and len({r["time"] for r in merged}) == steps > 2
