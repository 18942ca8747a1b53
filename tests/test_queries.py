"""Registered queries against DuckDB at the smallest scale.

The default run takes one query per area; VULNSPARK_ALL_QUERIES=1 takes every one.
"""

from __future__ import annotations

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from vulnspark.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("component_scope", "carry_forward_state", "close_reasons", "exceptions_precedence", "reach_tier", "entry_join_range", "hops_bfs",
          "placement_ledger", "score_tier", "rollup_dim", "osv_ranges", "top12_bucket")


#: Queries beyond SQL, held against a brute force in the tests.
BRUTE_FORCE = {"route_view"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) | BRUTE_FORCE and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")
@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("VULNSPARK_ALL_QUERIES") else SAMPLE)
def test_same_rows_as_the_oracle(spark, name):
    assert compare(connect(FOLDER), entry.oracle_sql()[name], entry.queries()[name](spark, FOLDER)) == ""
