"""Every registered query against its SQL, at the smallest scale."""

import os

import pytest
from oracle_check import compare

from tilewright.plans import load_all
from tilewright.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
load_all()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, key):
    r = compare(spark, SF, key, QUERIES, ORACLES)
    assert r["ok"] is not False, r
    assert r["rows"] > 0 or key in ("donor_candidates",)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
