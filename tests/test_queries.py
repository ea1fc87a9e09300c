"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

from tests.compare import assert_same
from tidewater.plans import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        assert_same(df, ORACLE[name], sf_dir)
    else:
        assert df.count() >= 0
