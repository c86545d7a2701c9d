import pytest
from oracle import compare

from sketchloom.plans.registry import ORACLES, QUERIES

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, D)
    if name in ORACLES:
        compare(df, ORACLES[name], D)
    else:
        assert df.count() > 0
