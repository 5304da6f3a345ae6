"""Every query runs, and returns what its SQL returns."""

import pytest

from paperloom import plans

from .compare import assert_same


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, folder, duck):
    df = plans.QUERIES[name](spark, folder)
    if name in plans.SQL:
        assert_same(df, duck, plans.SQL[name])
    else:
        assert df.columns and df.count() >= 0
