"""Each hotel point meets all the beaches that the reference routes it to."""

import os
from collections import Counter

import pytest

from meridia.plans import core_queries, registry

DATA = os.environ.get("MERIDIA_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no delivered tables")
@pytest.mark.parametrize("name", ["nearest_beaches", "beach_routes"])
def test_twenty_beaches_a_point(spark, name):
    points, beaches = core_queries._points(spark, DATA)
    found = Counter(r.pid for r in registry.queries()[name](spark, DATA).select("pid", "cid").distinct().collect())
    assert set(found) == {r.pid for r in points.collect()}
    assert set(found.values()) == {min(20, beaches.count())}
