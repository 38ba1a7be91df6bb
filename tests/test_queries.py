"""Registered queries against their SQL, on the smallest tables."""

import pytest

from geodiag.plans import queries
from oracle import SF, compare


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_its_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name])


def test_queries_without_sql(spark):
    assert set(queries.QUERIES) - set(queries.SQL) == {"crs_candidates"}
    rows = queries.QUERIES["crs_candidates"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.layer_idx, []).append(r)
    for layer in by.values():
        layer.sort(key=lambda r: r["rank"])
        plane = [r.max_area_distortion_pct for r in layer if not r.geographic]
        assert plane == sorted(plane) and {"EPSG:6933", "EPSG:3035", "EPSG:4326", "EPSG:3857"} <= {r.crs for r in layer} and layer[-1].geographic


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
