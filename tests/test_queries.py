"""Every registered query of the library against its SQL twin at the smallest size."""

from __future__ import annotations

import importlib
import math
import os
import statistics

import duckdb
import pytest

from trackloom.plans import registry
from trackloom.plans.adapters import BASE

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in BASE:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return connection


def cell(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return f"{round(float(value), 6) + 0.0:.6f}"


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([tuple(cell(r[k]) for k in order) for r in values], key=str)


#: Queries without SQL twin, and the tests of their values against plain programmes.
ELSEWHERE = {
    "g28_merged_zones": "test_generation.test_zones_are_those_of_whole_pages",
    "k10_markers": "test_generation.test_markers_are_those_of_the_plain_rule",
    "k11_path_colours": "test_generation.test_colours_are_those_of_the_plain_rule",
    "d04_targets": "test_generation.test_targets_keep_apart",
    "s01_tracks": "test_tracking.test_tracks_of_the_registered_query",
    "s01_kept_tracks": "test_queries.test_kept_tracks",
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql_twin(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    own = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        module, test = ELSEWHERE[name].split(".")
        assert own and hasattr(importlib.import_module(module), test)
        return
    twin = duck.execute(sql)
    columns = [c[0] for c in twin.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, own) == rows(columns, twin.fetchall())


def test_entry_runs_without_the_optional_parts(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["det_idx", "video", "frame", "x", "y", "area"]
    assert set(registry.queries()) <= set(__spark_entry__.queries()) and set(registry.oracle_sql()) <= set(__spark_entry__.oracle_sql())


def test_kept_tracks(spark):
    points = {}
    for r in registry.queries()["s01_tracks"](spark, SF_DIR).orderBy("track", "frame").collect():
        points.setdefault(r["track"], []).append((r["x"], r["y"]))
    kept = registry.queries()["s01_kept_tracks"](spark, SF_DIR).collect()
    assert {r["track"] for r in kept} == set(points)
    for r in kept:
        own = points[r["track"]]
        headings = [math.atan2(b[1] - a[1], b[0] - a[0]) for a, b in zip(own, own[1:]) if a != b]
        turns = [abs((b - a + math.pi) % (2 * math.pi) - math.pi) for a, b in zip(headings, headings[1:])]
        chord, turn = math.dist(own[0], own[-1]), statistics.median(turns) if turns else 0.0
        assert r["hits"] == len(own) and abs(r["chord"] - chord) < 1e-5 and abs(r["turn"] - turn) < 1e-5
        assert r["kept"] == (len(own) >= 6 and chord >= 45 and turn <= 3.2)
