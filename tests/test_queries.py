"""Every query with SQL against that SQL, and all others run to their end."""

import duckdb
import pytest

from tracklark.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return made


def shown(rows):
    return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    ran = con.execute(ORACLES[name])
    columns, rows = [c[0] for c in ran.description], ran.fetchall()
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert shown(got.select(*columns).collect()) == shown(rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    assert got.columns and got.collect() is not None


@pytest.mark.parametrize("name", ["radius_neighbours", "rect_overlap_pairs", "fixed_spot", "shared_frame_distance", "mask_overlaps", "distance_to_edge", "follow_reference"])
def test_range_joins_are_equi_joins(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_read_only_needed_columns(spark, sf_dir):
    plan = QUERIES["lookup_misses"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_comment" not in plan


def test_features_of_one_track_need_one_shuffle(spark, sf_dir):
    from tracklark.operators import features

    points = spark.createDataFrame([(1, 1, 0.0, 0.0)], "track_id long, frame int, x double, y double")
    plan = features.basic(points)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_greedy_matching_runs_no_python(spark, sf_dir):
    plan = QUERIES["match_decisions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan
