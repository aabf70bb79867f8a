"""Queries on tables with the keys and sizes of large copies: results as SQL gives them, plans that hold."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orbisframe.operators import spatial, validation
from orbisframe.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def like_sql(spark, folder, name, **made):
    """(rows got, rows of the SQL); made: texts of tables that are not read from SF."""
    con = duckdb.connect()
    for t in ("customer", "supplier", "events"):
        con.execute(f"copy ({made.get(t, f"select * from '{SF}/{t}.parquet'")}) to '{folder}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, str(folder)).select(*[f"`{n}`" for n in names]).collect()
    key = lambda r: tuple("" if v is None else repr(v) for v in r)
    return sorted(map(tuple, got), key=key), sorted(want.fetchall(), key=key)


def test_band_arith_rounds_large_values_like_sql(spark, tmp_path):
    got, want = like_sql(spark, tmp_path, "band_arith", events=f"select * replace(event_id + 1000 * r.range as event_id, user_id + 10000000 * r.range as user_id) from '{SF}/events.parquet', range(6) r")
    assert got == want


def test_band_unary_has_the_last_digits_of_sql(spark, tmp_path):
    got, want = like_sql(spark, tmp_path, "band_unary", events=f"select * replace(event_id + 1000 * r.range as event_id, user_id + 1500 * r.range as user_id) from '{SF}/events.parquet', range(20) r")
    assert got == want


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


#: Queries whose sides look small by their files and are not.
NEVER_BROADCAST = ["knn_weights", "bias_report", "morans_i", "ess", "evaluate_spatial", "gearys_c", "lisa", "lisa_clusters"]


@pytest.mark.parametrize("name", NEVER_BROADCAST)
def test_points_and_neighbours_are_not_broadcast(spark, name):
    assert "BroadcastHashJoin" not in plan(QUERIES[name](spark, SF))


#: Queries held to a broadcast limit on copies of the customers with shifted keys.
SMALL_BROADCASTS = ["bias_report", "ess", "lisa_clusters", "evaluate_spatial"]


@pytest.mark.parametrize("name", SMALL_BROADCASTS)
def test_copies_give_the_rows_of_sql_with_no_large_broadcast(spark, tmp_path, name):
    spark.conf.set("spark.sql.maxBroadcastTableSize", "64k")  # a larger one raises
    try:
        got, want = like_sql(spark, tmp_path, name, customer=f"select * replace(c_custkey + 150 * r.range as c_custkey) from '{SF}/customer.parquet', range(20) r")
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert len(got) > 0 and got == want


@pytest.fixture
def pairs_made(monkeypatch):
    """Counts the pairs that searches within a distance give out as rows."""
    made, real = [], spatial.within

    def within(*args):
        found = real(*args)
        made.append(found.count())
        return found

    for module in (spatial, validation):
        monkeypatch.setattr(module, "within", within)
    return made


def dense(spark, n):
    """n points in a square of side 1, of unlike values; every tenth without one."""
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y), None if i % 10 == 0 else float(i % 7)) for i, (x, y) in enumerate(rng.random((n, 2)))]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, v double")


def test_variogram_makes_no_rows_of_pairs(spark, pairs_made, monkeypatch):
    monkeypatch.setattr(spatial, "PART", 100, raising=False)  # some parts a cell
    rows, points = dense(spark, 700)
    got = {r.lag: r for r in spatial.variogram(points, "v", 5, 0.4).collect()}
    _, x, y, v = (np.array(c, dtype=float) for c in zip(*rows, strict=True))
    i, j = np.triu_indices(len(rows), 1)
    d = np.sqrt((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2)
    for lag in range(5):
        own = (d < 0.4) & (np.floor(d / (0.4 / 5)) == lag)
        half = (v[i] - v[j])[own] ** 2 / 2
        assert got[lag].pairs == own.sum()
        assert got[lag].distance == pytest.approx(d[own].mean())
        assert got[lag].semivariance == pytest.approx(half[~np.isnan(half)].mean())
    assert sum(pairs_made) == 0


def test_min_distance_of_dense_points_makes_few_pairs(spark, pairs_made, monkeypatch):
    monkeypatch.setattr(validation, "STRETCH", 20, raising=False)
    rows, points = dense(spark, 3000)
    order = [r.id for r in points.orderBy(F.xxhash64(F.lit(42), "id"), "id").collect()]
    place, kept = {r[0]: r[1:3] for r in rows}, []
    for i in order:
        if all(math.sqrt((place[i][0] - place[k][0]) ** 2 + (place[i][1] - place[k][1]) ** 2) >= 0.2 for k in kept):
            kept.append(i)
    for n in (5, 1000):
        pairs_made.clear()
        assert {r.id for r in validation.min_distance(points, n, 0.2).collect()} == set(kept[:n])
        assert sum(pairs_made) < 20 * len(rows)


@pytest.mark.parametrize("radius", [0.3, 0.03, 0.0])
def test_buffers_of_dense_folds_make_no_rows_of_all_pairs(spark, pairs_made, radius):
    rows, points = dense(spark, 600)
    folds = {"dealt": [i % 3 for i in range(600)], "blocks": [int(x * 3) for _, x, _, _ in rows]}
    xy = np.array([r[1:3] for r in rows])
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    for fold in folds.values():
        named = points.join(spark.createDataFrame(list(enumerate(fold)), "id long, fold int"), "id")
        got = [tuple(r) for r in validation.BufferedSpatialCV(radius, unit="crs").excluded(named).collect()]
        f = np.array(fold)
        want = {(int(i), k) for k in range(3) for i in np.flatnonzero((d[:, f == k] <= radius).any(axis=1) & (f != k))}
        assert len(got) == len(set(got)) and set(got) == want
    assert sum(pairs_made) == 0


def test_distance_weights_do_not_deal_out_pairs(spark):
    rows, points = dense(spark, 400)
    df = spatial.distance_weights(points, 0.2)
    assert "Window" not in plan(df)
    xy = np.array([r[1:3] for r in rows])
    near = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2)) <= 0.2
    np.fill_diagonal(near, False)
    assert {(r.i, r.j): r.w for r in df.collect()} == {(i, j): 1.0 / near[i].sum() for i, j in np.argwhere(near).tolist()}
