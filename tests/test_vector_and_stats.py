"""Geometry, features, spatial statistics, inference, splits, sources and presentation."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbisframe.functions import crs, distributions
from orbisframe.operators import inference, spatial, validation
from orbisframe.operators.filter import Filter
from orbisframe.operators.geometry import Geometry
from orbisframe.operators.raster import Image
from orbisframe.operators.vector import FeatureCollection, block
from orbisframe.plans.presentation import Map, Table, degree_label, degree_precision, scale_bar
from orbisframe.sources import catalogs, features
from orbisframe.sources.gedi import GEDI
from orbisframe.streaming.composite import running_composite


def cloud(spark, n=120, seed=1, cols="v double"):
    rng = random.Random(seed)
    rows = [(i, rng.random(), rng.random() ** 2, rng.gauss(0, 1)) for i in range(n)] + [(n, 0.5, 0.5, 1.0), (n + 1, 0.5, 0.5, 2.0), (n + 2, 9.0, 9.0, 0.0)]
    return spark.createDataFrame(rows, f"id long, x double, y double, {cols}"), rows


def test_neighbours_match_brute_force(spark):
    df, rows = cloud(spark)
    for k in (1, 5):
        got = sorted((r.i, r["rank"], r.j) for r in spatial.nearest(df, df, k, same=True).collect())
        want = []
        for a in rows:
            near = sorted((math.dist(a[1:3], b[1:3]), b[0]) for b in rows if b[0] != a[0])[:k]
            want += [(a[0], n + 1, b) for n, (_, b) in enumerate(near)]
        assert got == sorted(want)
    pairs = {(r.i, r.j) for r in spatial.within(df, df, 0.1).collect()}
    assert pairs == {(a[0], b[0]) for a in rows for b in rows if math.dist(a[1:3], b[1:3]) <= 0.1}
    assert spatial.nearest(df.limit(0), df, 2).count() == 0 and spatial.nearest(df, df.limit(1), 3, same=True).count() == 0


def test_moran_guards(spark):
    df, _ = cloud(spark)
    assert spatial.morans_i(df.withColumn("v", F.lit(1.0)), "v").p_value == 1.0
    with pytest.raises(ValueError):
        spatial.morans_i(df.limit(3), "v")
    with pytest.raises(ValueError):
        spatial.morans_i(df.withColumn("v", F.when(F.col("id") > 3, F.col("v"))), "v")
    df = df.filter("x < 2")
    trend = spatial.morans_i(df, "x", k=4)
    assert trend.I > 0.5 and trend.p_value < 1e-6 and "clustered" in trend.summary()
    ess = spatial.effective_sample_size(df, "x")
    assert ess["pseudoreplication_risk"] and ess["effective_n"] < ess["nominal_n"]
    lisa = spatial.local_morans_i(df, "x", k=4)
    assert {r.cluster for r in lisa.collect()} & {"HH", "LL"}
    assert 0 < spatial.gearys_c(df, "x", k=4) < 0.7
    bins = spatial.variogram(df, "x", 5, 0.5)
    nugget, sill = spatial.nugget_and_sill(bins)
    assert nugget < sill and spatial.variogram(df, "x").count() > 3


def test_distributions():
    assert distributions.t_p(2.0, 10) == pytest.approx(0.073388, rel=1e-4)
    assert distributions.f_p(3.0, 2, 20) == pytest.approx(0.072538, rel=1e-4)
    assert distributions.normal_p(1.959964) == pytest.approx(0.05, rel=1e-5)
    assert distributions.sample_size(0.5) == 63


def test_inference(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.random()), float(rng.random()), float(rng.normal(10 if i % 2 else 0, 1)), "ab"[i % 2 == 0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, y double, v double, g string")
    welch, u = inference.test(df, "v", "g"), inference.test(df, "v", "g", "mann_whitney")
    assert abs(welch.effect) > 5 and welch.p_value < 1e-6 and abs(u.effect) == 1.0 and (welch.effect > 0) == (u.effect > 0)
    assert inference.test(df, "v", "g", "anova").effect_name == "eta_squared"
    assert inference.test(df.withColumn("g", (F.col("id") % 3).cast("string")), "v", "g", "mwu").test == "One-way ANOVA"
    assert inference._u_exact(0, 3, 3) == pytest.approx(0.1)
    with pytest.raises(ValueError):
        inference.test(df, "v", "g", "x")
    with pytest.raises(ValueError):
        inference.test(df.filter("g = 'a'"), "v", "g")


def test_splits_do_not_leak(spark):
    df, rows = cloud(spark)
    cells = spark.createDataFrame([(i * 4 + j, i / 4, j / 4, (i + 1) / 4, (j + 1) / 4) for i in range(4) for j in range(4)], "block_id long, minx double, miny double, maxx double, maxy double")
    named = {r.id: r.block_id for r in validation.assign_blocks(df, cells).collect()}
    for i, x, y, _ in rows:
        d = [(math.hypot(max(a / 4 - x, x - a / 4 - 0.25, 0), max(b / 4 - y, y - b / 4 - 0.25, 0)), a * 4 + b) for a in range(4) for b in range(4)]
        assert named[i] == min(d)[1]
    seen = set()
    for train, val in validation.BufferedSpatialCV(0.05, 4, cells).split(df):
        t, v = train.collect(), {r.id: r for r in val.collect()}
        assert not {r.id for r in t} & v.keys() and not seen & v.keys()
        assert all(math.dist((a.x, a.y), (b.x, b.y)) > 0.05 for a in t for b in v.values())
        seen |= v.keys()
    assert len(seen) == len(rows)
    assert validation.SpatialCV(5, 3).folds(df).select("fold").distinct().count() == 3
    with pytest.raises(ValueError):
        validation.SpatialCV(cells.limit(2), 5).folds(df).count()


def test_leakage(spark):
    make = lambda pts: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    r = validation.leakage_report(make([(0, 0), (2000, 0), (0, 2000), (2000, 2000)]), make([(1000, 1000)]), 500)
    assert r.has_overlap and not r.has_leakage and r.proximity_checked and r.min_distance == pytest.approx(1000 * math.sqrt(2))
    far = validation.leakage_report(make([(0, 0), (0, 1), (1, 0), (1, 1)]), make([(5, 5), (5, 6), (6, 5)]))
    assert not far.has_overlap and "no leakage" in far.summary()
    assert validation.leakage_report(make([(0, 0)]), make([(0, 0)])).duplicate_count == 1


def test_sampling_and_patches(spark):
    df, _ = cloud(spark)
    kept = validation.min_distance(df, 500, 0.1).collect()
    assert all(math.dist((a.x, a.y), (b.x, b.y)) >= 0.1 for a in kept for b in kept if a.id != b.id)
    assert validation.min_distance(df, 1, 0.1).count() == 1
    halves = Image.from_numpy(spark, np.repeat([[1.0] * 10 + [2.0] * 10], 20, axis=0), (1.0, 0.0, 0.0, 0.0, -1.0, 20.0), 32633, ["k"])
    got = validation.stratified(halves.df, "k", 30).groupBy("k").count().collect()
    assert {(r.k, r["count"]) for r in got} == {(1.0, 30), (2.0, 30)}
    boxes = FeatureCollection(spark.createDataFrame([(0, "a", 0.0, 0.0, 1.0, 1.0), (1, "b", 2.0, 0.0, 3.0, 1.0)], "fid long, c string, minx double, miny double, maxx double, maxy double"))
    assert {(r.c, r["count"]) for r in validation.stratified_in(boxes, "c", 10).groupBy("c").count().collect()} == {("a", 10), ("b", 10)}
    ds = validation.PatchDataset(Image.from_numpy(spark, np.arange(1024.0).reshape(32, 32), (1.0, 0.0, 0.0, 0.0, -1.0, 32.0), 32633), patch_size=8, stride=4)
    assert ds.windows().count() == 49
    first = next(iter(ds.dataloader(4)))
    assert first.shape == (4, 1, 8, 8) and first[1, 0, 0, 0] == 4 and first[0, 0, 1, 0] == 32
    parts = {}
    for r in ds.split(block_size=16, seed=1).filter("split is not null").collect():
        parts.setdefault(r.split, []).append((r.row, r.col))
    flat = [(s, p) for s, ps in parts.items() for p in ps]
    assert all(s == t or abs(p[0] - q[0]) >= 8 or abs(p[1] - q[1]) >= 8 for s, p in flat for t, q in flat)


def test_blocks(spark):
    hexes = block(Geometry.Rectangle(0, 0, 10000, 10000, crs=32633), spark, 2000, shape="hexagonal").df.collect()
    r = 2000 / math.sqrt(3)
    assert [h.block_id for h in sorted(hexes, key=lambda h: h.block_id)] == list(range(len(hexes)))
    for a in hexes:
        for b in hexes:
            assert a is b or math.dist((a.cx, a.cy), (b.cx, b.cy)) > 1999
    rng = random.Random(2)
    inside = lambda h, x, y: abs(x - h.cx) <= 1000 + 1e-6 and abs(x - h.cx) / 2 + abs(y - h.cy) * math.sqrt(3) / 2 <= 1000 + 1e-6
    assert all(any(inside(h, x, y) for h in hexes) for x, y in ((rng.random() * 10000, rng.random() * 10000) for _ in range(200)))
    assert math.isclose(r * math.sqrt(3), 2000) and block(Geometry.Rectangle(91, 22, 91.1, 22.1), spark, 5000).crs.epsg == 32646
    with pytest.raises(ValueError):
        block(Geometry.Rectangle(0, 0, 1, 1), spark, 1, "crs", "disc")


def test_geometry():
    square = Geometry.Rectangle(0, 0, 2, 2)
    ell = Geometry.Polygon([(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)])
    assert (square.area, square.length, square.bounds) == (4, 8, (0, 0, 2, 2)) and ell.area == 5 and square.centroid.points == [(1, 1)]
    assert ell.intersection(square).area == pytest.approx(3) and ell.difference(square).area == pytest.approx(2)
    assert square.union(Geometry.Rectangle(1, 0, 3, 2)).area == pytest.approx(6) and square.symmetric_difference(Geometry.Rectangle(1, 0, 3, 2)).area == pytest.approx(4)
    assert square.contains(Geometry.Point(1, 1)) and not square.contains(ell) and square.intersects(ell) and not square.intersects(Geometry.Point(5, 5))
    assert Geometry.Point(0, 0).buffer(2).area == pytest.approx(4 * math.pi, rel=1e-2) and square.buffer(1).area == pytest.approx(4 + 8 + math.pi, rel=1e-2)
    assert len(Geometry.Polygon([(0, 0), (1, 0.001), (2, 0), (2, 2), (0, 2)]).simplify(0.1).polygons[0][0]) == 4
    assert ell.convex_hull.area == pytest.approx(7) and Geometry.from_geojson(json.dumps(ell.to_geojson())) == ell
    assert struct.unpack("<BIdd", Geometry.Point(1, 2).to_wkb()) == (1, 1, 1.0, 2.0) and square.to_wkt().startswith("POLYGON ((0 0, 2 0")
    for bad in (lambda: Geometry.Point(1), lambda: Geometry.Rectangle(1, 2, 3)):
        with pytest.raises((ValueError, TypeError)):
            bad()
    holed = Geometry.Polygon([[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)]])
    assert holed.area == 15 and not holed.contains_xy(1.5, 1.5) and holed.contains_xy(1, 1.5)


def test_geometry_columns(spark):
    holed = Geometry.Polygon([[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (2, 3)]])
    rng = random.Random(4)
    pts = [(rng.uniform(-1, 5), rng.uniform(-1, 5)) for _ in range(300)]
    df = spark.createDataFrame(pts, "x double, y double")
    got = df.select("x", "y", holed.contains_point(F.col("x"), F.col("y")).alias("i")).collect()
    assert all(r.i == holed.contains_xy(r.x, r.y) for r in got)
    tri = Geometry.Polygon([(0, 0), (4, 0), (0, 4)])
    boxes = [(a, b, a + rng.random(), b + rng.random()) for a, b in pts]
    df = spark.createDataFrame(boxes, "a double, b double, c double, d double")
    got = df.select("*", tri.meets_box(*[F.col(c) for c in "abcd"]).alias("i")).collect()
    assert all(r.i == tri.intersects(Geometry.Rectangle(r.a, r.b, r.c, r.d)) for r in got)


def test_crs(spark):
    assert crs.transform(9.0, 45.0, 4326, 32632) == pytest.approx((500000, 4982950.4), abs=0.01)
    for epsg, lon, lat in ((3857, 91.7, 22.2), (32646, 91.7, 22.2), (32733, 17.0, -33.0)):
        assert crs.transform(*crs.transform(lon, lat, 4326, epsg), epsg, 4326) == pytest.approx((lon, lat), abs=1e-7)
        x, y = crs.transform(F.lit(lon), F.lit(lat), 4326, epsg)
        assert tuple(spark.range(1).select(x, y).first()) == pytest.approx(crs.transform(lon, lat, 4326, epsg), abs=1e-4)
    assert crs.CRS(None) == "EPSG:4326" and crs.CRS(32633).is_projected and crs.utm_epsg(180, 1) == 32660
    with pytest.raises(ValueError):
        crs.CRS(2154)


def test_features_round_trip(spark, tmp_path):
    rows = [(0, 1.5, -2.25, "a", 3), (1, 0.1, 1e-9, 'q"x', 4), (2, 0.0, 123456.789, None, 5)]
    fc = FeatureCollection(spark.createDataFrame(rows, "fid long, x double, y double, name string, count long"))
    got = fc.df.select("x", "y", features.wkb(fc).alias("b")).collect()
    assert all(struct.unpack("<BIdd", bytes(r.b)) == (1, 1, r.x, r.y) for r in got)
    features.write_geojson(fc, str(tmp_path / "g"))
    back = features.read_geojson_lines(spark, str(tmp_path / "g")).df.collect()
    assert sorted((r.minx, r.miny, r.properties["name"]) for r in back) == sorted((x, y, n) for _, x, y, n, _ in rows)
    whole = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": Geometry.Rectangle(0, 1, 2, 3).to_geojson(), "properties": {"k": "v"}}]}
    (tmp_path / "c.json").write_text(json.dumps(whole))
    one = features.read_geojson(spark, str(tmp_path / "c.json")).df.first()
    assert (one.minx, one.miny, one.maxx, one.maxy, one.properties) == (0, 1, 2, 3, {"k": "v"})
    features.write_csv(fc, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["fid", "name", "count", "geometry"]
    features.write_parquet(fc, str(tmp_path / "p"))
    assert features.read_parquet(spark, str(tmp_path / "p")).size() == 3
    assert fc.filter(Filter.eq("name", "a")).first().fid == 0 and fc.select(["count", "nope"]).columns == ["count"]
    assert fc.sort("name").df.collect()[-1].name is None and fc.dissolve().df.first().maxy == 123456.789


def test_gedi(spark):
    rows = [(i, 22.0 + i / 100, 91.0, int(i % 20 < 18), 0, 0.95, 86400.0 * (730 + i % 20), [float(h) for h in range(101)]) for i in range(40)]
    shots = spark.createDataFrame(rows, "shot_number long, lat_lowestmode double, lon_lowestmode double, quality_flag int, degrade_flag int, sensitivity double, delta_time double, rh array<double>")
    q = GEDI(shots=shots)
    assert q.to_frame().count() == 40 and q.filterQuality().to_frame().count() == 36 and q.filterDate("2020-01-03", "2020-01-05").to_frame().count() == 6
    r = q.filterBounds(Geometry.Rectangle(90, 22.0, 92, 22.0)).select(["rh98"]).to_frame().first()
    assert r.asDict() == {"latitude": 22.0, "longitude": 91.0, "rh98": 98.0}
    low = spark.createDataFrame([(1.0, 2.0, 2500)], "lat_lowestmode double, lon_lowestmode double, rh100_cm int")
    assert GEDI("L2B", low).filterQuality().to_frame().first().rh100 == 25.0


def test_catalogs(spark, tmp_path):
    items = [{"id": f"i{k}", "collection": "c", "bbox": [k, 0, k + 1, 1], "properties": {"datetime": f"2023-0{k + 1}-01T00:00:00Z", "eo:cloud_cover": "10"}, "assets": {}} for k in range(5)]
    (tmp_path / "i.json").write_text("\n".join(map(json.dumps, items)))
    table = catalogs.read_items(spark, str(tmp_path / "i.json"))
    assert [r.id for r in catalogs.search_stac(table, "c", Geometry.Rectangle(1.5, 0, 2.5, 1), "2023-01-01", "2023-12-31").collect()] == ["i1", "i2"]
    times = spark.createDataFrame([("2023-02-01T10:00:00Z",), ("2023-08-01T00:00:00Z",)], "time string")
    assert [r.id for r in catalogs.nearest_items(times, table).collect()] == ["i1"]
    files = spark.createDataFrame([("/d/HLS.L30.T46QCK.2023001T042149.v2.0.B04.tif",), ("/d/HLS.L30.T46QCK.2023001T042149.v2.0.B05.tif",), ("/d/x.txt",)], "path string")
    (g,) = catalogs.granules(files).collect()
    assert (str(g.day), len(g.files)) == ("2023-01-01", 2)


def test_presentation(spark, tmp_path):
    assert degree_label(-22.5, True, "DMS") == "22° 30' 00\" S" and degree_label(91.51, False, "DM") == "91° 30.6' E" and degree_label(1.999999, False, "DMS") == "2° 00' 00\" E"
    assert degree_label(22.256, True) == "22.26° N" and (degree_precision(0.001), degree_precision(0.01), degree_precision(1)) == (4, 3, 2)
    assert scale_bar(40_000) == (10000, "10 km") and scale_bar(1000) == (250, "250 m")
    t = Table([{"a_b": 1, "c": 0.5}, {"a_b": None, "c": 2}], "x & y")
    assert t.to_markdown().startswith("| a_b | c |") and "a\\_b" in t.to_latex() and "x &amp; y" in t.to_html()
    t.save(str(tmp_path / "t.csv"))
    assert (tmp_path / "t.csv").read_text() == "a_b,c\n1,0.5\n,2\n"
    fc = FeatureCollection(spark.createDataFrame([(0, 91.0, 22.0, "</script><script>alert(1)")], "fid long, x double, y double, n string"))
    page = Map().centerObject(fc).addLayer(fc).add_legend("<b>", {"k": "red"}).add_colorbar(["red", "blue"], 0, 1, "v").to_html()
    assert "alert(1)" in page and "</script><script>alert" not in page and "&lt;b&gt;" in page


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = running_composite(stream, "value", ["event_type"]).writeStream.format("memory").queryName("composite").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = running_composite(events, "value", ["event_type"])
    assert spark.table("composite").count() == want.count() > 0


def sq(a, b, c, d):
    return Geometry.Polygon([(a, b), (c, b), (c, d), (a, d)])


def test_set_operations_of_any_polygons():
    ell = Geometry.Polygon([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)])
    holed = Geometry.Polygon([[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)]])
    assert [sq(0, 0, 4, 4).difference(ell).area, sq(0, 0, 4, 4).union(ell).area, holed.difference(sq(9, 9, 10, 10)).area, holed.union(sq(1, 1, 3, 3)).area] == [9, 16, 12, 16]
    assert sq(0, 0, 4, 4).difference(sq(1, 1, 3, 3)) == holed and sq(0, 0, 4, 4) != ell
    assert ell == Geometry.Polygon([(4, 1), (1, 1), (1, 4), (0, 4), (0, 0), (2, 0), (4, 0)])
    assert Geometry.Point(500000.25, 4000000.75).to_wkt() == "POINT (500000.25 4000000.75)"
    rng = random.Random(1)

    def star(cx, cy, n):
        far = [rng.uniform(0.3, 2) for _ in range(n)]
        return Geometry.Polygon([(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k, r in enumerate(far)])

    for _ in range(60):
        a, b = star(0, 0, rng.randrange(3, 12)), star(rng.uniform(-1, 1), rng.uniform(-1, 1), rng.randrange(3, 12))
        both, either, only, one = a.intersection(b), a.union(b), a.difference(b), a.symmetric_difference(b)
        assert either.area == pytest.approx(a.area + b.area - both.area) and only.area == pytest.approx(a.area - both.area)
        for _ in range(40):
            at = rng.uniform(-3, 3), rng.uniform(-3, 3)
            p, q = a.contains_xy(*at), b.contains_xy(*at)
            assert (both.contains_xy(*at), either.contains_xy(*at), only.contains_xy(*at), one.contains_xy(*at)) == (p and q, p or q, p and not q, p != q)


def test_boxes_keep_their_extent(spark):
    box = spark.createDataFrame([(1, 10.0, 50.0, 12.0, 51.0)], "fid long, minx double, miny double, maxx double, maxy double")
    got = FeatureCollection(box, 4326).reproject(32632).df.first()
    assert (got.minx, got.miny, got.maxx, got.maxy) == pytest.approx(crs.transform_bounds((10.0, 50.0, 12.0, 51.0), 4326, 32632))


def test_days_expressions_and_text_filters(spark):
    from orbisframe.functions.dates import to_day
    from orbisframe.functions.expression import compile_expression

    said = ["2023-01-31T22:30:00-05:00", "2023-02-01T01:00:00+02:00", "2023-01-31T10:00:00Z", "2023-01-31 10:00", "20230131", "2023031T042149", "x"]
    days = [str(r[0]) for r in spark.createDataFrame([(s,) for s in said], "s string").select(to_day(F.col("s"))).collect()]
    assert days == ["2023-02-01", "2023-01-31", "2023-01-31", "2023-01-31", "2023-01-31", "2023-01-31", "None"]
    for bad in ("a +", "import os", "(", ""):
        with pytest.raises(ValueError):
            compile_expression(bad, {"a": 1.0})
    compile_expression("  1 + 2 ", {})
    df = spark.createDataFrame([(12, "12"), (30, None)], "n int, s string")
    count = lambda f: f.apply(df).count()
    assert (count(Filter.stringContains("n", "1")), count(Filter.stringContains("s", "1")), count(~Filter.stringContains("s", "1"))) == (0, 1, 1)


def test_files_have_features_of_their_own(spark, tmp_path):
    one = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"a": "b"}}
    for n in range(2):
        (tmp_path / f"f{n}.json").write_text(json.dumps({"type": "FeatureCollection", "features": [one, one]}))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.jsonl").write_text("\n".join([json.dumps(one)] * 3))
    fids = [r.fid for r in features.read_geojson(spark, f"{tmp_path}/f*.json").df.collect()]
    assert len(set(fids)) == 4
    assert len({r.fid for r in features.read_geojson_lines(spark, f"{tmp_path}/lines").df.collect()}) == 3
    assert (degree_label(10.99999, True, "DM"), degree_label(-0.5, False, "DMS"), scale_bar(10_000)[0]) == ("11° 00.0' N", "0° 30' 00\" W", 2500)


def test_units(spark):
    """Degrees with a buffer in metres: brute force in the UTM zone."""
    rng = random.Random(7)
    rows = [(i, 11 + rng.random() * 0.2, 48 + rng.random() * 0.2, i % 4) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, x double, y double, fold int")
    zone = crs.utm_epsg(11.1, 48.1)
    flat = {i: crs.transform(x, y, 4326, zone) for i, x, y, _ in rows}
    fold = {r[0]: r[3] for r in rows}
    want = {(i, fold[j]) for i in flat for j in flat if fold[i] != fold[j] and math.dist(flat[i], flat[j]) <= 900}
    got = {(r.id, r.fold) for r in validation.BufferedSpatialCV(900.0, crs=4326).excluded(df).collect()}
    assert got == want and 10 < len(want)
    assert validation.BufferedSpatialCV(900.0, crs=4326, unit="crs").excluded(df).count() == 150 * 3
    with pytest.raises(ValueError):
        validation.BufferedSpatialCV(unit="miles")
    report = validation.leakage_report(df.filter("fold = 0"), df.filter("fold = 1"), 900.0, crs=4326)
    near = min(math.dist(flat[i], flat[j]) for i in flat for j in flat if fold[i] == 0 and fold[j] == 1)
    assert report.min_distance == pytest.approx(near) and report.buffer_violation == (near < 900)
    order = {r.id: r.o for r in df.select("id", F.xxhash64(F.lit(42), "id").alias("o")).collect()}
    kept = []
    for i in sorted(flat, key=lambda i: (order[i], i)):
        if all(math.dist(flat[i], flat[j]) >= 1500 for j in kept):
            kept.append(i)
    assert {r.id for r in validation.min_distance(df, 500, 1500.0, crs=4326).collect()} == set(kept)
    assert {r.id for r in validation.min_distance(FeatureCollection(df, 4326, "id"), 5, 1500.0).collect()} == set(kept[:5])


def test_patch_split_matches_brute_force(spark):
    grid = np.random.default_rng(1).normal(size=(96, 120))
    ds = validation.PatchDataset(Image.from_numpy(spark, grid, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), 32633), patch_size=8, stride=4)
    for ratios, seed in (((0.7, 0.15, 0.15), 1), ((0.5, 0.5, 0.0), 2), ((0.98, 0.01, 0.01), 3)):
        windows = {r.patch_id: (r.row, r.col) for r in ds.windows().collect()}
        groups = {}
        for p, (r, c) in windows.items():
            groups.setdefault(((r + 4) // 16) * (120 // 16 + 1) + (c + 4) // 16, []).append(p)
        hashed = {r.g: r.h for r in spark.createDataFrame([(g,) for g in groups], "g long").select("g", F.xxhash64(F.lit(seed), "g").alias("h")).collect()}
        order = sorted(groups, key=hashed.get)
        asked = [k for k in range(3) if ratios[k] > 0]
        free = len(order) - len(asked)
        counts = [(k in asked) + math.floor(ratios[k] * free) for k in range(3)]
        for k in sorted(range(3), key=lambda k: -(ratios[k] * free - math.floor(ratios[k] * free)))[: len(order) - sum(counts)]:
            counts[k] += 1
        which = {}
        for n, g in enumerate(order):
            for p in groups[g]:
                which[p] = 0 if n < counts[0] else 1 if n < counts[0] + counts[1] else 2
        close = lambda a, b: all(abs(x - y) < 8 for x, y in zip(windows[a], windows[b], strict=True))
        for k in (1, 0):
            later = [p for p, s in which.items() if s > k]
            which = {p: s for p, s in which.items() if s != k or not any(close(p, q) for q in later)}
        got = {r.patch_id: r.split for r in ds.split(ratios=ratios, block_size=16, seed=seed).collect()}
        assert got == {p: ("train", "val", "test")[which[p]] if p in which else None for p in windows}
