"""Rasters, stacks and the missing-value rules, with answers known in closed form."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbisframe.functions import missing as m
from orbisframe.functions.dates import to_day
from orbisframe.operators.collection import ImageCollection
from orbisframe.operators.filter import Filter
from orbisframe.operators.geometry import Geometry
from orbisframe.operators.raster import Grid, Image
from orbisframe.operators.reducer import Reducer

NAN, INF = math.nan, math.inf
UTM = (1.0, 0.0, 0.0, 0.0, -1.0, 10.0)


def image(spark, data, names=None, transform=UTM, epsg=32633, **meta):
    return Image.from_numpy(spark, data, transform, epsg, names, meta)


def same(got, want, tol=1e-9):
    np.testing.assert_allclose(got, want, rtol=tol, atol=tol, equal_nan=True)


def cases():
    return [
        ("gt", m.compare("a", ">", 1), [1, 0, 0]), ("ne", m.compare("a", "!=", 1), [1, 1, 1]), ("div0", m.divide("a", 0.0), [INF, None, -INF]),
        ("ratio0", m.ratio("a", 0.0), [None, None, None]), ("log", m.log(F.col("a") + 3), [math.log(5), None, -INF]), ("sqrt", m.sqrt("a"), [math.sqrt(2), None, None]),
        ("clamp", m.clamp("a", 0, 1), [1, None, 0]), ("both", m.both(F.least, "a", 0.0), [0, None, -3]), ("mask", m.update_mask(5.0, "a"), [5, 5, 5]),
        ("where", m.where(1.0, "a", 9.0), [9, 9, 9]), ("pow", m.power("a", 0.5), [math.sqrt(2), None, None]), ("mod", m.modulo("a", 2.5), [2, None, 2]),
        ("floordiv", m.floor_divide("a", 2.0), [1, None, -2]), ("unmask", m.unmask("a", 7), [2, 7, -3]), ("inf", m.subtract(m.divide("a", 0.0), m.divide("a", 0.0)), [None, None, None]),
        ("round", m.UNARY["round"](F.col("a") + 0.5), [2, None, -2]),
    ]


def test_missing_value_rules(spark):
    df = spark.createDataFrame([(0, 2.0), (1, None), (2, -3.0)], "i int, a double")
    rows = df.select("i", *[c.alias(n) for n, c, _ in cases()]).orderBy("i").collect()
    for n, _, want in cases():
        assert [r[n] for r in rows] == want, n
    assert [r[0] for r in spark.createDataFrame([(NAN,), (1.0,)], "a double").select(m.nn(F.col("a"))).collect()] == [None, 1.0]


def test_expression(spark):
    i = image(spark, [[1.0, 2.0], [3.0, 4.0]], ["NIR"])
    same(i.expression("(NIR - 1) / (NIR + 1) if NIR > 1 else -1").to_numpy()[0], [[-1, 1 / 3], [0.5, 0.6]])
    same(i.expression("1 < NIR <= 3 and not NIR == 2 or NIR // 4").to_numpy()[0], [[0, 0], [1, 1]])
    for bad in ("__import__('os')", "NIR.real", "[NIR]", "(lambda: 1)()", "'a'", "abs(NIR, 1)", "open(NIR)"):
        with pytest.raises((ValueError, NameError)):
            i.expression(bad)
    with pytest.raises(NameError):
        i.expression("X + 1")


def test_indices_and_selection(spark):
    names = ["B02", "B03", "B04", "B08", "B11", "B12"]
    i = image(spark, np.array([0.1, 0.3, 0.2, 0.8, 0.4, 0.5])[:, None, None] * np.ones((6, 2, 2)), names)
    for made, want in ((i.ndvi(), 0.6), (i.ndwi(), -0.5 / 1.1), (i.ndbi(), -0.4 / 1.2), (i.nbr(), 0.3 / 1.3), (i.savi(), 0.6 / 1.5 * 1.5), (i.evi(), 1.5 / (0.8 + 1.2 - 0.75 + 1))):
        same(made.to_numpy(), np.full((1, 2, 2), want), 1e-6)
    assert i.select([0, "B08"], ["x", "y"]).bands == ["x", "y"] and i.rgb().bands == ["B04", "B03", "B02"]
    with pytest.raises(KeyError):
        i.select("B9")
    with pytest.raises(IndexError):
        i.select(9)
    with pytest.raises(TypeError):
        bool(i)
    assert i.normalizedDifference(["B08", "B04"]).bands == ["nd"]


def test_qa_and_scaling(spark):
    qa = image(spark, [[[1.0, 2.0, 3.0, 4.0]], [[0.0, 1 << 10, 1 << 11, NAN]]], ["B4", "QA60"])
    same(qa.mask_clouds().to_numpy()[0], [[1, NAN, NAN, NAN]])
    hls = image(spark, [[[5000.0]], [[2.0]]], ["B2", "Fmask"])
    same(hls.auto_scale(dataset="HLS").to_numpy(), [[[0.5]], [[2.0]]])
    with pytest.raises(ValueError):
        hls.select(["B2"]).mask_clouds()


def test_focal_terrain_and_clip(spark):
    hole = np.ones((5, 5))
    hole[2, 2] = NAN
    same(image(spark, hole).focal_mean(1).to_numpy()[0], hole)
    ramp = np.tile(np.arange(10.0), (10, 1))
    dem = Image.from_numpy(spark, ramp, (0.001, 0.0, 90.0, 0.0, -0.001, 23.0), 4326)
    metres = 0.001 * (111412.84 * math.cos(math.radians(23)) - 93.5 * math.cos(3 * math.radians(23)))
    same(dem.slope().to_numpy()[0], np.full((10, 10), math.degrees(math.atan(1 / metres))), 1e-3)
    same(dem.aspect().to_numpy()[0], np.full((10, 10), 270.0))
    rng = np.random.default_rng(1).random((7, 9))
    padded = np.pad(rng, 3, mode="symmetric")
    want = np.array([[np.mean(padded[r : r + 7, c : c + 7]) for c in range(9)] for r in range(7)])
    same(image(spark, rng).focal_mean(3, "square").to_numpy()[0], want)
    same(image(spark, rng[:2, :2]).focal_median(3).to_numpy()[0][0, 0], np.median(np.pad(rng[:2, :2], 3, mode="symmetric")[:7, :7]))
    inside = image(spark, np.ones((10, 10))).clip(Geometry.Polygon([(0, 0), (10, 0), (0, 10)], crs=32633)).to_numpy()[0]
    assert np.isnan(inside[0, 5]) and inside[9, 5] == 1
    assert image(spark, [[1.0, 2.0], [3.0, NAN]]).reduceRegion(Reducer.mean())["B1"] == 2.0


def test_arithmetic_between_images(spark):
    a, b = image(spark, [[1.0, NAN], [3.0, 4.0]]), image(spark, [[2.0, 2.0], [0.0, 2.0]])
    same((a / b).to_numpy()[0], [[0.5, NAN], [INF, 2]])
    same((1 - a).to_numpy()[0], [[0, NAN], [-2, -3]])
    same((a > b).to_numpy()[0], [[0, 0], [1, 1]])
    same(a.where(b, a * 10).to_numpy()[0], [[10, NAN], [3, 40]])
    with pytest.raises(ValueError):
        a + image(spark, [[1.0]])
    with pytest.warns(UserWarning):
        a + image(spark, [[1.0, 1.0], [1.0, 1.0]], epsg=4326)


def test_stacks(spark):
    one, two = image(spark, [[NAN, 1.0]], ["q"], date="2023-01-05"), image(spark, [[NAN, 2.0]], ["q"], date="20230301")
    col = ImageCollection.from_images([one, two])
    same(col.qualityMosaic("q").to_numpy()[0], [[NAN, 2]])
    same(col.sum().to_numpy()[0], [[0, 3]])
    assert col.filter(Filter.date("2023-02-01", "2023-04-01")).size() == 1
    same(col.filterDate("2023-01-01", "2023-02-01").mean().to_numpy()[0], [[NAN, 1]])
    tiles = [image(spark, np.full((10, 10), v), transform=(1.0, 0.0, x, 0.0, -1.0, 10.0)) for v, x in ((1.0, 0.0), (2.0, 10.0))]
    wide = ImageCollection.from_images(tiles).mosaic()
    assert (wide.width, wide.height) == (20, 10)
    same(wide.to_numpy()[0], np.hstack([np.full((10, 10), 1.0), np.full((10, 10), 2.0)]))
    assert [i.get("image_id") for i in col.sort("date", False)] == ["1", "0"]
    with pytest.raises(TypeError):
        ImageCollection.from_images("x")


def test_grids(spark):
    i = image(spark, np.arange(16.0).reshape(4, 4), transform=(10.0, 0.0, 500000.0, 0.0, -10.0, 4000000.0), epsg=32631)
    same(i.on_grid(i.grid, "bilinear").to_numpy(), i.to_numpy())
    assert i.resample(0.5).shape == (1, 2, 2)
    back = i.reproject(4326).reproject(32631, 10.0, "nearest")
    assert back.bounds[0] <= 500000.5 and abs(np.nanmean(back.to_numpy()) - 7.5) < 0.5
    shown = image(spark, [[0.0, 1.0], [2.0, NAN]]).visualize(min=0, max=2).to_numpy()[0]
    same(shown, [[0, 127], [255, 0]])
    grey = image(spark, [[0.0, 1.0]]).visualize(min=0, max=1, palette=["#000000", "#ff0000"])
    assert grey.bands == ["red", "green", "blue"] and grey.to_numpy()[0, 0, 1] == 255


def test_save_and_open(spark, tmp_path):
    i = image(spark, [[1.0, NAN]], sensor="x")
    i.save(str(tmp_path / "r"))
    back = Image.open(spark, str(tmp_path / "r"))
    same(back.to_numpy(), i.to_numpy())
    assert back.grid == i.grid and back.get("sensor") == "x"


def test_dates(spark):
    given = ["2023-01-05", "20230105", "2023005T042149", "2023-01-05T10:00:00Z", "2023", "x", None, "2023-13-01"]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, s string").select("i", to_day(F.col("s")).cast("string").alias("d")).orderBy("i").collect()
    assert [r.d for r in rows] == ["2023-01-05"] * 4 + [None] * 4


def test_filters_on_missing(spark):
    df = spark.createDataFrame([(1, "a", NAN), (2, None, 1.0), (3, "b", None)], "i int, s string, v double")
    ids = lambda f: sorted(r.i for r in f.apply(df).collect())
    assert ids(Filter.neq("v", 1)) == [1, 3] and ids(~Filter.gt("v", 0)) == [1, 3] and ids(Filter.notInList("s", ["a"])) == [2, 3]
    assert ids(Filter.eq("absent", 1)) == [] and ids(Filter.date("2020-01-01")) == [1, 2, 3] and ids(Filter.gt("s", 1)) == []
    with pytest.raises(ValueError):
        Filter.metadata("v", "~", 1)


def test_grid():
    g = Grid(10, 5, (2.0, 0.0, 100.0, 0.0, -2.0, 50.0))
    assert g.bounds == (100, 40, 120, 50) and g.pixel(*g.center(3, 4)) == (3.5, 4.5)


def test_bands_of_one_image_combine_without_a_join(spark):
    data = np.arange(24.0).reshape(3, 2, 4)
    i = image(spark, data)
    made = (i.select("B1") * 2 - i.select("B2") / (i.select("B3") + 1)).where(i.select("B1") > 3, i.select("B3")).updateMask(i.select("B2") > 9)
    made = made.expression("x + y", {"x": made, "y": i.select("B3")})
    a, b, c = data
    want = np.where(a > 3, c, a * 2 - b / (c + 1))
    same(made.to_numpy()[0], np.where(b > 9, want + c, np.nan))
    plan = made.df._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan
    both = Image.from_images([i.select("B2"), i.select("B1")], ["u", "v"])
    same(both.to_numpy(), data[[1, 0]])
    other = image(spark, data)
    same((i - other).to_numpy(), np.zeros_like(data))


@pytest.mark.parametrize("kind", ["circle", "square", "gaussian"])
def test_focal_tiles_match_brute_force(spark, kind):
    """Several tiles, missing values, pixels that the frame lacks, and mirrored edges."""
    rng = np.random.default_rng(3)
    data = rng.normal(size=(150, 137))
    data[rng.random(data.shape) < 0.1] = np.nan
    i = image(spark, data)
    radius = 2
    pad = np.pad(data, radius, mode="symmetric")
    offsets = Image.kernel(radius, kind)
    stack = np.stack([pad[radius + r : radius + r + 150, radius + c : radius + c + 137] for r, c, _ in offsets])
    w = np.array([x for _, _, x in offsets])[:, None, None] * ~np.isnan(stack)
    mean = np.where(np.isnan(data), np.nan, np.nansum(stack * w, axis=0) / w.sum(axis=0))
    same(i.focal_mean(radius, kind).to_numpy()[0], mean)
    if kind == "square":
        same(i.focal_median(radius).to_numpy()[0], np.nanmedian(stack, axis=0))
    sparse = Image(i.df.filter("row < 40 and col < 30"), i.grid)
    got = sparse.focal_median(1).df.agg({"row": "max", "col": "max"}).first()
    assert sorted(got) == [30, 40]
