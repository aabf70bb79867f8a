"""Neighbour searches and spatial statistics over point frames (id, x, y, values).

Searches deal points into square cells and join on cells, never all pairs. Ties in distance go to the smaller id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import normal_p


def sorted_join(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the points: sorted and merged, never broadcast.

    Spark tells the size of a side by its files, which may hold a hundredth of what its rows take (compression, and cells or
    neighbours that a row is expanded to), and a broadcast goes through the driver as a whole.
    """
    return df.hint("merge")


def _cells(points: DataFrame, cell: float) -> DataFrame:
    return points.withColumn("__cx", F.floor(F.col("x") / cell).cast("long")).withColumn("__cy", F.floor(F.col("y") / cell).cast("long"))


def _spread(points: DataFrame, cell: float, reach: int) -> DataFrame:
    """Each point once for every cell within reach of its own."""
    around = F.sequence(F.lit(-reach), F.lit(reach))
    at = _cells(points, cell).withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around))
    return at.withColumn("__cx", F.col("__cx") + F.col("__dx")).withColumn("__cy", F.col("__cy") + F.col("__dy")).drop("__dx", "__dy")


def _far(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def within(left: DataFrame, right: DataFrame, radius: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, d, keep): pairs at most radius apart, with columns of left; by cells as wide as the radius."""
    cell = radius if radius > 0 else 1.0
    a = _spread(left.select(F.col("id").alias("i"), "x", "y", *keep), cell, 1).withColumnsRenamed({"x": "__x", "y": "__y"})
    b = _cells(right.select(F.col("id").alias("j"), "x", "y"), cell)
    d = _far(F.col("__x") - F.col("x"), F.col("__y") - F.col("y"))
    return a.join(sorted_join(b), ["__cx", "__cy"]).select("i", "j", d.alias("d"), *keep).filter(F.col("d") <= radius)


def nearest(left: DataFrame, right: DataFrame, k: int = 1, same: bool = False) -> DataFrame:
    """(i, j, d, rank): the k nearest points of right for each of left; same: a point is no neighbour of itself.

    Cells hold about k / 3 + 1 points. A point whose k-th candidate lies within the searched radius is settled; the others are
    searched again four times as wide, until the search spans everything. Of points in one place only the first k + 1 by id
    can be anyone's neighbours, so the rest are left out of the candidates.
    """
    stats = right.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    ends = left.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    k = min(k, stats["n"] - int(same))
    empty = left.sparkSession.createDataFrame([], "i long, j long, d double, rank int")
    if k < 1 or ends["x0"] is None:
        return empty
    wide = max(max(stats["x1"], ends["x1"]) - min(stats["x0"], ends["x0"]), max(stats["y1"], ends["y1"]) - min(stats["y0"], ends["y0"]), 1e-12)
    area = max((stats["x1"] - stats["x0"]) * (stats["y1"] - stats["y0"]), (wide / stats["n"]) ** 2, 1e-300)
    cell = max(math.sqrt(area * (k / 3 + 1) / stats["n"]), wide / 1e6)
    place = Window.partitionBy("x", "y").orderBy("id")
    pool = right.select("id", "x", "y").withColumn("__n", F.row_number().over(place)).filter(F.col("__n") <= k + 1)
    pool = pool.select(F.col("id").alias("j"), F.col("x").alias("__x"), F.col("y").alias("__y"), "x", "y")
    todo = left.select(F.col("id").alias("i"), "x", "y")
    done = None
    while True:
        last = 2 * cell >= wide
        b = _cells(pool, cell).drop("x", "y")
        d = F.sqrt((F.col("x") - F.col("__x")) ** 2 + (F.col("y") - F.col("__y")) ** 2)
        pairs = _spread(todo, cell, 2).join(sorted_join(b), ["__cx", "__cy"]).select("i", "j", d.alias("d"))
        pairs = pairs.filter(F.col("i") != F.col("j")) if same else pairs
        order = Window.partitionBy("i").orderBy("d", "j")
        ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).persist()
        if last:
            return ranked if done is None else done.unionByName(ranked)
        settled = ranked.filter((F.col("rank") == k) & (F.col("d") <= 2 * cell)).select("i")
        found = ranked.join(sorted_join(settled), "i", "left_semi")
        done = found if done is None else done.unionByName(found)
        todo = todo.join(sorted_join(settled), "i", "left_anti").persist()
        if todo.isEmpty():
            return done
        cell *= 4


def row_standardize(edges: DataFrame) -> DataFrame:
    """Weights of each i divided by their sum."""
    return edges.withColumn("w", F.try_divide(F.col("w"), F.sum("w").over(Window.partitionBy("i"))))


def knn_weights(points: DataFrame, k: int = 8) -> DataFrame:
    """(i, j, w): the k nearest neighbours of each point, row-standardised."""
    found = nearest(points, points, k, same=True)
    return row_standardize(found.select("i", "j", F.lit(1.0).alias("w")))


def distance_weights(points: DataFrame, threshold: float | None = None) -> DataFrame:
    """(i, j, w): points at most threshold apart (1.5 times the median nearest distance), row-standardised."""
    if threshold is None:
        threshold = 1.5 * nearest(points, points, 1, same=True).agg(F.median("d")).first()[0]
    # the pairs are worked out twice, first to count each point's: they outnumber the points by far and are never dealt out
    near = within(points, points, threshold).filter("i != j").groupBy(F.col("i").alias("id")).agg((1.0 / F.count("*")).alias("w"))
    weighted = points.select("id", "x", "y").join(sorted_join(near), "id")
    return within(weighted, points, threshold, ("w",)).filter("i != j").select("i", "j", "w")


@dataclass
class MoranResult:
    I: float  # noqa: E741
    expected: float
    variance: float
    z_score: float
    p_value: float
    n: int

    def summary(self) -> str:
        pattern = "not significant" if self.p_value > 0.05 else "clustered" if self.expected < self.I else "dispersed"
        return f"Moran's I = {self.I:.4f} (expected {self.expected:.4f}, z = {self.z_score:.3f}, p = {self.p_value:.4g}, n = {self.n}): {pattern}"


def _values(points: DataFrame, value: str) -> DataFrame:
    return points.select("id", F.col(value).cast("double").alias("v"))


def moran_frame(points: DataFrame, value: str, weights: DataFrame) -> DataFrame:
    """One row: n, I, expected, variance, z_score; NULL I where the values or weights don't vary."""
    v = _values(points, value)
    total = v.agg(F.count("*").alias("n"), F.count("v").alias("there"), F.avg("v").alias("mean"))
    z = v.crossJoin(F.broadcast(total)).select("id", (F.col("v") - F.col("mean")).alias("z"))  # total is one row
    moments = z.agg(F.count("*").cast("double").alias("n"), F.sum(F.col("z") ** 2).alias("ss"), F.sum(F.col("z") ** 4).alias("m4"))
    zi, zj = z.select(F.col("id").alias("i"), F.col("z").alias("zi")), z.select(F.col("id").alias("j"), F.col("z").alias("zj"))
    cross = weights.join(sorted_join(zi), "i").join(sorted_join(zj), "j").agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("num"))
    s1 = weights.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") ** 2).alias("s1"))
    ends = weights.select(F.col("i").alias("a"), "w").unionAll(weights.select(F.col("j").alias("a"), "w"))
    s2 = ends.groupBy("a").agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") ** 2).alias("s2"))
    row = moments.crossJoin(cross).crossJoin(s1).crossJoin(s2)  # one row each
    n, s0 = F.col("n"), F.col("s0")
    b2 = F.try_divide(F.col("m4") / n, (F.col("ss") / n) ** 2)
    top = n * ((n * n - 3 * n + 3) * F.col("s1") - n * F.col("s2") + 3 * s0 * s0) - b2 * ((n * n - n) * F.col("s1") - 2 * n * F.col("s2") + 6 * s0 * s0)
    expected = F.try_divide(F.lit(-1.0), n - 1)
    row = row.withColumn("I", F.try_divide(n, s0) * F.try_divide(F.col("num"), F.col("ss"))).withColumn("expected", expected)
    row = row.withColumn("variance", F.greatest(F.lit(1e-10), F.try_divide(top, (n - 1) * (n - 2) * (n - 3) * s0 * s0) - expected * expected))
    return row.select(n.cast("long").alias("n"), "I", "expected", "variance", ((F.col("I") - F.col("expected")) / F.sqrt("variance")).alias("z_score"))


def morans_i(points: DataFrame, value: str, weights: DataFrame | None = None, k: int = 8) -> MoranResult:
    """Global Moran's I with its randomisation inference; ValueError below 4 points or for missing values."""
    c = _values(points, value).agg(F.count("*"), F.count(F.nanvl("v", F.lit(None))), F.var_pop("v")).first()
    if c[0] < 4:
        raise ValueError("Moran's I needs at least 4 observations")
    if c[1] < c[0]:
        raise ValueError(f"{value} has missing values")
    r = moran_frame(points, value, knn_weights(points, k) if weights is None else weights).first()
    if not c[2] or r["I"] is None:
        return MoranResult(0.0, -1 / (c[0] - 1), 0.0, 0.0, 1.0, c[0])
    return MoranResult(r["I"], r["expected"], r["variance"], r["z_score"], normal_p(r["z_score"]), r["n"])


def geary_frame(points: DataFrame, value: str, weights: DataFrame) -> DataFrame:
    """One row: n, C; 1 where the values or weights don't vary."""
    v = _values(points, value)
    zi, zj = v.select(F.col("id").alias("i"), F.col("v").alias("vi")), v.select(F.col("id").alias("j"), F.col("v").alias("vj"))
    cross = weights.join(sorted_join(zi), "i").join(sorted_join(zj), "j").agg(F.sum("w").alias("s0"), F.sum(F.col("w") * (F.col("vi") - F.col("vj")) ** 2).alias("num"))
    total = v.agg(F.count("*").alias("n"), (F.var_pop("v") * F.count("v")).alias("ss")).crossJoin(cross)  # one row each
    return total.select("n", F.coalesce(F.try_divide((F.col("n") - 1) * F.col("num"), 2 * F.col("s0") * F.col("ss")), F.lit(1.0)).alias("C"))


def gearys_c(points: DataFrame, value: str, weights: DataFrame | None = None, k: int = 8) -> float:
    return geary_frame(points, value, knn_weights(points, k) if weights is None else weights).first()["C"]


def local_morans_i(points: DataFrame, value: str, weights: DataFrame | None = None, k: int = 8, p_threshold: float = 0.05) -> DataFrame:
    """points with {value}_std, I, z_score, p_value and cluster (HH, LL, HL, LH or not significant)."""
    weights = knn_weights(points, k) if weights is None else weights
    v = _values(points, value)
    means = v.agg(F.avg("v").alias("mean"), F.var_pop("v").alias("s2"), F.count("*").cast("double").alias("n"))
    z = v.crossJoin(F.broadcast(means)).withColumn("z", F.col("v") - F.col("mean"))  # one row
    if not means.first()["s2"]:
        same = {"I": F.lit(0.0), "z_score": F.lit(0.0), "p_value": F.lit(1.0), "cluster": F.lit("not significant")}
        return points.withColumns(same)
    b2 = z.agg((F.avg(F.col("z") ** 4)).alias("m4")).first()["m4"]
    lag = weights.join(sorted_join(z.select(F.col("id").alias("j"), F.col("z").alias("zj"))), "j").groupBy(F.col("i").alias("id"))
    lag = lag.agg(F.sum(F.col("w") * F.col("zj")).alias("lag"), F.sum("w").alias("wr"), F.sum(F.col("w") ** 2).alias("wq"))
    out = z.join(sorted_join(lag), "id", "left").na.fill(0.0, ["lag", "wr", "wq"])
    n, kurt = F.col("n"), F.lit(b2) / F.col("s2") ** 2
    expected = -F.col("wr") / (n - 1)
    variance = F.col("wq") * (n - kurt) / (n - 1) + (F.col("wr") ** 2 - F.col("wq")) * (2 * kurt - n) / ((n - 1) * (n - 2)) - expected**2
    out = out.withColumn("I", F.col("z") / F.col("s2") * F.col("lag"))
    out = out.withColumn("z_score", (F.col("I") - expected) / F.sqrt(F.greatest(variance, F.lit(1e-10))))

    @F.pandas_udf("double")
    def tail(s: pd.Series) -> pd.Series:
        return s.map(normal_p)

    out = out.withColumn("p_value", tail("z_score"))
    high, up = F.col("z") > 0, F.col("lag") > 0
    label = F.when(F.col("p_value") > p_threshold, "not significant").when(high & up, "HH").when((F.col("z") < 0) & (F.col("lag") < 0), "LL").when(high & (F.col("lag") < 0), "HL").otherwise("LH")
    stats = out.select("id", F.col("z").alias(f"{value}_std"), "I", "z_score", "p_value", label.alias("cluster"), F.col("lag").alias("spatial_lag"))
    return points.join(sorted_join(stats), "id")


def variogram(points: DataFrame, value: str, n_lags: int = 15, max_dist: float | None = None) -> DataFrame:
    """(lag, distance, semivariance, pairs): pairs below max_dist in n_lags half-open bins; empty bins have no row.

    max_dist bounds the search; without it half the largest distance is taken, that of the extremes of the convex hull.
    """
    if max_dist is None:
        from .geometry import convex_hull

        ends = points.groupBy("x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
        turns = F.array(*[F.lit(math.pi * t / 180) for t in range(360)])  # the extremes along 360 directions bound the hull
        spun = ends.select(F.explode(F.array("lo", "hi")).alias("y"), "x").select("x", "y", F.explode(turns).alias("t"))
        far = spun.groupBy("t").agg(F.max_by(F.struct("x", "y"), F.col("x") * F.cos("t") + F.col("y") * F.sin("t")).alias("p")).collect()
        hull = convex_hull([tuple(r["p"]) for r in far])
        max_dist = max((math.dist(a, b) for a in hull for b in hull), default=0.0) / 2
    if max_dist <= 0:
        return points.sparkSession.createDataFrame([], "lag int, distance double, semivariance double, pairs long")
    bins = _lag_sums(points.select("id", "x", "y", F.col(value).cast("double").alias("v")), max_dist, n_lags).groupBy("lag")
    n, known = F.sum("n"), F.sum("known")
    return bins.agg((F.sum("d") / n).alias("distance"), F.try_divide(F.sum("s"), known).alias("semivariance"), n.alias("pairs"))


#: Points of one cell that a task of a variogram holds against their neighbours.
PART = 2000


def _lag_sums(points: DataFrame, max_dist: float, n_lags: int) -> DataFrame:
    """(lag, n, d, known, s): pairs, their distances, those with both values and half their squared differences, summed by task.

    Points (id, x, y, v) are dealt into cells as wide as max_dist, and a cell's points into parts. A part gets the points of its own
    cell and of four of the cells around, so that each pair of points meets once; NumPy then adds up pairs that are never rows.
    """
    at = _cells(points.filter("x is not null and y is not null and not isnan(x) and not isnan(y)"), max_dist)
    parts = at.groupBy("__cx", "__cy").agg(F.ceil(F.count("*") / PART).cast("int").alias("__parts"))
    own = at.join(sorted_join(parts), ["__cx", "__cy"]).withColumn("__part", F.pmod(F.xxhash64("id"), F.col("__parts")).cast("int")).drop("__parts")
    ways = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    sent = at.withColumn("__way", F.explode(ways)).withColumn("__cx", F.col("__cx") - F.col("__way.dx")).withColumn("__cy", F.col("__cy") - F.col("__way.dy"))
    role = F.when((F.col("__way.dx") == 0) & (F.col("__way.dy") == 0), 1).otherwise(2).cast("byte")
    sent = sent.withColumn("__role", role).drop("__way").join(sorted_join(parts), ["__cx", "__cy"])
    sent = sent.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    names = ["__cx", "__cy", "__part", "__role", "id", "x", "y", "v", F.col("v").isNotNull().alias("there")]
    both = own.withColumn("__role", F.lit(0).cast("byte")).select(*names).unionByName(sent.select(*names))
    width = max_dist / n_lags

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("x")
        order = pdf["id"].rank(method="dense").to_numpy()  # ids may be of any type
        role, x, y, v, there = (pdf[c].to_numpy() for c in ("__role", "x", "y", "v", "there"))
        a, sums = np.flatnonzero(role == 0), np.zeros((4, n_lags + 1))
        for kind in (1, 2):
            b = np.flatnonzero(role == kind)
            step = max(1, 100_000 // max(1, len(b)))
            for k in range(0, len(a) if len(b) else 0, step):
                p = a[k : k + step]
                slack = max_dist * (1 + 1e-9)
                q = b[np.searchsorted(x[b], x[p[0]] - slack) : np.searchsorted(x[b], x[p[-1]] + slack, "right")]
                dx, dy = x[p][:, None] - x[q], y[p][:, None] - y[q]
                d = np.sqrt(dx * dx + dy * dy)
                near = d < max_dist
                if kind == 1:
                    near &= order[p][:, None] < order[q]
                i, j = np.nonzero(near)
                d = d[near]
                lag = np.floor(d / width).astype(np.int64)
                i, j = p[i], q[j]
                known, half = there[i] & there[j], (v[i] - v[j]) ** 2 / 2
                sums[0] += np.bincount(lag, minlength=n_lags + 1)
                sums[1] += np.bincount(lag, d, n_lags + 1)
                if known.all():
                    sums[2] += np.bincount(lag, minlength=n_lags + 1)
                    sums[3] += np.bincount(lag, half, n_lags + 1)
                else:
                    sums[2] += np.bincount(lag[known], minlength=n_lags + 1)
                    sums[3] += np.bincount(lag[known], half[known], n_lags + 1)
        n, d, known, s = sums
        return pd.DataFrame({"lag": np.arange(n_lags + 1), "n": n, "d": d, "known": known, "s": s})[n > 0]

    return both.groupBy("__cx", "__cy", "__part").applyInPandas(run, "lag int, n long, d double, known long, s double")


def nugget_and_sill(bins: DataFrame) -> tuple[float, float]:
    """The first and the largest semivariance; zeros without bins."""
    r = bins.agg(F.min_by("semivariance", "lag").alias("nugget"), F.max("semivariance").alias("sill")).first()
    return r["nugget"] or 0.0, r["sill"] or 0.0


def ess_column(i: Column, n: Column) -> tuple[Column, Column]:
    """(effective n, design effect) from Moran's I."""
    rho = F.greatest(F.lit(0.0), F.least(F.lit(0.99), i))
    effective = n * (1 - rho) / (1 + rho)
    return effective, n / F.greatest(F.lit(1.0), effective)


def effective_sample_size(points: DataFrame, value: str) -> dict:
    """n (1 - rho) / (1 + rho) with Moran's I, from 0 to 0.99, as rho; missing values are left out."""
    there = points.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    moran = morans_i(there, value)
    rho = max(0.0, min(0.99, moran.I))
    effective = moran.n * (1 - rho) / (1 + rho)
    design = moran.n / max(1.0, effective)
    return {
        "nominal_n": moran.n, "effective_n": round(effective), "morans_i": moran.I, "p_value": moran.p_value, "design_effect": design,
        "pseudoreplication_risk": design > 2 and moran.p_value < 0.05,
    }


def bias_report(points: DataFrame) -> DataFrame:
    """One row: sample_size, mean_nn_distance, clark_evans_r, spatial_pattern."""
    near = nearest(points, points, 1, same=True).agg(F.avg("d").alias("mean_nn_distance"))
    box = points.agg(F.count("*").alias("sample_size"), F.greatest(F.lit(1e-5), (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    row = box.crossJoin(near)  # one row each
    r = F.col("mean_nn_distance") / (0.5 / F.sqrt(F.col("sample_size") / F.col("area")))
    row = row.withColumn("clark_evans_r", r)
    pattern = F.when(F.col("clark_evans_r") < 0.9, "Clustered").when(F.col("clark_evans_r") > 1.1, "Dispersed").otherwise("Random")
    return row.select("sample_size", "mean_nn_distance", "clark_evans_r", pattern.alias("spatial_pattern"))
