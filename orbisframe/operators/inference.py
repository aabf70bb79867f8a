"""Group tests from distributed moments and ranks; p-values on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import f_p, normal_p, t_p
from .spatial import effective_sample_size


@dataclass
class StatTestResult:
    test: str
    statistic: float
    p_value: float
    effect: float
    effect_name: str
    ci: tuple[float, float] = (0.0, 0.0)
    sizes: dict = field(default_factory=dict)
    warning: str | None = None

    def summary(self) -> str:
        said = f"{self.test}: statistic = {self.statistic:.4f}, p = {self.p_value:.4g}, {self.effect_name} = {self.effect:.4f}"
        return said + (f"\n{self.warning}" if self.warning else "")


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """(g, n, mean, var, ord) for each group; ord is the first id of a group."""
    order = F.min("id") if "id" in df.columns else F.min(group)
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    return rows.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"), order.alias("ord"))


def rank_sums(df: DataFrame, value: str, group: str) -> DataFrame:
    """(g, n, ranks): sums of ranks, ties averaged. Equal values are counted first, so ranks are running sums over distinct values,
    taken range by range: values are dealt into ranges, and only the ranges' totals are summed in one place."""
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(value).cast("double").alias("v"), F.col(group).alias("g"))
    counts = rows.groupBy("v").agg(F.count("*").alias("c"))
    ranges = min(4096, max(64, counts.count() // 100_000))
    cuts = sorted(set(counts.agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []))
    part = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda x: x <= F.col("v"))) if cuts else F.lit(0)
    counts = counts.withColumn("part", part)
    totals = counts.groupBy("part").agg(F.sum("c").alias("t"))
    before = totals.select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("under", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(F.broadcast(before), "part")  # a row a range
    ranked = ranked.select("v", "c", (F.col("before") + F.col("under") + (F.col("c") + 1) / 2).alias("rank"))
    return rows.groupBy("v", "g").agg(F.count("*").alias("m")).join(ranked, "v").groupBy("g").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("rank")).alias("ranks"), F.sum((F.col("c") ** 2 - 1) * F.col("m")).alias("ties"))


def _u_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided p of U without ties, from the counts of all arrangements."""
    table = {(0, j): [1] for j in range(n2 + 1)} | {(i, 0): [1] for i in range(n1 + 1)}
    for i in range(1, n1 + 1):
        for j in range(1, n2 + 1):
            a, b, out = table[i - 1, j], table[i, j - 1], [0] * (i * j + 1)
            for k, x in enumerate(a):
                out[k + j] += x
            for k, x in enumerate(b):
                out[k] += x
            table[i, j] = out
    dist = table[n1, n2]
    top = max(u, n1 * n2 - u)
    return min(1.0, 2 * sum(dist[math.ceil(top) :]) / sum(dist))


def test(df: DataFrame, value: str, group: str, method: str | None = None) -> StatTestResult:
    """Welch's t (two groups), Mann-Whitney U, or ANOVA (more than two groups, or asked for).

    Missing values and groups are left out. Two-group tests warn when the residuals, where df has id, x and y, show spatial pseudoreplication.
    """
    if method not in (None, "welch", "t", "ttest", "mann_whitney", "mwu", "anova"):
        raise ValueError(f"unknown method {method!r}")
    groups = sorted(group_moments(df, value, group).collect(), key=lambda r: r["ord"])  # one row a group
    if len(groups) < 2:
        raise ValueError(f"two groups are needed, there are {len(groups)}")
    sizes = {str(r["g"]): r["n"] for r in groups}
    n = sum(r["n"] for r in groups)
    if len(groups) > 2 or method == "anova":
        grand = sum(r["n"] * r["mean"] for r in groups) / n
        between = sum(r["n"] * (r["mean"] - grand) ** 2 for r in groups)
        inner = sum((r["n"] - 1) * (r["var"] or 0.0) for r in groups)
        d1, d2 = len(groups) - 1, n - len(groups)
        f = (between / d1) / (inner / d2) if inner > 0 and d2 > 0 else math.inf
        return StatTestResult("One-way ANOVA", f, f_p(f, d1, d2) if math.isfinite(f) else 0.0, between / (between + inner) if between + inner else 0.0, "eta_squared", sizes=sizes)
    a, b = groups
    warning = None
    if all(c in df.columns for c in ("id", "x", "y")) and n >= 4:
        rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
        means = F.when(F.col(group) == a["g"], a["mean"]).otherwise(b["mean"])
        ess = effective_sample_size(rows.withColumn("__residual", F.col(value) - means), "__residual")
        if ess["pseudoreplication_risk"]:
            warning = f"residuals are spatially autocorrelated (I = {ess['morans_i']:.3f}): {ess['nominal_n']} observations are worth {ess['effective_n']}"
    if method in ("mann_whitney", "mwu"):
        ranks = {r["g"]: r for r in rank_sums(df, value, group).collect()}
        n1, n2 = a["n"], b["n"]
        u = ranks[a["g"]]["ranks"] - n1 * (n1 + 1) / 2
        ties = sum(r["ties"] for r in ranks.values())
        if min(n1, n2) <= 8 and n1 * n2 <= 100_000 and ties == 0:  # beyond that the normal form is as good
            p = _u_exact(u, n1, n2)
        else:
            sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
            p = min(1.0, normal_p(max(0.0, abs(u - n1 * n2 / 2) - 0.5) / sd)) if sd else 1.0
        return StatTestResult("Mann-Whitney U", u, p, 2 * u / (n1 * n2) - 1, "rank_biserial", sizes=sizes, warning=warning)
    qa, qb = (a["var"] or 0.0) / a["n"], (b["var"] or 0.0) / b["n"]
    se, diff = math.sqrt(qa + qb), a["mean"] - b["mean"]
    t = diff / se if se else math.copysign(math.inf, diff)
    df_ = (qa + qb) ** 2 / (qa**2 / (a["n"] - 1) + qb**2 / (b["n"] - 1)) if se else 1.0
    pooled = math.sqrt(((a["n"] - 1) * (a["var"] or 0.0) + (b["n"] - 1) * (b["var"] or 0.0)) / (n - 2)) if n > 2 else 0.0
    return StatTestResult("Welch t-test", t, t_p(t, df_) if se else 0.0, diff / pooled if pooled else 0.0, "cohens_d", (diff - 1.96 * se, diff + 1.96 * se), sizes, warning)
