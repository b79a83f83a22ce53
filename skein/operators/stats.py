"""Cluster bootstrap, Mann-Whitney, and GEE logistic regression from sufficient statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.plans.session import cut_lineage


def _replicates(per: DataFrame, keys: Sequence[str], values: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """keys, b and the sums of `values` over each replicate's clusters, drawn with replacement by hashed indices, for every key at once.

    per has one row per key and cluster, so n_boot times the number of clusters is replicated, not of rows; the
    clusters of a key are numbered in one task.
    """
    numbered = per.withColumn("_i", (F.row_number().over(Window.partitionBy(*keys).orderBy("cluster")) - 1).cast("long"))
    sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_g"))
    draws = per.sparkSession.range(n_boot).withColumnRenamed("id", "b").join(sizes, F.lit(True)).withColumn("_d", F.explode(F.sequence(F.lit(1).cast("long"), "_g")))
    index = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b"), F.col("_d")).cast("binary")), 1, 8), 16, 10).cast("long") % F.col("_g")
    return draws.withColumn("_i", index).join(numbered, [*keys, "_i"]).groupBy(*keys, "b").agg(*[F.sum(v).alias(v) for v in values])


def _interval(means: DataFrame, keys: Sequence[str]) -> DataFrame:
    return means.groupBy(*keys).agg(F.expr("percentile(m, 0.025)").alias("lo"), F.expr("percentile(m, 0.975)").alias("hi"), F.count("m").alias("used"))


def cluster_bootstrap_by(df: DataFrame, values: Sequence[str], cluster: str, by: Sequence[str] = (), n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """by, flag, est, lo, hi, n for each of `values` (and each group of `by`) with a value at all: pooled mean and percentile interval over resampled clusters.

    One pass over df; no interval under two clusters.
    """
    keys = [*by, "flag"]
    sums = [F.struct(F.lit(v).alias("flag"), F.sum(F.col(v).cast("double")).alias("s"), F.count(v).alias("n")) for v in values]
    per = df.groupBy(*by, F.col(cluster).alias("cluster")).agg(F.array(*sums).alias("_v")).select(*by, "cluster", F.inline("_v")).filter("n > 0")
    per = cut_lineage(per)
    whole = per.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("est"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"))
    means = _replicates(per, keys, ["s", "n"], n_boot, seed).select(*keys, (F.col("s") / F.col("n")).alias("m"))
    ci = lambda c: F.when(F.col("g") >= 2, F.col(c)).alias(c)
    return whole.join(_interval(means, keys), keys).select(*keys, "est", ci("lo"), ci("hi"), "n")


def cluster_bootstrap(df: DataFrame, value: str, cluster: str, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """est, lo, hi, n of one column, always one row."""
    one = df.sparkSession.createDataFrame([(value,)], "flag string")
    return one.join(cluster_bootstrap_by(df, [value], cluster, (), n_boot, seed), "flag", "left").select("est", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def _differences(df: DataFrame, groups: Sequence[str], values: Sequence[str], cluster: str, n_boot: int, seed: int) -> DataFrame:
    """grouping, value, n1, n0, mean1, mean0, est, lo, hi for every pair, in one pass over df; no interval unless half of the replicates have both sides."""
    keys = ["grouping", "value"]
    side = lambda g, v, k: F.when(F.col(g) == k, F.col(v).cast("double"))
    cells = [F.struct(F.lit(g).alias("grouping"), F.lit(v).alias("value"), *[f(side(g, v, k)).alias(f"{n}{k}") for k in (0, 1) for n, f in (("s", F.sum), ("n", F.count))]) for g in groups for v in values]
    per = df.groupBy(F.col(cluster).alias("cluster")).agg(F.array(*cells).alias("_v")).select("cluster", F.inline("_v")).na.fill(0).filter("n0 + n1 > 0")
    per = cut_lineage(per)
    sums = ["s0", "n0", "s1", "n1"]
    mean = lambda k: F.try_divide(f"s{k}", f"n{k}")
    whole = per.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    means = _replicates(per, keys, sums, n_boot, seed).select(*keys, (mean(1) - mean(0)).alias("m"))
    ci = lambda c: F.when(F.col("used") * 2 >= n_boot, F.col(c)).alias(c)
    return whole.join(_interval(means, keys), keys).select(*keys, "n1", "n0", mean(1).alias("mean1"), mean(0).alias("mean0"), (mean(1) - mean(0)).alias("est"), ci("lo"), ci("hi"))


def cluster_bootstrap_diff(df: DataFrame, value: str, group: str, cluster: str, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """est, lo, hi, always one row: mean of group 1 less mean of group 0."""
    one = df.sparkSession.createDataFrame([(group, value)], "grouping string, value string")
    return one.join(_differences(df, [group], [value], cluster, n_boot, seed), ["grouping", "value"], "left").select("est", "lo", "hi")


def _below(counts: DataFrame, keys: Sequence[str], cuts: int = 1000) -> DataFrame:
    """counts (keys, v, t) with `below`: the sum of t at smaller v of the key. Values are dealt into ranges, so no window holds all of them."""
    bounds = sorted(set(counts.agg(F.percentile_approx("v", [i / cuts for i in range(1, cuts)], 10 * cuts).alias("q")).first()["q"] or []))
    ranged = counts.withColumn("_r", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("v"))) if bounds else F.lit(0))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy(*keys, "_r").agg(F.sum("t").alias("_t")).withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inside = Window.partitionBy(*keys, "_r").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_own", F.coalesce(F.sum("t").over(inside), F.lit(0)))
    return own.join(F.broadcast(bases), [*keys, "_r"]).withColumn("below", F.col("_base") + F.col("_own")).drop("_r", "_base", "_own")  # at most cuts rows per key


def rank_tests(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n1, n0, u1, u, z, p from counts (keys, v, t rows with the value, t1 of them in group 1), for every key at once.

    Two-sided: exact where a side has at most 8 rows and no value repeats (and the sides' product is at most EXACT),
    else the tie-corrected normal approximation with continuity; null p under three rows a side.
    """
    ranked = _below(cut_lineage(counts), keys).withColumn("r", F.col("below") + (F.col("t") + 1) / 2.0)
    s = ranked.groupBy(*keys).agg(F.sum("t1").alias("n1"), (F.sum("t") - F.sum("t1")).alias("n0"), F.sum(F.col("r") * F.col("t1")).alias("r1"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    s = s.withColumn("u1", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0).withColumn("nn", F.col("n1") + F.col("n0"))
    s = s.withColumn("sigma", F.sqrt(F.col("n1") * F.col("n0") / 12.0 * ((F.col("nn") + 1) - F.try_divide("ties", F.col("nn") * (F.col("nn") - 1)))))
    s = s.withColumn("u", F.greatest("u1", F.col("n1") * F.col("n0") - F.col("u1"))).withColumn("z", F.try_divide(F.col("u") - F.col("n1") * F.col("n0") / 2.0 - 0.5, F.col("sigma")))
    # the complementary error function by its continued product form (Abramowitz and Stegun 7.1.26, error under 1.5e-7)
    x = F.abs("z") / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    erfc = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    near = F.least(F.lit(1.0), F.when(F.col("z") >= 0, erfc).otherwise(2 - erfc))
    small = (F.least("n1", "n0") <= 8) & (F.col("ties") == 0) & (F.col("n1") * F.col("n0") <= EXACT)
    p = F.when((F.col("n1") >= 3) & (F.col("n0") >= 3), F.when(small, _exact(F.when(small, F.col("u")), "n1", "n0")).otherwise(near))
    return s.select(*keys, "n1", "n0", "u1", "u", "z", p.alias("p"))


def mann_whitney(df: DataFrame, value: str, side: str) -> DataFrame:
    """n1, n0, u1, u, z, p of one column by a 0/1 side."""
    counts = df.filter(F.col(value).isNotNull() & F.col(side).isin(0, 1)).groupBy(F.lit(value).alias("value"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("t"), F.sum(F.col(side).cast("long")).alias("t1"))
    return rank_tests(counts, ["value"]).drop("value")


def compare_groups(articles: DataFrame, shares: DataFrame, groups: Sequence[str], values: Sequence[str], cluster: str, key: str = "article_id", count: str = "n", least: int = 5, n_boot: int = 2000) -> DataFrame:
    """grouping, value, n1, n0, mean1, mean0, est, lo, hi, p: readers' reactions to articles with a flag against those without.

    articles has the 0/1 flags of `groups`, shares the values per article; articles under `least` comments are left
    out, and a flag with one value gives no row. The joined rows are written once; intervals and tests read sums of them.
    """
    keys = ["grouping", "value"]
    rows = cut_lineage(articles.select(key, cluster, *groups).join(shares.filter(F.col(count) >= least).select(key, *values), key))
    cells = F.array(*[F.struct(F.lit(g).alias("grouping"), F.lit(v).alias("value"), F.col(g).cast("int").alias("g"), F.col(v).cast("double").alias("v")) for g in groups for v in values])
    counts = rows.select(F.inline(cells)).filter("g in (0, 1) and v is not null").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("t"), F.sum(F.col("g").cast("long")).alias("t1"))
    tests = rank_tests(counts, keys).select(*keys, "p")
    return _differences(rows, groups, values, cluster, n_boot, 0).filter("n1 > 0 and n0 > 0").join(tests, keys)


def exact_mann_whitney(u: float, n1: int, n0: int) -> float:
    """The exact two-sided p without ties: counts of rank sums by the usual recurrence."""
    ways = np.zeros(n1 * n0 + 1)
    ways[0] = 1
    for i in range(1, n1 + 1):  # the Gaussian binomial coefficient, factor by factor
        for k in range(n0 + i, n1 * n0 + 1)[::-1]:
            ways[k] -= ways[k - n0 - i]
        for k in range(i, n1 * n0 + 1):
            ways[k] += ways[k - i]
    return float(min(1.0, 2 * ways[math.ceil(max(u, n1 * n0 - u)) :].sum() / ways.sum()))


#: Beyond this product of the sides' sizes the exact distribution is not worked out.
EXACT = 1_000_000


@F.pandas_udf(T.DoubleType())
def _exact(u: pd.Series, n1: pd.Series, n0: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or x != x else exact_mann_whitney(x, int(a), int(b)) for x, a, b in zip(u, n1, n0)], dtype=float)


def gee_logit(df: DataFrame, outcome: str, predictor: str, cluster: str, min_n: int = 30, min_clusters: int = 8, rare: int = 5) -> tuple[list[dict], str | None]:
    """Odds ratios against the most frequent level with robust intervals, exchangeable correlation; or the reason why not.

    Rows of a cluster and level have one mean, so a cluster is its counts by level, written once. Each iteration sums
    matrices as wide as there are levels over the clusters, in the tasks; the driver gets one row per task.
    """
    cells = cut_lineage(df.filter(F.col(outcome).isNotNull() & F.col(predictor).isNotNull()).groupBy(F.col(cluster).alias("c"), F.col(predictor).cast("string").alias("l")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("double")).alias("y")))
    whole = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y"), F.countDistinct("c").alias("c")).first()
    total = int(whole["n"])
    if total < min_n:
        return [], f"only {total} rows"
    if whole["c"] < min_clusters:
        return [], f"only {whole['c']} clusters"
    if whole["y"] in (0, total):
        return [], "the outcome has one value"
    # levels with under `rare` rows are one; the others are at most total / rare, and a model of so many would not be asked for
    by: dict[str, list[float]] = {}
    for r in cells.groupBy("l").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).withColumn("l", F.when(F.col("n") >= rare, F.col("l")).otherwise("other")).groupBy("l").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect():
        by[r["l"]] = [float(r["n"]), float(r["y"])]
    if len(by) < 2:
        return [], "the predictor has one level"
    if split := sorted(v for v, (n, y) in by.items() if y in (0, n)):
        return [], f"separated: {', '.join(split)}"
    levels = sorted(by, key=lambda v: (-by[v][0], v))
    known = F.when(F.col("l").isin(levels), F.col("l")).otherwise("other")
    grouped = cells.groupBy("c", known.alias("l")).agg(F.sum("n").alias("n"), F.sum("y").alias("y")).groupBy("c")
    of = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("l") == v, F.col(c))), F.lit(0)).cast("double") for v in levels]).alias(c)
    clusters = cut_lineage(grouped.agg(of("n"), of("y")).select("n", "y"))
    p = len(levels)
    x = np.concatenate([np.ones((p, 1)), np.eye(p)[:, 1:]], 1)  # a level's row of the design

    def sums(beta: np.ndarray, rho: float, phi: float | None) -> np.ndarray:
        """phi None: [sum of squares, pairs, cross products]; else bread, score and meat, flat."""

        def run(frames):
            out = np.zeros(3 if phi is None else 2 * p * p + p)
            mu = 1 / (1 + np.exp(-x @ beta))
            sd = np.sqrt(mu * (1 - mu))
            d = x * sd[:, None]
            for f in frames:
                n, y = np.stack(f["n"].to_numpy()), np.stack(f["y"].to_numpy())
                pearson, m = (y - n * mu) / sd, n.sum(1)
                if phi is None:
                    square = ((y * (1 - mu) ** 2 + (n - y) * mu**2) / sd**2).sum(1)
                    out += [square.sum(), (m * (m - 1) / 2).sum(), ((pearson.sum(1) ** 2 - square) / 2).sum()]
                    continue
                k, weighted = rho / (1 + (m - 1) * rho), n @ d
                u = (pearson @ d - (k * pearson.sum(1))[:, None] * weighted) / (1 - rho)
                bread = (np.einsum("cl,li,lj->ij", n, d, d) - np.einsum("c,ci,cj->ij", k, weighted, weighted)) / (1 - rho)
                out += np.concatenate([bread.ravel(), u.sum(0), (u.T @ u).ravel()])
            yield pd.DataFrame({"v": [out.tolist()]})

        return np.sum([r["v"] for r in clusters.mapInPandas(run, "v array<double>").collect()], 0)

    beta, rho = np.zeros(p), 0.0
    for _ in range(100):
        square, pairs, cross = sums(beta, 0.0, None)
        phi = square / (total - p)
        rho = float(np.clip(cross / (phi * max(pairs - p, 1)), -0.9, 0.95))
        flat = sums(beta, rho, phi)
        bread, score, meat = flat[: p * p].reshape(p, p), flat[p * p : p * p + p], flat[p * p + p :].reshape(p, p)
        step = np.linalg.solve(bread, score)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    inverse = np.linalg.inv(bread)
    se = np.sqrt(np.diag(inverse @ meat @ inverse))
    rows = []
    for k in range(1, p):
        z = beta[k] / se[k]
        rows.append({"term": levels[k], "odds_ratio": round(math.exp(beta[k]), 3), "lo": round(math.exp(beta[k] - 1.959963984540054 * se[k]), 3), "hi": round(math.exp(beta[k] + 1.959963984540054 * se[k]), 3), "p": round(math.erfc(abs(z) / math.sqrt(2)), 4)})
    return rows, None
