"""Tables of the comparison: rates with cluster intervals, outlet types, bundles, title against lead, press releases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.dataset import RATES
from skein.operators.stats import cluster_bootstrap_by

OUTLET_RATES = ("exceeds_title", "title_body_gap", "strong_title")


def overall_rates(dataset: DataFrame, n_boot: int = 2000) -> DataFrame:
    """flag, n, est, lo, hi for every rate, flags that can nowhere be told included."""
    every = dataset.sparkSession.createDataFrame([(f,) for f in RATES], "flag string")
    got = cluster_bootstrap_by(dataset, RATES, "bundle_id", (), n_boot)
    return every.join(got, "flag", "left").select("flag", F.coalesce("n", F.lit(0)).alias("n"), "est", "lo", "hi")


def by_outlet_type(dataset: DataFrame, n_boot: int = 1000) -> DataFrame:
    """A row per outlet type, the most articles first: sizes, means, and three rates with their intervals as <rate>, <rate>_lo, <rate>_hi."""
    r2 = lambda c: F.round(F.avg(c), 2)
    sizes = dataset.groupBy("outlet_type").agg(F.count(F.lit(1)).alias("articles"), F.countDistinct("bundle_id").alias("bundles"), r2("title_strength").alias("mean_strength"), r2("delta_title").alias("mean_delta"), r2(F.col("n_sensational_title").try_cast("double")).alias("mean_sensational"), F.round(100 * F.avg(F.col("auto_title_question").try_cast("double")), 1).alias("question_pct"))
    rates = cluster_bootstrap_by(dataset, OUTLET_RATES, "bundle_id", ("outlet_type",), n_boot)
    wide = rates.groupBy("outlet_type").agg(*[F.max(F.when(F.col("flag") == f, F.col(c))).alias(f + tail) for f in OUTLET_RATES for c, tail in (("est", ""), ("lo", "_lo"), ("hi", "_hi"))])
    return sizes.join(wide, "outlet_type", "left").orderBy(F.desc("articles"), "outlet_type")


def bundle_ladder(dataset: DataFrame) -> DataFrame:
    """A row per bundle: the paper's design and levels beside the spread of its headlines' levels."""
    s = "title_strength"
    return dataset.groupBy("bundle_id").agg(
        F.min("design").alias("design"), F.min("paper_strength").alias("paper_strength"), F.min("press_release_strength").alias("press_release_strength"), F.count(F.lit(1)).alias("n"),
        F.min(s).alias("lowest"), F.max(s).alias("highest"), F.round(F.avg(s), 2).alias("mean"), F.round(F.stddev_pop(s), 2).alias("sd"), F.count_if(F.col("exceeds_title") == 1).alias("exceeds"), F.array_join(F.array_sort(F.collect_set("outlet_type")), ", ").alias("outlet_types"),
    )


def title_vs_lead(dataset: DataFrame) -> DataFrame:
    """One row: how often the title is stronger than, equal to or weaker than the lead, and the mean difference; no row without a pair."""
    d, pct = F.col("title_minus_lead"), lambda c: F.round(100 * F.avg(c.cast("double")), 1)
    return dataset.filter(d.isNotNull()).agg(F.count(F.lit(1)).alias("n"), pct(d > 0).alias("stronger"), pct(d == 0).alias("equal"), pct(d < 0).alias("weaker"), F.round(F.avg(d), 2).alias("mean_diff")).filter("n > 0")


def press_release_conditional(dataset: DataFrame, n_boot: int = 2000, least: int = 3) -> DataFrame:
    """pr_exceeds (0/1), n, est, lo, hi: how often titles exceed the paper where the press release does and where not; no rows under so many bundles."""
    known = dataset.filter("press_release_strength is not null and paper_strength is not null and exceeds_title is not null")
    known = known.withColumn("pr_exceeds", (F.col("press_release_strength") > F.col("paper_strength")).cast("int"))
    enough = known.agg((F.countDistinct("bundle_id") >= least).alias("_enough"))
    rates = cluster_bootstrap_by(known, ["exceeds_title"], "bundle_id", ("pr_exceeds",), n_boot)
    return rates.join(enough, F.lit(True)).filter("_enough").select("pr_exceeds", "n", "est", "lo", "hi")
