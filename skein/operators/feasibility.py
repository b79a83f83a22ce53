"""Whether a pilot's data can carry the study: each table is read once, for all the checks on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _checks(row: DataFrame, checks: list[tuple[str, Column, float | None]]) -> DataFrame:
    """item, value, ok from one row of aggregates; checks without a value give no row."""
    cells = [F.struct(F.lit(item).alias("item"), value.cast("double").alias("v"), F.lit(least).cast("double").alias("least")) for item, value, least in checks]
    return row.select(F.inline(F.array(*cells))).filter("v is not null").select("item", F.round("v", 6).alias("value"), (F.col("v") >= F.col("least")).alias("ok"))


def feasibility(coded: DataFrame, bundles: DataFrame | None = None, judged: DataFrame | None = None, conditions: DataFrame | None = None, kappas: DataFrame | None = None, per_article: DataFrame | None = None) -> DataFrame:
    """item, value, ok (null: for reference only). Checks whose data are missing give no row.

    coded: the dataset; bundles: bundle_id of all that were planned (those of coded without it); judged: include (Y/N)
    and link_type of fetched candidates; conditions: condition_retention(); kappas: field, kappa, weighted_kappa of
    automatic against human codes; per_article: n comments of each article.
    """
    upper = lambda c: F.upper(F.col(c).cast("string")) if c in coded.columns else F.lit(None).cast("string")
    told = lambda c: upper(c).isin("Y", "N")
    has = F.col("delta_title").isNotNull()
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    per = coded.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop(F.when(has, F.col("title_strength"))).alias("sd"), count(has).alias("known"), count(F.col("delta_title") != 0).alias("other"), count(F.col("delta_title") > 0).alias("up"),
        count(told("title_omission_misleading")).alias("asked"), count(upper("title_omission_misleading") == "Y").alias("misled"), count(told("source_error")).alias("checked"), count(upper("source_error") == "Y").alias("wrong"),
    )
    if bundles is not None:
        per = bundles.select("bundle_id").distinct().join(per, "bundle_id", "full")
    total = per.agg(F.avg((F.coalesce("n", F.lit(0)) >= 3).cast("int")).alias("enough"), F.avg("sd").alias("sd"), *[F.sum(c).alias(c) for c in ("n", "known", "other", "up", "asked", "misled", "checked", "wrong")])
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    out = _checks(total, [("bundles_with_3_articles", F.col("enough"), 0.7), ("share_delta_nonzero", share("other", "known"), 0.3), ("mean_within_bundle_sd", F.col("sd"), 0.5), ("share_title_stronger", share("up", "known"), None), ("share_omission_misleading", share("misled", "asked"), None), ("share_source_error", share("wrong", "checked"), None)])
    if judged is not None:
        link = F.coalesce(F.col("link_type"), F.lit("")) if "link_type" in judged.columns else F.lit("")
        of = judged.agg(F.avg((F.upper("include") == "Y").cast("int")).alias("yes"), F.avg((link == "background").cast("int")).alias("background"), F.avg((link == "unrelated").cast("int")).alias("unrelated"))
        out = out.unionByName(_checks(of, [("candidate_precision", F.col("yes"), None), ("candidate_background", F.col("background"), None), ("candidate_unrelated", F.col("unrelated"), None)]))
    if conditions is not None:
        out = out.unionByName(_checks(conditions.agg(F.avg("dropped_in_title_kept_in_body").alias("v")), [("share_condition_dropped", F.col("v"), None)]))
    if kappas is not None:
        of = kappas.agg(F.max(F.when(F.col("field") == "title_strength", F.col("weighted_kappa").try_cast("double"))).alias("k"), F.count_if(F.col("kappa").try_cast("double") < 0.4).alias("weak"))
        out = out.unionByName(_checks(of, [("auto_title_weighted_kappa", F.col("k"), 0.6)])).unionByName(_checks(of, [("weak_fields", F.when(F.col("weak") > 0, F.col("weak")), None)]).withColumn("ok", F.lit(False)))
    if per_article is not None:
        of = per_article.agg(F.count_if(F.col("n") >= 5).alias("busy")).join(total.select("n"), F.lit(True))  # two single rows
        out = out.unionByName(_checks(of, [("share_with_5_comments", share("busy", "n"), 0.5)]))
    return out
