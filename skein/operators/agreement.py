"""Coder agreement: kappa, weighted kappa, disagreements, adjudicated final codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.dataset import direction_code
from skein.operators.tables import merge_preserving


def clean(value: Column) -> Column:
    """Trimmed and upper-cased; blank and NA are null."""
    v = F.upper(F.trim(value.cast("string")))
    return F.when(~v.isin("", "NA"), v)


def kappa_table(pairs: DataFrame, fields: Mapping[str, tuple[str, str, bool]]) -> DataFrame:
    """field, n, agree_pct, kappa, weighted_kappa for each field: two columns of pairs and whether its codes are ordinal.

    Null kappa where one label is all there is; null weighted kappa for nominal fields and where a code is no whole
    number. Weights are the distance of the labels' ranks. All fields are counted in one pass over the pairs, reduced to
    a row per label before the shuffle; a sum of rank distances is a sum over the places between two labels of how many
    pairs have one on either side, so running sums over the labels are all it takes.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(o).alias("ordinal"), clean(F.col(a)).alias("x"), clean(F.col(b)).alias("y")) for f, (a, b, o) in fields.items()])
    both = pairs.select(F.inline(cells)).filter("x is not null and y is not null")
    number = lambda c: F.when(F.col(c).rlike("^[+-]?[0-9]+$"), F.col(c).try_cast("long"))
    crossed = both.groupBy("field", "ordinal", "x", "y").agg(F.count(F.lit(1)).alias("o")).withColumns({"i": number("x"), "j": number("y")})
    # of each pair of labels: the row label's count, the column label's, and the larger one's
    parts = F.array(
        F.struct(F.col("x").alias("label"), F.col("i").alias("rank"), F.col("o").alias("r"), F.lit(0).cast("long").alias("c"), F.when(F.col("x") == F.col("y"), F.col("o")).otherwise(F.lit(0)).alias("same"), F.when(F.col("i") >= F.col("j"), F.col("o")).otherwise(F.lit(0)).alias("top")),
        F.struct(F.col("y").alias("label"), F.col("j").alias("rank"), F.lit(0).cast("long").alias("r"), F.col("o").alias("c"), F.lit(0).cast("long").alias("same"), F.when(F.col("j") > F.col("i"), F.col("o")).otherwise(F.lit(0)).alias("top")),
    )
    sums = [F.sum(c).alias(c) for c in ("r", "c", "same", "top")]
    labels = crossed.select("field", "ordinal", F.inline(parts)).groupBy("field", "ordinal", "label", "rank").agg(*sums)
    plain = labels.groupBy("field", "ordinal").agg(F.sum("r").alias("n"), F.sum("same").alias("same"), F.sum(F.col("r") * F.col("c")).alias("chance"), F.count(F.lit(1)).alias("labels"), F.count_if(F.col("rank").isNull()).alias("unranked"))
    upto = Window.partitionBy("field").orderBy("rank")
    steps = labels.filter("ordinal and rank is not null").groupBy("field", "rank").agg(*sums[:2], sums[3]).select("field", *[F.sum(c).over(upto).alias(c.upper()) for c in ("r", "c", "top")], F.sum("r").over(Window.partitionBy("field")).alias("N"))
    apart = steps.groupBy("field").agg(F.sum(F.col("R") + F.col("C") - 2 * F.col("TOP")).alias("w"), F.sum(F.col("R") * (F.col("N") - F.col("C")) + F.col("C") * (F.col("N") - F.col("R"))).alias("e"))
    got = plain.join(apart, "field", "left")
    several = F.col("labels") > 1
    k = F.when(several, F.round(1 - (F.col("n") - F.col("same")) * F.col("n") / (F.col("n") * F.col("n") - F.col("chance")), 3))
    weighted = F.when(several & F.col("ordinal") & (F.col("unranked") == 0) & (F.col("e") > 0), F.round(1 - F.col("w") * F.col("n") / F.col("e"), 3))
    rows = got.select("field", F.col("n").cast("long").alias("n"), F.round(100.0 * F.col("same") / F.col("n"), 1).alias("agree_pct"), k.alias("kappa"), weighted.alias("weighted_kappa"))
    every = pairs.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    return every.join(rows, "field", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def kappa(pairs: DataFrame, a: str, b: str, weighted: bool = False) -> DataFrame:
    """One row: n, agree_pct, kappa of two columns."""
    return kappa_table(pairs, {"f": (a, b, weighted)}).select("n", "agree_pct", F.col("weighted_kappa" if weighted else "kappa").alias("kappa"))


def compare_coders(one: DataFrame, two: DataFrame, key: str, fields: Mapping[str, bool]) -> DataFrame:
    """kappa_table of two coders' sheets over the rows that both have; fields: name and whether it is ordinal."""
    sides = [s.select(key, *[F.col(f).alias(f"{f}_c{i}") for f in fields]) for i, s in ((1, one), (2, two))]
    return kappa_table(sides[0].join(sides[1], key), {f: (f"{f}_c1", f"{f}_c2", ordinal) for f, ordinal in fields.items()})


def long_form(sheet: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    return sheet.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([key], list(fields), "field", "value")


def disagreements(one: DataFrame, two: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields that both coders filled differently, whatever the case; NA counts as a value."""
    a, b = long_form(one, key, fields), long_form(two, key, fields).withColumnRenamed("value", "value_c2")
    return a.join(b, [key, "field"]).filter("trim(value) <> '' and trim(value_c2) <> '' and upper(trim(value)) <> upper(trim(value_c2))").select(key, "field", F.col("value").alias("value_c1"), "value_c2")


def finalize(sheets: Sequence[DataFrame], resolved: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Per field: adjudicated > agreed > single_coded > UNRESOLVED (blank); final_status lists what occurred, sorted."""
    longs = [long_form(s, key, fields).withColumn("coder", F.lit(i)) for i, s in enumerate(sheets)]
    every = longs[0]
    for x in longs[1:]:
        every = every.unionByName(x)
    filled = every.filter("trim(value) <> ''").groupBy(key, "field").agg(F.min_by("value", "coder").alias("first"), F.count(F.lit(1)).alias("n"), F.countDistinct(F.upper(F.trim("value"))).alias("kinds"))
    base = sheets[0].select(key).distinct().join(F.broadcast(sheets[0].sparkSession.createDataFrame([(f,) for f in fields], "field string")), F.lit(True))
    rows = base.join(filled, [key, "field"], "left").join(resolved.filter("trim(resolved) <> ''").select(key, "field", "resolved"), [key, "field"], "left")
    status = F.when(F.col("resolved").isNotNull(), "adjudicated").when((F.col("n") >= 2) & (F.col("kinds") == 1), "agreed").when(F.col("n") == 1, "single_coded").when(F.col("n") >= 2, "UNRESOLVED")
    value = F.when(F.col("resolved").isNotNull(), F.col("resolved")).when(status == "UNRESOLVED", "").otherwise(F.coalesce("first", F.lit("")))
    rows = rows.withColumn("status", status).withColumn("v", value)
    return rows.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.col("v"))).alias(f) for f in fields], F.array_join(F.array_sort(F.collect_set("status")), ",").alias("final_status"))


#: What is compared with a person's codes: the automatic column, and whether its codes are ordinal.
AUTOMATIC = {"title_strength": ("auto_title_strength", True), "lead_strength": ("auto_lead_strength", True), "direction": ("auto_direction", False), "advice": ("auto_advice", True), "caveat_in_body": ("auto_caveat", False)}
CODED = {"title_strength": True, "lead_strength": True, "direction": False, "advice": True, "caveat_in_body": False, "title_omission_misleading": False, "animal_generalization": True, "source_error": False}


def auto_vs_human(features: DataFrame, sheet: DataFrame, key: str = "article_id") -> DataFrame:
    """kappa_table of the automatic proposals against a coder's sheet, over the articles that both have."""
    auto = {"direction": direction_code(F.col("auto_direction")), "caveat_in_body": F.when(F.col("auto_caveat") == 1, "Y").when(F.col("auto_caveat") == 0, "N")}
    fields = {f: v for f, v in AUTOMATIC.items() if f in sheet.columns}
    f = features.select(key, *[auto.get(name, F.col(column)).alias(f"_a_{name}") for name, (column, _) in fields.items()])
    return kappa_table(f.join(sheet.select(key, *[F.col(n).alias(f"_h_{n}") for n in fields]), key), {n: (f"_a_{n}", f"_h_{n}", ordinal) for n, (_, ordinal) in fields.items()})


def run_agreement(sheets: Mapping[str, DataFrame], features: DataFrame | None, old: DataFrame | None = None, key: str = "article_id") -> tuple[DataFrame | None, DataFrame | None]:
    """(agreement, disagreements): the first two coders against each other, then the automatic codes against each coder.

    agreement: comparison, field, n, agree_pct, kappa, weighted_kappa. disagreements keep what was resolved before
    (old: key, field, resolved, resolution_notes). None where there is nothing to compare.
    """
    names, table, apart = list(sheets), None, None
    if len(names) >= 2:
        one, two = sheets[names[0]], sheets[names[1]]
        fields = {f: o for f, o in CODED.items() if f in one.columns and f in two.columns}
        table = compare_coders(one, two, key, fields).withColumn("comparison", F.lit(f"{names[0]} vs {names[1]}"))
        apart = disagreements(one, two, key, list(fields))
        human = ["resolved", "resolution_notes"]
        apart = apart.withColumns({c: F.lit("") for c in human}) if old is None else merge_preserving(apart, old, [key, "field"], human)
    for name in names if features is not None else ():
        one = auto_vs_human(features, sheets[name], key).withColumn("comparison", F.lit(f"auto vs {name}"))
        table = one if table is None else table.unionByName(one)
    return (table.select("comparison", "field", "n", "agree_pct", "kappa", "weighted_kappa") if table is not None else None), apart
