"""The analysis dataset: features, codes and papers joined, with the derived three-valued flags; and what is read off it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.entities import key_conditions

# The codebook's columns, directions and designs.
ARTICLE_HUMAN = ("title_strength", "lead_strength", "direction", "advice", "caveat_in_body", "title_omission_misleading", "animal_generalization", "source_error", "coder_notes")
PAPER_HUMAN = ("design", "paper_strength", "paper_direction", "key_conditions", "key_conditions_detail", "main_finding_ko", "paper_caveat", "press_release_url", "press_release_strength", "checked_by", "paper_notes")
PAPER_SHEET = ("bundle_id", "label", "doi", "title", "journal", "published", "pmid", "design_auto", "design_cues", "conclusion_en", "conclusion_source", "strength_auto", "strength_auto_cues", "direction_auto", "bundle_notes", "fetch_status")
DIRECTIONS = {"increase": "inc", "decrease": "dec", "null": "null", "mixed": "unclear"}
OBSERVATIONAL = ("observational", "pharmacovigilance", "case_report")
NUMBERS = ("title_strength", "lead_strength", "paper_strength", "advice", "press_release_strength")
RATES = ("exceeds_title", "exceeds_lead", "causal_inflation_title", "direction_mismatch", "strong_title", "title_body_gap")


def direction_code(direction: Column) -> Column:
    """Directions as codes; other values stay."""
    out = direction
    for name, code in DIRECTIONS.items():
        out = F.when(direction == name, code).otherwise(out)
    return out


def _filled(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")), F.lit(""))


def load_codes(features: DataFrame, source: str, sheet: DataFrame | None = None) -> DataFrame:
    """article_id and codes: from the features for source 'auto', else from a coder's or the final sheet; rows without a title level go."""
    if source == "auto":
        caveat = F.when(F.col("auto_caveat") == 1, "Y").when(F.col("auto_caveat") == 0, "N")
        return features.select("article_id", F.col("auto_title_strength").alias("title_strength"), F.col("auto_lead_strength").alias("lead_strength"), direction_code(F.col("auto_direction")).alias("direction"), F.col("auto_advice").alias("advice"), caveat.alias("caveat_in_body"))
    if sheet is None:
        raise FileNotFoundError(f"no sheet of {source}")
    return sheet.select("article_id", *[c for c in (*ARTICLE_HUMAN, "final_status") if c in sheet.columns]).filter(_filled(F.col("title_strength")) != "")


def load_papers(papers: DataFrame, allow_auto: bool) -> DataFrame:
    """bundle_id and a paper's codes: what a person filled in, else (if allowed) what was proposed."""
    of = lambda c: _filled(F.col(c)) if c in papers.columns else F.lit("")
    pick = lambda human, auto: F.when(of(human) != "", of(human)).otherwise(of(auto) if allow_auto else F.lit(""))
    source = F.when(of("paper_strength") != "", "coded").otherwise("auto" if allow_auto else "missing")
    return papers.select("bundle_id", pick("paper_strength", "strength_auto").alias("paper_strength"), pick("paper_direction", "direction_auto").alias("paper_direction"), pick("design", "design_auto").alias("design"), of("key_conditions").alias("key_conditions"), of("press_release_strength").alias("press_release_strength"), of("checked_by").alias("paper_checked_by"), source.alias("paper_code_source"))


def flag(condition: Column, valid: Column) -> Column:
    """1.0 or 0.0 where it can be told, else null."""
    return F.when(valid, condition.cast("double"))


def build_dataset(features: DataFrame, codes: DataFrame, papers: DataFrame, source: str = "final") -> DataFrame:
    """features x codes (inner, by article) x papers (left, by bundle), numbers read as such, and the derived columns.

    papers has one row per bundle; its side is broadcast by Spark where its size allows it.
    """
    d = features.join(codes, "article_id").join(papers, "bundle_id", "left")
    d = d.withColumns({c: F.col(c).try_cast("double") for c in NUMBERS if c in d.columns})
    title, lead, paper = F.col("title_strength"), F.col("lead_strength"), F.col("paper_strength")
    has_title, has_lead = title.isNotNull() & paper.isNotNull(), lead.isNotNull() & paper.isNotNull()
    known = ("inc", "dec", "null")
    says = F.col("direction").isin(*known) & F.col("paper_direction").isin(*known)
    caveat = F.upper(F.col("caveat_in_body"))
    return d.withColumns({
        "delta_title": title - paper,
        "delta_lead": lead - paper,
        "exceeds_title": flag(title > paper, has_title),
        "exceeds_lead": flag(lead > paper, has_lead),
        "causal_inflation_title": flag(title >= 4, has_title & F.col("design").isin(*OBSERVATIONAL) & (paper <= 3)),
        "direction_mismatch": flag(F.col("direction") != F.col("paper_direction"), says),
        "strong_title": flag(title >= 5, title.isNotNull()),
        "title_body_gap": flag((title >= 5) & (caveat == "Y"), title.isNotNull() & caveat.isin("Y", "N")),
        "title_minus_lead": title - lead,
        "code_source": F.lit(source),
    })


def condition_retention(dataset: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """A row per article and key condition of its paper: whether title, lead and body still name it. A condition named twice counts twice."""
    has = lambda s: F.coalesce(*[F.when(F.col("condition") == k, F.coalesce((F.col(f"auto_cond_{s}_{k}") == 1).cast("int"), F.lit(0))) for k in conditions])
    long = dataset.withColumn("condition", F.explode(key_conditions(F.col("key_conditions"), conditions)))
    long = long.select("article_id", "bundle_id", "outlet_type", "condition", *[has(s).alias(f"in_{s}") for s in ("title", "lead", "body")])
    dropped = ((F.col("in_title") == 0) & (F.col("in_body") == 1)).cast("int")
    absent = ((F.col("in_title") == 0) & (F.col("in_lead") == 0) & (F.col("in_body") == 0)).cast("int")
    return long.withColumns({"dropped_in_title_kept_in_body": dropped, "absent_everywhere": absent})


def condition_summary(long: DataFrame) -> DataFrame:
    pct = lambda c: F.round(100 * F.avg(c), 1)
    return long.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), *[pct(c).alias(f"{c}_pct") for c in ("in_title", "in_lead", "in_body", "dropped_in_title_kept_in_body", "absent_everywhere")])


def paper_sheet(papers: DataFrame, bundles: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """The sheet of papers for coders: what was fetched, the bundle's label and notes, and what people entered before."""
    from skein.operators.tables import merge_preserving

    info = bundles.select("bundle_id", F.col("label").alias("_label"), F.col("notes").alias("_notes"))
    p = papers.drop("label", "bundle_notes").join(info, "bundle_id", "left").withColumns({"label": F.coalesce("_label", F.lit("")), "bundle_notes": F.coalesce("_notes", F.lit(""))})
    if "direction_auto" in p.columns:
        p = p.withColumn("direction_auto", direction_code(F.col("direction_auto")))
    sheet = p.select(*[F.col(c).cast("string").alias(c) for c in PAPER_SHEET if c in p.columns])
    if old is None or "bundle_id" not in old.columns:
        return sheet.withColumns({c: F.lit("") for c in PAPER_HUMAN if c not in sheet.columns})
    return merge_preserving(sheet, old, ["bundle_id"], PAPER_HUMAN)


def coding_sheet(features: DataFrame, papers: DataFrame, conditions: Sequence[str], blind: bool, old: DataFrame | None = None) -> DataFrame:
    """A coder's sheet: the article, its paper's finding, and (unless blind) the automatic proposals; what was entered before stays."""
    from skein.operators.tables import merge_preserving

    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in papers.columns else F.lit("")
    first = lambda a, b: F.when(of(a) != "", of(a)).otherwise(of(b))
    info = papers.select("bundle_id", first("design", "design_auto").alias("paper_design"), first("main_finding_ko", "conclusion_en").alias("paper_finding"), of("key_conditions").alias("paper_key_conditions"))
    f = features.join(info, "bundle_id", "left").na.fill("", ["paper_design", "paper_finding", "paper_key_conditions"])
    about = [c for c in ("article_id", "bundle_id", "outlet", "outlet_type", "published", "url") if c in f.columns]
    out: dict[str, Column] = {c: F.col(c) for c in (*about, "paper_design", "paper_finding", "paper_key_conditions", "title", "lead")}
    if not blind:
        named = lambda s: F.array_join(F.array_compact(F.array(*[F.when(F.col(f"auto_cond_{s}_{k}") == 1, k) for k in conditions])), ", ")
        out |= {c: F.col(c) for c in ("auto_title_strength", "auto_title_cues", "auto_lead_strength", "auto_lead_cues")}
        out |= {"auto_direction": direction_code(F.col("auto_direction")), "auto_advice": F.col("auto_advice"), "auto_advice_cues": F.col("auto_advice_cues")}
        out |= {"auto_caveat": F.when(F.col("auto_caveat") == 1, "Y").otherwise("N"), "auto_caveat_sentences": F.col("auto_caveat_sentences"), "auto_title_question": F.col("auto_title_question")}
        out |= {"auto_title_conditions": named("title"), "auto_body_conditions": named("body"), "journals_mentioned": F.col("journals_mentioned"), "non_journal_sources": F.col("non_journal_sources")}
    sheet = f.select(*[v.cast("string").alias(k) for k, v in out.items()])
    if old is None or "article_id" not in old.columns:
        return sheet.withColumns({c: F.lit("") for c in ARTICLE_HUMAN})
    return merge_preserving(sheet, old, ["article_id"], ARTICLE_HUMAN)
