"""A synthetic study: bundles, articles and comments from hashes of their numbers, of any size, made by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRUGS = ("약물가", "약물나", "약물다", "약물라")
OUTCOMES = ("두통", "골절", "치매")
OUTLETS = (("하나일보", "daily"), ("둘경제", "economy"), ("셋의학", "medical_trade"), ("넷온라인", "online"))
CLAIMS = ("{d}{j} {o} 유발", "{d}, {o} 위험 증가", "{d} {o} 유발할 수 있다", "{d}{j} {o} 연관", "{d}{j} {o} 관련 없다")


def _hash(seed: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 30))


def _choose(options, by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (by % len(options) + 1).cast("int"))


def subject_particle(word: Column) -> Column:
    """The subject marker that fits the last syllable: one of its 28 finals is none."""
    return F.when((F.ascii(F.right(word, F.lit(1))) - 0xAC00) % 28 == 0, "가").otherwise("이")


def demo_articles(spark: SparkSession, bundles: int = 8, per_bundle: int = 4, seed: int = 7) -> DataFrame:
    a = spark.range(bundles * per_bundle).withColumn("n", F.col("id") % bundles)
    drug, outcome = _choose(DRUGS, F.col("n")), _choose(OUTCOMES, F.col("n"))
    claim = _choose(CLAIMS, _hash(seed, F.col("id")))
    filled = F.replace(F.replace(F.replace(claim, F.lit("{d}"), drug), F.lit("{j}"), subject_particle(drug)), F.lit("{o}"), outcome)
    outlet = _hash(seed + 1, F.col("id"))
    lead = F.concat(filled, F.lit("는 연구가 나왔다. 연구진은 참가자를 추적했다."))
    rest = F.when(_hash(seed + 2, F.col("id")) % 2 == 0, " 다만 관찰 연구라는 한계가 있다.").otherwise(" 후속 연구가 필요하다.")
    return a.select(F.format_string("a%05d", "id").alias("article_id"), F.format_string("demo%02d", "n").alias("bundle_id"), _choose([o for o, _ in OUTLETS], outlet).alias("outlet"), _choose([t for _, t in OUTLETS], outlet).alias("outlet_type"), filled.alias("title"), F.concat(lead, rest).alias("body"), F.lit("ok").alias("status"))


def demo_comments(articles: DataFrame, most: int = 12, seed: int = 7) -> DataFrame:
    n = (_hash(seed, F.col("article_id")) % (most + 1)).cast("int")
    lines = ("무섭다", "병원에 물어봐야지", "못 믿겠다", "좋은 정보")
    c = articles.select("article_id", F.explode(F.sequence(F.lit(0), n)).alias("turn")).filter("turn > 0")
    return c.select(F.concat_ws("-", "article_id", F.col("turn").cast("string")).alias("comment_id"), "article_id", "turn", _choose(lines, _hash(seed, F.col("article_id"), F.col("turn"))).alias("text"))


def demo_bundles(spark: SparkSession, bundles: int = 8) -> DataFrame:
    """The study's bundles as load_bundles() gives them."""
    n = spark.range(bundles).withColumn("n", F.col("id"))
    drug, outcome = _choose(DRUGS, F.col("n")), _choose(OUTCOMES, F.col("n"))
    return n.select(
        F.format_string("demo%02d", "n").alias("bundle_id"), F.concat_ws(" / ", drug, outcome).alias("label"), F.array(drug).alias("drug_terms"), F.array(outcome).alias("outcome_terms"),
        F.create_map(F.lit("doi"), F.format_string("10.0000/demo.%d", "n"), F.lit("journal"), F.lit("jama"), F.lit("published"), F.lit("2024-01-05")).alias("paper"), F.array(F.concat_ws(" ", drug, outcome)).alias("queries"),
        F.lit("2024-01-01").cast("date").alias("date_from"), F.lit("2024-02-01").cast("date").alias("date_to"), F.array().cast("array<map<string,string>>").alias("known_articles"), F.lit("").alias("notes"),
    )


def demo_papers(bundles: DataFrame, seed: int = 7) -> DataFrame:
    """A sheet of papers that people have filled in: most are observational and say what is correlated."""
    h = _hash(seed + 3, F.col("bundle_id"))
    return bundles.select(
        "bundle_id", "label", F.element_at("paper", F.lit("doi")).alias("doi"), F.concat(F.lit("Study of "), "label").alias("title"), F.lit("observational").alias("design_auto"), F.when(h % 4 == 0, "rct").otherwise("").alias("design"),
        F.lit("2").alias("strength_auto"), F.element_at(F.array(*map(F.lit, ("2", "2", "3", "5"))), (h % 4 + 1).cast("int")).alias("paper_strength"), F.lit("inc").alias("paper_direction"), F.lit("increase").alias("direction_auto"),
        F.lit("population; design").alias("key_conditions"), F.when(h % 3 == 0, "4").when(h % 3 == 1, "2").otherwise("").alias("press_release_strength"), F.lit("demo").alias("checked_by"), F.lit("Linked.").alias("conclusion_en"), F.lit("").alias("main_finding_ko"),
    )


def demo_candidates(articles: DataFrame, seed: int = 7) -> DataFrame:
    """The articles as a candidate table with people's choices: some links are background, some are left to the proposal."""
    h = _hash(seed + 4, F.col("article_id"))
    return articles.select(
        F.col("article_id").alias("candidate_id"), "bundle_id", F.lit("demo").alias("source"), F.lit("q").alias("query"), F.lit("2024-01-08").alias("pub_date"), "outlet", "outlet_type", "title", F.lit("").alias("description"), F.concat(F.lit("https://demo.kr/"), "article_id").alias("url"), F.lit("").alias("naver_url"),
        (h % 9).cast("string").alias("relevance_score"), F.lit("Y").alias("auto_include"), F.lit("").alias("relevance_reasons"), F.when(h % 11 == 0, "N").when(h % 3 == 0, "").otherwise("Y").alias("include"), F.when(h % 13 == 0, "background").otherwise("").alias("link_type"), F.lit("").alias("paper_match_evidence"), F.lit("").alias("candidate_notes"),
    )


def demo_codes(features: DataFrame, coder: int, seed: int = 7) -> DataFrame:
    """A coder's answers: mostly the automatic level, sometimes a step off; coders differ in which."""
    h = _hash(seed + 10 * coder, F.col("article_id"))
    off = lambda c: F.greatest(F.lit(0), F.least(F.lit(6), F.col(c) + F.when(h % 8 == 0, 1).when(h % 8 == 1, -1).otherwise(0)))
    return features.select(
        F.col("article_id").cast("string").alias("article_id"), off("auto_title_strength").cast("string").alias("title_strength"), off("auto_lead_strength").cast("string").alias("lead_strength"), F.when(h % 5 == 0, "unclear").otherwise("inc").alias("direction"), F.col("auto_advice").cast("string").alias("advice"),
        F.when((F.col("auto_caveat") == 1) != (h % 9 == 0), "Y").otherwise("N").alias("caveat_in_body"), F.when(h % 4 == 0, "Y").otherwise("N").alias("title_omission_misleading"), F.lit("NA").alias("animal_generalization"), F.when(h % 10 == 0, "Y").otherwise("N").alias("source_error"), F.lit("").alias("coder_notes"),
    )
