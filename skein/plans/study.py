"""The study's tables over the test tables, and its dataset, comparison and report queries with their SQL.

An article is a document (bundle = source, outlet type = lang, title = first line, body = the rest), a bundle and its
paper come from a nation, codes are automatic or come from the labels, comments are conversation turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text
from skein.functions.claims import NAMES
from skein.functions.lexicon import Lexicon
from skein.operators import agreement, compare, dataset, feasibility, features, stats
from skein.plans.registry import query, quoted, table

#: A lexicon over the words of the test tables: one entry per class of cues, several elsewhere.
CUES = {"no_relationship": "ofre", "causal": "tionan", "conditional": "anded", "ambiguous": "erthin", "correlational": "ingth", "ambiguous_weak": "ment"}
MODAL = {"negation": "of", "may": "and", "can": "in"}
CONDITIONS = {"population": ["mit der", "with"], "dose": ["from"], "design": ["for", "por"], "limitation": ["but", "pero"]}
REACTIONS = {"anxiety": ["please", "help", "dans"], "distrust": ["not", "why", "une"], "reassurance": ["how", "should", "les"]}
COUNTED = {"hedges": ["may", "pero"], "boosters": ["very", "sehr"], "sensational": ["!!!"], "attribution": ["said", "dijo"]}
ADVICE = {"3": ["!!!", "are not"], "2": ["for a"], "1": ["by an"]}
LEXICON = Lexicon({
    **{k: [v] for k, v in CUES.items()}, **{k: [v] for k, v in MODAL.items()}, **COUNTED,
    "exposure": ["ció"], "up": ["on t"], "down": ["in t"], "conditions": CONDITIONS, "advice": ADVICE, "reactions": REACTIONS,
})
KEYS = list(CONDITIONS)
JOURNALS, NOT_JOURNALS = {"one": ["Ofthe", "The"], "two": ["And the"], "three": ["Que"]}, ["De la"]


def articles(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("article_id"), F.col("source").alias("bundle_id"), F.col("lang").alias("outlet_type"), text.first_line(F.col("text")).alias("title"), text.rest_lines(F.col("text")).alias("body"), "text")


ARTICLES = """articles AS (SELECT doc_id AS article_id, source AS bundle_id, lang AS outlet_type, split_part(text, chr(10), 1) AS title,
    CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body, text FROM documents)"""


def bundles(spark, sf) -> DataFrame:
    """A bundle per nation: its terms, window and journal."""
    k = F.col("n_nationkey")
    terms = lambda *xs: F.array(*map(F.lit, xs))
    return table(spark, sf, "nation").select(
        F.concat(F.lit("src"), k.cast("string")).alias("bundle_id"), F.col("n_name").alias("label"), F.when(k % 5 == 0, "checked").otherwise("").alias("notes"),
        F.when(k % 2 == 0, terms("the", "that", "")).otherwise(terms("der", "que")).alias("drug_terms"), F.when(k % 3 == 0, terms("and", "with")).otherwise(terms("und", "la.")).alias("outcome_terms"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "one").otherwise("three").alias("journal"), F.when(k % 3 == 0, "").otherwise("Onth").alias("first_author"),
        F.when(k % 6 != 0, F.date_add(F.lit("2024-01-03").cast("date"), (k % 4).cast("int"))).alias("date_from"), F.when(k % 7 != 0, F.date_add(F.lit("2024-01-20").cast("date"), (k % 5).cast("int"))).alias("date_to"), F.lit("2024-01-05").cast("date").alias("published"),
    )


BUNDLES = """bundles AS (SELECT 'src' || n_nationkey AS bundle_id, n_name AS label, CASE WHEN n_nationkey % 5 = 0 THEN 'checked' ELSE '' END AS notes,
    CASE WHEN n_nationkey % 2 = 0 THEN '(?i)that|the' ELSE '(?i)der|que' END AS drugs, CASE WHEN n_nationkey % 3 = 0 THEN '(?i)with|and' ELSE '(?i)la[.]|und' END AS outcomes,
    CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'one' ELSE 'three' END AS journal, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'Onth' END AS author,
    CASE WHEN n_nationkey % 6 <> 0 THEN DATE '2024-01-03' + CAST(n_nationkey % 4 AS INT) END AS date_from, CASE WHEN n_nationkey % 7 <> 0 THEN DATE '2024-01-20' + CAST(n_nationkey % 5 AS INT) END AS date_to, DATE '2024-01-05' AS published FROM nation)"""


def paper_table(spark, sf) -> DataFrame:
    """What is known of a bundle's paper: proposals, and what people filled in for most."""
    k, region = F.col("n_nationkey"), F.col("n_regionkey")
    return table(spark, sf, "nation").select(
        F.concat(F.lit("src"), k.cast("string")).alias("bundle_id"), F.concat(F.lit("10.1/"), k.cast("string")).alias("doi"), F.col("n_name").alias("title"),
        F.when(k % 4 == 0, " ").otherwise((k % 7).cast("string")).alias("paper_strength"), region.cast("string").alias("strength_auto"),
        F.when(k % 5 == 0, "").when(k % 2 == 0, "inc").otherwise("dec").alias("paper_direction"), F.lit("null").alias("direction_auto"),
        F.when(k % 3 == 0, "").otherwise("rct").alias("design"), F.when(region < 3, "observational").otherwise("animal").alias("design_auto"),
        F.when(k % 6 == 0, "").otherwise("Dose; limitation,zzz/population  dose").alias("key_conditions"), F.when(k % 3 != 0, (k % 5).cast("string")).otherwise("").alias("press_release_strength"),
        F.when(k % 8 == 0, "a").otherwise("").alias("checked_by"), F.concat(F.lit("Conclusion "), F.col("n_name")).alias("conclusion_en"), F.when(k % 2 == 0, F.col("n_name")).otherwise("").alias("main_finding_ko"),
    )


PAPER_TABLE = """paper_table AS (SELECT 'src' || n_nationkey AS bundle_id, '10.1/' || n_nationkey AS doi, n_name AS title, CASE WHEN n_nationkey % 4 = 0 THEN ' ' ELSE CAST(n_nationkey % 7 AS VARCHAR) END AS paper_strength, CAST(n_regionkey AS VARCHAR) AS strength_auto,
    CASE WHEN n_nationkey % 5 = 0 THEN '' WHEN n_nationkey % 2 = 0 THEN 'inc' ELSE 'dec' END AS paper_direction, 'null' AS direction_auto, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'rct' END AS design, CASE WHEN n_regionkey < 3 THEN 'observational' ELSE 'animal' END AS design_auto,
    CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE 'Dose; limitation,zzz/population  dose' END AS key_conditions, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey % 5 AS VARCHAR) ELSE '' END AS press_release_strength,
    CASE WHEN n_nationkey % 8 = 0 THEN 'a' ELSE '' END AS checked_by, 'Conclusion ' || n_name AS conclusion_en, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS main_finding_ko FROM nation)"""
PAPERS = f"""{PAPER_TABLE}, papers AS (SELECT bundle_id, CASE WHEN trim(paper_strength) <> '' THEN trim(paper_strength) ELSE strength_auto END AS paper_strength, CASE WHEN paper_direction <> '' THEN paper_direction ELSE direction_auto END AS paper_direction,
    CASE WHEN design <> '' THEN design ELSE design_auto END AS design, key_conditions, press_release_strength, checked_by AS paper_checked_by, CASE WHEN trim(paper_strength) <> '' THEN 'coded' ELSE 'auto' END AS paper_code_source FROM paper_table)"""


# ---- normalised text, segments and levels as SQL, over the patterns of the library
def normal(c: str) -> str:
    """normalize_text() but for the normal form, which the test texts are in."""
    return rf"trim(regexp_replace(regexp_replace({c}, '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), chr(10) || chr(9) || ' ')"


def _any(c: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {quoted(p)})" for p in patterns) + ")"


def _noise(c: str) -> str:
    return f"(length({c}) < 8 OR ({_any(c, [text.PLACEHOLDER])} AND NOT {_any(c, [text.INNER_BYLINE])}) OR (length({c}) < 60 AND {_any(c, text.NOISE)}))"


def _bare(c: str) -> str:
    return rf"regexp_replace({c}, '[^\p{{L}}\p{{M}}\p{{N}}_]', '', 'g')"


def _head(c: str) -> str:
    repeats = f"(length({_bare('title')}) >= 10 AND starts_with({_bare(c)}, {_bare('title')}) AND length({_bare(c)}) - length({_bare('title')}) < 10)"
    return rf"({repeats} OR regexp_matches(left({c}, 80), {quoted(text.STAMP)}) OR regexp_matches({c}, 'DB\s*금지') OR {_noise(c)} OR (length({c}) <= 70 AND NOT regexp_matches({c}, {quoted(text.SENTENCE_END)})))"


def _stripped(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def sentences_sql(lines: str) -> str:
    """The sentences of a list of lines."""
    cut = rf"string_split(regexp_replace(p, '([.!?])\s+(\S)', '\1' || chr(1) || '\2', 'g'), chr(1))"
    return f"list_filter(list_transform(flatten(list_transform({lines}, p -> {cut})), x -> {_stripped('x')}), x -> x <> '')"


_BYLINE = f"CASE WHEN regexp_matches(left(x, 250), {quoted(text.INNER_BYLINE)}) THEN regexp_replace(x, {quoted('(?s)^.*?(?:' + text.INNER_BYLINE + ')')}, '') ELSE x END"
SEGMENTS = rf"""{ARTICLES}, normed AS (SELECT article_id, bundle_id, outlet_type, {normal('title')} AS title, title AS raw_title, body, string_split(regexp_replace({normal('body')}, '\bAdvertisement\b', ' ', 'g'), chr(10)) AS lines FROM articles),
  kept AS (SELECT *, coalesce(list_position(list_transform(lines, l -> {_head('trim(l)')}), false), 0) AS first FROM normed),
  parted AS (SELECT *, {sentences_sql("list_transform(CASE WHEN first > 0 THEN lines[first:] ELSE lines END, l -> " + normal('l') + ")")} AS found FROM kept),
  segments AS (SELECT article_id, bundle_id, outlet_type, title, raw_title, body, list_filter(list_transform(found, x -> {_stripped(f"regexp_replace({_BYLINE}, {quoted(text.LEADING_BYLINE)}, '')")}), x -> NOT {_noise('x')}) AS s FROM parted)"""


def _after(cue: str) -> str:
    """The windows behind each place of a cue in the lower-cased masked sentence m."""
    stops = r"""'^[^,.…·;!?''"“”‘’()\[\]<>〈〉/|]*'"""
    return f"list_transform(range(2, len(string_split(m, '{cue}')) + 1), i -> regexp_extract(left(array_to_string(string_split(m, '{cue}')[i:], '{cue}'), 8), {stops}))"


_NEG, _MAY, _CAN = (f"contains(w, '{MODAL[k]}')" for k in ("negation", "may", "can"))
#: From sentences sent(article_id, part, i, x, drugs, outcomes, gated) to claims(article_id, part, i, x, level, direction).
CLAIMS = f"""masked AS (SELECT *, regexp_replace(x, drugs, '[D]', 'g') AS k, lower(regexp_replace(x, drugs, '[D]', 'g')) AS m FROM sent),
  hits AS (SELECT *, list_concat(list_concat(list_transform({_after(CUES['no_relationship'])}, w -> 1), list_transform({_after(CUES['causal'])}, w -> CASE WHEN {_NEG} THEN 1 WHEN {_MAY} THEN 4 WHEN {_CAN} THEN 5 ELSE 6 END)),
      list_concat(list_transform({_after(CUES['conditional'])}, w -> 4), list_concat(list_transform({_after(CUES['ambiguous'])}, w -> CASE WHEN {_NEG} THEN 1 ELSE 3 END), list_transform({_after(CUES['correlational'])}, w -> CASE WHEN {_NEG} THEN 1 ELSE 2 END)))) AS h,
    list_transform({_after(CUES['ambiguous_weak'])}, w -> CASE WHEN {_NEG} THEN 1 ELSE 3 END) AS weak,
    NOT gated OR contains(k, '[D]') OR regexp_matches(k, outcomes) OR contains(m, 'ció') AS open FROM masked),
  graded AS (SELECT article_id, part, i, x, m, CASE WHEN NOT open THEN 0 ELSE coalesce(list_max(CASE WHEN coalesce(list_max(h), 0) >= 2 THEN h ELSE list_concat(h, weak) END), 0) END AS level FROM hits),
  claims AS (SELECT article_id, part, i, x, level, CASE WHEN level = 1 THEN 'null' WHEN level = 0 THEN '' WHEN contains(m, 'on t') AND contains(m, 'in t') THEN 'mixed' WHEN contains(m, 'on t') THEN 'increase' WHEN contains(m, 'in t') THEN 'decrease' ELSE '' END AS direction FROM graded)"""


def _cond(c: str, entries) -> str:
    return f"CAST(regexp_matches({c}, {quoted('(?i)' + '|'.join(entries))}) AS INT)"


def _count(c: str, entries) -> str:
    return f"len(regexp_extract_all(lower({c}), {quoted('|'.join(entries))}))"


_SECTIONS = ("title", "lead", "body")
_LABELS = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_MASKED = ", ".join(f"regexp_replace({c}, drugs, '[D]', 'g') AS k_{s}" for s, c in (("title", "title"), ("lead", "array_to_string(s[1:2], ' ')"), ("body", "array_to_string(s, ' ')")))
_COND_COLUMNS = ", ".join(f"{_cond(f'k_{s}', e)} AS auto_cond_{s}_{k}" for k, e in CONDITIONS.items() for s in _SECTIONS)
_COUNT_COLUMNS = ", ".join(f"{_count(f'k_{s}', COUNTED[k])} AS n_{k}_{s}" for k in ("hedges", "boosters", "sensational") for s in _SECTIONS)
_ADVISED = " ".join(f"WHEN regexp_matches(said, {quoted('(?i)' + '|'.join(ADVICE[k]))}) THEN {k}" for k in ("3", "2", "1"))
FEATURES = f"""{SEGMENTS}, {BUNDLES}, joined AS (SELECT segments.*, drugs, outcomes, journal FROM segments JOIN bundles USING (bundle_id)),
  sent AS (SELECT article_id, 'title' AS part, 1 AS i, title AS x, drugs, outcomes, false AS gated FROM joined
    UNION ALL SELECT article_id, CASE WHEN i <= 2 THEN 'lead' ELSE 'body' END, i, s[i], drugs, outcomes, true FROM (SELECT article_id, s, drugs, outcomes, unnest(range(1, len(s) + 1)) AS i FROM joined)), {CLAIMS},
  units AS (SELECT article_id, part, max(level) AS level, arg_max(direction, level * 1000000 - i) AS direction FROM claims GROUP BY article_id, part),
  wide AS (SELECT article_id, {', '.join(f"coalesce(max(CASE WHEN part = '{p}' THEN {c} END), {d}) AS {p}_{c}" for p in _SECTIONS for c, d in (('level', '0'), ('direction', "''")))} FROM units GROUP BY article_id),
  parts AS (SELECT article_id, bundle_id, outlet_type, title, array_to_string(s[1:2], ' ') AS lead, s, length(body) AS body_len, len(s) AS n_sentences, {_MASKED}, array_to_string(list_concat([title], s), ' ') AS said, title || ' ' || body AS whole, journal FROM joined),
  features AS (SELECT p.article_id, bundle_id, outlet_type, title, lead, body_len, n_sentences, title_level AS auto_title_strength, {_LABELS}[title_level + 1] AS auto_title_label, title_direction AS auto_title_direction,
    lead_level AS auto_lead_strength, {_LABELS}[lead_level + 1] AS auto_lead_label, lead_direction AS auto_lead_direction, body_level AS auto_body_max_strength,
    CASE WHEN title_direction <> '' THEN title_direction WHEN lead_direction <> '' THEN lead_direction ELSE body_direction END AS auto_direction,
    CAST(contains(title, '?') AS INT) AS auto_title_question, CAST(length(regexp_replace(title, '[^"''“”‘’「」『』]', '', 'g')) >= 2 AS INT) AS auto_title_quoted, {_COND_COLUMNS}, {_COUNT_COLUMNS},
    CAST(len(list_filter(s, x -> regexp_matches(x, '(?i)but|pero'))) > 0 AS INT) AS auto_caveat, array_to_string(list_transform(list_filter(s, x -> regexp_matches(x, '(?i)but|pero'))[1:3], x -> left(x, 160)), ' || ') AS auto_caveat_sentences,
    CASE {_ADVISED} ELSE 0 END AS auto_advice, {_count('whole', COUNTED['attribution'])} AS n_attribution FROM parts p JOIN wide w ON p.article_id = w.article_id)"""
FEATURE_COLUMNS = ["article_id", "bundle_id", "outlet_type", "title", "lead", "body_len", "n_sentences", "auto_title_strength", "auto_title_label", "auto_title_direction", "auto_lead_strength", "auto_lead_label", "auto_lead_direction", "auto_body_max_strength", "auto_direction", "auto_title_question", "auto_title_quoted", *[f"auto_cond_{s}_{k}" for k in KEYS for s in _SECTIONS], *[f"n_{k}_{s}" for k in ("hedges", "boosters", "sensational") for s in _SECTIONS], "auto_caveat", "auto_caveat_sentences", "auto_advice", "n_attribution"]


def feature_rows(spark, sf, cues: bool = False) -> DataFrame:
    return features.article_features(articles(spark, sf), bundles(spark, sf), LEXICON, JOURNALS, NOT_JOURNALS, cues=cues)


@query(f"WITH {FEATURES} SELECT * FROM features")
def features_wide(spark, sf):
    long = {"body_len", "n_sentences", *[c for c in FEATURE_COLUMNS if c.startswith("n_")]}
    return feature_rows(spark, sf).select(*[F.col(c).cast("long").alias(c) if c in long else c for c in FEATURE_COLUMNS])


@query()
def article_features(spark, sf):
    """The whole feature row of every document, with the cues' lists."""
    return feature_rows(spark, sf, cues=True)


@query(f"WITH {SEGMENTS} SELECT article_id, array_to_string(s[1:2], ' ') AS lead, greatest(len(s) - 2, 0) AS n_rest FROM segments")
def segment_lead(spark, sf):
    a = articles(spark, sf).withColumn("s", text.segment(F.col("title"), F.col("body")))
    return a.select("article_id", F.array_join("s.lead", " ").alias("lead"), F.size("s.rest").cast("long").alias("n_rest"))


# ---- codes, papers, dataset
_DIRECTION = "CASE {c} WHEN 'increase' THEN 'inc' WHEN 'decrease' THEN 'dec' WHEN 'mixed' THEN 'unclear' ELSE {c} END"
_AUTO_CODES = f"SELECT article_id, auto_title_strength AS title_strength, auto_lead_strength AS lead_strength, {_DIRECTION.format(c='auto_direction')} AS direction, auto_advice AS advice, CASE auto_caveat WHEN 1 THEN 'Y' ELSE 'N' END AS caveat_in_body FROM features"
DATASET = f"""{FEATURES}, {PAPERS}, codes AS ({_AUTO_CODES}), based AS (SELECT f.*, c.* EXCLUDE (article_id), TRY_CAST(p.paper_strength AS DOUBLE) AS paper_strength, paper_direction, design, key_conditions, TRY_CAST(press_release_strength AS DOUBLE) AS press_release_strength, paper_code_source
    FROM features f JOIN codes c USING (article_id) LEFT JOIN papers p ON f.bundle_id = p.bundle_id),
  dataset AS (SELECT *, title_strength - paper_strength AS delta_title, lead_strength - paper_strength AS delta_lead, CAST(title_strength > paper_strength AS DOUBLE) AS exceeds_title, CAST(lead_strength > paper_strength AS DOUBLE) AS exceeds_lead,
    CASE WHEN design IN ('observational', 'pharmacovigilance', 'case_report') AND paper_strength <= 3 THEN CAST(title_strength >= 4 AS DOUBLE) END AS causal_inflation_title,
    CASE WHEN direction IN ('inc', 'dec', 'null') AND paper_direction IN ('inc', 'dec', 'null') THEN CAST(direction <> paper_direction AS DOUBLE) END AS direction_mismatch,
    CAST(title_strength >= 5 AS DOUBLE) AS strong_title, CAST(title_strength >= 5 AND caveat_in_body = 'Y' AS DOUBLE) AS title_body_gap, CAST(title_strength - lead_strength AS DOUBLE) AS title_minus_lead FROM based)"""
_DATASET_COLUMNS = ["article_id", "bundle_id", "outlet_type", "title_strength", "lead_strength", "direction", "advice", "caveat_in_body", "paper_strength", "paper_direction", "design", "press_release_strength", "paper_code_source", "delta_title", "delta_lead", "exceeds_title", "exceeds_lead", "causal_inflation_title", "direction_mismatch", "strong_title", "title_body_gap", "title_minus_lead"]
_AS_DOUBLE = ("title_strength", "lead_strength", "advice")


def coded(spark, sf) -> DataFrame:
    """The analysis dataset from automatic codes, papers with proposals where nobody filled them in."""
    f = feature_rows(spark, sf)
    return dataset.build_dataset(f, dataset.load_codes(f, "auto"), dataset.load_papers(paper_table(spark, sf), True), "auto")


@query(f"WITH {DATASET} SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' if c in _AS_DOUBLE else c for c in _DATASET_COLUMNS)} FROM dataset")
def dataset_flags(spark, sf):
    return coded(spark, sf).select(*_DATASET_COLUMNS)


def sheet(spark, sf, which: int) -> DataFrame:
    """A coder's sheet over the labelled documents, with blanks and values that are not allowed."""
    l, k = table(spark, sf, "labels"), F.col("doc_id")
    value = F.col("quality" if which == 1 else "toxic")
    return l.select(
        k.alias("article_id"), F.when(k % (9 + which) == 0, "").otherwise(((value * 3 + k % 4) % 7).cast("string")).alias("title_strength"), ((value + k) % 5).cast("string").alias("lead_strength"),
        F.when(k % 2 == 0, "inc").when(value == 1, "dec").otherwise("null").alias("direction"), F.when(k % 8 == 0, "7").otherwise((value + 1).cast("string")).alias("advice"), F.when(value == 1, "Y").when(k % 3 == 0, "na").otherwise("n").alias("caveat_in_body"), F.when(k % 6 == 0, "Y").otherwise("N").alias("source_error"),
    )


def _sheet(which: int) -> str:
    v = "quality" if which == 1 else "toxic"
    return f"""sheet{which} AS (SELECT doc_id AS article_id, CASE WHEN doc_id % {9 + which} = 0 THEN '' ELSE CAST(({v} * 3 + doc_id % 4) % 7 AS VARCHAR) END AS title_strength, CAST(({v} + doc_id) % 5 AS VARCHAR) AS lead_strength,
    CASE WHEN doc_id % 2 = 0 THEN 'inc' WHEN {v} = 1 THEN 'dec' ELSE 'null' END AS direction, CASE WHEN doc_id % 8 = 0 THEN '7' ELSE CAST({v} + 1 AS VARCHAR) END AS advice, CASE WHEN {v} = 1 THEN 'Y' WHEN doc_id % 3 = 0 THEN 'na' ELSE 'n' END AS caveat_in_body, CASE WHEN doc_id % 6 = 0 THEN 'Y' ELSE 'N' END AS source_error FROM labels)"""


@query(f"WITH {_sheet(1)} SELECT * FROM sheet1 WHERE trim(title_strength) <> ''")
def load_codes(spark, sf):
    return dataset.load_codes(None, "coder1", sheet(spark, sf, 1))


@query(f"WITH {PAPERS} SELECT * FROM papers")
def load_papers(spark, sf):
    return dataset.load_papers(paper_table(spark, sf), True)


@query(f"WITH {PAPERS} SELECT bundle_id, trim(paper_strength) AS paper_strength, paper_direction, design, key_conditions, press_release_strength, checked_by AS paper_checked_by, CASE WHEN trim(paper_strength) <> '' THEN 'coded' ELSE 'missing' END AS paper_code_source FROM paper_table")
def load_papers_coded(spark, sf):
    return dataset.load_papers(paper_table(spark, sf), False)


_OLD_SHEET = "old_sheet AS (SELECT 'src' || n_nationkey AS bundle_id, 'note ' || n_nationkey AS paper_notes, CASE WHEN n_nationkey % 2 = 0 THEN 'rct' ELSE '' END AS design, n_name || '?' AS title FROM nation WHERE n_nationkey % 3 <> 1 UNION ALL SELECT 'gone', 'kept', 'rct', 'old')"


@query(f"""WITH {PAPER_TABLE}, {BUNDLES}, {_OLD_SHEET}, shown AS (SELECT p.bundle_id, b.label, p.doi, p.title, p.design_auto, p.conclusion_en, p.strength_auto, p.direction_auto, b.notes AS bundle_notes FROM paper_table p LEFT JOIN bundles b ON p.bundle_id = b.bundle_id)
  SELECT coalesce(n.bundle_id, o.bundle_id) AS bundle_id, coalesce(label, '') AS label, coalesce(doi, '') AS doi, coalesce(n.title, o.title) AS title, coalesce(design_auto, '') AS design_auto, coalesce(strength_auto, '') AS strength_auto, coalesce(direction_auto, '') AS direction_auto, coalesce(bundle_notes, '') AS bundle_notes,
    coalesce(o.design, '') AS design, coalesce(o.paper_notes, '') AS paper_notes, '' AS checked_by, CASE WHEN n.bundle_id IS NULL THEN 'Y' ELSE '' END AS _stale FROM shown n FULL JOIN old_sheet o ON n.bundle_id = o.bundle_id""")
def paper_sheet(spark, sf):
    n = table(spark, sf, "nation").filter("n_nationkey % 3 <> 1")
    k = F.col("n_nationkey")
    old = n.select(F.concat(F.lit("src"), k.cast("string")).alias("bundle_id"), F.concat(F.lit("note "), k.cast("string")).alias("paper_notes"), F.when(k % 2 == 0, "rct").otherwise("").alias("design"), F.concat("n_name", F.lit("?")).alias("title"))
    old = old.unionByName(spark.createDataFrame([("gone", "kept", "rct", "old")], old.schema))
    got = dataset.paper_sheet(paper_table(spark, sf), bundles(spark, sf), old)
    return got.select("bundle_id", "label", "doi", "title", "design_auto", "strength_auto", "direction_auto", "bundle_notes", "design", "paper_notes", "checked_by", "_stale")


_NAMED = lambda s: "concat_ws(', ', " + ", ".join(f"CASE WHEN auto_cond_{s}_{k} = 1 THEN '{k}' END" for k in KEYS) + ")"


def _sheet_sql(blind: bool) -> str:
    proposals = "" if blind else f""", CAST(auto_title_strength AS VARCHAR) AS auto_title_strength, CAST(auto_lead_strength AS VARCHAR) AS auto_lead_strength, {_DIRECTION.format(c='auto_direction')} AS auto_direction, CAST(auto_advice AS VARCHAR) AS auto_advice,
      CASE auto_caveat WHEN 1 THEN 'Y' ELSE 'N' END AS auto_caveat, auto_caveat_sentences, CAST(auto_title_question AS VARCHAR) AS auto_title_question, {_NAMED('title')} AS auto_title_conditions, {_NAMED('body')} AS auto_body_conditions"""
    return f"""WITH {FEATURES}, {PAPER_TABLE}, {_sheet(1)} SELECT CAST(f.article_id AS VARCHAR) AS article_id, f.bundle_id, outlet_type, CASE WHEN p.design <> '' THEN p.design ELSE p.design_auto END AS paper_design, CASE WHEN main_finding_ko <> '' THEN main_finding_ko ELSE conclusion_en END AS paper_finding,
      p.key_conditions AS paper_key_conditions, f.title, lead{proposals}, coalesce(o.title_strength, '') AS title_strength, coalesce(o.source_error, '') AS source_error, '' AS coder_notes FROM features f LEFT JOIN paper_table p ON f.bundle_id = p.bundle_id LEFT JOIN sheet1 o ON f.article_id = o.article_id"""


def _coding_sheet(spark, sf, blind):
    old = sheet(spark, sf, 1).withColumn("article_id", F.col("article_id").cast("string"))
    got = dataset.coding_sheet(feature_rows(spark, sf, cues=True), paper_table(spark, sf), KEYS, blind, old)
    drop = ["lead_strength", "direction", "advice", "caveat_in_body", "title_omission_misleading", "animal_generalization", "_stale", "auto_title_cues", "auto_lead_cues", "auto_advice_cues", "journals_mentioned", "non_journal_sources"]
    return got.drop(*drop)


@query(_sheet_sql(False))
def coding_sheet(spark, sf):
    return _coding_sheet(spark, sf, False)


@query(_sheet_sql(True))
def coding_sheet_blind(spark, sf):
    return _coding_sheet(spark, sf, True)


# ---- comparison
def boot_sql(values: str, n: int, name: str = "sums") -> str:
    """Sums over each replicate's clusters of a table per (cluster, ...)."""
    return f"""numbered AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS i FROM per), g AS (SELECT count(*) AS g FROM per), draws AS (SELECT b, ('0x' || substr(md5('0:' || b || ':' || d), 1, 8))::BIGINT % g AS i
      FROM (SELECT unnest(range({n})) AS b), g, (SELECT unnest(range(1, (SELECT g + 1 FROM g))) AS d)), {name} AS (SELECT b, {values} FROM draws JOIN numbered USING (i) GROUP BY b)"""


def rate_sql(flag: str, n: int, where: str = "true", source: str = "dataset") -> str:
    """One row est, lo, hi, n of a flag over the rows of a table."""
    return f"""(WITH per AS (SELECT bundle_id AS cluster, sum({flag}) AS s, count(*) AS n FROM {source} WHERE {flag} IS NOT NULL AND {where} GROUP BY 1), {boot_sql('sum(s) AS s, sum(n) AS n', n)}
      SELECT round((SELECT sum(s) / sum(n) FROM per), 6) AS est, CASE WHEN (SELECT g FROM g) >= 2 THEN round(quantile_cont(CAST(s / n AS DOUBLE), 0.025), 6) END AS lo, CASE WHEN (SELECT g FROM g) >= 2 THEN round(quantile_cont(CAST(s / n AS DOUBLE), 0.975), 6) END AS hi, coalesce(CAST((SELECT sum(n) FROM per) AS BIGINT), 0) AS n FROM sums)"""


_R6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
#: The dataset is used many times by a query's SQL, so it is worked out once.
_ONCE = DATASET.replace("  dataset AS (", "  dataset AS MATERIALIZED (")


@query(f"WITH {_ONCE} " + " UNION ALL ".join(f"SELECT '{f}' AS flag, n, est, lo, hi FROM {rate_sql(f, 2000)}" for f in dataset.RATES))
def overall_rates(spark, sf):
    return compare.overall_rates(coded(spark, sf)).select("flag", "n", *_R6("est", "lo", "hi"))


_TYPES = ("en", "de", "fr", "es")


@query(f"""WITH {_ONCE}, sizes AS (SELECT outlet_type, count(*) AS articles, count(DISTINCT bundle_id) AS bundles, round(avg(title_strength), 2) AS mean_strength, round(avg(delta_title), 2) AS mean_delta, round(avg(n_sensational_title), 2) AS mean_sensational, round(100 * avg(auto_title_question), 1) AS question_pct FROM dataset GROUP BY outlet_type),
  rates AS ({' UNION ALL '.join(f"SELECT '{t}' AS outlet_type, '{f}' AS flag, est, lo, hi FROM {rate_sql(f, 1000, f'outlet_type = {quoted(t)}')}" for t in _TYPES for f in compare.OUTLET_RATES)})
  SELECT s.*, {', '.join(f"max(CASE WHEN flag = '{f}' THEN {c} END) AS {f}{tail}" for f in compare.OUTLET_RATES for c, tail in (('est', ''), ('lo', '_lo'), ('hi', '_hi')))} FROM sizes s JOIN rates USING (outlet_type) GROUP BY ALL""")
def outlet_rates(spark, sf):
    got = compare.by_outlet_type(coded(spark, sf))
    rates = [f + tail for f in compare.OUTLET_RATES for tail in ("", "_lo", "_hi")]
    return got.select(*[c for c in got.columns if c not in rates], *_R6(*rates))


@query(f"""WITH {DATASET} SELECT bundle_id, min(design) AS design, min(paper_strength) AS paper_strength, min(press_release_strength) AS press_release_strength, count(*) AS n, CAST(min(title_strength) AS DOUBLE) AS lowest, CAST(max(title_strength) AS DOUBLE) AS highest,
  round(avg(title_strength), 2) AS mean, round(stddev_pop(title_strength), 2) AS sd, CAST(count_if(exceeds_title = 1) AS BIGINT) AS exceeds, array_to_string(list_sort(list_distinct(list(outlet_type))), ', ') AS outlet_types FROM dataset GROUP BY bundle_id""")
def bundle_ladder(spark, sf):
    return compare.bundle_ladder(coded(spark, sf))


@query(f"""WITH {DATASET} SELECT count(*) AS n, round(100 * avg(CAST(title_minus_lead > 0 AS DOUBLE)), 1) AS stronger, round(100 * avg(CAST(title_minus_lead = 0 AS DOUBLE)), 1) AS equal,
  round(100 * avg(CAST(title_minus_lead < 0 AS DOUBLE)), 1) AS weaker, round(avg(title_minus_lead), 2) AS mean_diff FROM dataset WHERE title_minus_lead IS NOT NULL""")
def title_vs_lead(spark, sf):
    return compare.title_vs_lead(coded(spark, sf))


@query(f"""WITH {_ONCE}, known AS MATERIALIZED (SELECT *, CAST(press_release_strength > paper_strength AS INT) AS pr FROM dataset WHERE press_release_strength IS NOT NULL AND paper_strength IS NOT NULL AND exceeds_title IS NOT NULL)
  SELECT * FROM ({' UNION ALL '.join(f"SELECT {v} AS pr_exceeds, n, est, lo, hi FROM {rate_sql('exceeds_title', 2000, f'pr = {v}', 'known')}" for v in (0, 1))}) WHERE n > 0 AND (SELECT count(DISTINCT bundle_id) FROM known) >= 3""")
def press_release(spark, sf):
    return compare.press_release_conditional(coded(spark, sf)).select("pr_exceeds", "n", *_R6("est", "lo", "hi"))


RETAINED = f"""{DATASET}, keyed AS (SELECT article_id, bundle_id, outlet_type, {', '.join(f'auto_cond_{s}_{k}' for s in _SECTIONS for k in KEYS)}, unnest(list_filter(string_split_regex(lower(key_conditions), '[;,/[:space:]]+'), x -> list_contains([{', '.join(quoted(k) for k in KEYS)}], x))) AS condition FROM dataset WHERE key_conditions IS NOT NULL),
  retained AS (SELECT article_id, bundle_id, outlet_type, condition, {', '.join(f"CASE condition {' '.join(f'WHEN {quoted(k)} THEN auto_cond_{s}_{k}' for k in KEYS)} END AS in_{s}" for s in _SECTIONS)} FROM keyed),
  retention AS (SELECT *, CAST(in_title = 0 AND in_body = 1 AS INT) AS dropped_in_title_kept_in_body, CAST(in_title = 0 AND in_lead = 0 AND in_body = 0 AS INT) AS absent_everywhere FROM retained)"""


def retained(spark, sf) -> DataFrame:
    return dataset.condition_retention(coded(spark, sf), KEYS)


@query(f"WITH {RETAINED} SELECT * FROM retention")
def condition_retention(spark, sf):
    return retained(spark, sf)


_PCTS = ("in_title", "in_lead", "in_body", "dropped_in_title_kept_in_body", "absent_everywhere")


@query(f"WITH {RETAINED} SELECT condition, count(*) AS n, {', '.join(f'round(100 * avg({c}), 1) AS {c}_pct' for c in _PCTS)} FROM retention GROUP BY condition")
def condition_summary(spark, sf):
    return dataset.condition_summary(retained(spark, sf))


@query(f"WITH {DATASET} SELECT 'outlet_type' AS item, outlet_type AS value, count(*) AS n FROM dataset GROUP BY outlet_type UNION ALL SELECT 'paper_code_source', paper_code_source, count(DISTINCT bundle_id) FROM dataset GROUP BY paper_code_source UNION ALL SELECT 'bundle_size', CAST(n AS VARCHAR), count(*) FROM (SELECT bundle_id, count(*) AS n FROM dataset GROUP BY bundle_id) GROUP BY n")
def value_counts(spark, sf):
    from skein.plans.report import value_counts as counts

    return counts(coded(spark, sf))


@query(f"WITH {_ONCE} SELECT * FROM {rate_sql('strong_title', 2000)}")
def bootstrap_ci(spark, sf):
    return stats.cluster_bootstrap(coded(spark, sf), "strong_title", "bundle_id").select(*_R6("est", "lo", "hi"), "n")


@query(f"""WITH {DATASET}, per AS (SELECT bundle_id AS cluster, sum(CASE WHEN outlet_type = 'en' THEN strong_title ELSE 0 END) AS s1, count_if(outlet_type = 'en') AS n1, sum(CASE WHEN outlet_type <> 'en' THEN strong_title ELSE 0 END) AS s0, count_if(outlet_type <> 'en') AS n0 FROM dataset GROUP BY 1),
  {boot_sql('sum(s1) AS s1, sum(n1) AS n1, sum(s0) AS s0, sum(n0) AS n0', 2000)}, m AS (SELECT CAST(s1 / nullif(n1, 0) - s0 / nullif(n0, 0) AS DOUBLE) AS m FROM sums)
  SELECT round((SELECT sum(s1) / sum(n1) - sum(s0) / sum(n0) FROM per), 6) AS est, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def bootstrap_diff(spark, sf):
    d = coded(spark, sf).withColumn("g", (F.col("outlet_type") == "en").cast("int"))
    return stats.cluster_bootstrap_diff(d, "strong_title", "g", "bundle_id").select(*_R6("est", "lo", "hi"))


# ---- comments
def reactions(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations").filter("text is not null")
    return c.select(F.col("conv_id").alias("article_id"), "turn", "text", *[LEXICON.any_(F.col("text"), "reactions", k).cast("int").alias(k) for k in REACTIONS])


REACT = "r AS (SELECT conv_id AS article_id, turn, " + ", ".join(f"CAST(regexp_matches(text, '(?i)({'|'.join(e)})') AS INT) AS {k}" for k, e in REACTIONS.items()) + " FROM conversations WHERE text IS NOT NULL)"


@query(f"WITH {REACT} SELECT * FROM r")
def comment_reactions(spark, sf):
    return reactions(spark, sf).drop("text")


def per_article(spark, sf) -> DataFrame:
    return reactions(spark, sf).groupBy("article_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(k).alias(k) for k in REACTIONS])


@query(f"WITH {REACT} SELECT article_id, count(*) AS n, {', '.join(f'round(avg({k}), 6) AS {k}' for k in REACTIONS)} FROM r GROUP BY article_id")
def comment_per_article(spark, sf):
    return per_article(spark, sf).select("article_id", "n", *_R6(*REACTIONS))


_GROUPS = ("strong_title", "exceeds_title")
_ERFC = "t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x)"


def rank_sql(value: str, side: str, source: str) -> str:
    """One row n1, n0, u1, z, p."""
    return f"""(WITH c AS (SELECT CAST({value} AS DOUBLE) AS v, CAST({side} AS INT) AS side FROM {source} WHERE {value} IS NOT NULL AND {side} IN (0, 1)), k AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM c),
      q AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM c GROUP BY v)), s AS (SELECT CAST(sum(side) AS DOUBLE) AS n1, CAST(sum(1 - side) AS DOUBLE) AS n0, sum(r * side) - sum(side) * (sum(side) + 1) / 2.0 AS u1 FROM k),
      zs AS (SELECT n1, n0, u1, ties, (greatest(u1, n1 * n0 - u1) - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS z FROM s, q), xs AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM zs)
      SELECT CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, u1, z, CASE WHEN n1 >= 3 AND n0 >= 3 THEN least(1, CASE WHEN z >= 0 THEN {_ERFC} ELSE 2 - {_ERFC} END) END AS p FROM xs)"""


@query(f"SELECT n1, n0, round(u1, 2) AS u1, round(z, 6) AS z, round(p, 6) AS p FROM {rank_sql('n_chars', 'en', '(SELECT n_chars, CAST(lang = ' + quoted('en') + ' AS INT) AS en FROM documents)')}")
def mann_whitney_u(spark, sf):
    d = table(spark, sf, "documents").withColumn("side", (F.col("lang") == "en").cast("int"))
    return stats.mann_whitney(d, "n_chars", "side").select("n1", "n0", F.round("u1", 2).alias("u1"), F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


def _group_sql(group: str, value: str) -> str:
    side = lambda g, e: f"sum(CASE WHEN {group} = {g} THEN {e} ELSE 0 END)"
    return f"""SELECT * FROM (WITH d AS (SELECT bundle_id, {group}, {value} FROM both_ WHERE {group} IN (0, 1)),
      per AS (SELECT bundle_id AS cluster, {side(1, value)} AS s1, {side(1, 1)} AS n1, {side(0, value)} AS s0, {side(0, 1)} AS n0 FROM d GROUP BY 1), {boot_sql('sum(s1) AS s1, sum(n1) AS n1, sum(s0) AS s0, sum(n0) AS n0', 2000)},
      m AS (SELECT CAST(s1 / nullif(n1, 0) - s0 / nullif(n0, 0) AS DOUBLE) AS m FROM sums), t AS (SELECT CAST(sum(n1) AS BIGINT) AS n1, CAST(sum(n0) AS BIGINT) AS n0, sum(s1) AS s1, sum(s0) AS s0 FROM per)
      SELECT '{group}' AS grouping, '{value}' AS value, n1, n0, round(s1 / n1, 6) AS mean1, round(s0 / n0, 6) AS mean0, round(s1 / n1 - s0 / n0, 6) AS est, round((SELECT quantile_cont(m, 0.025) FROM m), 6) AS lo, round((SELECT quantile_cont(m, 0.975) FROM m), 6) AS hi,
        (SELECT CASE WHEN least(n1, n0) > 8 THEN round(p, 6) END FROM {rank_sql(value, group, 'both_')}) AS p FROM t WHERE n1 > 0 AND n0 > 0)"""


@query(f"""WITH {_ONCE}, {REACT}, shares AS (SELECT article_id, count(*) AS n, {', '.join(f'avg({k}) AS {k}' for k in REACTIONS)} FROM r GROUP BY article_id HAVING count(*) >= 2), both_ AS MATERIALIZED (SELECT d.article_id, bundle_id, {', '.join(_GROUPS)}, {', '.join(REACTIONS)} FROM dataset d JOIN shares USING (article_id))
  {' UNION ALL '.join(_group_sql(g, v) for g in _GROUPS for v in REACTIONS)}""")
def compare_groups(spark, sf):
    got = stats.compare_groups(coded(spark, sf), per_article(spark, sf), _GROUPS, list(REACTIONS), "bundle_id", least=2)
    # the exact p of small sides is tested by brute force; SQL has the approximation
    return got.select("grouping", "value", "n1", "n0", *_R6("mean1", "mean0", "est", "lo", "hi"), F.when(F.least("n1", "n0") > 8, F.round("p", 6)).alias("p"))


@query()
def gee_logit(spark, sf):
    rows, why = stats.gee_logit(coded(spark, sf), "exceeds_title", "outlet_type", "bundle_id")
    rows = rows or [{"term": why, "odds_ratio": None, "lo": None, "hi": None, "p": None}]
    return spark.createDataFrame([(r["term"], r["odds_ratio"], r["lo"], r["hi"], r["p"]) for r in rows], "term string, odds_ratio double, lo double, hi double, p double")


# ---- agreement
def kappa_sql(source: str, a: str, b: str, ordinal: bool) -> str:
    """One row n, agree_pct, kappa, weighted_kappa of two text columns."""
    plain = lambda c: f"CASE WHEN upper(trim({c})) NOT IN ('', 'NA') THEN upper(trim({c})) END"
    labels = "l AS (SELECT l, dense_rank() OVER (ORDER BY TRY_CAST(l AS INT)) AS r FROM (SELECT x AS l FROM o UNION SELECT y FROM o))"
    weighted = "CASE WHEN (SELECT count(*) FROM l) > 1 AND (SELECT bool_and(TRY_CAST(l AS INT) IS NOT NULL) FROM l) THEN round(1 - w * n / we, 3) END" if ordinal else "CAST(NULL AS DOUBLE)"
    return f"""(WITH o AS (SELECT x, y, count(*) AS o FROM (SELECT {plain(a)} AS x, {plain(b)} AS y FROM {source}) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2), {labels},
      s AS (SELECT sum(o) AS n, sum(CASE WHEN x = y THEN o ELSE 0 END) AS same, sum(CASE WHEN x <> y THEN o ELSE 0 END) AS apart, sum(abs(a.r - b.r) * o) AS w FROM o JOIN l a ON x = a.l JOIN l b ON y = b.l),
      e AS (SELECT sum(CASE WHEN x <> y THEN nx * ny ELSE 0 END) AS e, sum(abs(a.r - b.r) * nx * ny) AS we FROM (SELECT x, sum(o) AS nx FROM o GROUP BY x) JOIN l a ON x = a.l, (SELECT y, sum(o) AS ny FROM o GROUP BY y) JOIN l b ON y = b.l)
      SELECT CAST(coalesce(n, 0) AS BIGINT) AS n, round(100.0 * same / n, 1) AS agree_pct, CASE WHEN (SELECT count(*) FROM l) > 1 THEN round(1 - apart * n / e, 3) END AS kappa, {weighted} AS weighted_kappa FROM s, e)"""


_BOTH = "both_ AS (SELECT " + ", ".join(f"a.{f} AS {f}_1, b.{f} AS {f}_2" for f in agreement.CODED if f not in ("title_omission_misleading", "animal_generalization")) + " FROM sheet1 a JOIN sheet2 b USING (article_id))"
_PRESENT = {f: o for f, o in agreement.CODED.items() if f not in ("title_omission_misleading", "animal_generalization")}
_AUTO_PAIRS = f"pairs{{k}} AS (SELECT CAST(auto_title_strength AS VARCHAR) AS a_title_strength, CAST(auto_lead_strength AS VARCHAR) AS a_lead_strength, {_DIRECTION.format(c='auto_direction')} AS a_direction, CAST(auto_advice AS VARCHAR) AS a_advice, CASE auto_caveat WHEN 1 THEN 'Y' ELSE 'N' END AS a_caveat_in_body, s.* FROM feats f JOIN sheet{{k}} s USING (article_id))"
_AGREEMENT = f"{FEATURES}, feats AS MATERIALIZED (SELECT article_id, auto_title_strength, auto_lead_strength, auto_direction, auto_advice, auto_caveat FROM features), {_sheet(1)}, {_sheet(2)}, {_BOTH}, {_AUTO_PAIRS.format(k=1)}, {_AUTO_PAIRS.format(k=2)}"
_AUTO_ROWS = lambda k: [f"SELECT 'auto vs coder{k}' AS comparison, '{f}' AS field, * FROM {kappa_sql(f'pairs{k}', 'a_' + f, f, o)}" for f, (_, o) in agreement.AUTOMATIC.items()]


@query(f"WITH {_AGREEMENT} " + " UNION ALL ".join([f"SELECT 'coder1 vs coder2' AS comparison, '{f}' AS field, * FROM {kappa_sql('both_', f + '_1', f + '_2', o)}" for f, o in _PRESENT.items()] + _AUTO_ROWS(1) + _AUTO_ROWS(2)))
def run_agreement(spark, sf):
    sheets = {"coder1": sheet(spark, sf, 1), "coder2": sheet(spark, sf, 2)}
    return agreement.run_agreement(sheets, feature_rows(spark, sf))[0]


@query(f"WITH {_AGREEMENT} " + " UNION ALL ".join(x.replace("'auto vs coder1' AS comparison, ", "") for x in _AUTO_ROWS(1)))
def auto_vs_human(spark, sf):
    return agreement.auto_vs_human(feature_rows(spark, sf), sheet(spark, sf, 1))


_OLD_RESOLVED = "old AS (SELECT doc_id AS article_id, 'title_strength' AS field, CAST(doc_id % 7 AS VARCHAR) AS resolved, 'talked' AS resolution_notes FROM labels WHERE doc_id % 3 = 0)"


@query(f"""WITH {_sheet(1)}, {_sheet(2)}, {_OLD_RESOLVED}, l AS ({' UNION ALL '.join(f"SELECT article_id, '{f}' AS field, a.{f} AS v1, b.{f} AS v2 FROM sheet1 a JOIN sheet2 b USING (article_id)" for f in _PRESENT)}),
  d AS (SELECT * FROM l WHERE trim(v1) <> '' AND trim(v2) <> '' AND upper(trim(v1)) <> upper(trim(v2)))
  SELECT coalesce(d.article_id, old.article_id) AS article_id, coalesce(d.field, old.field) AS field, coalesce(v1, '') AS value_c1, coalesce(v2, '') AS value_c2, coalesce(resolved, '') AS resolved, coalesce(resolution_notes, '') AS resolution_notes, CASE WHEN d.article_id IS NULL THEN 'Y' ELSE '' END AS _stale FROM d FULL JOIN old ON d.article_id = old.article_id AND d.field = old.field""")
def disagreement_sheet(spark, sf):
    k = F.col("doc_id")
    old = table(spark, sf, "labels").filter(k % 3 == 0).select(k.alias("article_id"), F.lit("title_strength").alias("field"), (k % 7).cast("string").alias("resolved"), F.lit("talked").alias("resolution_notes"))
    return agreement.run_agreement({"coder1": sheet(spark, sf, 1), "coder2": sheet(spark, sf, 2)}, None, old)[1]


@query(f"WITH {_sheet(1)}, f AS ({' UNION ALL '.join(f'SELECT article_id, {quoted(n)} AS field, {n} AS value FROM sheet1' for n in ('title_strength', 'lead_strength', 'direction', 'advice', 'caveat_in_body', 'source_error'))}) SELECT * FROM f WHERE trim(value) <> '' AND NOT (CASE field WHEN 'direction' THEN list_contains(['INC', 'DEC', 'NULL', 'UNCLEAR'], upper(value)) WHEN 'advice' THEN list_contains(['0', '1', '2', '3'], value) WHEN 'caveat_in_body' THEN list_contains(['Y', 'N'], upper(value)) WHEN 'source_error' THEN list_contains(['Y', 'N'], upper(value)) ELSE list_contains(['0', '1', '2', '3', '4', '5', '6'], value) END)")
def invalid_codes(spark, sf):
    from skein.operators import papers

    return papers.invalid_codes(sheet(spark, sf, 1), "article_id")


@query(f"WITH {_sheet(1)} SELECT CAST(count_if(trim(title_strength) <> '') AS BIGINT) AS done, count(*) AS total FROM sheet1")
def coding_progress(spark, sf):
    from skein.operators import papers

    return papers.coding_progress(sheet(spark, sf, 1))


# ---- feasibility
@query(f"""WITH {_ONCE}, feats AS MATERIALIZED (SELECT article_id, auto_title_strength, auto_lead_strength, auto_direction, auto_advice, auto_caveat FROM dataset), {_sheet(1)}, {_AUTO_PAIRS.format(k=1)},
  {RETAINED.removeprefix(DATASET + ', ')}, {REACT}, k AS MATERIALIZED ({' UNION ALL '.join(x.replace("'auto vs coder1' AS comparison, ", '') for x in _AUTO_ROWS(1))}), per AS (SELECT b.bundle_id, count(article_id) AS n, stddev_pop(CASE WHEN delta_title IS NOT NULL THEN title_strength END) AS sd FROM bundles b LEFT JOIN dataset d ON b.bundle_id = d.bundle_id GROUP BY b.bundle_id),
  v AS (SELECT 'bundles_with_3_articles' AS item, (SELECT avg(CAST(n >= 3 AS INT)) FROM per) AS v, 0.7 AS least UNION ALL SELECT 'share_delta_nonzero', (SELECT avg(CAST(delta_title <> 0 AS INT)) FROM dataset), 0.3 UNION ALL
    SELECT 'mean_within_bundle_sd', (SELECT avg(sd) FROM per), 0.5 UNION ALL SELECT 'share_title_stronger', (SELECT avg(CAST(delta_title > 0 AS INT)) FROM dataset), NULL UNION ALL
    SELECT 'candidate_precision', (SELECT avg(quality) FROM labels), NULL UNION ALL SELECT 'candidate_background', (SELECT avg(toxic) FROM labels), NULL UNION ALL SELECT 'candidate_unrelated', 0, NULL UNION ALL
    SELECT 'share_condition_dropped', (SELECT avg(dropped_in_title_kept_in_body) FROM retention), NULL UNION ALL SELECT 'auto_title_weighted_kappa', (SELECT weighted_kappa FROM k WHERE field = 'title_strength'), 0.6 UNION ALL
    SELECT 'share_with_5_comments', (SELECT count(*) FROM (SELECT article_id FROM r GROUP BY article_id HAVING count(*) >= 5)) / (SELECT CAST(count(*) AS DOUBLE) FROM dataset), 0.5)
  SELECT item, round(CAST(v AS DOUBLE), 6) AS value, v >= least AS ok FROM v WHERE v IS NOT NULL UNION ALL SELECT 'weak_fields', count(*), false FROM k WHERE kappa < 0.4 HAVING count(*) > 0""")
def feasibility_checks(spark, sf):
    d = coded(spark, sf)
    judged = table(spark, sf, "labels").select(F.when(F.col("quality") == 1, "Y").otherwise("N").alias("include"), F.when(F.col("toxic") == 1, "background").otherwise("").alias("link_type"))
    return feasibility.feasibility(d, bundles(spark, sf), judged, retained(spark, sf), agreement.auto_vs_human(feature_rows(spark, sf), sheet(spark, sf, 1)), per_article(spark, sf))
