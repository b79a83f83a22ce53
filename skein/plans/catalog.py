"""The queries of the engine's operators and their SQL, by name; plans/study.py has those of the dataset, plans/collection.py
those of sources and sheets. Coders are the two label columns, calls are events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import entities, text
from skein.functions.claims import ClaimCoder, advice_level, condition_map
from skein.functions.lexicon import ENGLISH, Lexicon
from skein.operators import agreement, mining, tables
from skein.plans import collection, study  # noqa: F401  (their queries register themselves)
from skein.plans.registry import ORACLE_SQL, QUERIES, query, quoted, table
from skein.plans.study import ARTICLES, DATASET, articles, coded, kappa_sql
from skein.sources import readers

__all__ = ["ORACLE_SQL", "QUERIES"]

#: A lexicon over the words of the test tables.
LEXICON = Lexicon({
    "causal": ["tionan"], "correlational": ["ingth"], "negation": ["of"], "may": ["and"], "can": ["the"], "up": ["on the"], "down": ["in the"],
    "strong": ["ing", "ment", "ung"], "weak": ["an", "en"],
    "conditions": {"dose": ["that"], "group": ["with", "mit der"], "design": ["for", "por"], "time": ["from"]},
    "advice": {"3": ["!!!", "with the"], "2": ["for the"], "1": ["by the"]},
    "reactions": {"fear": ["please", "help"], "doubt": ["not", "why"], "advice": ["how", "should"]},
})
DRUGS, OUTCOMES = ["that", "the"], ["and", "with"]


@query("SELECT doc_id, substr(sha1(source || '|' || lang || '|' || CAST(doc_id AS VARCHAR)), 1, 12) AS id FROM documents")
def stable_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.stable_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id"))


_KEYS = ["dose", "group", "design", "time"]
_COND = {"dose": "that", "group": "with|mit der", "design": "for|por", "time": "from"}
_SENTENCES = study.sentences_sql(f"string_split({study.normal('text')}, chr(10))")


@query(f"SELECT doc_id, {study.normal('text')} AS text FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("text"))


@query(f"SELECT doc_id, len(s) AS n, array_to_string(s, '~') AS sentences FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def sentence_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.split_sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s", "~").alias("sentences"))


@query(rf"""SELECT doc_id, len(s) AS n, array_to_string(s, '~') AS sentences FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace({study.normal('text')}, chr(10), ' '),
  '([.!?])\s+([A-Z(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)""")
def english_sentences(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", text.split_english_sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s", "~").alias("sentences"))


@query(f"""WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS x FROM documents) SELECT doc_id, count(*) AS n, CAST(count_if({study._noise('x')}) AS BIGINT) AS noise FROM s GROUP BY doc_id""")
def noise_lines(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.explode(text.split_sentences(F.col("text"))).alias("x"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(text.is_noise_sentence(F.col("x"))).alias("noise"))


#: Lines that look like credits, bylines, stamps and heads, made of the comments' turns.
_CREDITED = """SELECT conv_id, turn, CASE turn % 7 WHEN 0 THEN '(서울=통신) 김가나 기자 = ' || s WHEN 1 THEN '[자료] 이다라 특파원=' || s WHEN 2 THEN s || ' 최마바 인턴 기자 = ' || s WHEN 3 THEN '사진=' || left(s, 20) WHEN 4 THEN '등록 2026.09.07 15:00:00 ' || s WHEN 5 THEN left(s, 9) ELSE s END AS x FROM (SELECT conv_id, turn, split_part(text, chr(10), 1) AS s FROM conversations)"""


def _credited(spark, sf):
    s, k = text.first_line(F.col("text")), F.col("turn") % 7
    x = F.when(k == 0, F.concat(F.lit("(서울=통신) 김가나 기자 = "), s)).when(k == 1, F.concat(F.lit("[자료] 이다라 특파원="), s)).when(k == 2, F.concat(s, F.lit(" 최마바 인턴 기자 = "), s)).when(k == 3, F.concat(F.lit("사진="), F.substring(s, 1, 20))).when(k == 4, F.concat(F.lit("등록 2026.09.07 15:00:00 "), s)).when(k == 5, F.substring(s, 1, 9)).otherwise(s)
    return table(spark, sf, "conversations").select("conv_id", "turn", x.alias("x"))


@query(f"SELECT conv_id, turn, {study._stripped(f"regexp_replace({study._BYLINE}, {quoted(text.LEADING_BYLINE)}, '')")} AS x FROM ({_CREDITED})")
def leading_byline(spark, sf):
    return _credited(spark, sf).withColumn("x", text.strip_leading_byline(F.col("x")))


@query(f"SELECT conv_id, turn, {study._head('x')} AS head, {study._noise('x')} AS noise FROM (SELECT *, left(x, 14) AS title FROM ({_CREDITED}))")
def head_lines(spark, sf):
    c = _credited(spark, sf)
    return c.select("conv_id", "turn", text.is_head_line(F.col("x"), F.substring("x", 1, 14)).alias("head"), text.is_noise_sentence(F.col("x")).alias("noise"))


@query(f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\\n+'), x -> trim(regexp_replace(x, '\\s+', ' ', 'g'))),
  x -> x <> '' AND NOT (regexp_matches(x, {quoted(text.BOILERPLATE)}) AND length(x) < 120) AND NOT (regexp_matches(x, {quoted(text.CAPTION)}) AND length(x) < 60)), chr(10)) AS body FROM documents""")
def clean_body(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_body(F.col("text")).alias("body"))


@query("SELECT doc_id, regexp_matches(text, '(?i)(ing|ment|ung)') AS strong, regexp_matches(text, '(?i)(an|en)') AS weak FROM documents")
def lexicon_any(spark, sf):
    return table(spark, sf, "documents").select("doc_id", LEXICON.any_(F.col("text"), "strong").alias("strong"), LEXICON.any_(F.col("text"), "weak").alias("weak"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), 'that|mit der|with|for|por|from')) AS n FROM documents")
def lexicon_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", LEXICON.count(F.col("text"), "conditions").cast("long").alias("n"))


@query("SELECT doc_id, md5(regexp_replace(text, '(?i)that|the', '[D]', 'g')) AS masked FROM documents")
def mask_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.mask_terms(F.col("text"), DRUGS).cast("binary")).alias("masked"))


@query(f"WITH {study.BUNDLES} SELECT doc_id, md5(regexp_replace(text, drugs, '[D]', 'g')) AS masked FROM documents JOIN bundles ON source = bundle_id")
def mask_bundle_terms(spark, sf):
    b = study.bundles(spark, sf).select(F.col("bundle_id").alias("source"), text.terms_pattern(F.col("drug_terms")).alias("p"))
    return table(spark, sf, "documents").join(b, "source").select("doc_id", F.md5(text.mask_terms(F.col("text"), F.col("p")).cast("binary")).alias("masked"))


_CUES = "that|mit der|with|for|por|from"


@query(f"""WITH f AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{_CUES}') AS found, string_split_regex(lower(text), '{_CUES}') AS gaps FROM documents),
  p AS (SELECT doc_id, text, found, gaps, unnest(range(1, len(found) + 1)) AS i FROM f), q AS (SELECT doc_id, text, length(array_to_string(gaps[1:i], '')) + length(array_to_string(found[1:i - 1], '')) AS start, length(found[i]) AS len FROM p)
  SELECT doc_id, start, len, substr(text, start + 1, len) AS text FROM q""")
def cue_spans(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(LEXICON.spans(F.col("text"), "conditions")).alias("s"))
    return d.select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.len").cast("long").alias("len"), "s.text")


@query(f"WITH {study.BUNDLES}, d AS (SELECT doc_id, lower(regexp_replace(text, drugs, '[D]', 'g')) AS m FROM documents JOIN bundles ON source = bundle_id) SELECT doc_id, " + ", ".join(f"array_to_string(list_distinct(regexp_extract_all(m, '{'|'.join(e)}')), '; ') AS {k}" for k, e in (("design", ["for"]), ("dose", ["from"]))) + " FROM d")
def condition_cues(spark, sf):
    b = study.bundles(spark, sf).select(F.col("bundle_id").alias("source"), text.terms_pattern(F.col("drug_terms")).alias("p"))
    one = Lexicon({"conditions": {"design": ["for"], "dose": ["from"]}})
    d = table(spark, sf, "documents").join(b, "source").withColumn("m", F.lower(text.mask_terms(F.col("text"), F.col("p"))))
    return d.select("doc_id", *[F.array_join(F.array_distinct(one.texts(F.col("m"), "conditions", k)), "; ").alias(k) for k in ("design", "dose")])


_ALL_SENTENCES = f"{study.BUNDLES}, cutup AS (SELECT doc_id, drugs, outcomes, {_SENTENCES} AS s FROM documents JOIN bundles ON source = bundle_id), sent AS (SELECT doc_id AS article_id, '' AS part, i, s[i] AS x, drugs, outcomes, {{gated}} AS gated FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM cutup)), {study.CLAIMS}"
CODER = ClaimCoder(study.LEXICON)


def _sentence_rows(spark, sf):
    b = study.bundles(spark, sf).select(F.col("bundle_id").alias("source"), *[text.terms_pattern(F.col(f"{k}_terms")).alias(k) for k in ("drug", "outcome")])
    return table(spark, sf, "documents").join(b, "source").withColumn("s", text.split_sentences(F.col("text")))


def _strength(spark, sf, gated):
    c = _sentence_rows(spark, sf).select("doc_id", F.posexplode("s").alias("i", "x"), "drug", "outcome").select("doc_id", "i", CODER.code(F.col("x"), F.col("drug"), F.col("outcome"), gated).alias("c"))
    return c.filter("c.level > 0").select("doc_id", (F.col("i") + 1).cast("long").alias("i"), "c.level", "c.direction", "c.question")


@query(f"WITH {_ALL_SENTENCES.format(gated='false')} SELECT article_id AS doc_id, i, level, direction, contains(x, '?') AS question FROM claims WHERE level > 0")
def claim_strength(spark, sf):
    return _strength(spark, sf, False)


@query(f"WITH {_ALL_SENTENCES.format(gated='true')} SELECT article_id AS doc_id, i, level, direction, contains(x, '?') AS question FROM claims WHERE level > 0")
def claim_strength_gated(spark, sf):
    return _strength(spark, sf, True)


@query(f"""WITH {_ALL_SENTENCES.format(gated='true')} SELECT article_id AS doc_id, CAST(max(level) AS INT) AS level, arg_max(direction, level * 1000000 - i) AS direction, md5(arg_max(x, level * 1000000 - i)) AS sentence, bool_or(contains(x, '?')) AS question FROM claims GROUP BY article_id""")
def unit_strongest(spark, sf):
    d = _sentence_rows(spark, sf).select("doc_id", CODER.unit(F.col("s"), F.col("drug"), F.col("outcome")).alias("u"))
    return d.filter("u is not null").select("doc_id", "u.level", "u.direction", F.md5(F.col("u.sentence").cast("binary")).alias("sentence"), "u.question")


#: English claims over the benchmark's passages: a sentence is put in front of each.
_EN = [("The drug may cause harm.", 4, ""), ("It does not cause harm.", 1, "null"), ("Use was associated with higher rates.", 2, "increase"), ("It leads to lower rates.", 6, "decrease"), ("An increased risk was seen.", 3, "increase"), ("It could cause harm.", 5, ""), ("Nothing is claimed here.", 0, "")]
_EN_LEXICON = Lexicon(ENGLISH.sections | {"causal": ["cause", "leads to"]})


@query("SELECT item_id, level, direction, strongest FROM (SELECT item_id, CASE item_id % 7 " + " ".join(f"WHEN {k} THEN {lv}" for k, (_, lv, _) in enumerate(_EN)) + " END AS level, CASE item_id % 7 " + " ".join(f"WHEN {k} THEN '{d}'" for k, (_, _, d) in enumerate(_EN)) + " END AS direction, 2 AS closing FROM benchmark) b, (VALUES (0)) v(z), LATERAL (SELECT CASE WHEN level = 0 THEN 2 ELSE greatest(level, closing) END AS strongest) WHERE level > 0 UNION ALL SELECT item_id, 2, '', 2 FROM benchmark WHERE item_id % 7 = 6")
def conclusion_claims(spark, sf):
    k = F.col("item_id") % 7
    first = F.lit("")
    for n, (sentence, _, _) in enumerate(_EN):
        first = F.when(k == n, sentence).otherwise(first)
    said = F.concat(first, F.lit("\nIt was linked to something."))
    got = ClaimCoder(_EN_LEXICON, window=0, before=30).conclusion(text.split_english_sentences(said))
    return table(spark, sf, "benchmark").select("item_id", got.alias("c")).select("item_id", "c.main.level", "c.main.direction", F.col("c.strongest.level").alias("strongest"))


@query(f"""SELECT doc_id, {', '.join(f"regexp_matches(text, '(?i)({v})') AS {k}" for k, v in _COND.items())} FROM documents""")
def condition_flags(spark, sf):
    m = table(spark, sf, "documents").select("doc_id", condition_map(LEXICON, F.col("text")).alias("m"))
    return m.select("doc_id", *[F.element_at("m", F.lit(k)).alias(k) for k in _KEYS])


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(!!!|with the)') THEN 3 WHEN regexp_matches(text, '(?i)for the') THEN 2 WHEN regexp_matches(text, '(?i)by the') THEN 1 ELSE 0 END AS advice FROM documents""")
def advice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", advice_level(LEXICON, F.col("text")).alias("advice"))


@query(r"""WITH u AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS v FROM pages), p AS (SELECT page_id, regexp_extract(v, '^([^:]+)://', 1) AS scheme, lower(regexp_extract(v, '^[^:]+://([^/?]*)', 1)) AS host,
  regexp_replace(regexp_extract(v, '^[^:]+://[^/?]*([^?]*)', 1), '/+$', '') AS path, list_filter(string_split(regexp_extract(v, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|fbclid|from)=')) AS q FROM u)
  SELECT page_id, scheme || '://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM p""")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", entities.normalize_url(F.col("url")).alias("url"))


@query(r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?([^/?#]*)', 1)), '^www\.', '') AS host FROM pages),
  o(outlet, outlet_type, domain) AS (VALUES ('Dot Com', 'portal', 'com'), ('Examples', 'online', 'example.com'), ('Orgs', 'ngo', 'org')),
  m AS (SELECT page_id, host, outlet, outlet_type, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC NULLS LAST) AS r FROM h LEFT JOIN o ON host = domain OR ends_with(host, '.' || domain))
  SELECT page_id, coalesce(outlet, host) AS outlet, coalesce(outlet_type, 'unknown') AS outlet_type FROM m WHERE r = 1""")
def host_outlet_resolve(spark, sf):
    outlets = spark.createDataFrame([("Dot Com", "portal", "com"), ("Examples", "online", "example.com"), ("Orgs", "ngo", "org")], "outlet string, outlet_type string, domain string")
    return entities.resolve_outlets(table(spark, sf, "pages"), outlets).select("page_id", "outlet", "outlet_type")


_UNESCAPE = "html"
for _ in range(2):
    for _entity, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        _UNESCAPE = f"replace({_UNESCAPE}, '{_entity}', '{_sign}')"


@query(f"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(html, '<[^>]+>', ' ', 'g') AS html FROM pages)
  SELECT page_id, title, trim(regexp_replace({_UNESCAPE}, '\\s+', ' ', 'g')) AS text FROM p""")
def html_title_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), entities.strip_tags(F.col("html")).alias("text"))


@query()
def html_articles(spark, sf):
    p = table(spark, sf, "pages").select("page_id", readers.parse_html("html").alias("a"))
    return p.select("page_id", "a.title", "a.body", F.when(F.length("a.body") >= 200, "ok").otherwise("short_body").alias("status"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS used,
  row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= 100 AS allowed FROM events""")
def daily_budget(spark, sf):
    return tables.daily_budget(table(spark, sf, "events"), "ts", "event_id", 100).select("event_id", "day", "used", "allowed")


@query("""SELECT q.query, s.start, least(100, 250 - s.start + 1) AS display FROM (SELECT DISTINCT source || ' ' || t AS query FROM documents, (VALUES ('side effect'), ('risk')) v(t)) q, (SELECT unnest([1, 101, 201]) AS start) s""")
def page_plan(spark, sf):
    aliases = table(spark, sf, "documents").select(F.col("source").alias("alias")).distinct()
    templates = spark.createDataFrame([("{alias} side effect",), ("{alias} risk",)], "template string")
    return readers.page_plan(readers.discovery_queries(aliases, templates).select("query"), 250).select("query", "start", "display")


@query("""WITH o AS (SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS auto, c_mktsegment AS human FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, CAST(c_nationkey + 1 AS VARCHAR) AS auto FROM customer WHERE c_custkey % 4 <> 0)
  SELECT coalesce(n.id, o.id) AS id, coalesce(n.auto, o.auto) AS auto, coalesce(o.human, '') AS human, CASE WHEN n.id IS NULL THEN 'Y' ELSE '' END AS _stale FROM n FULL JOIN o ON n.id = o.id""")
def merge_preserving(spark, sf):
    c = table(spark, sf, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("auto"), F.col("c_mktsegment").alias("human"))
    new = c.filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 1).cast("string").alias("auto"))
    return tables.merge_preserving(new, old, ["id"], ["human"])


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 5 = 0""")
def upsert_partial(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return tables.upsert(o, o.filter("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("new")), ["o_orderkey"])


@query(f"""WITH {ARTICLES} SELECT article_id FROM articles WHERE body <> '' AND article_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND article_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def usable_semi_anti(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "article_id")
    return tables.usable(articles(spark, sf).withColumn("status", F.lit("ok")), labels.filter("quality = 0"), labels.filter("toxic = 1")).select("article_id")


@query(f"""WITH {ARTICLES} SELECT article_id, CASE WHEN article_id % 7 = 0 THEN 'manual_needed' WHEN length(body) < 400 THEN 'check_short' ELSE 'ok' END AS flag, length(body) AS body_len,
  substr(body, 1, 150) AS head, right(body, 120) AS tail FROM articles""")
def text_check_flags(spark, sf):
    a = articles(spark, sf).withColumn("status", F.when(F.col("article_id") % 7 == 0, "http_error:500").otherwise("ok"))
    return tables.text_check(a).withColumn("body_len", F.col("body_len").cast("long"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY md5('42|' || doc_id), doc_id) AS turn FROM documents),
  p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, md5('42|' || lang), md5('42|' || doc_id), doc_id) AS place FROM t)
  SELECT doc_id, CASE WHEN place <= 5 THEN 'Y' ELSE 'N' END AS selected FROM p""")
def stratified_select(spark, sf):
    return tables.stratified(table(spark, sf, "documents").select("doc_id", "source", "lang"), "source", "lang", "doc_id", 5).select("doc_id", "selected")


@query(f"SELECT n, agree_pct, kappa FROM {kappa_sql('labels', 'CAST(quality AS VARCHAR)', 'CAST(toxic AS VARCHAR)', False)}")
def kappa(spark, sf):
    return agreement.kappa(table(spark, sf, "labels"), "quality", "toxic")


@query(f"SELECT n, agree_pct, weighted_kappa AS kappa FROM {kappa_sql('labels', 'CAST(quality AS VARCHAR)', 'CAST(toxic AS VARCHAR)', True)}")
def weighted_kappa(spark, sf):
    return agreement.kappa(table(spark, sf, "labels"), "quality", "toxic", weighted=True)


_SHEETS = """a AS (SELECT doc_id, CAST(quality AS VARCHAR) AS f1, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'y' END AS f2 FROM labels), b AS (SELECT doc_id, CAST(toxic AS VARCHAR) AS f1, CASE WHEN doc_id % 7 = 0 THEN 'NA' WHEN doc_id % 3 = 0 THEN '' ELSE 'Y' END AS f2 FROM labels)"""


def _sheets(spark, sf):
    l = table(spark, sf, "labels")
    one = l.select("doc_id", F.col("quality").cast("string").alias("f1"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("y").alias("f2"))
    two = l.select("doc_id", F.col("toxic").cast("string").alias("f1"), F.when(F.col("doc_id") % 7 == 0, "NA").when(F.col("doc_id") % 3 == 0, "").otherwise("Y").alias("f2"))
    return one, two


@query(f"""WITH {_SHEETS} SELECT a.doc_id, 'f1' AS field, a.f1 AS value_c1, b.f1 AS value_c2 FROM a JOIN b USING (doc_id) WHERE a.f1 <> b.f1
  UNION ALL SELECT a.doc_id, 'f2', a.f2, b.f2 FROM a JOIN b USING (doc_id) WHERE a.f2 <> '' AND b.f2 <> '' AND upper(a.f2) <> upper(b.f2)""")
def disagreements(spark, sf):
    return agreement.disagreements(*_sheets(spark, sf), "doc_id", ["f1", "f2"])


@query(f"""WITH {_SHEETS}, l AS (SELECT a.doc_id, unnest(['f1', 'f2']) AS field, unnest([a.f1, a.f2]) AS v1, unnest([b.f1, b.f2]) AS v2, unnest([CASE WHEN a.doc_id % 11 = 0 THEN '9' END, NULL]) AS res FROM a JOIN b USING (doc_id)),
  s AS (SELECT *, CASE WHEN res IS NOT NULL THEN 'adjudicated' WHEN v1 <> '' AND v2 <> '' AND upper(v1) = upper(v2) THEN 'agreed' WHEN v1 <> '' AND v2 <> '' THEN 'UNRESOLVED' WHEN v1 <> '' OR v2 <> '' THEN 'single_coded' END AS status FROM l),
  f AS (SELECT *, CASE WHEN res IS NOT NULL THEN res WHEN status = 'UNRESOLVED' THEN '' WHEN v1 <> '' THEN v1 ELSE v2 END AS v FROM s)
  SELECT doc_id, max(CASE WHEN field = 'f1' THEN v END) AS f1, max(CASE WHEN field = 'f2' THEN v END) AS f2, coalesce(array_to_string(list_sort(list(DISTINCT status) FILTER (status IS NOT NULL)), ','), '') AS final_status FROM f GROUP BY doc_id""")
def finalize_codes(spark, sf):
    one, two = _sheets(spark, sf)
    resolved = one.filter("doc_id % 11 = 0").select("doc_id", F.lit("f1").alias("field"), F.lit("9").alias("resolved"))
    return agreement.finalize([one, two], resolved, "doc_id", ["f1", "f2"])


_TOKENS = """list_filter(list_transform(regexp_extract_all({c}, '[가-힣]+|[A-Za-z][A-Za-z0-9-]+|[0-9]+(?:[.][0-9]+)?'), lambda x: lower(x)), lambda x: length(x) > 1 OR NOT regexp_matches(x, '^[a-z0-9]$'))"""


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS.format(c='text')}) AS token FROM documents) GROUP BY token")
def tokens(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df"))


_ODDS = """c AS (SELECT token, CAST(count_if(side = 'A') AS DOUBLE) AS a, CAST(count_if(side = 'B') AS DOUBLE) AS b FROM t GROUP BY token), n AS (SELECT sum(a) AS na, sum(b) AS nb FROM c),
  z AS (SELECT token, (ln((a + 0.1 * (a + b)) / (na + 0.1 * (na + nb) - a - 0.1 * (a + b))) - ln((b + 0.1 * (a + b)) / (nb + 0.1 * (na + nb) - b - 0.1 * (a + b)))) / sqrt(1 / (a + 0.1 * (a + b)) + 1 / (b + 0.1 * (a + b))) AS z FROM c, n WHERE a + b >= {least})
  SELECT token, side, round(z, 2) AS z FROM (SELECT *, 'A' AS side FROM (SELECT * FROM z ORDER BY z DESC, token LIMIT 15) UNION ALL SELECT *, 'B' FROM (SELECT * FROM z ORDER BY z, token LIMIT 15))"""


@query(f"WITH {ARTICLES}, t AS (SELECT unnest({_TOKENS.format(c='title')}) AS token, 'A' AS side FROM articles UNION ALL SELECT unnest({_TOKENS.format(c='body')}), 'B' FROM articles), {_ODDS.format(least=3)}")
def log_odds(spark, sf):
    a = articles(spark, sf)
    marked = lambda c, side: F.transform(text.tokens(F.col(c)), lambda x: F.struct(x.alias("token"), F.lit(side).alias("side")))
    t = a.select(F.explode(F.concat(marked("title", "A"), marked("body", "B"))).alias("t")).select("t.*")
    return mining.log_odds(t, "side")


@query(f"WITH {DATASET}, t AS (SELECT unnest({_TOKENS.format(c='title')}) AS token, CASE WHEN exceeds_title = 1 THEN 'A' ELSE 'B' END AS side FROM dataset WHERE exceeds_title IS NOT NULL), {_ODDS.format(least=2)}")
def log_odds_exceeds(spark, sf):
    d = coded(spark, sf).filter("exceeds_title is not null")
    t = d.select(F.explode(text.tokens_of(F.col("title"))).alias("token"), F.when(F.col("exceeds_title") == 1, "A").otherwise("B").alias("side"))
    return mining.log_odds(t, "side", min_count=2)


_TITLE_LEAD = "title || ' ' || lead"


def _title_lead(spark, sf):
    return coded(spark, sf).withColumn("tokens", text.tokens_of(F.concat_ws(" ", "title", "lead")))  # both are normalised


@query(f"""WITH {DATASET}, tf AS (SELECT article_id, outlet_type, token, count(*) AS tf FROM (SELECT article_id, outlet_type, unnest({_TOKENS.format(c=_TITLE_LEAD)}) AS token FROM dataset) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token HAVING count(*) >= 2),
  sizes AS (SELECT lang AS outlet_type, count(*) AS size FROM documents WHERE source IN (SELECT 'src' || n_nationkey FROM nation) GROUP BY lang), w AS (SELECT article_id, outlet_type, token, tf * (ln((1 + (SELECT sum(size) FROM sizes)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (token)), nm AS (SELECT article_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY article_id),
  m AS (SELECT outlet_type, token, round(sum(w / norm) / any_value(size), 6) AS weight FROM w JOIN nm USING (article_id) JOIN sizes USING (outlet_type) GROUP BY outlet_type, token)
  SELECT outlet_type, token, weight FROM m WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY outlet_type ORDER BY weight DESC, token) <= 10""")
def tfidf_group(spark, sf):
    return mining.tfidf_by_group(_title_lead(spark, sf).select("article_id", "outlet_type", "tokens"), "article_id", "outlet_type", "tokens")


@query(f"""WITH {study.BUNDLES}, s AS (SELECT drugs, unnest({_SENTENCES}) AS x FROM documents JOIN bundles ON source = bundle_id), t AS (SELECT regexp_matches(x, drugs) AS drug, list_filter(list_distinct({_TOKENS.format(c="regexp_replace(x, drugs, ' ', 'g')")}), w -> NOT regexp_matches(w, '^(' || drugs[5:] || ')$')) AS w FROM s), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count_if(drug) AS DOUBLE) AS nd FROM t),
  c AS (SELECT token, count(*) AS ct, count_if(drug) AS c FROM (SELECT drug, unnest(w) AS token FROM t) GROUP BY token) SELECT token, CAST(c AS BIGINT) AS n_both, round(log2((c / n) / (ct / n * nd / n)), 3) AS pmi FROM c, n WHERE c >= 3 ORDER BY round(log2((c / n) / (ct / n * nd / n)), 3) DESC, c DESC, token LIMIT 25""")
def pmi(spark, sf):
    b = study.bundles(spark, sf).select(F.col("bundle_id").alias("source"), text.terms_pattern(F.col("drug_terms")).alias("p"), F.transform("drug_terms", F.lower).alias("terms"))
    s = table(spark, sf, "documents").join(b, "source").select(F.explode(text.split_sentences(F.col("text"))).alias("x"), "p", "terms")
    words = F.array_except(text.tokens_of(F.regexp_replace("x", F.col("p"), F.lit(" "))), F.col("terms"))
    return mining.pmi(s.select(words.alias("w"), F.rlike("x", F.col("p")).alias("drug")), "w", "drug")


@query()
def lda_topics(spark, sf):
    """Topics of the documents; random starts are the library's own, so SQL has none."""
    d = table(spark, sf, "documents").select("text", text.tokens(F.col("text")).alias("tokens"))
    return mining.lda_topics(d, "tokens", "text").select("topic", "share", "terms", "example")


_FOLDS = """sized AS (SELECT bundle_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, bundle_id) AS k FROM nb GROUP BY bundle_id), shares AS (SELECT least(5, count(*)) AS f FROM sized),
  dealt AS (SELECT CAST(0 AS BIGINT) AS k, CAST('' AS VARCHAR) AS bundle_id, CAST(-1 AS BIGINT) AS fold, (SELECT list_transform(range(f), x -> CAST(0 AS BIGINT)) FROM shares) AS loads UNION ALL
    SELECT s.k, s.bundle_id, CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT), list_transform(range(1, len(loads) + 1), i -> loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN s.n ELSE 0 END) FROM dealt d JOIN sized s ON s.k = d.k + 1)"""
_BAYES = f"""WITH RECURSIVE {DATASET}, nb AS MATERIALIZED (SELECT article_id, bundle_id, CAST(exceeds_title AS INT) AS y, {_TOKENS.format(c=_TITLE_LEAD)} AS tokens FROM dataset WHERE exceeds_title IS NOT NULL), {_FOLDS},
  docs AS MATERIALIZED (SELECT nb.*, fold FROM nb JOIN dealt USING (bundle_id)), held AS (SELECT DISTINCT fold AS held FROM docs), train AS (SELECT held, count(*) AS n, sum(y) AS n1 FROM held JOIN docs ON fold <> held GROUP BY held),
  tf AS MATERIALIZED (SELECT article_id, fold, y, token, count(*) AS tf FROM (SELECT article_id, fold, y, unnest(tokens) AS token FROM docs) GROUP BY ALL), df AS (SELECT held, token, count(*) AS df FROM held JOIN tf ON fold <> held GROUP BY ALL),
  w AS MATERIALIZED (SELECT df.held, article_id, fold, y, token, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (token) JOIN train ON train.held = df.held), unit AS MATERIALIZED (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY held, article_id)) AS u FROM w),
  learned AS (SELECT held, token, sum(CASE WHEN y = 1 THEN u ELSE 0 END) AS s1, sum(CASE WHEN y = 0 THEN u ELSE 0 END) AS s0 FROM unit WHERE fold <> held GROUP BY ALL), whole AS (SELECT held, sum(s1) AS t1, sum(s0) AS t0, count(*) AS v FROM learned GROUP BY held),
  lifts AS (SELECT l.held, token, ln((s1 + 1) / (t1 + v)) - ln((s0 + 1) / (t0 + v)) AS lift FROM learned l JOIN whole USING (held)), scores AS (SELECT article_id, sum(u * lift) AS lift FROM unit JOIN lifts ON unit.held = lifts.held AND unit.token = lifts.token WHERE fold = unit.held GROUP BY article_id),
  predictions AS (SELECT d.article_id, CAST(fold AS INT) AS fold, y AS actual, CASE WHEN n1 = 0 THEN 0 WHEN n1 = n THEN 1 ELSE CAST(ln(n1 / (n - n1)) + coalesce(lift, 0) > 0 AS INT) END AS predicted FROM docs d JOIN train ON held = fold LEFT JOIN scores USING (article_id))"""


def _bayes(spark, sf):
    return mining.nb_group_cv(_title_lead(spark, sf), "article_id", "bundle_id", "tokens", "exceeds_title")


@query(f"{_BAYES} SELECT * FROM predictions")
def nb_predictions(spark, sf):
    return _bayes(spark, sf)


@query(f"""{_BAYES}, c AS (SELECT CAST(count_if(actual = 0 AND predicted = 0) AS DOUBLE) AS c00, CAST(count_if(actual = 0 AND predicted = 1) AS DOUBLE) AS c01, CAST(count_if(actual = 1 AND predicted = 0) AS DOUBLE) AS c10, CAST(count_if(actual = 1 AND predicted = 1) AS DOUBLE) AS c11 FROM predictions)
  SELECT 'naive_bayes' AS model, round((c00 + c11) / (c00 + c01 + c10 + c11), 3) AS accuracy, round((2 * c00 / (2 * c00 + c01 + c10) + 2 * c11 / (2 * c11 + c01 + c10)) / 2, 3) AS macro_f1 FROM c UNION ALL
  SELECT 'majority', round(greatest(c00 + c01, c10 + c11) / (c00 + c01 + c10 + c11), 3), round(2 * greatest(c00 + c01, c10 + c11) / (2 * greatest(c00 + c01, c10 + c11) + least(c00 + c01, c10 + c11)) / 2, 3) FROM c""")
def nb_group_cv(spark, sf):
    return mining.classification_table(_bayes(spark, sf))


@query("""SELECT source AS bundle_id, count(*) AS articles, CAST(count_if(length(text) >= 200) AS BIGINT) AS bodies, CASE WHEN count_if(length(text) >= 200) >= 3 THEN 'OK' ELSE 'few' END AS state FROM documents GROUP BY source""")
def status_table(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("source", "bundle_id")
    return tables.status_table(d.select("bundle_id").distinct(), {"articles": d, "bodies": d.filter(F.length("text") >= 200)}, "bodies").select("bundle_id", "articles", "bodies", "state")


_PAGE_URL = r"""(SELECT page_id, scheme || '://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS norm_url, host AS outlet, html FROM (SELECT page_id, html, regexp_extract(v, '^([^:]+)://', 1) AS scheme, lower(regexp_extract(v, '^[^:]+://([^/?]*)', 1)) AS host,
  regexp_replace(regexp_extract(v, '^[^:]+://[^/?]*([^?]*)', 1), '/+$', '') AS path, list_filter(string_split(regexp_extract(v, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|fbclid|from)=')) AS q FROM (SELECT page_id, html, regexp_replace(url, '#.*$', '') AS v FROM pages)))"""


@query(rf"""WITH RECURSIVE base AS MATERIALIZED (SELECT page_id, CAST(page_id % 5 AS VARCHAR) AS bundle_id, norm_url, regexp_replace(outlet, '^www\.', '') AS outlet, left(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^\p{{L}}\p{{M}}\p{{N}}_]', '', 'g'), 2) AS bare_title, 'q' || (page_id % 3) AS query, row_number() OVER (ORDER BY page_id) AS k FROM {_PAGE_URL}),
  keyed AS MATERIALIZED (SELECT *, 'u|' || bundle_id || '|' || norm_url AS u, 't|' || bundle_id || '|' || outlet || '|' || bare_title AS t FROM base),
  walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS page_id, CAST(NULL AS BIGINT) AS into_, CAST([] AS VARCHAR[]) AS keys, CAST([] AS BIGINT[]) AS owners UNION ALL
    SELECT n.k, n.page_id, coalesce(owners[list_position(keys, u)], owners[list_position(keys, t)]), CASE WHEN coalesce(owners[list_position(keys, u)], owners[list_position(keys, t)]) IS NULL THEN list_concat(keys, [u, t]) ELSE keys END,
      CASE WHEN coalesce(owners[list_position(keys, u)], owners[list_position(keys, t)]) IS NULL THEN list_concat(owners, [n.page_id, n.page_id]) ELSE owners END FROM walk w JOIN keyed n ON n.k = w.k + 1),
  given AS (SELECT into_, list(b.query ORDER BY w.k) AS more FROM walk w JOIN base b USING (page_id) WHERE into_ IS NOT NULL GROUP BY into_)
  SELECT b.page_id, b.bundle_id, norm_url, outlet, bare_title, list_reduce(list_concat([b.query], coalesce(more, [])), lambda a, q: CASE WHEN contains(a, q) THEN a ELSE a || ' | ' || q END) AS query FROM base b JOIN walk w USING (page_id) LEFT JOIN given ON b.page_id = given.into_ WHERE w.into_ IS NULL""")
def candidate_dedupe(spark, sf):
    title = F.substring(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"(?U)\W", ""), 1, 2)
    p = table(spark, sf, "pages").select("page_id", F.pmod("page_id", F.lit(5)).cast("string").alias("bundle_id"), entities.normalize_url(F.col("url")).alias("norm_url"), entities.host_of(F.col("url")).alias("outlet"), title.alias("bare_title"), F.concat(F.lit("q"), (F.col("page_id") % 3).cast("string")).alias("query"))
    return tables.dedupe(p, "page_id")


_FOUND = ["and", "with", "for"]


@query("""WITH m AS (SELECT doc_id, source AS drug, lang AS outlet, split_part(text, chr(10), 1) AS title, 'https://' || lang || '.example/' || (doc_id % 211) AS url, CASE WHEN doc_id % 9 = 0 THEN '' ELSE strftime(DATE '2024-01-05' + CAST(doc_id % 40 AS INT), '%Y-%m') END AS month, list_filter(['and', 'with', 'for'], t -> contains(lower(text), t))[1:2] AS o, list_filter(['the', 'from', 'that'], t -> contains(lower(text), t))[1:2] AS j FROM documents),
  e AS (SELECT doc_id, drug, outlet, title, url, month, outcome, unnest(j) AS journal FROM (SELECT * EXCLUDE (o), unnest(o) AS outcome FROM m)),
  f AS (SELECT *, row_number() OVER (PARTITION BY drug, outcome, journal, month, url ORDER BY doc_id) AS r FROM e), g AS (SELECT *, row_number() OVER (PARTITION BY drug, outcome, journal, month ORDER BY doc_id) AS k FROM f WHERE r = 1)
  SELECT drug, outcome, journal, month, count(*) AS n_articles, count(DISTINCT outlet) AS n_outlets, array_to_string(list('[' || outlet || '] ' || title ORDER BY k) FILTER (k <= 4), ' || ') AS example_titles, array_to_string(list(url ORDER BY k) FILTER (k <= 4), ' ') AS example_urls FROM g GROUP BY ALL""")
def discover_groups(spark, sf):
    first2 = lambda terms: F.slice(text.contains_any(F.col("text"), terms), 1, 2)
    day = F.date_add(F.lit("2024-01-05").cast("date"), (F.col("doc_id") % 40).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("drug"), F.col("lang").alias("outlet"), text.first_line(F.col("text")).alias("title"), F.concat(F.lit("https://"), "lang", F.lit(".example/"), (F.col("doc_id") % 211).cast("string")).alias("url"), F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.date_format(day, "yyyy-MM")).alias("month"), first2(_FOUND).alias("outcomes"), first2(["the", "from", "that"]).alias("journals"))
    return tables.discover(d, "doc_id")


@query("""SELECT doc_id, strftime(CAST('2024-01-05' AS DATE) + CAST(doc_id % 400 AS INT), '%Y-%m') AS month, doc_id % 400 AS days FROM documents""")
def month_buckets(spark, sf):
    first = F.lit("2024-01-05")
    stamp = F.date_format(F.date_add(first.cast("date"), (F.col("doc_id") % 400).cast("int")), "EEE, d MMM yyyy 10:20:30 +0900")
    d = table(spark, sf, "documents").select("doc_id", entities.parse_pubdate(stamp).alias("at"))
    day = entities.iso_date(F.col("at"))
    return d.select("doc_id", F.date_format(day, "yyyy-MM").alias("month"), F.datediff(day, first.cast("date")).cast("long").alias("days"))


@query("""WITH s AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT source, doc_id, n_chars FROM s WHERE r <= 3""")
def top_per_group(spark, sf):
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf, "documents").select("source", "doc_id", "n_chars", r.alias("r")).filter("r <= 3").drop("r")
