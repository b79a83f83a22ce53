"""Queries of sources, sinks, entities and candidate tables with their SQL: payloads are built from the test tables, stored in
the forms that the sources read, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import entities, text
from skein.functions.lexicon import Lexicon
from skein.operators import papers, tables
from skein.plans.registry import query, quoted, table
from skein.plans.session import shared_folder
from skein.plans.study import ARTICLES, BUNDLES, JOURNALS, articles, bundles
from skein.sources import policy, readers


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/skein-{name}-{uuid.uuid4().hex}"


# ---- files
@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus || ', \"x\"' || chr(10) || 'ü' END AS note, '' AS missing FROM orders")
def csv_roundtrip(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.concat("o_orderstatus", F.lit(', "x"\nü'))).alias("note"))
    path = _fresh(spark, "csv")
    readers.write_csv(o, path)
    return readers.read_csv(spark, path, ["o_orderkey", "note", "missing"])


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_roundtrip(spark, sf):
    path = _fresh(spark, "jsonl")
    readers.write_jsonl(table(spark, sf, "conversations"), path)
    return readers.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT 'n' || n_nationkey AS article_id, n_name AS title, 'Region ' || n_regionkey || ' of ' || n_name AS body FROM nation")
def manual_texts(spark, sf):
    """One file per nation: the title, a blank of several lines, a notice that goes, and the body."""
    path = _fresh(spark, "manual")
    rows = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.concat("n_name", F.lit("\n\n\nRegion  "), F.col("n_regionkey").cast("string"), F.lit(" of "), "n_name", F.lit("\nCopyright all of it\n")).alias("value"))
    rows.write.partitionBy("name").text(path)
    return readers.read_manual_texts(spark, f"{path}/*/*.txt", name=r"name=([^/]+)/")


_YAML = """
- {bundle_id: b1, label: One, drug_terms: [aspirin], outcome_terms: [falls, bleeding], paper: {doi: "10.1/1", journal: jama}, queries: [aspirin falls], date_from: 2024-01-01, date_to: 2024-02-01,
   known_articles: [{title_hint: Aspirin and falls, url: "https://news.a.kr/1?utm_source=x", outlet: Daily A, date: 2024-01-05}, {title_hint: JAMA on nothing, outlet: Nowhere}], notes: " kept "}
- {bundle_id: b-2, drug_terms: [x], outcome_terms: ["y.z"], paper: {title: A title}, queries: [x y, x z], date_from: 2024-03-01, date_to: 2024-03-01}
"""


@query("""SELECT * FROM (VALUES ('b1', 'One', 'aspirin', 'falls;bleeding', '10.1/1', 1, DATE '2024-01-01', DATE '2024-02-01', 2, 'kept'), ('b-2', 'b-2', 'x', 'y.z', NULL, 2, DATE '2024-03-01', DATE '2024-03-01', 0, '')) t(bundle_id, label, drugs, outcomes, doi, queries, date_from, date_to, known, notes)""")
def load_bundles(spark, sf):
    b = readers.load_bundles(spark, _YAML)
    return b.select("bundle_id", "label", F.array_join("drug_terms", ";").alias("drugs"), F.array_join("outcome_terms", ";").alias("outcomes"), F.element_at("paper", F.lit("doi")).alias("doi"), F.size("queries").alias("queries"), "date_from", "date_to", F.size("known_articles").alias("known"), "notes")


@query("SELECT 'b-2' AS bundle_id UNION ALL SELECT 'src' || n_nationkey FROM nation WHERE n_nationkey IN (3, 7)")
def select_bundles(spark, sf):
    one = readers.select_bundles(readers.load_bundles(spark, _YAML), ["b-2", "none"]).select("bundle_id")
    return one.unionByName(readers.select_bundles(bundles(spark, sf), ["src3", "src7"]).select("bundle_id"))


@query("SELECT * FROM (VALUES ('KEY', 'a=b'), ('OTHER', 'x y')) t(key, value)")
def dotenv(spark, sf):
    found = readers.parse_dotenv("# KEY=no\nKEY = 'a=b'\nKEY=later\nnothing\nOTHER=\"x y\"\n")
    return spark.createDataFrame(sorted(found.items()), "key string, value string")


_LEXICON_YAML = "conditions:\n  dose: [from, 're:w(?:ith|as)']\n  time: [for]\nadvice:\n  3: [the]\n"


@query("SELECT doc_id, len(regexp_extract_all(lower(text), 'from|with|was')) AS dose, regexp_matches(text, '(?i)for') AS time, regexp_matches(text, '(?i)the') AS advice FROM documents")
def lexicon_file(spark, sf):
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".yaml", encoding="utf-8") as f:  # read on the driver at once
        f.write(_LEXICON_YAML)
        f.flush()
        lex = Lexicon.load(f.name)
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", lex.count(t, "conditions", "dose").cast("long").alias("dose"), lex.any_(t, "conditions", "time").alias("time"), lex.any_(t, "advice", "3").alias("advice"))


# ---- network payloads
@query("SELECT n_name AS title, 'https://n/' || n_nationkey AS link, CAST(n_regionkey AS VARCHAR) AS pub_date FROM nation")
def search_pages(spark, sf):
    """A paged search over the nations' list, which is 25 rows whatever the scale, behind a client and a budget."""
    import json

    rows = [r.asDict() for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]

    def get(url, params, headers):
        some = rows[params["start"] - 1 : params["start"] - 1 + params["display"]]
        return 200, json.dumps({"result": {"total": len(rows), "items": [{"title": r["n_name"], "originallink": f"https://n/{r['n_nationkey']}", "pubDate": str(r["n_regionkey"])} for r in some]}})

    client = readers.SearchClient(get, {"one": ("https://api", "id", "secret")}, "one", "k", "s", readers.CallBudget(10))
    pages = [{"items": [item]} for item in readers.search_pages(client, "q", None, 300, 10)]
    spark.dataSource.register(readers.PagedSource)
    got = spark.read.format("skein_pages").option("pages", json.dumps(pages)).load()
    return got.select("title", "link", "pub_date")


@query("""SELECT s_suppkey, '10.5/s' || s_suppkey AS doi, s_name || ' study' AS cr_title, 'J ' || s_nationkey AS cr_journal, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS cr_first_author, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 2 END AS cr_n_authors,
  CASE s_suppkey % 4 WHEN 0 THEN '2024-01-0' || (1 + s_nationkey % 9) WHEN 1 THEN '2023-1' || (s_nationkey % 3) WHEN 2 THEN '2022' ELSE '' END AS cr_published FROM supplier""")
def crossref_records(spark, sf):
    s, k, n = table(spark, sf, "supplier"), F.col("s_suppkey"), F.col("s_nationkey").cast("int")
    online = F.when(k % 4 == 0, F.struct(F.array(F.array(F.lit(2024), F.lit(1), 1 + n % 9)).alias("date-parts")))
    printed = F.when(k % 4 <= 1, F.struct(F.array(F.array(F.lit(2023), 10 + n % 3)).alias("date-parts")))
    issued = F.when(k % 4 <= 2, F.struct(F.array(F.array(F.lit(2022))).alias("date-parts")))
    item = F.struct(F.concat(F.lit("10.5/S"), k.cast("string")).alias("DOI"), F.array("s_name", F.lit("study")).alias("title"), F.array(F.concat(F.lit("J "), n.cast("string"))).alias("container-title"), F.when(k % 3 != 0, F.array(F.struct(F.col("s_name").alias("family")), F.struct(F.lit("B").alias("family")))).alias("author"), online.alias("published-online"), printed.alias("published-print"), issued.alias("issued"))
    return s.select("s_suppkey", F.to_json(item).alias("j")).select("s_suppkey", papers.crossref_record(F.from_json("j", papers.CROSSREF)).alias("r")).select("s_suppkey", *[f"r.{c}" for c in ("doi", "cr_title", "cr_journal", "cr_first_author", "cr_n_authors", "cr_published")])


@query("SELECT s_suppkey, 'p' || s_suppkey AS pmid, s_name AS epmc_title, 'J' AS epmc_journal, 'Review; Trial' AS epmc_pub_types, '2024-02-03' AS epmc_first_pub_date FROM supplier WHERE s_suppkey % 5 <> 0")
def europe_pmc_records(spark, sf):
    k = F.col("s_suppkey")
    one = F.struct(F.concat(F.lit("p"), k.cast("string")).alias("pmid"), F.col("s_name").alias("title"), F.struct(F.struct(F.lit("J").alias("title")).alias("journal")).alias("journalInfo"), F.struct(F.array(F.lit("Review"), F.lit("Trial")).alias("pubType")).alias("pubTypeList"), F.lit("2024-02-03").alias("firstPublicationDate"))
    j = F.to_json(F.struct(F.struct(F.when(k % 5 != 0, F.array(one)).otherwise(F.array().cast(one_type := "array<struct<pmid:string,title:string,journalInfo:struct<journal:struct<title:string>>,pubTypeList:struct<pubType:array<string>>,firstPublicationDate:string>>")).cast(one_type).alias("result")).alias("resultList")))
    r = table(spark, sf, "supplier").select("s_suppkey", papers.europe_pmc_record(F.from_json(j, papers.EUROPE_PMC)).alias("r")).filter("r is not null")
    return r.select("s_suppkey", "r.pmid", "r.epmc_title", "r.epmc_journal", "r.epmc_pub_types", "r.epmc_first_pub_date")


_DESIGNS = Lexicon({"designs": {"meta": ["meta-analysis"], "rct": ["randomized"], "cohort": ["cohort"]}})
_ABSTRACTS = ["<jats:title>Methods</jats:title><jats:p>A cohort.</jats:p><jats:title>Conclusions</jats:title><jats:p>It causes x.</jats:p>", "<h4>Background</h4>B.<h4>Interpretation</h4>It may cause harm.", "OBJECTIVE: To see. CONCLUSIONS AND RELEVANCE: Linked to y.", "Emulated randomized cohort. Not associated. It was linked to z.", ""]
_CONCLUSIONS = [("It causes x.", "section:conclusions", "cohort", 6), ("It may cause harm.", "section:interpretation", "review", 4), ("Linked to y.", "section:conclusions and relevance", "unknown", 2), ("Not associated. It was linked to z.", "last_two_sentences", "cohort", 2), ("", "", "unknown", None)]


@query("SELECT 'src' || n_nationkey AS bundle_id, " + ", ".join(f"CASE n_nationkey % 5 {' '.join(f'WHEN {k} THEN ' + ('NULL' if c[i] is None else quoted(c[i]) if isinstance(c[i], str) else str(c[i])) for k, c in enumerate(_CONCLUSIONS))} END AS {name}" for i, name in enumerate(("conclusion_en", "conclusion_source", "design_auto", "strength_auto"))) + ", 'Study ' || n_name AS title, '10.1/' || n_nationkey AS doi, CASE WHEN n_nationkey % 2 = 0 THEN 'crossref_ok' ELSE 'crossref_not_found' END || ', ' || CASE WHEN n_nationkey % 5 < 4 THEN 'europepmc_ok' ELSE 'europepmc_not_found' END AS fetch_status FROM nation")
def fetch_papers(spark, sf):
    from skein.functions.lexicon import ENGLISH

    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    key = F.concat(F.lit("src"), k.cast("string")).alias("bundle_id")
    raw = F.element_at(F.array(*map(F.lit, _ABSTRACTS)), (k % 5 + 1).cast("int"))
    b = n.select(key, F.create_map(F.lit("doi"), F.concat(F.lit("10.1/"), k.cast("string")), F.lit("title"), F.concat(F.lit("Study "), "n_name")).alias("paper"))
    none = lambda *names: [F.lit("").alias(x) for x in names]
    crossref = n.filter(k % 2 == 0).select(key, F.struct(F.lit("").alias("doi"), F.concat(F.lit("Study "), "n_name").alias("cr_title"), *none("cr_journal", "cr_first_author", "cr_published", "cr_abstract")).alias("r"))
    pmc = n.filter(k % 5 < 4).select(key, F.struct(*none("pmid", "epmc_title", "epmc_journal", "epmc_first_pub_date"), F.when(k % 5 == 1, "Review").otherwise("").alias("epmc_pub_types"), raw.alias("epmc_abstract")).alias("r"))
    claims = Lexicon(ENGLISH.sections | {"causal": ["causes", "cause"]})
    got = papers.paper_rows(b, crossref, pmc, _DESIGNS, claims, ["meta", "rct", "cohort"])
    return got.select("bundle_id", "conclusion_en", "conclusion_source", "design_auto", "strength_auto", "title", "doi", "fetch_status")


@query("""SELECT conv_id AS article_id, substr(sha1('001|' || conv_id || '|' || turn || '|' || trim(text)), 1, 12) AS comment_id, trim(text) AS text, CAST(turn AS VARCHAR) AS reg_time, turn AS likes, CAST(0 AS BIGINT) AS dislikes FROM conversations WHERE trim(coalesce(text, '')) <> '' AND turn % 4 <> 1""")
def comment_pages(spark, sf):
    """Every conversation as a JSONP page of comments; every fourth is deleted."""
    c = table(spark, sf, "conversations").select("conv_id", F.struct(F.col("turn").cast("string").alias("commentNo"), F.col("text").alias("contents"), F.col("turn").cast("string").alias("regTime"), F.col("turn").alias("sympathyCount"), (F.col("turn") % 4 == 1).alias("deleted")).alias("c"))
    pages = c.groupBy("conv_id").agg(F.to_json(F.struct(F.struct(F.collect_list("c").alias("commentList")).alias("result"))).alias("j"))
    pages = pages.select(F.col("conv_id").alias("article_id"), F.lit("001").alias("oid"), F.col("conv_id").cast("string").alias("aid"), F.concat(F.lit("cb_1("), "j", F.lit(");\n")).alias("page"))
    return readers.comment_rows(pages)


@query("SELECT doc_id AS article_id, source AS bundle_id, '0' || (10 + doc_id % 90) AS oid, lpad(CAST(doc_id AS VARCHAR), 10, '0') AS aid FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT conv_id FROM conversations)")
def pending_comments(spark, sf):
    k = F.col("doc_id")
    portal = F.concat(F.lit("https://n.news.naver.com/mnews/article/0"), (10 + k % 90).cast("string"), F.lit("/"), F.lpad(k.cast("string"), 10, "0"), F.lit("?sid=1"))
    a = table(spark, sf, "documents").select(k.alias("article_id"), F.col("source").alias("bundle_id"), F.when(k % 3 == 1, portal).otherwise("").alias("naver_url"), F.when(k % 3 == 2, portal).otherwise("https://x.kr/1").alias("fetched_url"))
    return tables.pending_comments(a, table(spark, sf, "conversations").withColumnRenamed("conv_id", "article_id"))


@query("SELECT page_id, NOT (regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) LIKE '/fr/%' OR regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) LIKE '/de/1%') AS allowed FROM pages")
def robots_allowed(spark, sf):
    rules = "User-agent: *\nDisallow: /fr/\n\nUser-agent: TrainBot\nDisallow: /de/1\n"
    return table(spark, sf, "pages").select("page_id", policy.allowed_by(rules, ("*", "TrainBot"))(F.col("url")).alias("allowed"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'denied' WHEN 2 THEN 'denied' WHEN 3 THEN 'limit' WHEN 4 THEN 'error' ELSE 'ok' END AS outcome FROM events")
def call_outcomes(spark, sf):
    status = F.element_at(F.array(*map(F.lit, (200, 401, 403, 429, 503, 204))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", readers.call_outcome(status).alias("outcome"))


@query("SELECT page_id, md5(html || ' ë') AS page FROM pages")
def charset_decode(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(readers.decode_legacy(F.encode(F.concat("html", F.lit(" ë")), "UTF-8")).cast("binary")).alias("page"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2024-01-07T10:15' WHEN 1 THEN '2024-03-09' WHEN 2 THEN '2024-01-02T03:04:05' ELSE '' END AS published FROM documents")
def published_dates(spark, sf):
    k = F.col("doc_id") % 4
    meta = F.when(k == 0, "20240107101538").when(k == 2, "2024-01-02T03:04:05").otherwise("")
    shown = F.when(k == 1, "기사입력 : 2024.3.9 오후").otherwise("nothing here")
    return table(spark, sf, "documents").select("doc_id", readers.published_day(meta, shown).alias("published"))


# ---- candidates
_OUTLETS = [("Dot Com", "portal", "com"), ("Examples", "online", "example.com"), ("Orgs", "ngo", "org"), ("Daily A", "daily", "a.kr")]


def outlets(spark) -> DataFrame:
    return spark.createDataFrame(_OUTLETS, "outlet string, outlet_type string, domain string")


CANDIDATES = f"{ARTICLES}, {BUNDLES}, cand AS (SELECT article_id, bundle_id, CASE article_id % 5 WHEN 0 THEN title WHEN 1 THEN left(title, 12) ELSE body END AS title, CASE article_id % 3 WHEN 0 THEN body WHEN 1 THEN '' ELSE title END AS description, CASE WHEN article_id % 6 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + CAST(article_id % 30 AS INT), '%Y-%m-%d') || ' 10:00' END AS pub_date FROM articles)"


def candidates(spark, sf) -> DataFrame:
    k = F.col("article_id")
    title = F.when(k % 5 == 0, F.col("title")).when(k % 5 == 1, F.substring("title", 1, 12)).otherwise(F.col("body"))
    desc = F.when(k % 3 == 0, F.col("body")).when(k % 3 == 1, "").otherwise(F.col("title"))
    day = F.when(k % 6 == 0, "").otherwise(F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")), "yyyy-MM-dd"), F.lit(" 10:00")))
    return articles(spark, sf).select("article_id", "bundle_id", title.alias("title"), desc.alias("description"), day.alias("pub_date"))


def _journals_sql(c: str) -> str:
    """The keys of the study's journals in a text, each alias taken out before shorter ones are looked for."""
    steps = sorted(((a, k) for k, names in JOURNALS.items() for a in names), key=lambda x: (-len(x[0]), x[0]))
    found, rest = [], c
    for alias, key in steps:
        pattern = f"'(^|[^A-Za-z]){alias}([^A-Za-z]|$)'"
        found.append(f"CASE WHEN regexp_matches({rest}, {pattern}) THEN '{key}' END")
        rest = f"regexp_replace(regexp_replace({rest}, {pattern}, '\\1 \\2', 'g'), {pattern}, '\\1 \\2', 'g')"
    return f"list_distinct(list_filter([{', '.join(found)}], x -> x IS NOT NULL))"


@query(f"WITH {ARTICLES} SELECT article_id, array_to_string(list_sort({_journals_sql('text')}), ';') AS journals FROM articles")
def journal_mentions(spark, sf):
    return articles(spark, sf).select("article_id", F.array_join(F.array_sort(entities.find_journals(F.col("text"), JOURNALS)), ";").alias("journals"))


_RESEARCH = ["anthe", "is"]


@query(f"""WITH {CANDIDATES}, f AS (SELECT c.*, b.* EXCLUDE (bundle_id), title || ' ' || description AS both_, TRY_CAST(left(pub_date, 10) AS DATE) AS day, {_journals_sql("title || ' ' || description")} AS found FROM cand c JOIN bundles b ON c.bundle_id = b.bundle_id),
  p AS (SELECT *, CASE WHEN regexp_matches(title, drugs) THEN 2 WHEN regexp_matches(description, drugs) THEN 1 END AS drug, CASE WHEN regexp_matches(title, outcomes) THEN 2 WHEN regexp_matches(description, outcomes) THEN 1 END AS outcome, CASE WHEN journal <> '' AND list_contains(found, journal) THEN 3 WHEN len(found) > 0 THEN -1 END AS jo,
    CASE WHEN author <> '' AND contains(lower(both_), lower(author)) THEN 2 END AS au, CASE WHEN regexp_matches(both_, '(?i)anthe|is') THEN 1 END AS re, CASE WHEN day < date_from THEN -3 WHEN day > date_to THEN -1 WHEN day - published BETWEEN 0 AND 14 THEN 1 END AS da FROM f),
  z AS (SELECT *, coalesce(drug, 0) + coalesce(outcome, 0) + coalesce(jo, 0) + coalesce(au, 0) + coalesce(re, 0) + coalesce(da, 0) AS score FROM p)
  SELECT article_id, score AS relevance_score, CASE WHEN drug IS NULL OR outcome IS NULL THEN 'N' WHEN score >= 7 THEN 'Y' ELSE '?' END AS auto_include, concat_ws('; ', 'drug:' || drug, 'outcome:' || outcome, 'journal:' || jo, 'author:' || au, 'research:' || re, 'date:' || da) AS relevance_reasons FROM z""")
def relevance_score(spark, sf):
    return tables.relevance(candidates(spark, sf), bundles(spark, sf), JOURNALS, (), _RESEARCH).select("article_id", "relevance_score", "auto_include", "relevance_reasons")


@query(f"WITH {CANDIDATES} SELECT article_id FROM cand c JOIN bundles b ON c.bundle_id = b.bundle_id WHERE pub_date = '' OR (CAST(left(pub_date, 10) AS DATE) >= coalesce(date_from, DATE '1900-01-01') AND CAST(left(pub_date, 10) AS DATE) <= coalesce(date_to, DATE '2900-01-01'))")
def date_window_filter(spark, sf):
    return tables.in_window(candidates(spark, sf), bundles(spark, sf)).select("article_id")


_JUDGED = "judged AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' y' WHEN 1 THEN 'N' ELSE '' END AS include, CASE WHEN quality = 1 THEN 'Y' ELSE '?' END AS auto_include, CASE WHEN doc_id % 7 = 0 THEN 'Background' WHEN doc_id % 11 = 0 THEN 'unrelated ' ELSE '' END AS link_type FROM labels)"


@query(f"WITH {_JUDGED} SELECT doc_id FROM judged WHERE (trim(include) = 'y' OR (include = '' AND auto_include = 'Y')) AND trim(lower(link_type)) NOT IN ('background', 'unrelated')")
def selected_candidates(spark, sf):
    k = F.col("doc_id")
    rows = table(spark, sf, "labels").select("doc_id", F.when(k % 4 == 0, " y").when(k % 4 == 1, "N").otherwise("").alias("include"), F.when(F.col("quality") == 1, "Y").otherwise("?").alias("auto_include"), F.when(k % 7 == 0, "Background").when(k % 11 == 0, "unrelated ").otherwise("").alias("link_type"))
    return tables.selected_candidates(rows, use_auto=True).select("doc_id")


@query("""SELECT * FROM (VALUES ('b1', 'Aspirin and falls', 'https://news.a.kr/1?utm_source=x', 'Daily A', 'daily', '2024-01-05', '', 4, '?', 'drug:2; outcome:2', substr(sha1('b1|https://news.a.kr/1'), 1, 12)),
  ('b1', 'JAMA on nothing', '', 'Nowhere', 'unknown', '', 'URL and title to be checked', 3, '?', 'journal:3', substr(sha1('b1|Nowhere|JAMA on nothing'), 1, 12))) t(bundle_id, title, url, outlet, outlet_type, pub_date, description, relevance_score, auto_include, relevance_reasons, candidate_id)""")
def seed_candidates(spark, sf):
    b = readers.load_bundles(spark, _YAML)
    given = lambda k: F.coalesce(F.element_at("paper", F.lit(k)), F.lit(""))
    b = b.withColumns({"journal": given("journal"), "first_author": given("first_author"), "published": F.lit(None).cast("date"), "known_articles": F.transform("known_articles", lambda a: F.struct(*[F.element_at(a, F.lit(k)).alias(k) for k in ("title_hint", "url", "outlet", "date")]))})
    got = tables.seed_candidates(b, outlets(spark), {"jama": ["JAMA"]})
    return got.select("bundle_id", "title", "url", "outlet", "outlet_type", "pub_date", "description", "relevance_score", "auto_include", "relevance_reasons", "candidate_id")


@query("""WITH n AS (SELECT c_custkey AS k, 'b' || (c_nationkey % 3) AS bundle_id, 'https://x.kr/' || (c_custkey % 400) AS url, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE 'none' END AS relevance_score FROM customer WHERE c_custkey % 4 <> 0),
  first AS (SELECT *, row_number() OVER (PARTITION BY bundle_id, url ORDER BY k) AS r FROM n), new AS (SELECT substr(sha1(bundle_id || '|' || url), 1, 12) AS candidate_id, * FROM first WHERE r = 1),
  old AS (SELECT substr(sha1('b' || (c_nationkey % 3) || '|https://x.kr/' || (c_custkey % 400)), 1, 12) AS candidate_id, 'b' || (c_nationkey % 3) AS bundle_id, 'old ' || c_name AS title, '5' AS relevance_score, c_mktsegment AS include, row_number() OVER (PARTITION BY c_nationkey % 3, c_custkey % 400 ORDER BY c_custkey) AS r FROM customer WHERE c_custkey % 3 = 0),
  o AS (SELECT * FROM old WHERE r = 1)
  SELECT coalesce(new.candidate_id, o.candidate_id) AS candidate_id, coalesce(new.bundle_id, o.bundle_id) AS bundle_id, coalesce(new.title, o.title) AS title, coalesce(TRY_CAST(coalesce(new.relevance_score, o.relevance_score) AS INT), 0) AS relevance_score, coalesce(o.include, '') AS include FROM new FULL JOIN o ON new.candidate_id = o.candidate_id""")
def save_candidates(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    base = c.select(k.alias("place"), F.concat(F.lit("b"), (F.col("c_nationkey") % 3).cast("string")).alias("bundle_id"), F.concat(F.lit("https://x.kr/"), (k % 400).cast("string")).alias("url"), F.col("c_name").alias("title"), F.lit("o").alias("outlet"), F.lit("q").alias("query"), F.when(k % 2 == 0, F.col("c_nationkey").cast("string")).otherwise("none").alias("relevance_score"), F.col("c_mktsegment").alias("include"))
    new = tables.candidate_ids(base.filter("place % 4 <> 0").drop("include"))
    old = tables.candidate_ids(base.filter("place % 3 = 0").withColumns({"title": F.concat(F.lit("old "), "title"), "relevance_score": F.lit("5")}))
    first = old.groupBy("candidate_id").agg(F.min_by(F.struct("bundle_id", "title", "relevance_score", "include"), "place").alias("f")).select("candidate_id", "f.*")
    return tables.save_candidates(new, first, ["candidate_id", "bundle_id", "title", "relevance_score"], ["include"]).select("candidate_id", "bundle_id", "title", "relevance_score", "include")


@query("""SELECT doc_id AS article_id, CASE WHEN doc_id % 7 = 0 THEN 'ok' WHEN doc_id % 5 = 0 THEN 'ok' WHEN doc_id % 3 = 0 THEN 'no_url' WHEN doc_id % 3 = 1 THEN 'ok' ELSE 'short_body' END AS status,
  CASE WHEN doc_id % 7 = 0 THEN 'manual' WHEN doc_id % 5 = 0 THEN 'existing' WHEN doc_id % 3 = 0 THEN 'none' ELSE 'fetched' END AS origin, CASE WHEN doc_id % 7 = 0 THEN 'M' WHEN doc_id % 5 = 0 THEN 'E' WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'second' ELSE 'b' END AS body FROM documents WHERE doc_id % 10 <> 9
  UNION ALL SELECT doc_id, 'http_error:500', 'existing', 'old' FROM documents WHERE doc_id % 10 = 9 AND doc_id % 5 = 4""")
def scraped_articles(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    asked = d.filter(k % 10 != 9).select(k.alias("candidate_id"), F.col("source").alias("bundle_id"), F.lit("asked").alias("title"))
    manual = d.filter(k % 7 == 0).filter(k % 10 != 9).select(k.alias("article_id"), F.lit("t").alias("title"), F.lit("M").alias("body"))
    existing = d.filter((k % 5 == 0) | (k % 10 == 9)).select(k.alias("article_id"), F.col("source").alias("bundle_id"), F.when(k % 10 == 9, "http_error:500").otherwise("ok").alias("status"), F.lit("t").alias("title"), F.when(k % 10 == 9, "old").otherwise("E").alias("body"))
    tried = [d.filter(k % 3 == r).select(k.alias("article_id"), F.lit(n).alias("rank"), F.lit(status).alias("status"), F.lit("").alias("title"), F.lit(body).alias("body")) for r, n, status, body in ((1, 1, "short_body", "first"), (1, 2, "ok", "second"), (1, 3, "ok", "third"), (2, 1, "http_error:404", "a"), (2, 2, "short_body", "b"))]
    fetched = tried[0]
    for t in tried[1:]:
        fetched = fetched.unionByName(t)
    return tables.best_texts(asked, manual, existing, fetched).select("article_id", "status", "origin", "body")


# ---- entities and text
@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'a' ELSE '' END || t AS title FROM (SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([a-zA-Z ]*)', 1), '\\s+', ' ', 'g')) AS t FROM pages)""")
def clean_titles(spark, sf):
    t = F.trim(F.regexp_replace(F.regexp_extract("html", "<title>([a-zA-Z ]*)", 1), r"\s+", " "))
    p = table(spark, sf, "pages").withColumn("t", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("[Only news] a"), t, F.lit(" - Daily A"))).otherwise(t))
    return p.select("page_id", entities.clean_title(F.col("t"), F.lit("Daily A")).alias("title"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE lpad(CAST(event_id % 900 AS VARCHAR), 3, '0') END AS oid, CASE WHEN event_id % 3 = 2 THEN NULL ELSE lpad(CAST(event_id AS VARCHAR), 10, '0') END AS aid FROM events")
def portal_ids(spark, sf):
    k = F.col("event_id")
    oid, aid = F.lpad((k % 900).cast("string"), 3, "0"), F.lpad(k.cast("string"), 10, "0")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://n.news.naver.com/mnews/article/comment/"), oid, F.lit("/"), aid)).when(k % 3 == 1, F.concat(F.lit("https://news.naver.com/main/read.naver?mode=x&oid="), oid, F.lit("&aid="), aid)).otherwise(F.concat(F.lit("https://other.kr/article/"), oid, F.lit("/"), aid))
    ids = entities.portal_ids(url)
    return table(spark, sf, "events").select("event_id", ids["oid"].alias("oid"), ids["aid"].alias("aid"))


@query("SELECT event_id, event_type || ' <x> & ''' || user_id || '''' AS text FROM events")
def api_text(spark, sf):
    raw = F.concat(F.lit("<b>"), "event_type", F.lit("</b>  &amp;lt;x&gt; \n &amp; &#39;"), F.col("user_id").cast("string"), F.lit("&apos; "))
    return table(spark, sf, "events").select("event_id", entities.clean_api_text(raw).alias("text"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '–' WHEN event_id % 5 = 1 THEN CAST(event_id % 50 AS VARCHAR) || '.5%' ELSE CAST(event_id % 50 AS VARCHAR) || '.5% [' || CAST(event_id % 20 AS VARCHAR) || '.0, 99.0]' END AS shown FROM events")
def interval_text(spark, sf):
    k = F.col("event_id")
    est = F.when(k % 5 != 0, (k % 50 + 0.5) / 100)
    low = F.when(k % 5 > 1, (k % 20) / 100)
    return table(spark, sf, "events").select("event_id", text.format_ci(est, low, F.lit(0.99)).alias("shown"))


@query("SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), '; ') AS roles FROM conversations GROUP BY conv_id")
def joined_roles(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return c.select("conv_id", F.array_join(F.array_sort(F.split(text.ordered_join(F.col("r")), "; ")), "; ").alias("roles"))


@query("SELECT '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || (SELECT string_agg('| ' || n_nationkey || ' | ' || n_name || '\\|x |', chr(10) ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 10) || chr(10) || chr(10) || 'First 10 of 25 rows.' AS shown")
def markdown_table(spark, sf):
    from skein.plans.report import to_markdown

    n = table(spark, sf, "nation").orderBy("n_nationkey").select("n_nationkey", F.concat("n_name", F.lit("|x")).alias("n_name"), F.lit(1).alias("_hidden"))
    return spark.createDataFrame([(to_markdown(n, 10),)], "shown string")
