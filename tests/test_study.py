"""Papers, features, policy gates, the synthetic study and the report."""

from pyspark.sql import functions as F

from skein.functions.lexicon import KOREAN, Lexicon
from skein.operators import features, mining, papers
from skein.plans import catalog, report
from skein.sources import demo, policy, readers

LEX = Lexicon({**KOREAN.sections, "conditions": {"age": ["노인"], "design": ["관찰 연구"], "limitation": ["한계", "다만"]}, "hedges": ["필요"], "boosters": ["획기적"], "sensational": ["충격"], "advice": {"3": ["중단"], "2": ["상담"], "1": ["주의"]}})


def test_abstracts(spark):
    raws = ["<jats:title>Methods</jats:title><jats:p>We did.</jats:p><jats:title>Conclusions</jats:title><jats:p>It causes x.</jats:p>", "<h4>Background</h4>B.<h4>Interpretation</h4>No effect.", "OBJECTIVE: To see. CONCLUSIONS: Linked to y.", "One. Two here. Three there."]
    frame = spark.createDataFrame([(r,) for r in raws], "raw string").coalesce(1)
    got = [r.c for r in frame.select(papers.conclusion(papers.abstract_sections(F.col("raw"))).alias("c")).collect()]
    assert [c.source for c in got] == ["section:conclusions", "section:interpretation", "section:conclusions", "last_two_sentences"]
    assert [c.text for c in got] == ["It causes x.", "No effect.", "Linked to y.", "Two here. Three there."]


def test_designs_and_picks(spark):
    lex = Lexicon({"designs": {"meta": ["meta-analysis"], "rct": ["randomized"], "cohort": ["cohort"]}})
    rows = [("A randomized trial", "", "", "rct"), ("Emulated randomized trial in a cohort", "", "", "cohort"), ("Things", "", "Review", "review"), ("A meta-analysis", "", "Review", "meta"), ("x", "", "", "unknown")]
    frame = spark.createDataFrame(rows, "t string, a string, p string, want string")
    assert all(r.d.design == r.want for r in frame.select("want", papers.guess_design(lex, F.col("t"), F.col("a"), F.col("p"), ["meta", "rct", "cohort"]).alias("d")).collect())
    picks = spark.createDataFrame([("3", "5"), (" ", "5"), ("", "")], "h string, a string")
    assert [tuple(r.p) for r in picks.select(papers.pick(F.col("h"), F.col("a"), True).alias("p")).collect()] == [("3", "coded"), ("5", "auto"), (None, "missing")]
    assert [r.p.source for r in picks.select(papers.pick(F.col("h"), F.col("a"), False).alias("p")).collect()] == ["coded", "missing", "missing"]
    sheet = spark.createDataFrame([(1, "7", "inc"), (2, "", "Dec"), (3, "6", "up")], "id int, title_strength string, direction string")
    assert sorted(map(tuple, papers.invalid_codes(sheet, "id").collect())) == [(1, "title_strength", "7"), (3, "direction", "up")]
    assert tuple(papers.coding_progress(sheet).first()) == (2, 3)
    found = spark.createDataFrame([("k", "A title here", "A title here!"), ("k", "A title here", "other")], "key string, wanted string, title string")
    assert papers.best_title(found, "wanted", "title", "key", readers.sequence_ratio).first().title == "A title here!"


def test_demo_study_end_to_end(spark):
    articles = demo.demo_articles(spark, 8, 6)
    assert articles.count() == 48 and articles.exceptAll(demo.demo_articles(spark, 8, 6)).count() == 0
    none = spark.createDataFrame([], "article_id string")
    bad = articles.limit(1).select("article_id")
    bundles = demo.demo_bundles(spark, 8).withColumn("journal", F.element_at("paper", F.lit("journal")))
    selection, rows = features.precode(articles, bundles, bad, none, 4, lexicon=LEX, journals={"jama": ["JAMA"]})
    assert selection.count() == 47 and selection.filter("selected = 'Y'").count() == 32
    got = {r.article_id: r for r in rows.collect()}
    assert len(got) == 32
    for r in got.values():
        want = 1 if "관련 없다" in r.title else 6 if r.title.endswith("유발") else 5 if "수 있다" in r.title else 3 if "위험 증가" in r.title else 2
        assert r.auto_title_strength == want and r.auto_lead_strength == want and r.auto_journal_match is None
        assert r.auto_caveat == r.auto_cond_body_design and (r.auto_caveat == 1) != (r.n_hedges_body == 1)
    comments = demo.demo_comments(articles)
    assert comments.count() > 0 and comments.select("comment_id").distinct().count() == comments.count()
    one = spark.createDataFrame([("약물가",), ("골절",)], "w string")
    assert [r.p for r in one.select(demo.subject_particle(F.col("w")).alias("p")).collect()] == ["가", "이"]


def test_policy_gates():
    texts = {"https://a.kr/robots.txt": (200, "User-agent: *\nDisallow: /no\n\nUser-agent: TrainBot\nDisallow: /"), "https://b.kr/robots.txt": (404, "Disallow: /")}
    asked = []

    def get(url):
        asked.append(url)
        return texts.get(url, (200, "<article><p>" + "word " * 80 + "</p></article>"))

    plain, strict = policy.Robots(get), policy.Robots(get, ("*", "TrainBot"))
    assert plain.blocked_by("https://a.kr/x") is None and plain.blocked_by("https://a.kr/no/1") == "*" and plain.blocked_by("https://b.kr/no") is None
    assert strict.blocked_by("https://a.kr/x") == "TrainBot" and policy.Robots(get, respect=False).blocked_by("https://a.kr/no") is None
    slept, now = [], [0.0]
    pace = policy.Pace(2, clock=lambda: now[0], sleep=slept.append)
    status = lambda url, robots=plain: policy.fetch_status(url, robots, pace, get, readers.extract_html)[0]
    assert status("https://b.kr/1") == "ok" and status("") == "no_url" and status("https://a.kr/no") == "robots_disallowed:*"
    texts["https://b.kr/2"], texts["https://b.kr/3"] = (503, ""), (200, "<p>short</p>")
    assert status("https://b.kr/2") == "http_error:503" and status("https://b.kr/3") == "short_body" and slept == [2, 2]
    assert asked.count("https://a.kr/robots.txt") == 2


def test_markdown(spark):
    rows = spark.range(50).select("id", F.lit("a|b\nc").alias("t"), F.lit(1).alias("_hidden"))
    shown = report.to_markdown(rows, 3)
    assert shown.count("\n| ") == 4 and "a\\|b c" in shown and "First 3 of 50 rows." in shown and "_hidden" not in shown


def test_commands(spark, tmp_path, capsys):
    from skein.__main__ import STEPS, main

    assert len(STEPS) == 14
    assert main(["list"]) == 0 and "outlet_rates" in capsys.readouterr().out
    assert main(["search-plan", "a", "b", "--max-results", "250"]) == 0 and capsys.readouterr().out == "6 calls\n"
    assert main(["run", "status_table", "/root/testdata/sf0.001", f"{tmp_path}/s"]) == 0 and spark.read.parquet(f"{tmp_path}/s").count() > 0
    assert main(["discover", f"{tmp_path}/e", "--estimate", "--drugs", "x", "y", "--max-results", "100"]) == 0 and "at most 2 calls" in capsys.readouterr().out
    assert main(["collect-comments", f"{tmp_path}/e"]) == 1 and main(["finalize", f"{tmp_path}/e"]) == 1


def test_the_demo_study_from_the_command_line(spark, tmp_path, capsys):
    """All steps over a synthetic study: sheets, agreement, final codes, every table, figure and section of the report."""
    from skein.__main__ import main

    root = f"{tmp_path}/study"
    assert main(["demo", root, "--bundles", "10", "--n-boot", "40"]) == 0
    text = (tmp_path / "study/report.md").read_text()
    assert all(f"## {title}" in text for title in report.TITLES.values()) and "| exceeds_title |" in text and "comment_reactions.svg" in text
    tables = {p.name for p in (tmp_path / "study/tables").iterdir()}
    assert {"analysis_dataset", "agreement", "feasibility", "rq1_overall", "rq1_by_outlet_type", "rq1_bundle_ladder", "rq1_title_vs_lead", "rq1_press_release", "rq2_condition_long", "rq2_condition_summary", "rq3_comments_per_article", "rq3_comment_reactions", "tm_logodds_title_vs_body", "tm_tfidf_outlet"} <= tables | {"agreement"}
    from xml.etree import ElementTree

    drawn = sorted((tmp_path / "study/figures").glob("*.svg"))
    assert len(drawn) == 4 and all(ElementTree.parse(p) for p in drawn)
    capsys.readouterr()
    assert main(["status", root]) == 0 and "coder1: 36 of 36" in capsys.readouterr().out
    assert main(["analyze", root, "--source", "auto", "--n-boot", "20"]) == 0 and "Automatic codes" in (tmp_path / "study/report.md").read_text()
    assert main(["analyze", root, "--source", "nobody"]) == 1


def test_collecting_into_a_folder(spark, tmp_path):
    """Seeds, search, papers, texts and comments from canned answers; a second run keeps what people entered and asks for nothing twice."""
    import json

    from skein.plans.workspace import Workspace

    (tmp_path / "bundles.yaml").write_text("- {bundle_id: b1, drug_terms: [aspirin], outcome_terms: [falls], paper: {doi: '10.1/1', journal: jama, published: 2024-01-03}, queries: [aspirin falls], date_from: 2024-01-01, date_to: 2024-02-01, known_articles: [{title_hint: Aspirin and falls, url: 'https://a.kr/1', outlet: A}]}")
    w = Workspace(spark, str(tmp_path), LEX, {"jama": ["JAMA"]}, spark.createDataFrame([("A", "daily", "a.kr")], "outlet string, outlet_type string, domain string"))
    assert w.seed_candidates().count() == 1
    items = [{"title": "<b>Aspirin</b> falls in JAMA", "originallink": "https://a.kr/2", "link": "https://n.news.naver.com/article/001/0000000002", "pubDate": "Fri, 05 Jan 2024 09:00:00 +0900"}, {"title": "Aspirin falls", "originallink": "https://a.kr/3", "pubDate": "Fri, 05 Apr 2024 09:00:00 +0900"}]
    assert w.search_news(lambda p: {"total": 2, "items": items}).count() == 2  # the third is outside the window
    c = w.sheet("candidates")
    w.save(c.withColumn("include", F.when(F.contains("url", F.lit("/2")), "Y").otherwise("")), "candidates")
    assert {r.url: r.include for r in w.seed_candidates().collect()} == {"https://a.kr/1": "", "https://a.kr/2": "Y"}
    answers = {"https://api.crossref.org/works/10.1/1": json.dumps({"message": {"DOI": "10.1/1", "title": ["Aspirin"], "issued": {"date-parts": [[2024, 1]]}, "abstract": "CONCLUSIONS: Aspirin was linked to falls. METHODS: a trial."}})}
    got = w.fetch_papers(lambda url, params=None: (200, answers[url]) if url in answers else (404, "")).first()
    assert (got.title, got.published, got.conclusion_en, got.strength_auto, got.fetch_status) == ("Aspirin", "2024-01", "Aspirin was linked to falls.", "2", "crossref_ok, europepmc_not_found")
    asked = []

    def page(url):
        asked.append(url)
        return (404, "") if url.endswith("robots.txt") else (200, "<html><title>Aspirin</title><article><p>" + "Aspirin was linked to falls. " * 20 + "</p></article></html>")

    assert [r.flag for r in w.scrape(page, delay=0).collect()] == ["ok"] and asked.count("https://a.kr/2") == 1
    w.scrape(page, delay=0)
    assert asked.count("https://a.kr/2") == 1 and w.articles().count() == 1
    said = []
    jsonp = lambda oid, aid, n: said.append((oid, aid)) or 'cb({"result": {"commentList": [{"contents": "good", "commentNo": "1"}]}});'
    assert w.collect_comments(jsonp) == 1 and w.collect_comments(jsonp) == 1 and said == [("001", "0000000002")]
    assert w.precode(coders=["c1"], blind=[]) == 1
    answers = iter(["6", "x", "2", "inc", "0", "Y", "N", "NA", "N", "fine"])
    assert w.annotate("c1", lambda field, shown: next(answers)) == (1, 1)
    row = w.sheet("article_coding_c1").first()
    assert (row.title_strength, row.lead_strength, row.coder_notes) == ("6", "2", "fine")
    assert w.precode(coders=["c1"], blind=[]) == 1 and w.sheet("article_coding_c1").first().title_strength == "6"


def test_figures_are_well_formed(spark):
    from xml.etree import ElementTree

    from skein.plans import figures

    series = spark.createDataFrame([("b<1", 3, 1, 2.5, 6), ("b2", None, 0, 1.0, 2)], "bundle_id string, paper int, low int, mean double, high int")
    drawn = [figures.ladder(series), figures.bars([("a & b", 0.5, 0.2, 0.9), ("none", None, None, None)], "Rates"), figures.heatmap([("dose", 80.0, None, 10.0)], ["title", "lead", "body"], "Kept")]
    roots = [ElementTree.fromstring(svg) for svg in drawn]
    texts = [t.text for r in roots for t in r.iter("{http://www.w3.org/2000/svg}text")]
    assert {"b<1", "a & b", "50.0 %", "80%", "10%"} <= set(texts) and len(list(roots[0].iter("{http://www.w3.org/2000/svg}path"))) == 1


def test_article_features_of_the_whole_body(spark):
    lex = Lexicon({"causal": ["causes"], "negation": [], "may": [], "can": [], "up": ["higher"], "down": ["lower"], "conditions": {"dose": ["daily"]}, "hedges": ["perhaps"], "boosters": ["surely"], "sensational": ["shock"], "advice": {"3": ["ask your doctor"], "2": [], "1": []}, "attribution": ["said"]})
    body = "Drugx causes lower risk daily, perhaps.\nSurely a shock, they said. Ask your doctor."
    rows = spark.createDataFrame([("a", "b", "Title", body), ("c", "b", "Title", "Drugx daily. Two said. Three from Old Gazette in signatures said.")], "article_id string, bundle_id string, title string, body string")
    got = {r.article_id: r for r in features.article_features(rows, spark.createDataFrame([("b", ["drugx", "perhaps not"], ["risk"], "nature")], "bundle_id string, drug_terms array<string>, outcome_terms array<string>, journal string"), lex, {"nature": ["nature"]}, ["Old Gazette", "Gazette"]).collect()}
    a, c = got["a"], got["c"]
    assert (a.auto_cond_lead_dose, a.auto_cond_body_dose, a.n_hedges_lead, a.n_hedges_body, a.n_boosters_body, a.n_sensational_body) == (1,) * 6
    assert (a.auto_direction, a.n_attribution, a.auto_advice, a.auto_advice_cues, a.non_journal_sources, a.auto_journal_match) == ("decrease", 1, 3, "Ask your doctor", "", None)
    assert (c.auto_direction, c.n_attribution, c.auto_cond_body_dose, c.non_journal_sources, c.journals_mentioned, c.auto_journal_match) == ("", 2, 1, "Old Gazette", "", 0)


def test_article_features_query_has_every_document(spark):
    rows = catalog.QUERIES["article_features"](spark, "/root/testdata/sf0.001")
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    missed = [c for c in rows.columns if c.startswith("auto_cond_lead_") and not c.endswith("_cues")]
    assert len(missed) == 4 and all(rows.filter(f"{c} > {c.replace('lead', 'body')}").isEmpty() for c in missed)


def test_topics_know_every_term(spark):
    terms = 270_000  # more than the vectorizer's default vocabulary
    rows = spark.range(3 * terms).select((F.col("id") % 108).alias("d"), F.concat(F.lit("t"), F.floor(F.col("id") / 3)).alias("t"))
    docs = rows.groupBy("d").agg(F.collect_list("t").alias("tokens"))
    assert len(mining.count_vectors(docs, "tokens").vocabulary) == terms


def test_topics_query_has_the_defaults(spark):
    rows = catalog.QUERIES["lda_topics"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 5 and all(len(r.terms.split(", ")) == 10 for r in rows)
