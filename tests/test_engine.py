"""Rules of the engine's operators on small frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import entities, text
from skein.functions.claims import ClaimCoder
from skein.functions.lexicon import ENGLISH, KOREAN, Lexicon
from skein.operators import agreement, mining, stats, tables
from skein.sources import readers
from skein.streaming import budget


def one(spark, column, **values):
    names = list(values)
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], kinds).select(column.alias("x")).first()["x"]


T = F.col("t")


def test_spans_take_the_earliest_then_longest(spark):
    lex = Lexicon({"a": ["risk", "high risk of", "re:ris[kc]s?", "of"], "n": {"1": ["x"], "2": ["y"]}})
    got = one(spark, lex.spans(T, "a"), t="A high risk of Risks, of")
    assert [(s.start, s.len, s.text) for s in got] == [(2, 12, "high risk of"), (15, 5, "Risks"), (22, 2, "of")]
    assert one(spark, lex.count(T, "a"), t="nothing") == 0 and lex.entries("n") == ["x", "y"] and lex.subkeys("n") == ["1", "2"]


@pytest.mark.parametrize(("sentence", "level", "direction"), [
    ("약물이 부작용을 유발", 6, ""), ("약물이 부작용 유발할 수 있다", 5, ""), ("약물이 유발할 수도 있다", 4, ""), ("부작용을 유발하지 않는다", 1, "null"),
    ("복용자에서 위험 증가", 3, "increase"), ("치매와 연관", 2, ""), ("치매와 관련 없다", 1, "null"), ("치매 위험", 3, ""), ("오늘의 날씨", 0, ""), ("원인, 수 있다", 6, ""),
])
def test_korean_levels(spark, sentence, level, direction):
    got = one(spark, ClaimCoder(KOREAN).code(T, require_target=False), t=sentence)
    assert (got.level, got.direction) == (level, direction)


@pytest.mark.parametrize(("sentence", "level"), [
    ("The drug causes harm.", 6), ("The drug may causes harm.", 4), ("It could causes harm.", 5), ("It does not causes harm.", 1), ("Use was associated with falls.", 2), ("An increased risk was seen.", 3), ("No claim.", 0),
])
def test_english_levels_look_in_front(spark, sentence, level):
    assert one(spark, ClaimCoder(ENGLISH, window=0, before=30).code(T, require_target=False), t=sentence).level == level


def test_counts_are_those_of_the_spans(spark):
    rng = random.Random(11)
    lex = Lexicon({"plain": ["ab", "abc", "cab", "b c", "É"], "selfish": ["aba", "xab"], "regex": ["re:a+b?", "c"]})
    texts = ["".join(rng.choice("abcxé É") for _ in range(rng.randrange(40))) for _ in range(200)] + ["xababa", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert lex._plain("plain") and not lex._plain("selfish") and not lex._plain("regex")
    for key in lex.sections:
        for r in frame.select(lex.count(T, key).alias("n"), lex.texts(T, key).alias("x"), lex.spans(T, key).alias("s")).collect():
            assert r.n == len(r.s) and list(r.x) == [s.text for s in r.s]


def test_target_gate_masking_and_unit(spark):
    coder = ClaimCoder(ENGLISH, window=0, before=30)
    gated = lambda s: one(spark, coder.code(T, ["aspirin", "aspirin plus"], ["falls"]), t=s).level
    assert gated("Rain causes mud.") == 0 and gated("Aspirin causes mud.") == 6 and gated("Rain causes falls.") == 6
    assert one(spark, text.mask_terms(T, ["aspirin", "aspirin plus"]), t="Aspirin Plus or ASPIRIN") == "[D] or [D]"
    assert one(spark, text.mask_terms(T, text.terms_pattern(F.col("d"))), t="ab abc a.c", d=["ab", "abc", "", "a.c"]) == "[D] [D] [D]"
    assert one(spark, text.mask_terms(T, text.terms_pattern(F.col("d"))), t="ab", d=[]) == "ab"
    by_row = lambda s: one(spark, coder.code(T, text.terms_pattern(F.col("d")), text.terms_pattern(F.col("o"))), t=s, d=["aspirin"], o=["fa.ls"]).level
    assert by_row("Rain causes falls.") == 0 and by_row("Aspirin causes mud.") == 6 and by_row("Rain causes fa.ls.") == 6
    got = one(spark, coder.unit(F.col("s"), require_target=False), s=["Was it linked to x?", "It causes y.", "This causes z."])
    assert (got.level, got.sentence, got.question) == (6, "It causes y.", True)
    assert one(spark, coder.unit(F.col("s")), s=[]) is None
    both = one(spark, coder.conclusion(F.col("s")), s=["Hello.", "It was linked to x.", "It causes y."])
    assert (both.main.level, both.strongest.level) == (2, 6)


def test_segmentation(spark):
    body = "Study shows a thing in mice\n입력 2024.01.02 10:00\n사진=a mouse in a house.\nFirst sentence is here. Second one follows! Third is the rest."
    got = one(spark, text.segment(F.lit("Study shows a thing in mice"), T), t=body)
    assert list(got.lead) == ["First sentence is here.", "Second one follows!"] and list(got.rest) == ["Third is the rest."]
    only = one(spark, text.segment(F.lit("A title of some length"), T), t="short head\nanother head")
    assert list(only.lead) == ["short head", "another head"]
    assert one(spark, text.normalize_text(T), t="１．３배 ​ ㎎\n\n\n x ") == "1.3배 mg\n x"
    assert one(spark, text.strip_leading_byline(T), t="(서울=통신) 김가나 기자 = 새 소식이다.") == "새 소식이다."
    assert one(spark, text.tokens(T, ["the"]), t="The Drug-7 가나 1.5 a 나") == ["drug-7", "가나", "1.5", "나"]


def test_entities(spark):
    url = lambda u: one(spark, entities.normalize_url(T), t=u)
    assert url("HTTPS://Ex.COM/A/b/?utm_source=x&id=7&fbclid=q#top") == "HTTPS://ex.com/A/b?id=7" and url("ex.com/") == "https://ex.com"
    rows = spark.createDataFrame([("https://news.a.co.kr/x", ""), ("https://b.org/y", "Daily A"), ("https://zzz.net", "")], "url string, name string")
    outlets = spark.createDataFrame([("A", "wide", "co.kr"), ("A News", "online", "a.co.kr"), ("Daily A", "print", "daily.kr")], "outlet string, outlet_type string, domain string")
    got = {r.url: (r.outlet, r.outlet_type) for r in entities.resolve_outlets(rows, outlets, name="name").collect()}
    assert got == {"https://news.a.co.kr/x": ("A News", "online"), "https://b.org/y": ("Daily A", "print"), "https://zzz.net": ("zzz.net", "unknown")}
    journals = {"jama": ["JAMA"], "jama_im": ["JAMA Internal Medicine"], "bmj": ["BMJ", "영국의학저널"]}
    assert one(spark, entities.find_journals(T, journals, ["BMJ Group"]), t="JAMA Internal Medicine and BMJ Group, XJAMAs") == ["jama_im"]
    assert one(spark, entities.parse_pubdate(T), t="Fri, 05 Jan 2024 09:08:07 +0900") == "2024-01-05 09:08:07" and one(spark, entities.parse_pubdate(T), t="soon") is None
    assert one(spark, entities.clean_api_text(T), t="<b>A</b> &amp;lt;x&gt;  y") == "A <x> y"
    assert str(one(spark, entities.iso_date(T), t="20240105")) == "2024-01-05"


def test_merge_preserving_is_idempotent(spark):
    old = spark.createDataFrame([("1", "a", "mine"), ("1", "a", "later"), ("2", "b", ""), ("9", "z", "kept")], "id string, auto string, human string")
    new = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C")], "id string, auto string")
    first = tables.merge_preserving(new, old, ["id"], ["human"], ["auto", "human"])
    got = sorted(tuple(r) for r in first.select("id", "auto", "human", "_stale").collect())
    assert got == [("1", "A", "later", ""), ("2", "B", "", ""), ("3", "C", "", ""), ("9", "z", "kept", "Y")]
    again = tables.merge_preserving(new, first, ["id"], ["human"])
    assert sorted(tuple(r) for r in again.select("id", "auto", "human", "_stale").collect()) == got
    assert tables.merge_preserving(new, old.drop("id"), ["id"], ["human"]).columns == ["id", "auto"]


def test_sequential_dedupe_does_not_register_dropped_keys(spark):
    rows = [(1, "b", "u1", "o", "t1", "q1"), (2, "b", "u1", "o", "t2", "q2"), (3, "b", "u3", "o", "t2", "q3"), (4, "b", "", "o", "t1", "q1"), (5, "c", "u1", "o", "t1", "q9")]
    frame = spark.createDataFrame(rows, "page_id long, bundle_id string, norm_url string, outlet string, bare_title string, query string")
    assert sorted((r.page_id, r["query"]) for r in tables.dedupe(frame, "page_id").collect()) == [(1, "q1 | q2"), (3, "q3"), (5, "q9")]


def test_dedupe_against_a_pass_in_order(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("bc"), rng.choice(["", None, *map(str, range(40))]), rng.choice(["o", "p", None]), str(rng.randrange(30)), rng.choice(["", None, "q", "qq", "r", "s t"])) for i in range(400)]
    rows += [(400 + i, "b", str(100 + i // 2), "o", f"chain {(i + 1) // 2}", "q") for i in range(12)]  # each row shares a key with the one before
    survivors, seen = {}, {}
    for i, bundle, url, outlet, title, query in rows:
        keys = [("u", bundle, url)] * bool(url) + [("t", bundle, outlet, title)]
        hit = next((seen[k] for k in keys if k in seen), None)
        if hit is None:
            seen.update(dict.fromkeys(keys, i))
            survivors[i] = query
        elif query and query not in (survivors[hit] or ""):
            survivors[hit] = f"{survivors[hit]} | {query}" if survivors[hit] else query
    frame = spark.createDataFrame(rows, "page_id long, bundle_id string, norm_url string, outlet string, bare_title string, query string").repartition(5)
    got = tables.dedupe(frame, "page_id")
    assert got.columns == frame.columns and {r.page_id: r["query"] for r in got.collect()} == survivors
    assert tables.dedupe(frame.limit(0), "page_id").count() == 0


def test_selection_takes_strata_in_turn(spark):
    frame = spark.createDataFrame([(i, "g", "x" if i < 90 else "y" if i < 95 else "z") for i in range(100)], "k long, g string, s string")
    chosen = [r.s for r in tables.stratified(frame, "g", "s", "k", 6).filter("selected = 'Y'").collect()]
    assert sorted(chosen) == ["x", "x", "y", "y", "z", "z"] and tables.stratified(frame, "g", "s", "k", 0).filter("selected = 'Y'").count() == 100


def test_kappa_by_hand(spark):
    frame = spark.createDataFrame([("Y", "y"), ("Y", "N"), ("N", "N"), ("NA", "Y"), ("", "N"), ("N", "N")], "a string, b string")
    got = agreement.kappa(frame, "a", "b").first()
    assert (got.n, got.agree_pct, got.kappa) == (4, 75.0, 0.5)
    ordinal = spark.createDataFrame([("0", "0"), ("1", "3"), ("3", "3"), ("6", "1")], "a string, b string")
    rank = {0: 0, 1: 1, 3: 2, 6: 3}
    pairs = [(0, 0), (1, 3), (3, 3), (6, 1)]
    seen = sum(abs(rank[a] - rank[b]) for a, b in pairs) / 4
    expected = sum(abs(rank[a] - rank[b]) for a, _ in pairs for _, b in pairs) / 16
    assert agreement.kappa(ordinal, "a", "b", weighted=True).first().kappa == round(1 - seen / expected, 3)
    dirty = ordinal.unionByName(spark.createDataFrame([("x", "1")], "a string, b string"))
    assert agreement.kappa(dirty, "a", "b", weighted=True).first().kappa is None and agreement.kappa(dirty, "a", "b").first().n == 5
    assert agreement.kappa(frame.filter("a = 'zzz'"), "a", "b").first().n == 0


def test_bootstrap_and_ranks(spark):
    rng = random.Random(3)
    rows = [(f"c{i % 12}", rng.random() < 0.2 + 0.05 * (i % 12), i % 2) for i in range(600)]
    frame = spark.createDataFrame([(c, float(x), g) for c, x, g in rows] + [("c1", None, 1)], "c string, x double, g int")
    got = stats.cluster_bootstrap(frame, "x", "c", 400).first()
    assert got.n == 600 and abs(got.est - np.mean([x for _, x, _ in rows])) < 1e-12 and 0.01 < got.est - got.lo < 0.2 and 0.01 < got.hi - got.est < 0.2
    alone = stats.cluster_bootstrap(frame.filter("c = 'c1'"), "x", "c", 50).first()
    assert alone.lo is None and alone.est is not None and stats.cluster_bootstrap(frame.limit(0), "x", "c", 50).first().est is None
    assert stats.cluster_bootstrap_diff(frame.filter("g = 1"), "x", "g", "c", 50).first().est is None
    values = [(float(v), s) for v, s in ((1, 0), (2, 0), (3, 1), (4, 0), (5, 1), (6, 1), (7, 1))]
    u = stats.mann_whitney(spark.createDataFrame(values, "v double, s int"), "v", "s").first()
    assert u.u1 == 11 and abs(stats.exact_mann_whitney(11, 4, 3) - 4 / 35) < 1e-12
    assert abs(u.p - 4 / 35) < 1e-12  # small and without ties: exact
    z = (11 - 6 - 0.5) / math.sqrt(12 / 12 * 8)
    assert abs(u.z - z) < 1e-12
    many = [(float(v), int(v % 3 == 0 or v > 35)) for v in range(40)] + [(3.0, 1)]
    u = stats.mann_whitney(spark.createDataFrame(many, "v double, s int"), "v", "s").first()
    wins = sum((a > b) + (a == b) / 2 for a, x in many if x for b, y in many if not y)
    assert u.u1 == wins and abs(u.p - min(1, math.erfc(abs(u.z) / math.sqrt(2)))) < 1e-6


def test_gee(spark):
    rng = np.random.default_rng(1)
    rows = [(f"c{i}", lv, int(rng.random() < p)) for i in range(60) for lv, p in (("a", 0.3), ("a", 0.3), ("b", 0.6)) for _ in range(3)]
    frame = spark.createDataFrame(rows, "c string, l string, y int")
    got, why = stats.gee_logit(frame, "y", "l", "c")
    odds = {v: np.mean([y for _, x, y in rows if x == v]) for v in "ab"}
    plain = odds["b"] / (1 - odds["b"]) / (odds["a"] / (1 - odds["a"]))
    assert why is None and got[0]["term"] == "b" and abs(got[0]["odds_ratio"] / plain - 1) < 0.05 and got[0]["lo"] < plain < got[0]["hi"]
    assert "rows" in stats.gee_logit(frame.limit(5), "y", "l", "c")[1]
    assert "separated" in stats.gee_logit(frame.withColumn("y", (F.col("l") == "b").cast("int")), "y", "l", "c")[1]


def test_folds_and_naive_bayes(spark):
    rows = [(i, f"g{i % 7}", ["good", "fine"] if i % 3 else ["bad", "poor"], float(i % 3 > 0)) for i in range(90)]
    frame = spark.createDataFrame(rows, "k long, g string, tokens array<string>, y double")
    folds = mining.group_folds(frame, "g", 5)
    assert len({f for _, f in folds}) == 5 and len(folds) == 7
    got = mining.nb_group_cv(frame, "k", "g", "tokens", "y").collect()
    assert len(got) == 90 and all(r.actual == r.predicted for r in got) and mining.nb_group_cv(frame.limit(5), "k", "g", "tokens", "y") is None


def test_sources(spark, tmp_path):
    frame = spark.createDataFrame([("1", 'a "quoted"\nline'), ("2", "가나")], "id string, t string")
    readers.write_csv(frame, f"file://{tmp_path}/c")
    assert sorted(map(tuple, readers.read_csv(spark, f"file://{tmp_path}/c", ["id", "t", "gone"]).collect())) == [("1", 'a "quoted"\nline', ""), ("2", "가나", "")]
    assert readers.read_csv(spark, f"file://{tmp_path}/none", ["a"]).count() == 0
    readers.write_jsonl(frame, f"file://{tmp_path}/j")
    assert readers.read_jsonl(spark, f"file://{tmp_path}/j", "id string, t string").count() == 2
    (tmp_path / "m").mkdir()
    (tmp_path / "m/art1.txt").write_text("Title\nBody one.\nBody two.")
    assert tuple(readers.read_manual_texts(spark, f"file://{tmp_path}/m").first()) == ("art1", "Title", "Body one.\nBody two.")
    pages = '[{"items": [{"title": "a", "link": "l", "pubDate": "p"}]}, {"items": [{"title": "b", "originallink": "o", "link": "l"}]}]'
    spark.dataSource.register(readers.PagedSource)
    got = spark.read.format("skein_pages").option("pages", pages).load().orderBy("title").collect()
    assert [(r.title, r.link, r.pub_date) for r in got] == [("a", "l", "p"), ("b", "o", None)]


def test_paging_budget_and_bundles(spark):
    calls = []

    def fetch(params):
        calls.append(params["start"])
        return {"total": 250, "items": [{"n": i} for i in range(params["start"], min(params["start"] + params["display"], 251))]}

    assert len(list(readers.search_pages(fetch, "q", readers.CallBudget(10)))) == 250 and calls == [1, 101, 201]
    tight = readers.CallBudget(1)
    with pytest.raises(readers.BudgetExceeded):
        list(readers.search_pages(fetch, "q", tight))
    assert tight.used == 1
    good = "- {bundle_id: b1, label: x, drug_terms: [d], outcome_terms: [o], paper: {doi: '1'}, queries: [q], date_from: 2024-01-01, date_to: 2024-02-01}"
    assert readers.load_bundles(spark, good).count() == 1
    assert readers.select_bundles(readers.load_bundles(spark, good), ["b1", "zz"]).count() == 1
    with pytest.raises(ValueError, match="no bundle"):
        readers.select_bundles(readers.load_bundles(spark, good), ["zz"])
    with pytest.raises(ValueError, match="twice.*no doi.*date_from after"):
        readers.load_bundles(spark, good + "\n- {bundle_id: b1, drug_terms: [d], outcome_terms: [o], queries: [q], date_from: 2024-03-01, date_to: 2024-02-01}")


def test_html_and_charsets(spark):
    page = "<html><head><title>T &amp; x</title><meta property='og:title' content='Real'></head><body><nav>menu</nav><article><p>One  two.</p><figure>cap</figure><p>Three.</p></article><script>x()</script></body></html>"
    assert readers.extract_html(page)[:2] == ("Real", "One two.\nThree.")
    raw = spark.createDataFrame([(bytearray("<meta charset=euc-kr>가나".encode("cp949")),), (bytearray("é".encode()),)], "c binary")
    assert [r.x for r in raw.select(readers.decode_legacy("c").alias("x")).collect()] == ["<meta charset=euc-kr>가나", "é"]
    assert one(spark, readers.parse_jsonp(T, "result struct<n:int>"), t='cb({"result":{"n":3}});').result.n == 3
    assert one(spark, readers.sequence_ratio(T, F.lit("abcd")), t="abcd") == 1.0


def test_streaming_counts(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 10:00:00",), ("2024-01-01 11:00:00",), ("2024-01-05 00:00:00",)], "s string").select(F.to_timestamp("s").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/in")
    q = budget.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select n from counts").collect()) == [1, 2]


def test_titles_ids_and_conditions(spark):
    title = lambda t, o="": one(spark, entities.clean_title(T, F.col("o")), t=t, o=o)
    assert title("[Only] A &quot;new&quot; study - Daily Health News", "Daily Health") == 'A "new" study'
    assert title("A study - of many things that matter", "Daily") == "A study - of many things that matter" and title("A study | KBX") == "A study"
    ids = lambda u: one(spark, entities.portal_ids(T), t=u)
    assert tuple(ids("https://n.news.naver.com/mnews/article/001/0012345678?sid=1")) == ("001", "0012345678") and tuple(ids("https://naver.com/read?oid=22&aid=7")) == ("22", "7") and ids("https://x/article/001/0012345678") is None
    assert one(spark, entities.key_conditions(T, ["dose", "age"]), t="Age; dose,zzz/dose") == ["age", "dose", "dose"] and one(spark, entities.key_conditions(T, ["a"]), t="") == []


def test_clients_budgets_and_retries(tmp_path, monkeypatch):
    answers = {"a": (200, '{"items": []}'), "b": (401, ""), "c": (429, "slow"), "d": (500, "x")}
    asked = []

    def get(url, params, headers):
        asked.append((url, headers))
        return answers[params["query"]]

    day = ["2024-01-01"]
    budget_ = readers.CallBudget(5, path=f"{tmp_path}/b/calls.json", today=lambda: day[0])
    client = readers.SearchClient(get, {"x": ("https://s", "Id", "Key")}, "x", "me", "secret", budget_)
    assert client({"query": "a"}) == {"items": []} and asked == [("https://s", {"Id": "me", "Key": "secret"})]
    for query, error in (("b", readers.AccessDenied), ("c", readers.BudgetExceeded), ("d", OSError)):
        with pytest.raises(error):
            client({"query": query})
    again = readers.CallBudget(5, path=f"{tmp_path}/b/calls.json", today=lambda: day[0])
    assert again.used == 4 and again.remaining == 1
    again.take()
    with pytest.raises(readers.BudgetExceeded):
        again.take()
    day[0] = "2024-01-02"
    assert again.used == 0
    with pytest.raises(ValueError, match="backend"):
        readers.SearchClient(get, {}, "x", "", "", budget_)
    slept, codes = [], iter([503, 429, 200])
    assert readers.with_retries(lambda: (next(codes), "t"), sleep=slept.append)() == (200, "t") and slept == [1.5, 3.0]
    assert readers.with_retries(lambda: (503, ""), tries=2, sleep=slept.append)()[0] == 503
    pages = {1: 'cb({"result": {"commentList": [{"contents": " a ", "commentNo": 1}, {"contents": "b", "deleted": true}, {"contents": ""}], "pageModel": {"lastPage": 2}}});', 2: '{"result": {"commentList": [{"contents": "(c)"}], "pageModel": {"lastPage": 2}}}'}
    assert [c["text"] for c in readers.fetch_comments(pages.__getitem__)] == ["a", "(c)"] and len(list(readers.fetch_comments(pages.__getitem__, 1))) == 1
    (tmp_path / ".env").write_text("SKEIN_A=1\nSKEIN_B='two'\n")
    monkeypatch.setenv("SKEIN_A", "kept")
    monkeypatch.delenv("SKEIN_B", raising=False)
    import os

    readers.load_dotenv(f"{tmp_path}/.env")
    assert (os.environ["SKEIN_A"], os.environ.pop("SKEIN_B")) == ("kept", "two")


def test_written_sheets_begin_with_a_mark(spark, tmp_path):
    readers.write_csv(spark.createDataFrame([("1", "가")], "id string, t string"), f"file://{tmp_path}/s")
    part = next((tmp_path / "s").glob("part-*"))
    assert part.read_bytes() == b"\xef\xbb\xbfid,t\n1,\xea\xb0\x80\n"
    assert readers.read_csv(spark, f"file://{tmp_path}/s", ["id", "t"]).first().id == "1"


def test_relevance_guards_and_literal_terms(spark):
    b = spark.createDataFrame([("b", ["n.th", "vitamin (c"], ["x"], "", "", None, None, None)], "bundle_id string, drug_terms array<string>, outcome_terms array<string>, journal string, first_author string, date_from date, date_to date, published date")
    c = spark.createDataFrame([("b", "nothing", "", ""), ("b", "Vitamin (C and X", "n.th", ""), ("b", "n.th x", "", "2024-01-01")], "bundle_id string, title string, description string, pub_date string")
    got = sorted((r.relevance_score, r.auto_include, r.relevance_reasons) for r in tables.relevance(c, b, {"jama": ["JAMA"]}).collect())
    assert got == [(0, "N", ""), (4, "?", "drug:2; outcome:2"), (4, "?", "drug:2; outcome:2")]


def test_upserts_of_a_stream(spark, tmp_path):
    kept = {"rows": spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")}
    apply = budget.upsert_batches(lambda: kept["rows"], lambda df: kept.update(rows=spark.createDataFrame(df.collect(), df.schema)), ["k"])
    apply(spark.createDataFrame([(2, "B"), (3, "c"), (3, "c")], "k long, v string"), 0)
    assert sorted(map(tuple, kept["rows"].collect())) == [(1, "a"), (2, "B"), (3, "c")]


def test_intervals_as_text(spark):
    shown = lambda e, lo, hi, pct=True: one(spark, text.format_ci(F.lit(e).cast("double"), F.lit(lo).cast("double"), F.lit(hi).cast("double"), pct), t="")
    assert shown(0.5, 0.25, 0.75) == "50.0% [25.0, 75.0]" and shown(None, None, None) == "–" and shown(0.5, None, None) == "50.0%" and shown(1.5, 1, 2, False) == "1.5 [1.0, 2.0]"
