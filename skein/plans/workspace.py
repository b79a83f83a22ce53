"""A study's folder: its tables as CSV and JSONL, and the steps that fill them, each from what the steps before left.

Tables that people edit are small (a row per candidate, article or paper), so each is one CSV file.
"""

from __future__ import annotations

import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.lexicon import ENGLISH, KOREAN, Lexicon
from skein.operators import agreement, dataset, features, papers, tables
from skein.plans.report import Study, run_analysis, to_markdown
from skein.plans.session import cut_lineage
from skein.sources import policy, readers

CANDIDATES = ["candidate_id", "bundle_id", "source", "query", "pub_date", "outlet", "outlet_type", "title", "description", "url", "naver_url", "relevance_score", "auto_include", "relevance_reasons"]
CANDIDATE_HUMAN = ["include", "link_type", "paper_match_evidence", "candidate_notes"]
ARTICLE = "article_id string, bundle_id string, outlet string, outlet_type string, title string, body string, status string, url string, naver_url string, fetched_url string"
COMMENT = "article_id string, comment_id string, text string, reg_time string, likes long, dislikes long"
# The column names of exported lists.
COLUMN_NAMES = {"pub_date": ["일자", "날짜", "date"], "outlet": ["언론사", "매체", "media"], "title": ["제목", "title"], "description": ["본문", "내용", "content"], "url": ["URL", "url", "링크"]}
REACTIONS = ("anxiety", "distrust", "reassurance")


def http_get(url: str, params: Mapping | None = None, headers: Mapping | None = None) -> tuple[int, str]:
    """(status, text) of one request; a server that can't be reached is status 599."""
    asked = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}" if params else url, headers=dict(headers or {}))
    try:
        with urllib.request.urlopen(asked, timeout=20) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""
    except OSError:
        return 599, ""


class Workspace:
    def __init__(self, spark: SparkSession, root: str, lexicon: Lexicon = KOREAN, journals: Mapping[str, Sequence[str]] | None = None, outlets: DataFrame | None = None):
        self.spark, self.root, self.lexicon, self.journals = spark, os.path.abspath(root), lexicon, journals or {}
        self.outlets = outlets if outlets is not None else spark.createDataFrame([], "outlet string, outlet_type string, domain string")
        os.makedirs(self.root, exist_ok=True)

    def path(self, name: str) -> str:
        return f"file://{self.root}/{name}"

    def sheet(self, name: str) -> DataFrame | None:
        """A CSV table with all its columns as text, or None."""
        if not readers.exists(self.spark, self.path(name)):
            return None
        header = self.spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(self.path(name)).columns
        return readers.read_csv(self.spark, self.path(name), [c.lstrip("﻿") for c in header])

    def save(self, df: DataFrame, name: str) -> None:
        """Written whole before it takes the old table's place, which it may have been read from."""
        readers.write_csv(cut_lineage(df), self.path(name))

    def bundles(self, only: Sequence[str] = ()) -> DataFrame:
        with open(f"{self.root}/bundles.yaml", encoding="utf-8") as f:
            b = readers.select_bundles(readers.load_bundles(self.spark, f.read()), only)
        given = lambda k: F.coalesce(F.element_at("paper", F.lit(k)), F.lit(""))
        known = F.transform("known_articles", lambda a: F.struct(*[F.element_at(a, F.lit(k)).alias(k) for k in ("title_hint", "url", "outlet", "date")]))
        return b.withColumns({"journal": given("journal"), "first_author": given("first_author"), "published": F.try_to_date(F.substring(given("published"), 1, 10), "yyyy-MM-dd"), "known_articles": known})

    def articles(self) -> DataFrame:
        return readers.read_jsonl(self.spark, self.path("articles"), ARTICLE)

    def comments(self) -> DataFrame:
        return readers.read_jsonl(self.spark, self.path("comments"), COMMENT)

    def old(self, name: str, columns: Sequence[str]) -> DataFrame:
        found = self.sheet(name)
        return found if found is not None else self.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))

    # ---- steps
    def save_candidates(self, new: DataFrame) -> DataFrame:
        new = new.withColumns({c: F.lit("") for c in CANDIDATES if c not in new.columns}).withColumn("place", F.monotonically_increasing_id())
        self.save(tables.save_candidates(cut_lineage(new), self.old("candidates", [*CANDIDATES, *CANDIDATE_HUMAN]), [*CANDIDATES, *CANDIDATE_HUMAN], CANDIDATE_HUMAN), "candidates")
        return self.sheet("candidates")

    def seed_candidates(self, only: Sequence[str] = ()) -> DataFrame:
        return self.save_candidates(tables.seed_candidates(self.bundles(only), self.outlets, self.journals))

    def search_news(self, client: Callable[[dict], dict], only: Sequence[str] = (), most: int = 300) -> DataFrame:
        """Candidates of all queries of the bundles; a used-up budget ends the search, and what was found is kept."""
        bundles, rows = self.bundles(only), []
        try:
            for b in bundles.select("bundle_id", "queries").collect():  # configuration
                for q in b.queries:
                    rows += [(b.bundle_id, q, i.get("title"), i.get("description"), i.get("originallink") or i.get("original_link") or "", i.get("link") or "", i.get("pubDate") or i.get("pub_date") or "") for i in readers.search_pages(client, q, None, most)]
        except readers.BudgetExceeded as e:
            print(e)
        from skein.functions.entities import clean_api_text, parse_pubdate, resolve_outlets

        found = self.spark.createDataFrame(rows, "bundle_id string, query string, title string, description string, original string, naver_url string, pub string")
        found = found.withColumns({"title": clean_api_text(F.coalesce("title", F.lit(""))), "description": clean_api_text(F.coalesce("description", F.lit(""))), "naver_url": F.when(F.contains("naver_url", F.lit("naver.com")), F.col("naver_url")).otherwise(""), "pub_date": F.coalesce(F.substring(parse_pubdate(F.col("pub")), 1, 16), F.lit(""))})
        found = resolve_outlets(found.withColumn("url", F.when(F.col("original") != "", F.col("original")).otherwise(F.col("naver_url"))), self.outlets).drop("original", "pub")
        return self.save_candidates(tables.candidate_ids(tables.in_window(tables.relevance(found, bundles, self.journals), bundles)).withColumn("source", F.lit("search")))

    def discover(self, client: Callable[[dict], dict], queries: DataFrame, outcomes: Sequence[str], most: int = 100) -> DataFrame:
        """Groups of reports (queries: drug, query) that name an outcome and a journal; a used-up budget ends the search."""
        from skein.functions.entities import clean_api_text, find_journals, normalize_url, parse_pubdate, resolve_outlets
        from skein.functions.text import contains_any

        rows = []
        try:
            for q in queries.select("drug", "query").collect():  # configuration
                for i in readers.search_pages(client, q.query, None, most):
                    rows.append((len(rows), q.drug, i.get("title"), i.get("description"), i.get("originallink") or i.get("link") or "", i.get("pubDate") or ""))
        except readers.BudgetExceeded as e:
            print(e)
        hits = self.spark.createDataFrame(rows, "n long, drug string, title string, description string, url string, pub string")
        said = F.concat_ws(" ", clean_api_text(F.coalesce("title", F.lit(""))), clean_api_text(F.coalesce("description", F.lit(""))))
        hits = resolve_outlets(hits, self.outlets).withColumns({"outcomes": F.slice(contains_any(said, outcomes), 1, 2), "journals": F.slice(find_journals(said, self.journals), 1, 2), "month": F.coalesce(F.substring(parse_pubdate(F.col("pub")), 1, 7), F.lit("")), "url": normalize_url(F.col("url")), "title": clean_api_text(F.col("title"))})
        found = tables.discover(hits, "n").withColumns({"picked": F.lit(""), "paper_doi": F.lit(""), "notes": F.lit("")})
        self.save(found, "bundle_candidates")
        return self.sheet("bundle_candidates")

    def import_list(self, file: str, bundle_id: str) -> DataFrame:
        """Candidates of one bundle from an exported .xlsx or CSV file, beside those there are."""
        from skein.sources import spreadsheets

        bundles = self.bundles([bundle_id])
        path = f"file://{os.path.abspath(file)}"
        rows = spreadsheets.read_xlsx(self.spark, path) if file.lower().endswith(".xlsx") else self.spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        rows = spreadsheets.import_candidates(rows, bundle_id, COLUMN_NAMES, os.path.basename(file))
        return self.save_candidates(tables.score_imported(rows, bundles, self.outlets, self.journals, "list"))

    def fetch_papers(self, get: Callable[..., tuple[int, str]], only: Sequence[str] = ()) -> DataFrame:
        """Works by DOI from Crossref and Europe PMC; answers are kept as they came, a source that does not answer is not found."""
        bundles, got = self.bundles(only), []
        for b in bundles.select("bundle_id", "paper").collect():  # configuration
            doi = (b.paper or {}).get("doi", "")
            a = get(f"https://api.crossref.org/works/{doi}") if doi else (404, "")
            e = get("https://www.ebi.ac.uk/europepmc/webservices/rest/search", {"query": f'DOI:"{doi}"', "resultType": "core", "format": "json", "pageSize": 1}) if doi else (404, "")
            got.append((b.bundle_id, a[1] if a[0] < 400 else None, e[1] if e[0] < 400 else None))
        raw = self.spark.createDataFrame(got, "bundle_id string, crossref string, europepmc string")
        crossref = raw.withColumn("m", F.from_json("crossref", f"message {papers.CROSSREF}")["message"]).filter("m is not null").select("bundle_id", papers.crossref_record(F.col("m")).alias("r"))
        pmc = raw.select("bundle_id", papers.europe_pmc_record(F.from_json("europepmc", papers.EUROPE_PMC)).alias("r")).filter("r is not null")
        designs = Lexicon({"designs": self.lexicon.sections.get("designs", {})})
        rows = papers.paper_rows(bundles, crossref, pmc, designs, ENGLISH, list(designs.sections["designs"]))
        rows = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
        old = self.sheet("papers")
        self.save(rows if old is None else tables.upsert(old, rows, ["bundle_id"]).na.fill(""), "papers")
        return self.sheet("papers")

    def scrape(self, get: Callable[[str], tuple[int, str]], use_auto: bool = False, delay: float = 2.0, force: bool = False) -> DataFrame:
        """Texts of chosen candidates: a person's file, else what was fetched before, else the publisher's page, else the portal's."""
        chosen = tables.selected_candidates(self.sheet("candidates"), use_auto)
        manual = readers.read_manual_texts(self.spark, self.path("manual_texts/*.txt")) if os.path.isdir(f"{self.root}/manual_texts") else self.spark.createDataFrame([], "article_id string, title string, body string")
        existing = cut_lineage(self.articles())
        done = manual.select("article_id").unionByName(existing.filter("status = 'ok'" if not force else "false").select("article_id"))
        todo = chosen.join(done.withColumnRenamed("article_id", "candidate_id"), "candidate_id", "left_anti").select("candidate_id", "url", "naver_url").collect()  # paced by the second, so a list
        robots, pace, tries = policy.Robots(get), policy.Pace(delay), []
        for c in todo:
            for rank, url in enumerate((c.url, c.naver_url)):
                if url:
                    status, title, body = policy.fetch_status(url, robots, pace, get, readers.extract_html)
                    tries.append((c.candidate_id, rank, status, title, body))
                    if status == "ok":
                        break
        fetched = self.spark.createDataFrame(tries, "article_id string, rank int, status string, title string, body string")
        best = tables.best_texts(chosen, manual, existing if not force else existing.withColumn("status", F.lit("old")), fetched)
        about = chosen.select(F.col("candidate_id").alias("article_id"), "outlet", "outlet_type", "url", "naver_url").unionByName(existing.select("article_id", "outlet", "outlet_type", "url", "naver_url")).dropDuplicates(["article_id"])
        rows = cut_lineage(best.drop("origin").join(about, "article_id", "left").withColumn("fetched_url", F.col("url")))
        readers.write_jsonl(rows, self.path("articles"))
        checked = tables.text_check(self.articles()).select(*[F.col(c).cast("string") for c in ("article_id", "flag", "body_len", "head", "tail")])
        self.save(tables.merge_preserving(checked, self.old("text_check", ["article_id", "text_ok", "text_fix_notes"]), ["article_id"], ["text_ok", "text_fix_notes"]), "text_check")
        return self.sheet("text_check")

    def collect_comments(self, get: Callable[[str, str, int], str], most: int = 200) -> int:
        """Comments of articles on the portal that have none yet; get(oid, aid, page) gives a page's text. An article that fails is asked again next time."""
        from skein.functions.text import stable_id

        rows = []
        for a in tables.pending_comments(self.articles(), self.comments()).collect():  # paced by the second, so a list
            try:
                rows += [(a.article_id, a.oid, a.aid, str(c["comment_no"]), c["text"], str(c["reg_time"]), int(c["likes"]), int(c["dislikes"])) for c in readers.fetch_comments(lambda page, a=a: get(a.oid, a.aid, page), most)]
            except (OSError, ValueError) as e:
                print(f"{a.article_id}: {e}")
        new = self.spark.createDataFrame(rows, "article_id string, oid string, aid string, no string, text string, reg_time string, likes long, dislikes long")
        new = new.select("article_id", stable_id(F.col("oid"), F.col("aid"), F.col("no"), F.col("text")).alias("comment_id"), "text", "reg_time", "likes", "dislikes")
        readers.write_jsonl(cut_lineage(self.comments().unionByName(new)), self.path("comments"))
        return self.comments().count()

    def features(self) -> DataFrame:
        return self.spark.read.parquet(self.path("features"))

    def precode(self, coders: Sequence[str] = ("coder1", "coder2"), blind: Sequence[str] = ("coder2",), most: int = 5) -> int:
        """The sheet of papers, the feature rows of chosen articles, and a sheet per coder."""
        bundles = self.bundles()
        fetched = self.old("papers", dataset.PAPER_SHEET)
        known = bundles.select("bundle_id", *[F.coalesce(F.element_at("paper", F.lit(k)), F.lit("")).alias(k) for k in ("doi", "title", "journal", "published")])
        self.save(dataset.paper_sheet(fetched if not fetched.isEmpty() else known, bundles, self.sheet("paper_coding")), "paper_coding")
        bad = self.old("text_check", ["article_id", "text_ok"]).filter("upper(text_ok) = 'N'")
        out = self.old("candidates", ["candidate_id", "include"]).filter("upper(include) = 'N'").withColumnRenamed("candidate_id", "article_id")
        selection, rows = features.precode(self.articles(), bundles, bad, out, most, lexicon=self.lexicon, journals=self.journals)
        self.save(selection, "selection")
        rows.write.mode("overwrite").parquet(self.path("features"))
        for coder in coders:
            sheet = dataset.coding_sheet(self.features(), self.sheet("paper_coding"), self.lexicon.subkeys("conditions"), coder in blind, self.sheet(f"article_coding_{coder}"))
            self.save(sheet, f"article_coding_{coder}")
        return self.features().count()

    def annotate(self, coder: str, ask: Callable[[str, str], str]) -> tuple[int, int]:
        """Asks for each field of each article that has no title level (ask(field, shown) gives the answer; 'q' ends, 's' skips); saves after every article."""
        name = f"article_coding_{coder}"
        for row in self.sheet(name).filter("trim(title_strength) = ''").collect():
            answers = {}
            for field in dataset.ARTICLE_HUMAN:
                allowed = papers.ALLOWED.get(field)
                while True:
                    answer = ask(field, row["title"]).strip()
                    if answer in ("q", "s") or allowed is None or answer.lower() in (a.lower() for a in allowed):
                        break
                if answer in ("q", "s"):
                    break
                answers[field] = answer
            if answer == "q":
                break
            if answer != "s":
                given = self.spark.createDataFrame([(row["article_id"], *answers.values())], ", ".join(f"`{c}` string" for c in ("article_id", *answers)))
                sheet = self.sheet(name)
                kept = sheet.filter(F.col("article_id") != row["article_id"])
                self.save(kept.unionByName(sheet.drop(*answers).join(given, "article_id")).select(*sheet.columns), name)
        return tuple(papers.coding_progress(self.sheet(name)).first())

    def sheets(self, coders: Sequence[str]) -> dict[str, DataFrame]:
        return {c: s for c in coders if (s := self.sheet(f"article_coding_{c}")) is not None}

    def agreement(self, coders: Sequence[str]) -> DataFrame | None:
        f = self.features().withColumn("article_id", F.col("article_id").cast("string"))
        table, apart = agreement.run_agreement(self.sheets(coders), f, self.sheet("disagreements"))
        if apart is not None:
            self.save(apart, "disagreements")
        if table is not None:
            self.save(table, "agreement")
        return table

    def finalize(self, coders: Sequence[str]) -> DataFrame:
        sheets = self.sheets(coders)
        if not sheets:
            raise FileNotFoundError("no coders' sheets")
        resolved = self.old("disagreements", ["article_id", "field", "resolved"]).select("article_id", "field", "resolved")
        final = agreement.finalize(list(sheets.values()), resolved, "article_id", [f for f in dataset.ARTICLE_HUMAN if f != "coder_notes"])
        self.save(final.withColumn("coders", F.lit("+".join(sheets))), "article_coding_final")
        return self.sheet("article_coding_final")

    def analyze(self, source: str = "final", allow_auto: bool = False, n_boot: int = 2000) -> str:
        f = self.features()
        f = f.withColumn("article_id", F.col("article_id").cast("string"))
        codes = dataset.load_codes(f, source, None if source == "auto" else self.sheet(f"article_coding_{source}"))
        d = dataset.build_dataset(f, codes, dataset.load_papers(self.sheet("paper_coding"), allow_auto or source == "auto"), source)
        if d.isEmpty():
            raise ValueError("no coded articles")
        comments = self.comments()
        kinds = [r for r in REACTIONS if r in (self.lexicon.sections.get("reactions") or {})]
        coded = None if comments.isEmpty() or not kinds else comments.select("article_id", "text", *[self.lexicon.any_(F.col("text"), "reactions", r).cast("int").alias(r) for r in kinds])
        study = Study(d, self.articles(), self.bundles(), self.lexicon.subkeys("conditions"), coded, kinds, self.sheet("agreement"), self.sheet("candidates"))
        return run_analysis(study, self.root, n_boot, source)

    def status(self, coders: Sequence[str] = ("coder1", "coder2")) -> str:
        counts = {"candidates": self.old("candidates", ["bundle_id"]), "included": self.old("candidates", ["bundle_id", "include"]).filter("upper(include) = 'Y'"), "texts": self.articles().filter("status = 'ok'")}
        if readers.exists(self.spark, self.path("features")):
            counts["coded"] = self.features()
        shown = to_markdown(tables.status_table(self.bundles().select("bundle_id"), counts, "texts").orderBy("bundle_id"))
        for coder, sheet in self.sheets(coders).items():
            done, total = papers.coding_progress(sheet).first()
            shown += f"\n\n{coder}: {done} of {total}"
        return shown
