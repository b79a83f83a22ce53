"""python -m skein COMMAND: the steps of a study in a folder, and the query catalog.

Network steps read keys and backends from the environment or the folder's .env; see each command's help.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from skein.functions.lexicon import KOREAN, Lexicon
from skein.plans import catalog
from skein.plans.report import to_markdown
from skein.plans.session import ship
from skein.plans.workspace import Workspace, http_get
from skein.sources import demo, policy, readers

#: Study steps: name, help.
STEPS = {
    "status": "counts per bundle and coders' progress", "discover": "groups of reports on one finding, from a search",
    "fetch-papers": "metadata and abstracts of the bundles' papers", "search-news": "candidates from a search API", "seed-candidates": "candidates that the bundles know already",
    "import-list": "candidates of one bundle from an exported spreadsheet or CSV file", "scrape": "texts of chosen candidates", "collect-comments": "comments of articles on the portal",
    "precode": "feature rows and coders' sheets", "annotate": "ask a coder article by article", "agreement": "coders against each other and against the automatic codes",
    "finalize": "final codes", "analyze": "tables, figures and the report", "demo": "a synthetic study through all steps",
}


def session() -> SparkSession:
    return ship(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate())


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="skein", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="write a query's result as Parquet")
    run.add_argument("name", choices=sorted(catalog.QUERIES))
    run.add_argument("tables", help="folder of the input tables")
    run.add_argument("out")
    plan = commands.add_parser("search-plan", help="calls that a search would take; nothing is sent")
    plan.add_argument("queries", nargs="+")
    plan.add_argument("--max-results", type=int, default=300)
    for name, what in STEPS.items():
        step = commands.add_parser(name, help=what)
        step.add_argument("root", help="the study's folder")
        step.add_argument("--lexicon", help="YAML file of the lexicon")
        if name in ("fetch-papers", "search-news", "seed-candidates", "import-list"):
            step.add_argument("--bundle", default="", help="bundle ids with commas between; all without")
        if name in ("search-news", "discover"):
            step.add_argument("--max-results", type=int, default=300)
            step.add_argument("--estimate", action="store_true", help="only say how many calls it would take")
        if name == "discover":
            step.add_argument("--drugs", nargs="+", default=[])
            step.add_argument("--outcomes", nargs="+", default=[])
            step.add_argument("--template", nargs="+", default=["{alias}"])
        if name == "import-list":
            step.add_argument("file")
        if name == "scrape":
            step.add_argument("--use-auto", action="store_true")
            step.add_argument("--force", action="store_true")
        if name in ("scrape", "collect-comments"):
            step.add_argument("--delay", type=float, default=2.0)
        if name == "collect-comments":
            step.add_argument("--accept-terms", action="store_true", help="the portal's terms were read and allow it")
            step.add_argument("--url", help="address of the comment pages with {oid}, {aid} and {page}")
        if name in ("status", "precode", "agreement", "finalize"):
            step.add_argument("--coders", nargs="+", default=["coder1", "coder2"])
        if name == "precode":
            step.add_argument("--blind", nargs="*", default=["coder2"])
            step.add_argument("--most", type=int, default=5, help="articles per bundle, 0 for all")
        if name == "annotate":
            step.add_argument("--coder", required=True)
        if name == "analyze":
            step.add_argument("--source", default="final", help="final, auto or a coder")
            step.add_argument("--allow-auto", action="store_true", help="proposals where nobody coded the paper")
        if name in ("analyze", "demo"):
            step.add_argument("--n-boot", type=int, default=2000 if name == "analyze" else 500)
        if name == "demo":
            step.add_argument("--bundles", type=int, default=8)
            step.add_argument("--seed", type=int, default=7)
    return parser


def _client(root: str) -> readers.SearchClient:
    """A search client from SEARCH_ID, SEARCH_SECRET, SEARCH_BACKENDS (JSON: name to address and two header names), SEARCH_BACKEND and SEARCH_DAILY_CALLS."""
    need = {k: os.environ.get(k, "") for k in ("SEARCH_ID", "SEARCH_SECRET", "SEARCH_BACKENDS", "SEARCH_BACKEND")}
    if missing := [k for k, v in need.items() if not v]:
        raise ValueError(f"set {', '.join(missing)}")
    budget = readers.CallBudget(int(os.environ.get("SEARCH_DAILY_CALLS", 1000)), path=f"{root}/search_calls.json")
    backends = {k: tuple(v) for k, v in json.loads(need["SEARCH_BACKENDS"]).items()}
    return readers.SearchClient(lambda url, params, headers: http_get(url, params, headers), backends, need["SEARCH_BACKEND"], need["SEARCH_ID"], need["SEARCH_SECRET"], budget, policy.Pace(0.2).wait)


def build_demo(w: Workspace, n: int, seed: int) -> None:
    """The tables of a synthetic study, coded by two coders."""
    bundles, articles = demo.demo_bundles(w.spark, n), demo.demo_articles(w.spark, n, seed=seed)
    rows = [{"bundle_id": b.bundle_id, "label": b.label, "drug_terms": list(b.drug_terms), "outcome_terms": list(b.outcome_terms), "paper": dict(b.paper), "queries": list(b.queries), "date_from": str(b.date_from), "date_to": str(b.date_to)} for b in bundles.collect()]
    with open(f"{w.root}/bundles.yaml", "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False)  # JSON is YAML
    with open(f"{w.root}/SYNTHETIC", "w", encoding="utf-8") as f:
        f.write("All of this is made up.\n")
    readers.write_jsonl(articles, w.path("articles"))
    readers.write_jsonl(demo.demo_comments(articles, seed=seed), w.path("comments"))
    w.save(demo.demo_candidates(articles, seed), "candidates")
    w.save(demo.demo_papers(bundles, seed), "paper_coding")
    w.precode(most=0)
    for k, coder in enumerate(("coder1", "coder2")):
        codes = demo.demo_codes(w.features(), k + 1, seed)
        sheet = w.sheet(f"article_coding_{coder}")
        w.save(sheet.drop(*codes.columns[1:]).join(codes, "article_id").select(*sheet.columns), f"article_coding_{coder}")


DEMO_LEXICON = Lexicon(KOREAN.sections | {
    "conditions": {"population": ["참가자", "복용자"], "design": ["관찰 연구"], "limitation": ["한계", "다만"]}, "hedges": ["필요"], "boosters": ["획기적"], "sensational": ["충격"],
    "advice": {"3": ["중단"], "2": ["상담"], "1": ["주의"]}, "attribution": ["연구진"], "reactions": {"anxiety": ["무섭"], "distrust": ["못 믿"], "reassurance": ["좋은"]},
})


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = session()
    if args.command == "run":
        catalog.QUERIES[args.name](spark, args.tables).write.mode("overwrite").parquet(args.out)
        return 0
    if args.command == "search-plan":
        queries = spark.createDataFrame([(q,) for q in args.queries], "query string")
        print(readers.page_plan(queries, args.max_results).count(), "calls")
        return 0
    readers.load_dotenv(f"{args.root}/.env")
    lexicon = Lexicon.load(args.lexicon) if args.lexicon else DEMO_LEXICON
    w = Workspace(spark, args.root, lexicon)
    only = [x for x in getattr(args, "bundle", "").split(",") if x]
    try:
        return _step(w, args, only)
    except (FileNotFoundError, ValueError, readers.AccessDenied) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _step(w: Workspace, args: argparse.Namespace, only: list[str]) -> int:
    spark, c = w.spark, args.command
    if c == "status":
        print(w.status(args.coders))
    elif c == "discover":
        aliases = spark.createDataFrame([(d, d) for d in args.drugs], "drug string, alias string")
        queries = readers.discovery_queries(aliases, spark.createDataFrame([(t,) for t in args.template], "template string"))
        print("at most", readers.page_plan(queries, args.max_results).count(), "calls")
        if not args.estimate:
            print(to_markdown(w.discover(_client(w.root), queries, args.outcomes, args.max_results)))
    elif c == "fetch-papers":
        print(to_markdown(w.fetch_papers(readers.with_retries(http_get), only).select("bundle_id", "title", "fetch_status")))
    elif c == "search-news":
        queries = w.bundles(only).selectExpr("explode(queries) as query")
        print("at most", readers.page_plan(queries, args.max_results).count(), "calls")
        if not args.estimate:
            print(w.search_news(_client(w.root), only, args.max_results).count(), "candidates")
    elif c == "seed-candidates":
        print(w.seed_candidates(only).count(), "candidates")
    elif c == "import-list":
        print(w.import_list(args.file, only[0] if only else "").count(), "candidates")
    elif c == "scrape":
        print(to_markdown(w.scrape(readers.with_retries(http_get), args.use_auto, args.delay, args.force).groupBy("flag").count()))
    elif c == "collect-comments":
        if not args.accept_terms or not args.url:
            raise ValueError("read the portal's terms, then give --accept-terms and --url")
        pace = policy.Pace(args.delay)

        def page(oid: str, aid: str, n: int) -> str:
            pace.wait()
            status, text = http_get(args.url.format(oid=oid, aid=aid, page=n))
            if status >= 400:
                raise OSError(f"status {status}")
            return text

        print(w.collect_comments(page), "comments")
    elif c == "precode":
        print(w.precode(args.coders, args.blind, args.most), "articles to code")
    elif c == "annotate":
        done, total = w.annotate(args.coder, lambda field, shown: input(f"{shown}\n  {field} (q ends, s skips) > "))
        print(f"{done} of {total}")
    elif c == "agreement":
        table = w.agreement(args.coders)
        print(to_markdown(table) if table is not None else "nothing to compare")
    elif c == "finalize":
        print(w.finalize(args.coders).count(), "final codes")
    elif c == "analyze":
        w.analyze(args.source, args.allow_auto, args.n_boot)
        print(f"{w.root}/report.md")
    elif c == "demo":
        build_demo(w, args.bundles, args.seed)
        w.agreement(("coder1", "coder2"))
        w.finalize(("coder1", "coder2"))
        w.analyze("final", n_boot=args.n_boot)
        print(f"{w.root}/report.md")
    return 0


if __name__ == "__main__":
    sys.exit(main())
