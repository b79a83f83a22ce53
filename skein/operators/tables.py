"""Table lifecycle: human-preserving upserts, usable rows, stratified selection, sheets, sequential dedupe, budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.entities import find_journals, normalize_url, portal_ids, resolve_outlets
from skein.functions.text import literal, stable_id, terms_pattern
from skein.plans.session import cut_lineage


def merge_preserving(new: DataFrame, old: DataFrame, key: Sequence[str], human: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """New automatic values win, human columns stay as they were, rows gone from new stay with _stale = 'Y'.

    Of several old rows with a key the first in `order` gives the human values; all of them stay if stale. Without the
    key columns in old, new is returned as it is. Missing columns are ''.
    """
    key = list(key)
    if any(k not in old.columns for k in key):
        return new
    kept = [h for h in human if h in old.columns]
    first = Window.partitionBy(*key).orderBy(*[F.col(c) for c in order or key])
    lookup = old.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*key, *[F.col(h).alias(f"_old_{h}") for h in kept], F.lit(True).alias("_seen"))
    merged = new.join(lookup, key, "left")
    for h in human:
        mine = F.col(h) if h in new.columns else F.lit("")
        merged = merged.withColumn(h, F.when(F.col("_seen"), F.coalesce(f"_old_{h}", F.lit(""))).otherwise(mine) if h in kept else mine)
    merged = merged.drop("_seen", *[f"_old_{h}" for h in kept])
    stale = old.join(new.select(*key).distinct(), key, "left_anti").withColumn("_stale", F.lit("Y"))
    return merged.unionByName(stale, allowMissingColumns=True).na.fill("")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of new replace old rows with their key."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def usable(articles: DataFrame, text_bad: DataFrame, excluded: DataFrame, key: str = "article_id") -> DataFrame:
    """Fetched articles with a body, without those marked unreadable or excluded."""
    good = articles.filter("status = 'ok' and body <> ''")
    return good.join(text_bad.select(key), key, "left_anti").join(excluded.select(key), key, "left_anti")


def selected_candidates(rows: DataFrame, use_auto: bool = False) -> DataFrame:
    """include = Y, or (use_auto) blank with auto_include = Y; never background or unrelated links. Missing columns are blank."""
    of = lambda c: F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) if c in rows.columns else F.lit("")
    chosen = (of("include") == "Y") | ((of("include") == "") & (of("auto_include") == "Y") if use_auto else F.lit(False))
    return rows.filter(chosen & ~of("link_type").isin("BACKGROUND", "UNRELATED"))


def stratified(rows: DataFrame, group: str, stratum: str, key: str, most: int, seed: str = "42") -> DataFrame:
    """rows with selected (Y/N): at most `most` of each group, taken round by round over its strata in hashed order; most <= 0: all.

    Only the first `most` of a stratum and then of a group are numbered, which Spark cuts before the shuffle, so no
    task gets a whole group; rows learn their choice by a join on their key. Rows with the same key share it.
    """
    if most <= 0:
        return rows.withColumn("selected", F.lit("Y"))
    h = lambda c: F.md5(F.concat_ws("|", F.lit(seed), F.col(c).cast("string")).cast("binary"))
    narrow = rows.select(F.col(group).alias("_g"), F.col(stratum).alias("_s"), F.col(key).alias("_k"), h(stratum).alias("_hs"), h(key).alias("_hk"))
    turn = F.row_number().over(Window.partitionBy("_g", "_s").orderBy("_hk", "_k"))
    place = F.row_number().over(Window.partitionBy("_g").orderBy("_turn", "_hs", "_hk", "_k"))
    chosen = narrow.withColumn("_turn", turn).filter(F.col("_turn") <= most).withColumn("_place", place).filter(F.col("_place") <= most).select("_k").distinct()
    chosen = chosen.withColumn("_chosen", F.lit("Y"))
    return rows.join(chosen, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("selected", F.coalesce("_chosen", F.lit("N"))).drop("_k", "_chosen")


def text_check(articles: DataFrame, short: int = 400) -> DataFrame:
    body = F.coalesce("body", F.lit(""))
    flag = F.when(F.col("status") != "ok", "manual_needed").when(F.length(body) < short, "check_short").otherwise("ok")
    return articles.select("article_id", flag.alias("flag"), F.length(body).alias("body_len"), F.substring(body, 1, 150).alias("head"), F.right(body, F.lit(120)).alias("tail"))


def dedupe(rows: DataFrame, order: str) -> DataFrame:
    """Candidates in arrival order: a row whose bundle and normalised URL, or bundle, outlet and bare title, were met before
    gives its query to the survivor (the URL's before the title's) and registers nothing.

    Done in rounds over keys: undecided rows that are the first of both their keys stay, and what shares a key with
    them goes, until none is undecided. Each round is written out; minima are taken before the shuffle and only
    (key, minimum) is joined, so a group of any size stays spread. order has one value per row; a row without a URL
    has a URL key of its own; a null or empty query adds nothing.
    """
    url = F.when(F.col("norm_url") != "", F.to_json(F.struct("bundle_id", "norm_url")))
    keyed = rows.select(F.col(order).alias("_o"), F.coalesce(url, F.concat(F.lit("row "), F.col(order).cast("string"))).alias("_u"), F.to_json(F.struct("bundle_id", "outlet", "bare_title")).alias("_t"), F.col("query").alias("_q"))
    keyed = undecided = cut_lineage(keyed)
    kept = None
    while not undecided.isEmpty():
        firsts = [undecided.groupBy(k).agg(F.min("_o").alias(f"_first{k}")) for k in ("_u", "_t")]
        placed = undecided.join(firsts[0], "_u").join(firsts[1], "_t")
        leads = (F.col("_o") == F.col("_first_u")) & (F.col("_o") == F.col("_first_t"))
        placed = cut_lineage(placed.select("_o", "_u", "_t", leads.alias("_leads")))
        new = placed.filter("_leads").select("_o", "_u", "_t")
        kept = new if kept is None else kept.unionByName(new)
        undecided = cut_lineage(placed.filter("not _leads").join(new.select("_u"), "_u", "left_anti").join(new.select("_t"), "_t", "left_anti").select("_o", "_u", "_t"))
    if kept is None:
        return rows
    own = kept.select("_o", F.lit(True).alias("_stays"))
    gone = keyed.join(own, "_o", "left").filter("_stays is null").drop("_stays")
    gone = gone.join(kept.select("_u", F.col("_o").alias("_by_u")), "_u", "left").join(kept.select("_t", F.col("_o").alias("_by_t")), "_t", "left")
    into = F.when(F.col("_by_u") < F.col("_o"), F.col("_by_u")).otherwise(F.col("_by_t"))
    # distinct queries in order of their first row: a later copy would be in the text already
    given = gone.filter("_q <> ''").groupBy(into.alias("_into"), "_q").agg(F.min("_o").alias("_o"))
    lists = given.groupBy("_into").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_q"))), lambda x: x["_q"]).alias("_more"))
    joined = lambda acc, q: F.when(F.contains(acc, q), acc).when(acc == "", q).otherwise(F.concat(acc, F.lit(" | "), q))
    query = F.when(F.col("_more").isNull(), F.col("query")).otherwise(F.aggregate("_more", F.coalesce("query", F.lit("")), joined))
    stay = rows.join(own, F.col(order) == F.col("_o"), "left_semi").join(lists, F.col(order) == F.col("_into"), "left")
    return stay.withColumn("query", query).select(*rows.columns)


def save_candidates(new: DataFrame, old: DataFrame, columns: Sequence[str], human: Sequence[str], key: str = "candidate_id") -> DataFrame:
    """The candidate table after a search: new rows, deduped in the order of `place` where they have it, with the human
    entries of old ones, and old rows that were not found again.

    Sorted by bundle, best score first; a score that is no number is 0.
    """
    if "place" in new.columns:
        bare = F.regexp_replace(F.coalesce("title", F.lit("")), r"(?U)\W+", "")
        url = F.when(F.coalesce("url", F.lit("")) != "", normalize_url(F.col("url")))
        new = dedupe(new.withColumns({"norm_url": url, "bare_title": bare}), "place").drop("norm_url", "bare_title", "place")
    shown = [F.col(c) if c in new.columns else F.lit("").alias(c) for c in columns]
    gone = old.join(new.select(key), key, "left_anti").select(*[c for c in columns if c in old.columns])
    every = new.select(*shown).unionByName(gone, allowMissingColumns=True)
    merged = merge_preserving(every, old, [key], human).drop("_stale")
    score = F.coalesce(F.try_to_number(F.col("relevance_score").cast("string"), F.lit("S999999999")).cast("int"), F.lit(0))
    return merged.withColumn("relevance_score", score).orderBy("bundle_id", F.desc("relevance_score"), key)


def daily_budget(calls: DataFrame, ts: str, key: str, limit: int) -> DataFrame:
    """Whether each call is within its day's limit, counted before the call. Seconds are counted apart first, so no window holds an hour or a day of calls."""
    rows = calls.withColumn("_day", F.to_date(ts)).withColumn("_second", F.date_trunc("second", F.col(ts)))
    counts = rows.groupBy("_day", "_second").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_day").orderBy("_second").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_day", "_second").orderBy(ts, key))
    return rows.withColumn("_i", inside).join(base, ["_day", "_second"]).withColumn("used", (F.col("_base") + F.col("_i")).cast("long")).withColumn("allowed", F.col("used") <= limit).withColumn("day", F.col("_day").cast("string")).drop("_day", "_second", "_base", "_i")


def status_table(bundles: DataFrame, counts: dict[str, DataFrame], enough: str, least: int = 3) -> DataFrame:
    """Counts per bundle and whether `enough` reaches the least."""
    out = bundles
    for name, rows in counts.items():
        out = out.join(rows.groupBy("bundle_id").agg(F.count(F.lit(1)).alias(name)), "bundle_id", "left")
    return out.na.fill(0).withColumn("state", F.when(F.col(enough) >= least, "OK").otherwise("few"))


#: Words of reports on research.
RESEARCH = ("연구", "논문", "학술지", "저널", "게재", "연구팀", "연구진", "분석 결과", "발표")


def in_window(rows: DataFrame, bundles: DataFrame, day: str = "pub_date") -> DataFrame:
    """Rows of known bundles whose day is within their bundle's date_from and date_to; a blank day or border passes."""
    span = bundles.select("bundle_id", F.col("date_from").alias("_from"), F.col("date_to").alias("_to"))
    at = F.try_to_date(F.substring(F.col(day).cast("string"), 1, 10), "yyyy-MM-dd")
    outside = F.coalesce(at < F.col("_from"), F.lit(False)) | F.coalesce(at > F.col("_to"), F.lit(False))
    return rows.join(span, "bundle_id").filter(~outside).drop("_from", "_to")


def relevance(candidates: DataFrame, bundles: DataFrame, journals: Mapping[str, Sequence[str]], not_journals: Sequence[str] = (), research: Sequence[str] = RESEARCH) -> DataFrame:
    """candidates (bundle_id, title, description, pub_date) with relevance_score, auto_include and relevance_reasons.

    bundles: bundle_id, drug_terms, outcome_terms, journal, first_author, date_from, date_to, published. Terms are
    literal, whatever their case; a blank own journal or author matches nothing; reasons are 'what:points'.
    """
    own = bundles.select("bundle_id", *[terms_pattern(F.col(c)).alias(f"_{c}") for c in ("drug_terms", "outcome_terms")], *[F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in ("journal", "first_author")], *[F.col(c).alias(f"_{c}") for c in ("date_from", "date_to", "published")])
    c = candidates.join(own, "bundle_id").withColumns({"_t": F.coalesce("title", F.lit("")), "_d": F.coalesce("description", F.lit(""))})
    both = F.concat_ws(" ", "_t", "_d")
    c = c.withColumn("_found", find_journals(both, journals, not_journals)).withColumn("_day", F.try_to_date(F.substring(F.col("pub_date").cast("string"), 1, 10), "yyyy-MM-dd"))
    has = lambda text, pattern: F.rlike(F.col(text), F.col(pattern))
    drug, outcome = (has("_t", p) | has("_d", p) for p in ("_drug_terms", "_outcome_terms"))
    named = lambda p: F.when(has("_t", p), 2).when(has("_d", p), 1)
    date = F.when(F.col("_day") < F.col("_date_from"), -3).when(F.col("_day") > F.col("_date_to"), -1).when(F.datediff("_day", "_published").between(0, 14), 1)
    points = {
        "drug": named("_drug_terms"), "outcome": named("_outcome_terms"),
        "journal": F.when((F.col("_journal") != "") & F.array_contains("_found", F.col("_journal")), 3).when(F.size("_found") > 0, -1),
        "author": F.when((F.col("_first_author") != "") & F.contains(F.lower(both), F.lower("_first_author")), 2),
        "research": F.when(both.rlike("(?iu)" + "|".join(map(literal, research))), 1) if research else F.lit(None).cast("int"),
        "date": date,
    }
    c = c.withColumns({f"_p_{k}": v for k, v in points.items()} | {"_ok": drug & outcome})
    score = sum((F.coalesce(F.col(f"_p_{k}"), F.lit(0)) for k in points), F.lit(0))
    reasons = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_p_{k}").isNotNull(), F.concat(F.lit(f"{k}:"), F.col(f"_p_{k}").cast("string"))) for k in points])), "; ")
    c = c.withColumns({"relevance_score": score, "relevance_reasons": reasons})
    suggested = F.when(~F.col("_ok"), "N").when(F.col("relevance_score") >= 7, "Y").otherwise("?")
    return c.withColumn("auto_include", suggested).select(*candidates.columns, "relevance_score", "auto_include", "relevance_reasons")


def candidate_ids(rows: DataFrame) -> DataFrame:
    """rows (bundle_id, url, outlet, title) with candidate_id: a digest of the bundle and the normalised URL, or the outlet and title without one."""
    blank = F.trim(F.coalesce("url", F.lit(""))) == ""
    place = F.when(blank, F.concat_ws("|", F.coalesce("outlet", F.lit("")), F.coalesce("title", F.lit("")))).otherwise(normalize_url(F.trim("url")))
    return rows.withColumn("candidate_id", stable_id(F.col("bundle_id"), place))


def seed_candidates(bundles: DataFrame, outlets: DataFrame, journals: Mapping[str, Sequence[str]], not_journals: Sequence[str] = ()) -> DataFrame:
    """Candidate rows of the articles that bundles know already (known_articles: title_hint, url, outlet, date); people decide on them."""
    known = bundles.select("bundle_id", F.explode("known_articles").alias("k")).select("bundle_id", *[F.coalesce(f"k.{a}", F.lit("")).alias(b) for a, b in (("title_hint", "title"), ("url", "url"), ("outlet", "name"), ("date", "_shown"))])
    rows = resolve_outlets(known, outlets, name="name").drop("name").withColumns({"pub_date": F.lit(None).cast("string"), "description": F.lit("")})
    scored = relevance(rows, bundles, journals, not_journals)
    scored = scored.withColumns({"pub_date": F.col("_shown"), "description": F.when(F.col("url") == "", "URL and title to be checked").otherwise(""), "auto_include": F.lit("?")}).drop("_shown")
    return candidate_ids(scored).withColumns({"source": F.lit("known"), "query": F.lit("")})


def score_imported(rows: DataFrame, bundles: DataFrame, outlets: DataFrame, journals: Mapping[str, Sequence[str]], source: str, not_journals: Sequence[str] = ()) -> DataFrame:
    """Candidates of an imported list (spreadsheets.import_candidates()) with their outlets resolved and their scores, ready for save_candidates()."""
    named = resolve_outlets(rows.withColumnRenamed("outlet", "name"), outlets, name="name").drop("name")
    return relevance(named, bundles, journals, not_journals).withColumn("source", F.lit(source))


def best_texts(candidates: DataFrame, manual: DataFrame, existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """One article per candidate and one per existing article: a person's text first, then what was fetched well before, then the
    new fetch; an article that is no longer chosen stays as it was.

    manual: article_id, title, body. existing and fetched: article_id, status, title, body (fetched: a row per try with
    its rank; the first that is ok counts, else the last). candidates: candidate_id, bundle_id, title.
    """
    c = candidates.select(F.col("candidate_id").alias("article_id"), "bundle_id", F.col("title").alias("_asked"))
    good = F.struct((F.col("status") != "ok").cast("int").alias("bad"), F.when(F.col("status") == "ok", F.col("rank")).otherwise(-F.col("rank")).alias("r"))
    tried = fetched.groupBy("article_id").agg(F.min_by(F.struct("status", "title", "body"), good).alias("_f"))
    m = manual.select("article_id", F.struct(F.lit("ok").alias("status"), F.col("title"), F.col("body")).alias("_m"))
    e = existing.select("article_id", F.struct("status", "title", "body").alias("_e"))
    nothing = F.struct(F.lit("no_url").alias("status"), F.lit("").alias("title"), F.lit("").alias("body"))
    rows = c.join(m, "article_id", "left").join(e, "article_id", "left").join(tried, "article_id", "left")
    best = F.when(F.col("_m").isNotNull(), F.col("_m")).when(F.col("_e.status") == "ok", F.col("_e")).otherwise(F.coalesce("_f", nothing))
    origin = F.when(F.col("_m").isNotNull(), "manual").when(F.col("_e.status") == "ok", "existing").when(F.col("_f").isNotNull(), "fetched").otherwise("none")
    rows = rows.select("article_id", "bundle_id", best.alias("_b"), origin.alias("origin"), "_asked")
    rows = rows.select("article_id", "bundle_id", "_b.status", F.when(F.coalesce("_b.title", F.lit("")) != "", F.col("_b.title")).otherwise(F.col("_asked")).alias("title"), F.coalesce("_b.body", F.lit("")).alias("body"), "origin")
    rest = existing.join(c.select("article_id"), "article_id", "left_anti").select("article_id", "bundle_id", "status", "title", "body", F.lit("existing").alias("origin"))
    return rows.unionByName(rest)


def pending_comments(articles: DataFrame, comments: DataFrame) -> DataFrame:
    """article_id, oid, aid of the articles on the portal that have no comments yet: what a collection has still to ask for."""
    ids = F.coalesce(portal_ids(F.col("naver_url")), portal_ids(F.col("fetched_url")))
    todo = articles.join(comments.select("article_id").distinct(), "article_id", "left_anti")
    return todo.withColumn("_ids", ids).filter("_ids is not null").select("article_id", "bundle_id", "_ids.oid", "_ids.aid")


def discover(hits: DataFrame, order: str) -> DataFrame:
    """drug, outcome, journal, month, n_articles, n_outlets, example_titles, example_urls of search hits (drug, outlet, title, url, month, outcomes, journals); the most outlets, then articles first.

    A URL counts once in a group. Of each group the first four articles are shown; they are chosen by their order
    before groups are gathered, so a large group is counts and four rows.
    """
    group = ["drug", "outcome", "journal", "month"]
    e = hits.withColumn("outcome", F.explode("outcomes")).withColumn("journal", F.explode("journals"))
    once = e.groupBy(*group, "url").agg(F.min(F.struct(F.col(order).alias("_o"), "outlet", "title")).alias("f")).select(*group, "url", "f.*")
    sizes = once.groupBy(*group).agg(F.count(F.lit(1)).alias("n_articles"), F.countDistinct("outlet").alias("n_outlets"))
    first = once.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy("_o"))).filter("_k <= 4")
    shown = first.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_k", "outlet", "title", "url"))).alias("s"))
    titles = F.array_join(F.transform("s", lambda x: F.concat(F.lit("["), x["outlet"], F.lit("] "), x["title"])), " || ")
    return sizes.join(shown, group).select(*group, "n_articles", "n_outlets", titles.alias("example_titles"), F.array_join(F.col("s.url"), " ").alias("example_urls")).orderBy(F.desc("n_outlets"), F.desc("n_articles"), *group)
