"""URLs, outlets, dates and journal names."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import literal


def normalize_url(url: Column) -> Column:
    """https unless another scheme is named, lower host, no trailing slash, tracking parameters or fragment."""
    u = F.regexp_replace(F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*://"), url).otherwise(F.concat(F.lit("https://"), url)), "#.*$", "")
    head, query = F.split_part(u, F.lit("?"), F.lit(1)), F.regexp_extract(u, r"\?(.*)$", 1)
    scheme, rest = F.split_part(head, F.lit("://"), F.lit(1)), F.regexp_extract(head, "^[^:]+://(.*)$", 1)
    host, path = F.split_part(rest, F.lit("/"), F.lit(1)), F.regexp_extract(rest, "^[^/]*(/.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|fbclid|from)="))
    return F.concat(scheme, F.lit("://"), F.lower(host), F.regexp_replace(path, "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.\\-]*://)?([^/?#]*)", 1)), "^www\\.", "")


def resolve_outlets(rows: DataFrame, outlets: DataFrame, url: str = "url", name: str | None = None) -> DataFrame:
    """outlets (outlet, outlet_type, domain): by exact name, else by the longest domain that the host ends with, else (name or host, unknown).

    The host's suffixes are exploded and equi-joined, so neither side is scanned against the other.
    """
    base = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_host", host_of(F.col(url)))
    labels = F.split(F.col("_host"), "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    by_domain = outlets.select(F.lower("domain").alias("_suffix"), F.col("outlet").alias("_o"), F.col("outlet_type").alias("_t"))
    hosts = base.select("_host").distinct().withColumn("_suffix", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(F.split("_host", "\\."))), lambda i: F.array_join(F.slice(F.split("_host", "\\."), i, F.size(F.split("_host", "\\."))), ".")))))
    best = hosts.join(by_domain, "_suffix").groupBy("_host").agg(F.max_by(F.struct("_o", "_t"), F.length("_suffix")).alias("_best"))
    found = base.join(best, "_host", "left")
    fallback = F.coalesce(F.nullif(F.col(name), F.lit("")), F.col("_host")) if name else F.col("_host")
    if name:
        names = outlets.select(F.regexp_replace(F.lower("outlet"), r"\s", "").alias("_name"), F.col("outlet").alias("_no"), F.col("outlet_type").alias("_nt")).dropDuplicates(["_name"])
        found = found.join(names, F.regexp_replace(F.lower(F.col(name)), r"\s", "") == F.col("_name"), "left")
        by_name, name_type = F.col("_no"), F.col("_nt")
    else:
        by_name = name_type = F.lit(None).cast("string")
    return found.withColumn("outlet", F.coalesce(by_name, F.col("_best._o"), fallback)).withColumn("outlet_type", F.coalesce(name_type, F.col("_best._t"), F.lit("unknown"))).drop("_row", "_host", "_best", "_name", "_no", "_nt")


def _name(alias: str) -> str:
    """Latin names stand alone; the case counts."""
    return rf"(?<![A-Za-z]){literal(alias)}(?![A-Za-z])" if re.fullmatch("[A-Za-z .]+", alias) else literal(alias)


def find_not_journals(text: Column, names: Sequence[str]) -> Column:
    """Names in the text that are cited like journals: longest first, each match taken out of the text."""
    state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("found"))
    for name in sorted(names, key=len, reverse=True):
        state = F.when(state["text"].rlike(_name(name)), F.struct(F.regexp_replace(state["text"], _name(name), " ").alias("text"), F.concat(state["found"], F.array(F.lit(name))).alias("found"))).otherwise(state)
    return state["found"]


def find_journals(text: Column, aliases: Mapping[str, Sequence[str]], not_journals: Sequence[str] = ()) -> Column:
    """Journal keys in the text: longest alias first, each match taken out of the text; Latin aliases need non-letters around."""
    start = text
    for other in sorted(not_journals, key=len, reverse=True):
        start = F.regexp_replace(start, _name(other), " ")
    state = F.struct(start.alias("text"), F.array().cast("array<string>").alias("found"))
    for alias, key in sorted(((a, k) for k, names in aliases.items() for a in names), key=lambda x: (-len(x[0]), x[0])):
        regex = _name(alias)
        state = F.when(state["text"].rlike(regex), F.struct(F.regexp_replace(state["text"], regex, " ").alias("text"), F.array_union(state["found"], F.array(F.lit(key))).alias("found"))).otherwise(state)
    return state["found"]


def parse_pubdate(text: Column) -> Column:
    """An RFC 2822 date as its own local time: yyyy-MM-dd HH:mm:ss, null if it is none."""
    bare = F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", "")
    return F.date_format(F.try_to_timestamp(F.regexp_replace(bare, r"\s*[+-]\d{4}\s*$|\s*GMT\s*$", ""), F.lit("d MMM yyyy HH:mm:ss")), "yyyy-MM-dd HH:mm:ss")


def iso_date(text: Column) -> Column:
    return F.coalesce(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.regexp_extract(text, r"^(\d{8})", 1), "yyyyMMdd"))


def unescape(text: Column) -> Column:
    """The common entities, twice, as feeds escape twice."""
    for _ in range(2):
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def clean_api_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(text, "</?b>", "")), r"\s+", " "))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, "<[^>]+>", " ")), r"\s+", " "))


def clean_title(title: Column, outlet: Column, longest: int = 20, short: int = 8) -> Column:
    """Unescaped, without a [tag] in front, and without a tail behind a separator that names the outlet (any for a blank outlet) or is very short."""
    t = F.regexp_replace(F.trim(unescape(F.coalesce(title, F.lit("")))), r"^\[[^\]]{2,15}\]\s*", "")
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    name = F.coalesce(outlet, F.lit(""))
    out = F.trim(t)
    for sep in (" < ", " :: ", " : ", " - ", " | "):  # the last of these is looked at first
        tail = F.substring_index(t, sep, -1)
        fits = (F.length(tail) <= longest) & ((name == "") | F.contains(bare(tail), bare(name)) | (F.length(tail) <= short))
        out = F.when(F.contains(t, F.lit(sep)) & fits, F.trim(F.substring(t, F.lit(1), F.length(t) - F.length(tail) - len(sep)))).otherwise(out)
    return out


def portal_ids(url: Column, portal: str = "naver.com") -> Column:
    """struct(oid, aid) of an article's page on the portal, from its path (/article/<oid>/<aid>) or its oid and aid parameters; null if neither."""
    path = r"/article/(?:comment/)?(\d{3})/(\d{6,12})"
    param = lambda name: F.regexp_extract(url, rf"[?&]{name}=([^&#]+)", 1)
    head = F.regexp_extract(url, r"^[^?#]*", 0)
    oid = F.coalesce(F.nullif(F.regexp_extract(head, path, 1), F.lit("")), F.nullif(param("oid"), F.lit("")))
    aid = F.coalesce(F.nullif(F.regexp_extract(head, path, 2), F.lit("")), F.nullif(param("aid"), F.lit("")))
    return F.when(F.contains(host_of(url), F.lit(portal)) & oid.isNotNull() & aid.isNotNull(), F.struct(oid.alias("oid"), aid.alias("aid")))


def key_conditions(value: Column, known: Sequence[str]) -> Column:
    """The known categories in a list that commas, semicolons, slashes or blanks divide; order and repeats stay."""
    return F.filter(F.split(F.lower(F.coalesce(value, F.lit(""))), r"[;,/\s]+"), lambda x: x.isin(*known))
