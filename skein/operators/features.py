"""The feature row of an article: levels of title, lead and rest, conditions by section, counts, caveats, advice, journals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text
from skein.functions.claims import MASK, NAMES, ClaimCoder, advice_level
from skein.functions.entities import find_journals, find_not_journals
from skein.functions.lexicon import Lexicon
from skein.functions.text import mask_terms, normalize_text, segment, terms_pattern
from skein.operators.tables import stratified, usable

SECTIONS = ("title", "lead", "body")


def article_features(articles: DataFrame, bundles: DataFrame, lexicon: Lexicon, journals: Mapping[str, Sequence[str]], not_journals: Sequence[str] = (), window: int = 8, cues: bool = True) -> DataFrame:
    """One row per article of a bundle of `bundles` (bundle_id, drug_terms, outcome_terms, journal), in one narrow projection.

    The title is coded without the target gate, lead and rest with it; the body section is all sentences, lead
    included; conditions, hedges, boosters and sensational words are looked for in text with the bundle's drugs masked,
    caveats, advice, attribution and journals in the text as it stands. What a lexicon has no section for gives 0 or ''.
    """
    coder = ClaimCoder(lexicon, window)
    terms = bundles.select("bundle_id", terms_pattern(F.col("drug_terms")).alias("_drugs"), terms_pattern(F.col("outcome_terms")).alias("_outcomes"), F.coalesce("journal", F.lit("")).alias("_journal"))
    a = articles.join(terms, "bundle_id").withColumns({"_title": normalize_text(F.col("title")), "_body": F.coalesce("body", F.lit("")), "_s": segment(F.col("title"), F.col("body"))})
    a = a.withColumns({"_leading": F.col("_s.lead"), "_trailing": F.col("_s.rest")})
    title, drugs, outcomes = F.col("_title"), F.col("_drugs"), F.col("_outcomes")
    joined = {"title": title, "lead": F.array_join("_leading", " "), "body": F.array_join(F.concat("_leading", "_trailing"), " ")}
    masked = {k: mask_terms(v, drugs, MASK) for k, v in joined.items()}
    units = {"title": coder.code(title, drugs, outcomes, require_target=False), "lead": coder.unit(F.col("_leading"), drugs, outcomes), "body_max": coder.unit(F.col("_trailing"), drugs, outcomes)}
    coded = a.withColumns({f"_{k}_code": v for k, v in units.items()})
    out: dict[str, Column] = {"title": title, "lead": joined["lead"], "body_len": F.length("_body"), "n_sentences": F.size("_leading") + F.size("_trailing")}
    names = F.array(*map(F.lit, NAMES))
    for k in units:
        u = F.col(f"_{k}_code")
        level = F.coalesce(u["level"], F.lit(0))
        out |= {f"auto_{k}_strength": level, f"auto_{k}_cues": F.array_join(F.array_distinct(F.coalesce(u["cues"], F.array().cast("array<string>"))), "; ")}
        if k != "body_max":
            out |= {f"auto_{k}_label": F.get(names, level), f"auto_{k}_direction": F.coalesce(u["direction"], F.lit(""))}
    directions = [F.nullif(F.col(f"_{k}_code")["direction"], F.lit("")) for k in units]
    out |= {"auto_direction": F.coalesce(*directions, F.lit("")), "auto_body_max_sentence": F.coalesce(F.substring(F.col("_body_max_code")["sentence"], 1, 200), F.lit(""))}
    out |= {"auto_title_question": F.contains(title, F.lit("?")).cast("int"), "auto_title_quoted": text.is_quoted(title).cast("int")}
    for k in lexicon.subkeys("conditions"):
        for s in SECTIONS:
            out[f"auto_cond_{s}_{k}"] = lexicon.any_(masked[s], "conditions", k).cast("int")
            if cues:
                out[f"auto_cond_{s}_{k}_cues"] = text.ordered_join(lexicon.texts(masked[s], "conditions", k))
    for k in ("hedges", "boosters", "sensational"):
        there = k in lexicon.sections
        for s in SECTIONS:
            out[f"n_{k}_{s}"] = lexicon.count(masked[s], k) if there else F.lit(0)
        out[f"{k}_title_cues"] = F.array_join(lexicon.texts(masked["title"], k), "; ") if there else F.lit("")
    has_caveat = (lambda s: lexicon.any_(s, "conditions", "limitation")) if "limitation" in lexicon.subkeys("conditions") else (lambda s: F.lit(False))
    caveats = F.filter(F.concat("_leading", "_trailing"), has_caveat)
    out |= {"auto_caveat": (F.size(caveats) > 0).cast("int"), "auto_caveat_sentences": F.array_join(F.transform(F.slice(caveats, 1, 3), lambda s: F.substring(s, 1, 160)), " || ")}
    said = F.array_join(F.concat(F.array(title), "_leading", "_trailing"), " ")
    if "advice" in lexicon.sections:
        level = advice_level(lexicon, said)
        named = F.coalesce(*[F.when(level == k, F.array_join(F.array_distinct(lexicon.texts(said, "advice", str(k))), "; ")) for k in (3, 2, 1) if lexicon.entries("advice", str(k))], F.lit(""))
        out |= {"auto_advice": level, "auto_advice_cues": named}
    else:
        out |= {"auto_advice": F.lit(0), "auto_advice_cues": F.lit("")}
    full = F.concat_ws(" ", title, "_body")
    cited, others = find_journals(full, journals, not_journals), find_not_journals(full, not_journals)
    out |= {"journals_mentioned": F.array_join(cited, "; "), "non_journal_sources": F.array_join(others, "; "), "auto_journal_match": F.when((F.size(cited) > 0) | (F.size(others) > 0), F.array_contains(cited, F.col("_journal")).cast("int"))}
    out["n_attribution"] = lexicon.count(full, "attribution") if "attribution" in lexicon.sections else F.lit(0)
    if not cues:
        out = {k: v for k, v in out.items() if not k.endswith("_cues")}
    return coded.select(*[c for c in ("article_id", "bundle_id", "outlet", "outlet_type", "published", "url") if c in articles.columns], *[v.alias(k) for k, v in out.items()])


def precode(articles: DataFrame, bundles: DataFrame, text_bad: DataFrame, excluded: DataFrame, most: int, **options) -> tuple[DataFrame, DataFrame]:
    """(selection, features): usable articles, at most `most` of each bundle over its outlet types, and their feature rows.

    Articles of unknown bundles are selected like others but have no feature row.
    """
    good = usable(articles, text_bad, excluded)
    chosen = stratified(good, "bundle_id", "outlet_type", "article_id", most)
    selection = chosen.select("article_id", "bundle_id", "selected", F.when(F.col("selected") == "Y", "within cap").otherwise("over cap").alias("reason"))
    return selection, article_features(chosen.filter("selected = 'Y'").drop("selected"), bundles, **options)
