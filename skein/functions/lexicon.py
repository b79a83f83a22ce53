"""Lexicons: named lists of literal or regular-expression entries, matched by Column expressions.

An entry is a literal text, or a regular expression behind `re:`. Existence is one alternation; spans are found per
entry and overlaps resolved to the earliest, then longest.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import literal

SPAN = "struct<start:int,len:int,text:string>"


def pattern(entry: str) -> str:
    return "(?iuU)" + (entry[3:] if entry.startswith("re:") else literal(entry))


class Lexicon:
    def __init__(self, sections: Mapping):
        self.sections = sections

    @classmethod
    def load(cls, path: str) -> Lexicon:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls(yaml.safe_load(f))

    def entries(self, *keys: str) -> list[str]:
        """The entries under a path of keys; of a mapping, those of all its keys in order."""
        at = self.sections
        for key in keys:
            at = at[int(key)] if key not in at and key.isdigit() else at[key]
        return [e for v in at.values() for e in v] if isinstance(at, Mapping) else list(at)

    def subkeys(self, *keys: str) -> list[str]:
        at = self.sections
        for key in keys:
            at = at[key]
        return [str(k) for k in at]

    def any_(self, text: Column, *keys: str) -> Column:
        entries = self.entries(*keys)
        if not entries:
            return F.lit(False)
        return text.rlike("(?iuU)" + "|".join(f"(?:{pattern(e)[6:]})" for e in entries))

    def spans(self, text: Column, *keys: str) -> Column:
        """Matches as array<struct<start,len,text>>, start from 0, blanks dropped, overlaps resolved."""
        found = F.concat(*[_spans_of(text, pattern(e)) for e in self.entries(*keys)])
        ordered = F.array_sort(F.filter(found, lambda s: F.trim(s["text"]) != ""), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["len"] - a["len"]))
        empty = F.array().cast(f"array<{SPAN}>")
        start = F.struct(F.lit(0).alias("end"), empty.alias("kept"))
        take = lambda a, s: F.when(s["start"] >= a["end"], F.struct((s["start"] + s["len"]).alias("end"), F.concat(a["kept"], F.array(s)).alias("kept"))).otherwise(a)
        return F.aggregate(ordered, start, take)["kept"]

    def _plain(self, *keys: str) -> str | None:
        """One pattern that finds what spans() finds, where all entries are literal and none can overlap itself: the longest at the earliest place."""
        entries = set(self.entries(*keys))
        if not entries or any(e.startswith("re:") or not e.strip() or _overlaps_itself(e.lower()) for e in entries):
            return None
        return "(?iuU)" + "|".join(map(literal, sorted(entries, key=lambda e: (-len(e), e))))

    def texts(self, text: Column, *keys: str) -> Column:
        if plain := self._plain(*keys):
            return F.regexp_extract_all(text, F.lit(plain), F.lit(0))
        return F.transform(self.spans(text, *keys), lambda s: s["text"])

    def count(self, text: Column, *keys: str) -> Column:
        if plain := self._plain(*keys):
            return F.regexp_count(text, F.lit(plain))
        return F.size(self.spans(text, *keys))


def _overlaps_itself(entry: str) -> bool:
    return any(entry[:k] == entry[-k:] for k in range(1, len(entry)))


def _spans_of(text: Column, regex: str) -> Column:
    """Spans of one pattern: what lies between matches, and the matches, laid end to end."""
    return F.when(text.rlike(regex), _all_spans(text, regex)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _all_spans(text: Column, regex: str) -> Column:
    matches = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    between = F.split(text, regex, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = (a["at"] + F.length(x["gap"])).cast("int")
        span = F.struct(begin.alias("start"), F.length(x["match"]).cast("int").alias("len"), x["match"].alias("text"))
        return F.struct((begin + F.length(x["match"])).cast("int").alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.greatest(F.size(matches), F.lit(1))), matches, lambda g, m: F.struct(F.coalesce(g, F.lit("")).alias("gap"), m.alias("match")))
    return F.aggregate(F.filter(pairs, lambda p: p["match"].isNotNull()), start, step)["out"]


#: A small lexicon of our own for the Korean coder; hosts bring theirs.
KOREAN = Lexicon({
    "causal": ["유발", "일으킨", "원인"], "conditional": ["경우 위험"], "ambiguous": ["위험 증가", "위험을 높"], "ambiguous_weak": ["위험"],
    "correlational": ["연관", "관련성"], "no_relationship": ["관련 없", "무관"], "exposure": ["복용", "투여", "접종"],
    "negation": ["않", "아니", "없"], "may": ["수도 있", "우려"], "can": ["수 있"], "up": ["증가", "높"], "down": ["감소", "낮"],
})
ENGLISH = Lexicon({
    "causal": ["re:\\bcauses?\\b", "leads to"], "ambiguous": ["increased risk", "higher risk"], "correlational": ["associated with", "linked to"], "no_relationship": ["no association", "no evidence of"],
    "negation": ["re:\\b(?:not|no)\\s*(?:\\w+\\s*)?$"], "may": ["re:\\b(?:may|might)\\s*$"], "can": ["re:\\b(?:can|could)\\s*$"], "up": ["increase", "higher"], "down": ["decrease", "lower"],
})
