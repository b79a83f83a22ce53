"""Claim strength of sentences: cues, modality windows, resolution and direction, as one struct-valued expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.lexicon import Lexicon
from skein.functions.text import let, literal, mask_terms

MASK = "[D]"
# Where the window behind a cue ends, and the marks of changed cues.
STOPS = r"[^,.…·;!?'\"“”‘’()\[\]<>〈〉/|]*"
AFTER_MARKS = {"negation": "+부정", "may": "+가능성", "can": "+수 있", "weak": "(약)"}
BEFORE_MARKS = {"negation": "not+", "may": "may+", "can": "can+"}
#: The scale's names; levels of the cue classes where nothing in the window changes them.
NAMES = ("no_statement", "no_relationship", "correlational", "ambiguous", "conditional_causal", "can_cause", "causal")
LEVELS = {"no_relationship": 1, "causal": 6, "conditional": 4, "ambiguous": 3, "ambiguous_weak": 3, "correlational": 2}


class ClaimCoder:
    """window > 0: the characters behind a cue, up to a stop, hold its modality; before > 0: those in front of it do."""

    def __init__(self, lexicon: Lexicon, window: int = 8, before: int = 0):
        self.lexicon, self.window, self.before = lexicon, window, before

    def _near(self, text: Column, span: Column) -> Column:
        if self.before:
            return F.substring(text, F.greatest(F.lit(1), span["start"] - self.before + 1), F.least(F.lit(self.before), span["start"]))
        return F.regexp_extract(F.substring(text, span["start"] + span["len"] + 1, F.lit(self.window)), "^" + STOPS, 0)

    def _hits(self, text: Column, kind: str) -> Column:
        if kind not in self.lexicon.sections:
            return F.array().cast("array<struct<level:int,cue:string>>")
        lex = self.lexicon

        def hit(span: Column) -> Column:
            near = self._near(text, span)
            plain = F.concat(span["text"], F.lit(AFTER_MARKS["weak"])) if kind == "ambiguous_weak" else span["text"]
            marked = lambda mark: F.concat(F.lit(BEFORE_MARKS[mark]), span["text"]) if self.before else F.concat(span["text"], F.lit(AFTER_MARKS[mark]))
            pair = lambda level, cue: F.struct(F.lit(level).alias("level"), cue.alias("cue"))
            if kind == "causal":
                return F.when(lex.any_(near, "negation"), pair(1, marked("negation"))).when(lex.any_(near, "may"), pair(4, marked("may"))).when(lex.any_(near, "can"), pair(5, marked("can"))).otherwise(pair(6, plain))
            if kind in ("no_relationship", "conditional"):
                return pair(LEVELS[kind], plain)
            return F.when(lex.any_(near, "negation"), pair(1, marked("negation"))).otherwise(pair(LEVELS[kind], plain))

        return F.transform(lex.spans(text, kind), hit)

    def code(self, sentence: Column, drug_terms: Sequence[str] | Column = (), outcome_terms: Sequence[str] | Column = (), require_target: bool = True) -> Column:
        """struct(level, cues, negated, question, direction, sentence) of a normalised sentence; cues are 'level:cue', with a mark where the window changed
        their level. Terms are given, or columns of terms_pattern()."""
        text = mask_terms(sentence, drug_terms, MASK)
        gate = F.lit(True)
        if require_target:
            gate = F.contains(text, F.lit(MASK))
            if isinstance(outcome_terms, Column):
                gate = gate | F.rlike(text, outcome_terms)
            elif outcome_terms:
                gate = gate | text.rlike("(?iu)" + "|".join(map(literal, outcome_terms)))
            if "exposure" in self.lexicon.sections:
                gate = gate | self.lexicon.any_(text, "exposure")
        strong = F.concat(*[self._hits(text, k) for k in ("no_relationship", "causal", "conditional", "ambiguous", "correlational")])
        none = F.array().cast("array<struct<level:int,cue:string>>")
        weak = self._hits(text, "ambiguous_weak")
        hits = let(strong, lambda s: F.when(F.exists(s, lambda h: h["level"] >= 2), s).otherwise(F.concat(s, weak)))
        hits = F.when(gate, hits).otherwise(none)

        def result(found: Column) -> Column:
            level = F.coalesce(F.array_max(F.transform(found, lambda h: h["level"])), F.lit(0))
            return let(level, lambda n: F.struct(n.alias("level"), F.transform(F.filter(found, lambda h: h["level"] == n), lambda h: F.concat(h["level"].cast("string"), F.lit(":"), h["cue"])).alias("cues"), (n == 1).alias("negated"), F.contains(sentence, F.lit("?")).alias("question"), self.direction(text, n).alias("direction"), sentence.alias("sentence")))

        return let(hits, result)

    def direction(self, text: Column, level: Column) -> Column:
        up, down = self.lexicon.any_(text, "up"), self.lexicon.any_(text, "down")
        return F.when(level == 1, "null").when(level == 0, "").when(up & down, "mixed").when(up, "increase").when(down, "decrease").otherwise("")

    def unit(self, sentences: Column, *terms, **options) -> Column:
        """The strongest sentence of a unit, the first on ties; its question flag is any sentence's."""
        coded = F.transform(sentences, lambda s: self.code(s, *terms, **options))
        kind = "struct<level:int,cues:array<string>,negated:boolean,question:boolean,direction:string,sentence:string>"
        start = F.struct(F.lit(None).cast(kind).alias("best"), F.lit(False).alias("question"))
        better = lambda a, x: a["best"].isNull() | (x["level"] > a["best"]["level"])
        fold = F.aggregate(coded, start, lambda a, x: F.struct(F.when(better(a, x), x).otherwise(a["best"]).alias("best"), (a["question"] | x["question"]).alias("question")))
        return let(fold, lambda f: F.when(f["best"].isNotNull(), f["best"].withField("question", f["question"])))

    def conclusion(self, sentences: Column) -> Column:
        """struct(main, strongest): the first sentence with a claim, and the strongest."""
        coded = F.transform(sentences, lambda s: self.code(s, require_target=False))
        return F.struct(F.get(F.filter(coded, lambda c: c["level"] > 0), 0).alias("main"), self.unit(sentences, require_target=False).alias("strongest"))


def advice_level(lexicon: Lexicon, text: Column) -> Column:
    """The highest of three levels of advice that the text has, else 0."""
    return F.coalesce(*[F.when(lexicon.any_(text, "advice", str(k)), F.lit(k)) for k in (3, 2, 1)], F.lit(0))


def condition_map(lexicon: Lexicon, text: Column) -> Column:
    return F.create_map(*[x for k in lexicon.subkeys("conditions") for x in (F.lit(k), lexicon.any_(text, "conditions", k))])
