"""Text primitives as Column -> Column builders; Unicode normal forms are the one thing Catalyst lacks (Arrow UDF)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTENCE_BREAK = r"(?<=[.!?])\s+(?=\S)"
ENGLISH_BREAK = r"(?<=[.!?])\s+(?=[A-Z(\[])"

# Equal sentences, tokens and leads depend on them.
QUOTES = "[\"'“”‘’「」『』]"
TOKEN = r"[가-힣]+|[A-Za-z][A-Za-z0-9\-]+|\d+(?:\.\d+)?"
NOISE = (
    r"^\(?[^()]{0,25}=\s*[^()]{0,15}\)?\s*$",
    r"^\[?[^\]]{0,30}기자\]?$",
    r"(사진|그래픽|이미지|자료)\s*=\s*\S+",
    r"게티이미지|이미지투데이|클립아트코리아|셔터스톡",
    r"무단\s*전재|재배포\s*금지|저작권자|Copyright|ⓒ|©",
    r"^[▶☞■◆●▲△※]",
    r"[\w.+-]+@[\w-]+\.[\w.]+",
)
PLACEHOLDER = r"Global Health Pick|독자 여러분께 .{0,40}제공합니다|^(Advertisement\s*)+$|구글에서 선호하는 매체|재판매 및 DB\s*금지"
INNER_BYLINE = r"[가-힣]{2,4}\s*(인턴\s*)?(기자|특파원)\s*=\s*"
LEADING_BYLINE = r"^\s*(\([^)]{1,30}=[^)]{1,20}\)\s*)?(\[[^\]]{1,40}\]\s*)?([가-힣]{2,4}\s*(기자|특파원|객원기자)\s*=\s*)?"
STAMP = r"(등록|입력|수정)\s*20\d{2}[.\-]\d{2}[.\-]\d{2}\s*[\d:]*"
SENTENCE_END = r"[.!?다]['\"’”)\]]?$"
BOILERPLATE = r"무단\s*전재|재배포\s*금지|저작권자|Copyright|ⓒ|©|기사제보|구독\s*신청|^\s*관련\s*기사|[\w.+-]+@[\w-]+\.[\w.]+|^\s*[▶☞■◆]"
CAPTION = r"(사진|그래픽|이미지|자료)\s*[=:]|게티이미지|이미지투데이|셔터스톡|클립아트코리아"
DATE_TEXT = r"(?:입력|등록|승인|기사입력|게재)\s*[:]?\s*(20\d{2})[.\-/년 ]\s*(\d{1,2})[.\-/월 ]\s*(\d{1,2})"


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def literal(text: str) -> str:
    """A pattern for the text itself, in the syntax that Java and RE2 share."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Texts that are in the form already, as most are, are handed back as they came."""
    values, changed = texts.to_pylist(), False
    for i, t in enumerate(values):
        if t is not None and not unicodedata.is_normalized("NFKC", t):
            values[i], changed = unicodedata.normalize("NFKC", t), True
    return pa.array(values, texts.type) if changed else texts


def normalize_text(text: Column) -> Column:
    """NFKC, no zero-width spaces, runs of blanks as one, no empty lines, stripped; null is empty. Not for use inside lambdas."""
    return squeeze(nfkc(F.coalesce(text, F.lit(""))))


def squeeze(text: Column) -> Column:
    t = F.regexp_replace(F.replace(F.replace(text, F.lit("\u200b"), F.lit("")), F.lit("\u00a0"), F.lit(" ")), "[ \\t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\n\s*\n+", "\n"), r"^\s+|\s+$", "")


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def rest_lines(text: Column) -> Column:
    return F.when(F.locate("\n", text) > 0, F.substring(text, F.locate("\n", text) + 1, F.length(text))).otherwise(F.lit(""))


def _stripped(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def sentences_of(text: Column) -> Column:
    """Sentences of each line of a normalised text, by closing signs followed by white space."""
    return _stripped(F.flatten(F.transform(F.split(text, "\n"), lambda p: F.split(p, SENTENCE_BREAK))))


def split_sentences(text: Column) -> Column:
    return sentences_of(normalize_text(text))


def split_english_sentences(text: Column) -> Column:
    return _stripped(F.split(F.replace(normalize_text(text), F.lit("\n"), F.lit(" ")), ENGLISH_BREAK))


def is_noise_sentence(s: Column, short: int = 8, long: int = 60) -> Column:
    """Too short, a fixed phrase of publishers (unless a byline is in it), or short with the marks of credits, bylines and notices."""
    marks = F.lit(False)
    for pattern in NOISE:
        marks = marks | s.rlike(pattern)
    return (F.length(s) < short) | (s.rlike(PLACEHOLDER) & ~s.rlike(INNER_BYLINE)) | ((F.length(s) < long) & marks)


def clean_body(text: Column) -> Column:
    """Lines squeezed; boilerplate under 120 and captions under 60 characters go, and empty lines."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    keep = lambda x: (x != "") & ~(x.rlike(BOILERPLATE) & (F.length(x) < 120)) & ~(x.rlike(CAPTION) & (F.length(x) < 60))
    return F.array_join(F.filter(lines, keep), "\n")


def strip_leading_byline(s: Column, within: int = 250) -> Column:
    """Without what stands before the end of a byline in the first characters, and without a place and names in front."""
    head = F.substring(s, 1, within)
    end = F.regexp_instr(head, F.lit(INNER_BYLINE)) + F.length(F.regexp_extract(head, INNER_BYLINE, 0))
    cut = F.when(head.rlike(INNER_BYLINE), F.substring(s, end, F.length(s))).otherwise(s)
    return F.regexp_replace(F.regexp_replace(cut, LEADING_BYLINE, ""), r"^\s+|\s+$", "")


def is_head_line(line: Column, title: Column, subtitle: int = 70) -> Column:
    """The title again, a time stamp, noise, or a short line that ends no sentence. Both arguments are normalised."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\W", "")
    repeats = (F.length(bare(title)) >= 10) & F.startswith(bare(line), bare(title)) & (F.length(bare(line)) - F.length(bare(title)) < 10)
    stamp = F.substring(line, 1, 80).rlike(STAMP) | line.rlike(r"DB\s*금지")
    return repeats | stamp | is_noise_sentence(line) | ((F.length(line) <= subtitle) & ~line.rlike(SENTENCE_END))


def segment(title: Column, body: Column, n_lead: int = 2) -> Column:
    """struct(lead, rest): the first sentences behind the head lines, and the others, without bylines and noise; if all lines are head lines, all count."""
    lines = F.split(F.regexp_replace(normalize_text(body), r"\bAdvertisement\b", " "), "\n")

    def cut(a: Column) -> Column:
        lines = a["lines"]
        first = F.array_position(F.transform(lines, lambda x: is_head_line(F.trim(x), a["title"])), F.lit(False))
        kept = F.when(first > 0, F.slice(lines, F.greatest(first.cast("int"), F.lit(1)), F.greatest(F.size(lines), F.lit(1)))).otherwise(lines)
        found = F.transform(_stripped(F.flatten(F.transform(kept, lambda p: F.split(squeeze(p), SENTENCE_BREAK)))), strip_leading_byline)
        return let(F.filter(found, lambda x: ~is_noise_sentence(x)), lambda all_: F.struct(F.slice(all_, 1, n_lead).alias("lead"), F.slice(all_, n_lead + 1, F.greatest(F.size(all_), F.lit(1))).alias("rest")))

    # the normalised title is an argument, as lambdas can't hold its Arrow function
    return let(F.struct(normalize_text(title).alias("title"), lines.alias("lines")), cut)


def is_quoted(text: Column) -> Column:
    """Whether a normalised text has quotation marks around something."""
    return F.regexp_count(text, F.lit(QUOTES)) >= 2


def terms_pattern(terms: Column) -> Column:
    """One pattern for an array of literal terms, longest first, whatever their case; for no terms one that matches nothing."""
    real = F.filter(F.array_distinct(F.coalesce(terms, F.array().cast("array<string>"))), lambda t: t != "")
    longest = F.array_sort(real, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    quoted = F.transform(longest, lambda t: F.regexp_replace(t, r"([\\.^$|?*+()\[\]{}])", r"\\$1"))
    return F.when(F.size(quoted) == 0, "(?!)").otherwise(F.concat(F.lit("(?iu)"), F.array_join(quoted, "|")))


def mask_terms(text: Column, terms: Sequence[str] | Column, mask: str = "[D]") -> Column:
    """Replaces fixed terms, longest first, whatever their case; terms are given, or a column of terms_pattern()."""
    new = mask.replace("\\", "\\\\").replace("$", "\\$")
    if isinstance(terms, Column):
        return F.regexp_replace(text, terms, F.lit(new))
    if not terms:
        return text
    longest = sorted(terms, key=lambda t: (-len(t), t))
    return F.regexp_replace(text, "(?iu)" + "|".join(map(literal, longest)), new)


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """The terms that the text has, in their order, whatever their case."""
    return F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(t.lower())), F.lit(t)) for t in terms]))


def tokens(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Lower-cased words and numbers; stop words and single ASCII characters go."""
    return tokens_of(normalize_text(text), stopwords)


def tokens_of(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """The tokens of a normalised text."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    keep = lambda x: (F.length(x) > 1) | ~x.rlike("^[a-z0-9]$")
    return F.filter(found, (lambda x: keep(x) & ~x.isin(*stopwords)) if stopwords else keep)


def stable_id(*parts: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, length)


def ordered_join(items: Column, sep: str = "; ", most: int = 150) -> Column:
    return F.substring(F.array_join(F.array_distinct(items), sep), 1, most)


def format_ci(estimate: Column, low: Column, high: Column, percent: bool = True) -> Column:
    k = 100 if percent else 1
    tail = "%" if percent else ""
    shown = F.format_string(f"%.1f{tail and '%%'} [%.1f, %.1f]", estimate * k, low * k, high * k)
    return F.when(estimate.isNull(), "–").when(low.isNull(), F.format_string(f"%.1f{tail and '%%'}", estimate * k)).otherwise(shown)
