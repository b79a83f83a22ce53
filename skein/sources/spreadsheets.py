"""Spreadsheets (.xlsx) and exported candidate lists, without a spreadsheet library: an .xlsx file is a zip of XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.entities import normalize_url
from skein.functions.text import stable_id

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _text(node) -> str:
    """The plain text of a string item; phonetic readings are left out."""
    return "".join(t.text or "" for part in node for t in ([part] if part.tag == f"{MAIN}t" else part.iter(f"{MAIN}t") if part.tag == f"{MAIN}r" else []))


def sheet_rows(content: bytes) -> Iterator[list[str]]:
    """The cells of the first sheet as strings; gaps are ''. The sheet's XML is read as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = [_text(node) for node in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        sheets = [n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        if not sheets:
            return
        with book.open(min(sheets, key=lambda n: int(re.findall(r"\d+", n)[0]))) as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag != f"{MAIN}row":
                    continue
                cells: list[str] = []
                for cell in node.iter(f"{MAIN}c"):
                    at = len(cells)
                    if letters := re.match(r"[A-Z]+", cell.get("r", "")):
                        at = 0
                        for letter in letters[0]:
                            at = at * 26 + ord(letter) - 64
                        at -= 1
                    value, inline = cell.find(f"{MAIN}v"), cell.find(f"{MAIN}is")
                    text = _text(inline) if inline is not None else "" if value is None else value.text or ""
                    if cell.get("t") == "s" and text:
                        text = shared[int(text)]
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = text
                yield cells
                node.clear()


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """All-string columns named by the first row. The format holds about a million rows at most, so one task reads it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows: list[tuple[int, list[str]]] = []
                for row in enumerate(sheet_rows(content)):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["row", "cells"])
                        rows = []
                yield pd.DataFrame(rows, columns=["row", "cells"])

    cells = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, cells array<string>")
    first = cells.filter("row = 0").first()
    header = first["cells"] if first else []
    return cells.filter("row > 0").select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(header) if name and name not in header[:i]])


def day_of(text: Column) -> Column:
    """A date from eight digits or from year, month and day with -, / or . between; null otherwise."""
    digits = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    parts = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(text, r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}", 0), "[/.]", "-"), F.lit("yyyy-M-d"))
    return F.coalesce(digits, parts).cast("date")


def import_candidates(rows: DataFrame, bundle_id: str, aliases: Mapping[str, Sequence[str]], query: str = "", most: int = 300) -> DataFrame:
    """Candidates from an exported list whose columns go by several names; the first that is there counts.

    aliases has title, description, outlet, url and pub_date. Without a title column it is an error.
    """
    found = {k: next((n for n in names if n in rows.columns), None) for k, names in aliases.items()}
    if not found.get("title"):
        raise ValueError(f"no title column among {rows.columns}")
    get = lambda k: F.trim(F.coalesce(F.col(f"`{found[k]}`").cast("string"), F.lit(""))) if found.get(k) else F.lit("")
    url, name = get("url"), F.concat_ws("|", get("outlet"), get("title"))
    return rows.select(
        stable_id(F.lit(bundle_id), F.when(url != "", normalize_url(url)).otherwise(name)).alias("candidate_id"),
        F.lit(bundle_id).alias("bundle_id"), F.lit(query).alias("query"),
        F.coalesce(day_of(get("pub_date")).cast("string"), F.lit("")).alias("pub_date"),
        get("outlet").alias("outlet"), get("title").alias("title"), F.substring(get("description"), 1, most).alias("description"), url.alias("url"),
    )
