"""Spreadsheets, exported candidate lists, the candidate table and comparisons of reactions."""

import io
import zipfile

import pytest

from skein.operators import stats, tables
from skein.sources import spreadsheets

ALIASES = {"title": ["Headline", "Title"], "description": ["Text"], "outlet": ["Outlet"], "url": ["URL"], "pub_date": ["Day"]}


def book(rows: list[list[str]], inline: bool) -> bytes:
    """A minimal workbook; empty cells are left out, so later ones keep their places by their references."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared, lines = [], []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, value in enumerate(row):
            at = f"{chr(65 + c)}{r}"
            if value and inline:
                cells.append(f'<c r="{at}" t="inlineStr"><is><r><t>{value[:2]}</t></r><r><t>{value[2:]}</t></r></is></c>')
            elif value.isdigit():
                cells.append(f'<c r="{at}"><v>{value}</v></c>')
            elif value:
                shared.append(value)
                cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t><rPh><t>x</t></rPh></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>")
    return out.getvalue()


@pytest.mark.parametrize("inline", [False, True])
def test_xlsx_candidates(spark, tmp_path, inline):
    rows = [["Day", "Outlet", "Title", "", "URL", "Text"], ["20240105", "Daily", "First", "", "https://A.com/x/", "long " * 100], ["2024/3/7", "", "Second", "", "", ""], ["soon", "Daily", "Third", "z", "", "t"]]
    assert [r + [""] * (6 - len(r)) for r in spreadsheets.sheet_rows(book(rows, inline))] == rows
    (tmp_path / "list.xlsx").write_bytes(book(rows, inline))
    frame = spreadsheets.read_xlsx(spark, str(tmp_path / "list.xlsx"))
    assert frame.columns == ["Day", "Outlet", "Title", "URL", "Text"]
    got = {r.title: r for r in spreadsheets.import_candidates(frame, "b1", ALIASES, "list.xlsx").collect()}
    assert [got[t].pub_date for t in ("First", "Second", "Third")] == ["2024-01-05", "2024-03-07", ""]
    assert len(got["First"].description) == 300 and len({r.candidate_id for r in got.values()}) == 3 and got["Second"].url == ""
    with pytest.raises(ValueError, match="title"):
        spreadsheets.import_candidates(frame.drop("Title"), "b1", ALIASES)


def test_saved_candidates_keep_human_entries(spark):
    columns = ["candidate_id", "bundle_id", "title", "relevance_score", "include"]
    old = spark.createDataFrame([("a", "b", "old a", "3", "Y"), ("m", "b", "by hand", "x", "N")], columns)
    new = spark.createDataFrame([("a", "b", "new a", "5"), ("c", "b", "new c", "9"), ("d", "a", "new d", "1")], columns[:4])
    got = tables.save_candidates(new, old, columns, ["include"])
    assert got.columns == columns and [tuple(r) for r in got.collect()] == [("d", "a", "new d", 1, ""), ("c", "b", "new c", 9, ""), ("a", "b", "new a", 5, "Y"), ("m", "b", "by hand", 0, "N")]


def test_compare_groups(spark):
    articles = spark.createDataFrame([(i, f"c{i % 5}", float(i % 2), 1.0 if i else None) for i in range(20)], "article_id long, cluster string, strong double, same double")
    shares = spark.createDataFrame([(i, 5 if i != 3 else 4, 0.8 if i % 2 else 0.1 + i / 1000) for i in range(20)], "article_id long, n long, fear double")
    (row,) = stats.compare_groups(articles, shares, ["strong", "same"], ["fear"], "cluster", n_boot=100).collect()
    assert (row.grouping, row.value, row.n1, row.n0) == ("strong", "fear", 9, 10) and row.mean1 == pytest.approx(0.8)
    assert row.est == pytest.approx(row.mean1 - row.mean0) and row.lo <= row.est <= row.hi and row.p < 0.001
