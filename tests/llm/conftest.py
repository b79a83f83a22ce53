import pytest

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
#: Edge rows: nulls, empty and very long texts, ties, repeated rows, odd characters, and columns whose names clash with our own.
EDGE = [
    (1, "Same TEXT here twice", "en", "a"),
    (2, "same text here twice", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (4, "", "en", "b"),
    (5, "   \n\t ", "en", "b"),
    (6, LONG, "en", "c"),
    (7, LONG + " end", "en", "c"),
    (8, "Ünïcödé ﬁ 数字 १२३ don't we'll I'M x''s 's  'tis    y", "de", None),
    (9, "a", "fr", "d"),
    (9, "a", "fr", "d"),
    (9, "b", "fr", "d"),
    (None, "no id at all", "fr", "d"),
    (10, "!!! $$$ 123 !!!", "en", "d"),
    (11, "line one\r\nline two\n\n\n  line three   ", "en", "d"),
    (12, "=" * 3000 + " " * 700 + "z" * 900, "es", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string, keep_id int, kept boolean, rank string, length string, part string, score double, _key int, _id int, _drop int, _row int, _again int, _bucket int, _doc int, fp int, h1 int, weight int, token int, band int, fingerprint int, held_out int, stays int"


def rows_of(rows):
    return [(*r, 7, None, "x", None, "p", 0.5, *range(15)) for r in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows_of(EDGE), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest of the test tables, whole."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def torn(spark):
    """Texts whose bytes are no UTF-8."""
    rows = [(1, b"plain text here"), (2, b"bad \xff\xfe bytes here"), (3, b"\xc3"), (4, b"half \xe2\x82"), (5, b"\x80\x80 and more words in it"), (6, None)]
    return spark.createDataFrame(rows, "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text", "'en' as lang").repartition(2)
