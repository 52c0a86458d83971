import datetime as dt

import pytest
from pyspark.sql import functions as F

from veritab.functions import scalars as S
from veritab.functions import words as T


def run(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers(spark):
    cells = ["$1,200.50", "(1,234.5)", "FRW 5000", "N/A", "1e5", ".5", "12%", "+3", "  7 ", "KES 5", "NaN", "", None, "—", "5."]
    assert run(spark, S.parse_number, cells) == [1200.5, -1234.5, 5000.0, None, None, None, 12.0, 3.0, 7.0, None, None, None, None, None, None]
    assert run(spark, S.parse_int, ["2.5", "3.5", "x"]) == [2, 4, None]


def test_dates(spark):
    d = dt.date
    strict = ["15/01/2025", "3/4/70", "3/4/68", "2025-1-5", "5 March 2024", "5 Mar 2024", "31/02/2024", "March 5, 2024", None]
    assert run(spark, S.parse_date, strict) == [d(2025, 1, 15), d(1970, 4, 3), d(2068, 4, 3), d(2025, 1, 5), d(2024, 3, 5), d(2024, 3, 5), None, None, None]
    wide = ["March 5, 2024", "01/13/2024", "May 2024", "2024-01-02 10:00:00", "7-May-2024", "x"]
    assert run(spark, S.parse_date_builtin, wide) == [d(2024, 3, 5), d(2024, 1, 13), d(2024, 5, 1), d(2024, 1, 2), d(2024, 5, 7), None]
    assert run(spark, S.is_ambiguous_date, ["03/04/2026", "13/04/2026", "04/04/2026", "x", None]) == [True, False, False, False, False]


def test_text(spark):
    assert run(spark, S.clean_text, [" a \n b ", "  ", None]) == ["a b", None, None]
    assert run(spark, S.sanitize_filename, ["../../etc/evil_sales.csv", "a\\b.txt", "///", None]) == ["evil_sales.csv", "b.txt", "upload", "upload"]
    assert run(spark, S.source_type, ["notes.zip", "a.XLSX", "b.ndjson", "c"]) == [None, "excel", "json", None]
    assert run(spark, S.page_from_label, ["page 3", "Pages 2-4", "x"]) == [3, 2, None]
    assert run(spark, S.compact_number, [1500.0, 2.5e6, 12.0], "double") == ["1.5K", "2.5M", "12"]
    assert run(spark, lambda c: S.excerpt(c, 10), ["one two three", "short"]) == ["one two…", "short"]
    assert run(spark, S.neutral_cell, ["=cmd", "plain"]) == ["'=cmd", "plain"]


def test_entities(spark):
    text = "Revenue grew 12% to reach $4.5 million, with costs up 3%. In March 2024 and 12/05/2025. A clinic, the clinic, and patients."
    assert run(spark, T.extract_numbers, [text, None]) == [["$4.5 million", "12%", "3%"], []]
    assert run(spark, T.extract_dates, [text]) == [["March 2024", "12/05/2025"]]
    got = T.keywords(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert [(r.keyword, r["count"]) for r in got] == [("clinic", 2)]


@pytest.mark.parametrize(("text", "label", "confidence"), [("Region Product Revenue Units Sold", "Sales", "high"), ("Foo Bar", "General dataset", "low"), ("salary", "HR", "medium")])
def test_classify(spark, text, label, confidence):
    a, b = T.classify(F.lit(text))
    assert spark.range(1).select(a.alias("a"), b.alias("b")).first() == (label, confidence)
