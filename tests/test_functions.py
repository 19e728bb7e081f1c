"""Golden values of text, date, intent and chunk functions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recordloom.functions import chunk, dates, intent, text

NOW = datetime(2026, 1, 28)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("r")).first()[0]


def test_dates(spark):
    d = datetime(2026, 1, 28, 12, 5)
    assert one(spark, dates.week_of_year("x"), d, "timestamp") == 5
    assert one(spark, dates.time_of_day("x"), d, "timestamp") == "noon, midday, afternoon, early afternoon"
    assert "Quarter: Q1 2026" in one(spark, dates.temporal_context("x"), d, "timestamp")
    assert one(spark, dates.alternative_dates("x"), d, "timestamp") == "28/01/2026, 2026-01-28, January 28, 2026, Jan 28, 2026, 28 January 2026"
    assert one(spark, dates.parse_date("x"), "2020-02-21 11:23:23") == datetime(2020, 2, 21, 11, 23, 23)
    assert one(spark, dates.parse_date("x"), "no date") is None and one(spark, dates.temporal_context("x"), None, "timestamp") is None


@pytest.mark.parametrize(
    "q, start, end",
    [
        ("earliest record", datetime(1900, 1, 1), intent.MAX_DATE), ("latest pdf", datetime(2025, 12, 29), NOW), ("after October 9, 2025", datetime(2025, 10, 10), intent.MAX_DATE), ("before 2025-03-01", datetime(1900, 1, 1), datetime(2025, 2, 28)),
        ("between January 2025 and March 2025", datetime(2025, 1, 1), datetime(2025, 3, 31, 23, 59, 59)), ("from 2025-01-02 to 2025-01-05", datetime(2025, 1, 2), datetime(2025, 1, 5, 23, 59, 59)),
        ("around noon", datetime(2026, 1, 28, 11, 30), datetime(2026, 1, 28, 12, 30)), ("at 3:15 pm", datetime(2026, 1, 28, 15, 14), datetime(2026, 1, 28, 15, 16)), ("yesterday", datetime(2026, 1, 27), datetime(2026, 1, 27, 23, 59, 59)),
        ("day before yesterday", datetime(2026, 1, 26), datetime(2026, 1, 26, 23, 59, 59)), ("3 days ago", datetime(2026, 1, 25), datetime(2026, 1, 25, 23, 59, 59)), ("last week", datetime(2026, 1, 19), datetime(2026, 1, 25, 23, 59, 59)),
        ("last month", datetime(2025, 12, 1), datetime(2025, 12, 31, 23, 59, 59)), ("last 2 months", datetime(2025, 11, 28), NOW), ("Q1 2024", datetime(2024, 1, 1), datetime(2024, 3, 31, 23, 59, 59)), ("week 42 of 2024", datetime(2024, 10, 13), datetime(2024, 10, 19, 23, 59, 59)),
        ("last october", datetime(2025, 10, 1), datetime(2025, 10, 31, 23, 59, 59)), ("oct 3, 2024", datetime(2024, 10, 3), datetime(2024, 10, 3, 23, 59, 59)), ("09-10-2025", datetime(2025, 10, 9), datetime(2025, 10, 9, 23, 59, 59)),
        ("31/12/2025", datetime(2025, 12, 31), datetime(2025, 12, 31, 23, 59, 59)), ("12/31/2025", datetime(2025, 12, 31), datetime(2025, 12, 31, 23, 59, 59)), ("reports of 2023", datetime(2023, 1, 1), datetime(2023, 12, 31, 23, 59, 59)),
        ("may I see the report", None, None), ("no date at all", None, None),
    ],
)
def test_date_ranges(q, start, end):
    assert intent.date_range(q, NOW) == (start, end)


@pytest.mark.parametrize(
    "raw, want",
    [('["a","b"]', ["a", "b"]), ('```json\n["a"]\n```', ["a"]), ('Here: ["x", "y"] done', ["x", "y"]), ('"p" and "q"', ["p", "q"]), ("", []), (None, []), ("[]", []), ('{"keywords": ["k"]}', ["k"]), ('["a", null, " "]', ["a"]), ("nothing", [])],
)
def test_keyword_reply(raw, want):
    assert intent.parse_keyword_reply(raw) == want


def test_query_words():
    assert intent.clean_query("  a  &  b “c” ") == 'a and b "c"'
    assert intent.strip_function_words("what is the discussion about $20,000") == "discussion $20,000"
    assert intent.search_tokens("cost $20,000 for What lease Lease") == ["20,000", "20000", "cost", "lease"] or "20000" in intent.search_tokens("cost $20,000")
    assert intent.file_type_filters("a document in word") == ["docx", "doc"] and intent.file_type_filters("a document") == [] and intent.file_type_filters("a document", compat=True) == ["docx", "doc"]
    assert intent.dynamic_limit(20, True, True, 1, 3) == 600 and intent.dynamic_limit(100, True, False, 1, 0) == 1000
    assert "Week42" in intent.smart_keywords("report of week 42") and intent.understand("latest pdf", NOW).latest
    with pytest.raises(ValueError):
        intent.understand("  ", NOW)


def test_text(spark):
    assert one(spark, text.safe_key("x"), " Güter & Co. ") == "güter_co" and one(spark, text.safe_key("x"), "--") == "unknown"
    assert one(spark, text.clean_ocr("x"), "I N V O I C E for $ 5 ,000 in 20 26, CHAMBERLAI N, D26/ 133, leavinga") == "INVOICE for $5,000 in 2026, CHAMBERLAIN, D26/133, leaving a"
    assert one(spark, text.camel_spacing("x"), "helloWorld HTTPServer") == "hello World HTTPServer"
    assert one(spark, text.preview("x"), "a" * 101) == "a" * 100 + "..." and one(spark, text.preview("x"), None) is None
    assert one(spark, text.token_estimate("x"), "an extraordinary case.") == 7 and one(spark, text.token_estimate("x"), "") == 0 and one(spark, text.token_estimate("x"), None) == 0
    assert one(spark, text.clean_lines("x"), "[PAGE 1]\nab\n%%%%#####\nGood line , here") == "[PAGE 1]\nGood line, here"
    assert one(spark, text.correct_characters("x"), "fi1l 0ften 5erver rnodel modern 6reen") == "fill Often Server model modern Green"
    assert one(spark, text.normalize_names("x"), "the CE O of open text, Q 3, ofa kind") == "the CEO of OpenText, Q3, of a kind"
    assert one(spark, text.rebuild_paragraphs("x"), "one\ntwo\n- item\nHEAD 1\nthree") == "one two\n\n- item\n\nHEAD 1 three"
    assert one(spark, text.pack_lines("x", 5), "ab\ncd\nefghijk\nl") == ["ab\ncd", "efghijk", "l"]
    assert "exam\nple" not in one(spark, text.universal_clean("x"), "an exam-\nple of the servicePart")
    assert one(spark, text.column_letters("x"), 28, "int") == "AB"
    r, c = text.cell_reference("x")
    assert one(spark, F.struct(r, c), "BC12") == (12, 55)


def test_chunks():
    with pytest.raises(ValueError):
        chunk.validate(50, 10)
    with pytest.raises(ValueError):
        chunk.validate(200, 200)
    assert chunk.chunk_text("") == [] and chunk.chunk_text(None) == []
    t = "[PAGE 1]" + "One sentence here. " * 60 + "[PAGE 2]" + "Another one there. " * 60
    got = chunk.chunk_text(t, 100, 20)
    assert got[0][2] == 0 and got[-1][4] == 2 and got[0][4] == 1 and all(e - s <= 400 for _, _, s, e, _ in got)
    assert all(b[2] < a[3] and b[2] > a[2] for a, b in zip(got, got[1:]))
