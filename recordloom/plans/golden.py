"""Functions of queries and texts on tables of cases with stated results; the SQL holds the results alone."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import chunk, intent, text
from recordloom.operators import acl
from recordloom.sources import scans

NOW = datetime(2026, 1, 28)
END = "9999-12-31 23:59:59"

# (number of the rule, query, start, end), asked on Wednesday 28 January 2026
DATES = [
    (1, "earliest record", "1900-01-01 00:00:00", END), (1, "the oldest lease of 2020", "1900-01-01 00:00:00", END), (2, "latest pdf", "2025-12-29 00:00:00", "2026-01-28 00:00:00"), (2, "most recent invoices", "2025-12-29 00:00:00", "2026-01-28 00:00:00"),
    (3, "after October 9, 2025", "2025-10-10 00:00:00", END), (3, "created after 2025-03-01", "2025-03-02 00:00:00", END), (4, "before 2025-03-01", "1900-01-01 00:00:00", "2025-02-28 00:00:00"), (4, "before 1st of nothing", None, None),
    (5, "between 9 am and 5 pm on 2025-10-09", "2025-10-09 09:00:00", "2025-10-09 17:00:00"), (6, "between January 2025 and March 2025", "2025-01-01 00:00:00", "2025-03-31 23:59:59"), (6, "from Nov 2024 to Feb 2025", "2024-11-01 00:00:00", "2025-02-28 23:59:59"),
    (7, "from 2025-01-02 to 2025-01-05", "2025-01-02 00:00:00", "2025-01-05 23:59:59"), (7, "between October 3, 2024 and October 9, 2024", "2024-10-03 00:00:00", "2024-10-09 23:59:59"),
    (8, "around noon", "2026-01-28 11:30:00", "2026-01-28 12:30:00"), (8, "around midnight", "2026-01-27 23:30:00", "2026-01-28 00:30:00"), (8, "in the morning", "2026-01-28 05:00:00", "2026-01-28 12:00:00"), (8, "this afternoon", "2026-01-28 12:00:00", "2026-01-28 17:00:00"),
    (8, "evening records", "2026-01-28 17:00:00", "2026-01-28 21:00:00"), (8, "created at night", "2026-01-28 21:00:00", "2026-01-29 05:00:00"), (8, "around 3:15 pm", "2026-01-28 14:45:00", "2026-01-28 15:45:00"),
    (9, "at 3:15 pm", "2026-01-28 15:14:00", "2026-01-28 15:16:00"), (9, "at 12 am", "2026-01-27 23:59:00", "2026-01-28 00:01:00"), (10, "after 14:30", "2026-01-28 14:30:00", END), (11, "created today", "2026-01-28 00:00:00", "2026-01-28 23:59:59"),
    (12, "recently added", "2026-01-14 00:00:00", "2026-01-28 00:00:00"), (13, "yesterday", "2026-01-27 00:00:00", "2026-01-27 23:59:59"), (13, "day before yesterday", "2026-01-26 00:00:00", "2026-01-26 23:59:59"),
    (14, "3 days ago", "2026-01-25 00:00:00", "2026-01-25 23:59:59"), (14, "last 10 days", "2026-01-18 00:00:00", "2026-01-28 00:00:00"), (15, "last week", "2026-01-19 00:00:00", "2026-01-25 23:59:59"), (15, "this week", "2026-01-26 00:00:00", "2026-01-28 00:00:00"),
    (16, "last month", "2025-12-01 00:00:00", "2025-12-31 23:59:59"), (16, "this month", "2026-01-01 00:00:00", "2026-01-28 00:00:00"), (17, "last 2 weeks", "2026-01-14 00:00:00", "2026-01-28 00:00:00"), (17, "last 2 months", "2025-11-28 00:00:00", "2026-01-28 00:00:00"),
    (17, "last 3 years", "2023-01-28 00:00:00", "2026-01-28 00:00:00"), (18, "this year", "2026-01-01 00:00:00", "2026-01-28 00:00:00"), (18, "last year", "2025-01-01 00:00:00", "2025-12-31 23:59:59"), (19, "reports of 2023", "2023-01-01 00:00:00", "2023-12-31 23:59:59"),
    (19, "plan for 2040", None, None), (20, "Q1 2024", "2024-01-01 00:00:00", "2024-03-31 23:59:59"), (20, "third quarter of 2025", "2025-07-01 00:00:00", "2025-09-30 23:59:59"), (20, "q4", "2026-10-01 00:00:00", "2026-12-31 23:59:59"),
    (21, "week 42 of 2024", "2024-10-13 00:00:00", "2024-10-19 23:59:59"), (21, "week of October 9, 2025", "2025-10-05 00:00:00", "2025-10-11 23:59:59"), (22, "last october", "2025-10-01 00:00:00", "2025-10-31 23:59:59"), (22, "last january", "2026-01-01 00:00:00", "2026-01-31 23:59:59"),
    (23, "October 2024", "2024-10-01 00:00:00", "2024-10-31 23:59:59"), (23, "in february", "2026-02-01 00:00:00", "2026-02-28 23:59:59"), (24, "oct 3, 2024", "2024-10-03 00:00:00", "2024-10-03 23:59:59"), (24, "3rd October 2024", "2024-10-03 00:00:00", "2024-10-03 23:59:59"),
    (25, "09-10-2025", "2025-10-09 00:00:00", "2025-10-09 23:59:59"), (25, "31/12/2025", "2025-12-31 00:00:00", "2025-12-31 23:59:59"), (25, "12/31/2025", "2025-12-31 00:00:00", "2025-12-31 23:59:59"), (25, "2025-10-09", "2025-10-09 00:00:00", "2025-10-09 23:59:59"),
    (26, "may I see the report", None, None), (26, "no date at all", None, None), (26, "", None, None),
]

# (function, query, result: a JSON array or a plain value)
QUERIES = [
    ("smart", 'find "annual report" 20,000 for Harbour Board', "annual report|20000|Harbour Board"), ("smart", "report of week 42", "42|report|week|Week42"), ("smart", "lease A12B of HR-2024/7", "2024|A12B|lease|HR-2024/7"), ("smart", "", ""),
    ("numbers", 'the "cost of timber" in 2024 and 17 parts', "cost of timber|2024|17"), ("numbers", "no numbers", ""),
    ("types", "pdf or word documents", "pdf|docx|doc"), ("types", "a document", ""), ("types", "Excel sheets and txt", "xlsx|xls|txt"), ("types_compat", "a document", "docx|doc"), ("types_compat", "powerpoint", "pptx|ppt"),
    ("tokens", "cost $20,000 for What lease Lease", "20,000|20000|cost|lease"), ("tokens", "rent of 17 flats", "17|rent|flats"), ("tokens", "is it", ""),
    ("score", "0.5 api gateway", "0.3"), ("score", "0.5 Harbour", "0.35"), ("score", "0.5 file of invoices", "0.4"), ("score", "0.15 api Service file", "0.2"), ("score", "0.7 cranes", "0.7"),
    ("reply", '["a","b"]', "a|b"), ("reply", '```json\n["a"]\n```', "a"), ("reply", 'Here: ["x", "y"] done', "x|y"), ("reply", '"p" and "q"', "p|q"), ("reply", '{"keywords": ["k"]}', "k"), ("reply", '["a", null, " "]', "a"), ("reply", "nothing", ""), ("reply", "", ""),
    ("date", "October 9th, 2025", "2025-10-09"), ("date", "9 Oct 2025", "2025-10-09"), ("date", "sept 2024", "2024-09-01"), ("date", "2025-02-30", ""), ("date", "13/05/2024", "2024-05-13"), ("date", "05/13/2024", "2024-05-13"), ("date", "tomorrow", "2026-01-29"), ("date", "March 3", "2026-03-03"),
    ("fallback", "which book is called Timber Trade?", "Timber|Trade"),
]

_SENTENCE = "One sentence here. "
# (name, text, size in tokens, overlap in tokens, chunks as sequence:start-end@page)
CHUNKS = [
    ("no sentence ends", "word " * 200, 100, 20, "0:0-375@1|1:295-670@1|2:590-965@1|3:885-1000@1"), ("sentence ends", _SENTENCE * 40, 100, 20, "0:0-399@1|1:319-703@1|2:623-760@1"), ("within one chunk", "Short text.", 1000, 200, "0:0-11@1"), ("blank", " \n ", 1000, 200, ""),
    ("empty", "", 500, 0, ""), ("page marks", "[PAGE 3]abc[PAGE 4]def", 1000, 200, "0:0-6@3"), ("text before the first mark", "abc[PAGE 2]def", 100, 0, "0:0-6@0"), ("two pages", "[PAGE 1]" + "x" * 400 + "[PAGE 2]" + "y" * 100, 100, 0, "0:0-400@1|1:400-500@2"), ("no overlap", "x" * 900, 100, 0, "0:0-400@1|1:400-800@1|2:800-900@1"),
    ("overlap of half", "x" * 900, 100, 50, "0:0-400@1|1:200-600@1|2:400-800@1|3:600-900@1"),
]

# (function, text, result)
CLEANING = [
    ("lines", "[PAGE 1]\nab\n%%%%#####\nGood line , here", "[PAGE 1]\nGood line, here"), ("lines", "", ""), ("lines", "One.Two  three.....\n----- cut -----", "One. Two three...\n--- cut ---"),
    ("ocr", "I N V O I C E for $ 5 ,000 in 20 26, CHAMBERLAI N, D26/ 133, leavinga", "INVOICE for $5,000 in 2026, CHAMBERLAIN, D26/133, leaving a"), ("ocr", "see file://c:/x.txt", "see"), ("ocr", "Q 3 well - kept", "Q3 well-kept"),
    ("camel", "helloWorld HTTPServer v2Beta", "hello World HTTPServer v2 Beta"), ("characters", "fi1l 0ften 5erver rnodel modern 6reen 8ank", "fill Often Server model modern Green Bank"), ("characters", "WllI tab1es", "WIII tables"),
    ("names", "the CE O of open text, Q 3, FY 26, ofa kind", "the CEO of OpenText, Q3, FY26, of a kind"), ("names", "Anda ib m mc donald", "Anda IBM McDonald"),
    ("paragraphs", "one\ntwo\n- item\nHEAD 1\nthree", "one two\n\n- item\n\nHEAD 1 three"), ("paragraphs", "a\n\n1. b\nhttps://x", "a\n\n1. b\n\nhttps://x"), ("pack", "ab\ncd\nefghijk\nl", "ab\ncd#efghijk#l"), ("noise", "an exam-\nple of Fi1es , here", "an example of Files, here"),
    ("universal", "The servicePart was insta11ed.\nIt runs\n- fast", "The service Part was installed. It runs - fast"),
]


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], names: str) -> str:
    def lit(v: object) -> str:
        if v is None:
            return "NULL::VARCHAR"
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


def golden_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date ranges of queries, at least one for each rule."""

    def asked(q: str) -> list[str | None]:
        return [None if d is None else f"{d:%Y-%m-%d %H:%M:%S}" for d in intent.date_range(q, NOW)]

    got = [(n, i, *asked(q)) for i, (n, q, _, _) in enumerate(DATES)]  # queries are understood on the driver, one at a time
    return _rows(spark, got, "rule int, n int, start_at string, end_at string")


def golden_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords, numbers, file types, tokens, scores, replies and dates of queries."""
    tools: dict[str, Callable[[str], object]] = {
        "smart": intent.smart_keywords, "numbers": intent.numbers_and_quotes, "types": intent.file_type_filters, "types_compat": lambda q: intent.file_type_filters(q, True), "tokens": intent.search_tokens,
        "score": lambda q: f"{intent.dynamic_min_score(float(q.split(' ', 1)[0]), q, q.split(' ')[1:]):.4g}", "reply": intent.parse_keyword_reply, "date": lambda q: f"{d:%Y-%m-%d}" if (d := intent.parse_query_date(q, NOW)) else "", "fallback": intent.fallback_words,
    }
    got = [(i, k, "|".join(r) if isinstance(r := tools[k](q), list) else str(r)) for i, (k, q, _) in enumerate(QUERIES)]
    return _rows(spark, got, "n int, tool string, result string")


def golden_query_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column forms of the same functions."""
    rows = [(i, k, q) for i, (k, q, _) in enumerate(QUERIES) if k in ("numbers", "types", "reply") and not q.startswith("{")]
    df = _rows(spark, rows, "n int, tool string, q string")
    q = F.col("q")
    made = F.when(F.col("tool") == "numbers", intent.numbers_and_quotes_col(q)).when(F.col("tool") == "types", intent.file_types_col(q)).otherwise(intent.keyword_reply_col(q))
    return df.select("n", "tool", F.array_join(made, "|").alias("result"))


def golden_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of texts by size and overlap."""
    out = None
    for name, body, size, overlap, _ in CHUNKS:
        one = chunk.chunk_documents(_rows(spark, [(name, body)], "id string, body string"), "id", "body", size, overlap)
        out = one if out is None else out.union(one)
    part = F.format_string("%d:%d-%d@%d", "chunk_sequence", "start_pos", "end_pos", "page_number")
    made = out.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(part)), "|").alias("chunks"))
    names = _rows(spark, [(c[0],) for c in CHUNKS], "id string")
    return names.join(made, "id", "left").select(F.col("id").alias("name"), F.coalesce("chunks", F.lit("")).alias("chunks"))


def golden_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of lines and texts."""
    df = _rows(spark, [(i, k, t) for i, (k, t, _) in enumerate(CLEANING)], "n int, tool string, t string")
    t = F.col("t")
    tools = {
        "lines": text.clean_lines(t), "ocr": text.clean_ocr(t), "camel": text.camel_spacing(t), "characters": text.correct_characters(t), "names": text.normalize_names(t), "paragraphs": text.rebuild_paragraphs(t),
        "pack": F.array_join(text.pack_lines(t, 5), "#"), "noise": text.clean_noise(t), "universal": text.universal_clean(t),
    }
    made = F.coalesce(*[F.when(F.col("tool") == k, c) for k, c in tools.items()])
    return df.select("n", "tool", made.alias("result"))


def golden_search_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts of the source system: all parts, a month of days, more than a month, nothing."""
    days = scans.search_string(None, datetime(2024, 1, 1), datetime(2024, 1, 31))
    got = [
        (1, scans.search_string("lease", datetime(2024, 1, 30), datetime(2024, 2, 1), ["pdf", ".docx"])), (2, f"{days.count('createdOn')} {days[:22]} {days[-22:]}"), (3, scans.search_string(" ", datetime(2024, 1, 1), datetime(2024, 2, 1))),
        (4, scans.search_string(None)), (5, scans.search_string("roof", None, None, ["pdf"])),
    ]
    return _rows(spark, got, "n int, s string")


_STRINGS = [
    (1, "content:lease and (createdOn:01/30/2024 or createdOn:01/31/2024 or createdOn:02/01/2024) and (extension:pdf or extension:docx)"), (2, "31 (createdOn:01/01/2024   createdOn:01/31/2024)"), (3, "(createdOn:01/01/2024)"), (4, "number:*"), (5, "content:roof and (extension:pdf)"),
]


def golden_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permission values by kind, and the JSON form of permission lists."""
    rows = _rows(spark, [(1, "jasilth"), (2, "NORTH\\jasilth"), (3, "Group: Clerks"), (4, "LOCATION:Block 3")], "n int, v string")
    kind, name = acl.classify(F.col("v"))
    lists = acl.acl_json({"UpdateDocument": F.array(F.lit("b")), "ViewDocument": F.array(name, F.lit("x"))})
    return rows.select("n", kind.alias("kind"), name.alias("name"), lists.alias("lists"))


_ACCESS = [(n, k, v, '{"ViewDocument":["' + v.replace("\\", "\\\\") + '","x"],"UpdateDocument":["b"]}') for n, k, v in [(1, "user", "jasilth"), (2, "user", "NORTH\\jasilth"), (3, "group", "Clerks"), (4, "location", "Block 3")]]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (golden_dates, golden_queries, golden_query_columns, golden_chunks, golden_cleaning, golden_search_strings, golden_access)}


def oracle_sql() -> dict[str, str]:
    columns = [(i, k, r) for i, (k, q, r) in enumerate(QUERIES) if k in ("numbers", "types", "reply") and not q.startswith("{")]
    return {
        "golden_dates": _values([(n, i, a, b) for i, (n, _, a, b) in enumerate(DATES)], "rule, n, start_at, end_at"), "golden_queries": _values([(i, k, r) for i, (k, _, r) in enumerate(QUERIES)], "n, tool, result"),
        "golden_query_columns": _values(columns, "n, tool, result"), "golden_chunks": _values([(c[0], c[4]) for c in CHUNKS], "name, chunks"), "golden_cleaning": _values([(i, k, r) for i, (k, _, r) in enumerate(CLEANING)], "n, tool, result"),
        "golden_search_strings": _values(_STRINGS, "n, s"), "golden_access": _values(_ACCESS, "n, kind, name, lists"),
    }
