"""Lexical search over an inverted index kept as a table of postings.

Terms are runs of letters and digits, lower-cased. A posting holds term, document, field class and frequency. Two
analyzers are offered: plain terms, and English ones, which are stemmed and leave stop words out, for documents and
queries alike. Documents without terms have no postings; blank queries, and queries of stop words alone, match nothing.

:func:`write_index` stores postings by buckets of terms, sorted by term, so a search reads the buckets of its terms
and within them the row groups that may hold them. The range partitioning behind it splits frequent terms by document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.session import stage

# fixed values: weights of the four field classes
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
# fixed values: field -> class
FIELD_CLASSES = {"title": "A", "content": "B", "category": "C", "record_type": "C", "container": "D", "assignee": "D", "file_type": "D"}
LIKE_SCORE = 0.8
BUCKETS = 64
_TERM = re.compile(r"[^\W_]+")
# fixed values: words the English analyzer leaves out (public list of the Snowball project)
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having",
    "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
]
_STOP = frozenset(ENGLISH_STOP_WORDS)


def plain_term(word: str) -> str:
    return word


@lru_cache(maxsize=500_000)
def english_term(word: str) -> str:
    """The stem of a lower-cased word, empty for a stop word."""
    return "" if word in _STOP else stem(word)


def query_terms(q: str, analyzer: Callable[[str], str] = plain_term) -> list[str]:
    return [t for t in dict.fromkeys(map(analyzer, _TERM.findall(q.lower()))) if t]


def postings(df: DataFrame, id_col: str, fields: dict[str, str], analyzer: Callable[[str], str] = plain_term) -> DataFrame:
    """``(term, id, field, tf)`` for the columns named in ``fields`` (column -> field class A to D).

    A document is counted where it stands, so nothing is shuffled; ``id_col`` must be unique.
    """
    classes = list(fields.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [c.to_pylist() for c in batch.columns[1:]]
            at, term, field, tf = [], [], [], []
            for i in range(batch.num_rows):
                for kind in dict.fromkeys(classes):
                    count: Counter = Counter()
                    for c, k in zip(texts, classes):
                        if k == kind and c[i]:
                            count.update(map(analyzer, _TERM.findall(c[i].lower())))
                    del count[""]
                    at += [i] * len(count)
                    term += count.keys()
                    field += [kind] * len(count)
                    tf += count.values()
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(field, pa.string()), pa.array(tf, pa.int32())], names=["term", "id", "field", "tf"])

    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("id", df.schema[id_col].dataType), T.StructField("field", T.StringType()), T.StructField("tf", T.IntegerType())])
    return df.select(F.col(id_col).alias("id"), *fields).mapInArrow(run, schema)


def _bucket(term: Column) -> Column:
    return (F.crc32(term) % BUCKETS).cast("int")


def write_postings(made: DataFrame, path: str) -> None:
    """Store postings, and whatever columns come with them, by buckets of terms and sorted by term; they are read twice."""
    spread = made.withColumn("bucket", _bucket(F.col("term"))).repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
    spread.write.partitionBy("bucket").parquet(path)


def write_index(df: DataFrame, id_col: str, fields: dict[str, str], path: str, analyzer: Callable[[str], str] = plain_term) -> None:
    """Store the postings of ``df``; :func:`open_index` reads them. Maintained with the table it belongs to."""
    made = stage(postings(df, id_col, fields, analyzer), "postings")
    write_postings(made, f"{path}/postings")
    made.groupBy("id").agg(F.sum("tf").alias("n_terms")).write.parquet(f"{path}/lengths")


_SCHEMA = "term string, id {id}, field string, tf int, bucket int"


def open_index(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Postings of a stored index, partitioned by ``bucket``."""
    return spark.read.schema(_SCHEMA.format(id=id_type)).parquet(f"{path}/postings")


def open_lengths(spark: SparkSession, path: str) -> DataFrame:
    """``(id, n_terms)`` of a stored index."""
    return spark.read.parquet(f"{path}/lengths")


def of_terms(index: DataFrame, wanted: list[str]) -> DataFrame:
    """Postings of the given terms; of a stored index only their buckets are read."""
    if not wanted:
        return index.where(F.lit(False))
    if "bucket" in index.columns:
        index = index.where(F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % BUCKETS for w in wanted})))
    return index.where(F.col("term").isin(wanted))


def weight_of(field: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), field)


def search(index: DataFrame, q: str, match: str = "all", limit: int | None = 20, analyzer: Callable[[str], str] = plain_term) -> DataFrame:
    """``(id, score, matched)``: documents that hold all terms of the query, or any of them with ``match='any'``.

    The score sums weight * tf / (tf + 1) over terms and fields.
    """
    wanted = query_terms(q, analyzer)
    hits = of_terms(index, wanted)
    if len(wanted) <= 62:  # one bit per term keeps the count of distinct terms in the same partial aggregate
        bit = F.lit(0).cast("long")
        for i, t in enumerate(wanted):
            bit = F.when(F.col("term") == t, F.lit(1 << i).cast("long")).otherwise(bit)
        matched = F.bit_count(F.bit_or(bit)).cast("long")
    else:
        matched = F.count_distinct("term")
    got = hits.groupBy("id").agg(F.sum(weight_of(F.col("field")) * F.col("tf") / (F.col("tf") + 1)).alias("score"), matched.alias("matched"))
    if match == "all":
        got = got.where(F.col("matched") == len(wanted))
    return got.orderBy(F.desc("score"), "id").limit(limit) if limit else got


def bm25(index: DataFrame, lengths: DataFrame, q: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(id, score)`` by Okapi BM25 (Robertson and Zaragoza 2009); ``lengths`` is ``(id, n_terms)``."""
    stats = lengths.agg(F.count("*").alias("n"), F.avg("n_terms").alias("mean"))
    hits = of_terms(index, query_terms(q)).groupBy("term", "id").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    # one row of statistics and one per query term: both bounded by the query
    joined = hits.join(F.broadcast(df), "term").join(lengths, "id").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / F.col("mean")))
    return joined.groupBy("id").agg(F.sum(idf * tf).alias("score"))


def escape_like(word: str) -> str:
    return word.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")


def contains_any(content: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(content), F.lit(w.lower()))
    return out


def like_fallback(df: DataFrame, id_col: str, content: str, words: list[str], limit: int = 100) -> DataFrame:
    """``(id, score)`` with a fixed score of the rows that hold any of the words, whatever the case, in order of id."""
    return df.where(contains_any(F.col(content), words)).select(F.col(id_col).alias("id"), F.lit(LIKE_SCORE).alias("score")).orderBy("id").limit(limit)


def like_in_token_order(df: DataFrame, id_col: str, content: str, tokens: list[str], limit: int = 5, most_tokens: int = 4) -> DataFrame:
    """``(id, first_token)``: rows that hold a token, those of earlier tokens first, each row once."""
    used = tokens[:most_tokens]
    first = F.coalesce(*[F.when(F.contains(F.lower(F.col(content)), F.lit(t.lower())), F.lit(i)) for i, t in enumerate(used)], F.lit(None).cast("int"))
    hits = df.select(F.col(id_col).alias("id"), first.alias("first_token")).where("first_token is not null")
    return hits.orderBy("first_token", "id").limit(limit)


def web_query(content: Column, q: str) -> Column:
    """Predicate of a search-box query: words are all needed, ``or`` gives alternatives, ``-`` excludes, quotes hold phrases."""

    def holds(words: list[str]) -> Column:
        return content.rlike(r"(?i)(?U)\b" + r"[\W_]+".join(re.escape(w) for w in words) + r"\b")

    groups: list[Column] = []
    current: Column | None = None
    for neg, phrase, word in re.findall(r'(-?)(?:"([^"]+)"|(\S+))', q):
        if not phrase and word.lower() == "or":
            if current is not None:
                groups.append(current)
                current = None
            continue
        parts = re.findall(r"[^\W_]+", phrase or word)
        if not parts:
            continue
        c = ~holds(parts) if neg else holds(parts)
        current = c if current is None else current & c
    if current is not None:
        groups.append(current)
    out = F.lit(False)
    for g in groups:
        out = out | g
    return F.coalesce(out, F.lit(False))


def web_terms(q: str) -> list[str]:
    """Words a search-box query asks for, those of excluded words and phrases left out."""
    out = []
    for neg, phrase, word in re.findall(r'(-?)(?:"([^"]+)"|(\S+))', q):
        if not neg and (phrase or word.lower() != "or"):
            out += _TERM.findall((phrase or word).lower())
    return list(dict.fromkeys(out))


def web_rank(content: Column, q: str) -> Column:
    """Score of a text for a search-box query: tf / (tf + 1) summed over its words, with the weight of content."""
    total = F.lit(0.0)
    for t in web_terms(q):
        tf = F.regexp_count(F.lower(content), F.lit(rf"(?U)(?<![\p{{L}}\p{{N}}]){t}(?![\p{{L}}\p{{N}}])"))
        total = total + tf / (tf + 1)
    return total * WEIGHTS["B"]


def web_top_per_record(df: DataFrame, id_col: str, record: str, content: str, q: str, n: int = 5) -> DataFrame:
    """``(record, id, score)``: the best ``n`` rows of each record for a search-box query over contents."""
    hits = df.where(web_query(F.col(content), q)).select(record, F.col(id_col).alias("id"), web_rank(F.col(content), q).alias("score"))
    return top_per_group(hits, record, "score", "id", n)


def keyword_score(content: Column, keywords: list[str]) -> Column:
    """Share of keywords held: 1 for each whole one, 0.3 for one of five letters or more whose first five are held; at most 1."""
    if not keywords:
        return F.lit(0.0)
    low = F.lower(F.coalesce(content, F.lit("")))
    total = F.lit(0.0)
    for k in keywords:
        k = k.lower()
        exact = F.contains(low, F.lit(k))
        part = F.when(F.contains(low, F.lit(k[:5])), 0.3).otherwise(0.0) if len(k) >= 5 else F.lit(0.0)
        total = total + F.when(exact, 1.0).otherwise(part)
    return F.when(F.trim(low) == "", 0.0).otherwise(F.least(F.lit(1.0), total / len(keywords)))


# fixed values: field -> weight
KEYWORD_WEIGHTS = {"chunk_content": 0.35, "record_title": 0.20, "file_name": 0.15, "document_category": 0.11, "record_type": 0.08, "container": 0.05, "assignee": 0.04, "date_created": 0.02, "file_type": 0.01}


def keyword_score_fields(columns: dict[str, Column], keywords: list[str]) -> Column:
    """Weighted mean of :func:`keyword_score` over the fields that are present."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in KEYWORD_WEIGHTS.items():
        if name in columns:
            there = F.coalesce(F.trim(columns[name]), F.lit("")) != ""
            total = total + F.when(there, keyword_score(columns[name], keywords) * w).otherwise(0.0)
            weight = weight + F.when(there, w).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(0.0)


# ---- stemming (Porter 1980) --------------------------------------------------------------------------------

_VOWEL = "aeiou"
# fixed values: endings and what they become
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]


def _shape(w: str) -> str:
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in _VOWEL or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c", re.sub("c+", "c", _shape(w))))


def _cvc(w: str) -> bool:
    return len(w) >= 3 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def stem(word: str) -> str:
    """Stem of a lower-cased English word."""
    w = word
    if len(w) <= 2:
        return w
    for a, b in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(a):
            w = w[: len(w) - len(a)] + b
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            base = w[: -len(end)]
            if w.endswith(end) and "v" in _shape(base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in _STEP4:
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def top_per_group(hits: DataFrame, group: str, score: str, tie: str, k: int = 1) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return hits.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")
