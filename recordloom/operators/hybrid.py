"""Fusion of semantic and lexical hits, rerank scores and one hit per record."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_HITS = 1000


def expanded_limit(limit: int, allowed: int | None = None) -> int:
    """How many hits each leg fetches: five times the limit, 1000 at most, or as many as the records allowed."""
    return allowed if allowed else min(limit * 5, MOST_HITS)


def fuse(semantic: DataFrame, lexical: DataFrame, limit: int = 10, threshold: float = 0.0, keyword_weight: float = 0.3) -> DataFrame:
    """``(id, score, semantic, lexical)`` from two legs ``(id, score)`` of at most ``MOST_HITS`` rows each.

    A hit missing in a leg has 0 there; lexical scores are divided by their largest; the threshold comes after
    the limit.
    """
    a = semantic.select("id", F.col("score").alias("semantic"))
    b = lexical.select("id", F.col("score").alias("lexical"))
    # both legs are cut already, so one partition holds 2 * MOST_HITS rows at most and no leg is computed twice
    both = a.join(b, "id", "full_outer").withColumn("top", F.max("lexical").over(Window.partitionBy()))
    both = both.select("id", F.coalesce("semantic", F.lit(0.0)).alias("semantic"), F.coalesce(F.when(F.col("top") > 0, F.col("lexical") / F.col("top")), F.lit(0.0)).alias("lexical"))
    scored = both.withColumn("score", (1 - keyword_weight) * F.col("semantic") + keyword_weight * F.col("lexical"))
    return scored.orderBy(F.desc("score"), "id").limit(limit).where(F.col("score") >= threshold)


def fuse_like(semantic: DataFrame, like: DataFrame, limit: int = 10, threshold: float = 0.0) -> DataFrame:
    """Fusion when full-text search found nothing and the fallback did: the keyword leg weighs 0.9."""
    return fuse(semantic, like, limit, threshold, 0.9)


def best_per_record(hits: DataFrame, record: str = "record_uri", score: str = "score", tie: str = "id") -> DataFrame:
    """The best hit of each record; an aggregate, so a record with very many hits is reduced before the shuffle."""
    others = [c for c in hits.columns if c not in (record, score)]
    best = hits.groupBy(record).agg(F.max_by(F.struct(*hits.columns), F.struct(F.col(score), -F.col(tie) if dict(hits.dtypes)[tie] in ("bigint", "int") else F.col(tie))).alias("b"))
    return best.select(*[F.col(f"b.{c}") for c in [record, score, *others]])


def rerank(hits: DataFrame, raw: str, top_k: int, most: int = 50) -> DataFrame:
    """Hits by min-max normalised rerank score; the best ``most`` by ``score`` take part, equal raw scores give 1.

    ``hits`` is a search result and has been limited before, so the one-partition window is bounded by ``most``.
    """
    cand = hits.orderBy(F.desc("score"), "id").limit(most)
    w = Window.partitionBy()
    low, high = F.min(raw).over(w), F.max(raw).over(w)
    return cand.withColumn("rerank_score", F.when(high > low, (F.col(raw) - low) / (high - low)).otherwise(1.0)).orderBy(F.desc("rerank_score"), "id").limit(top_k)


def rerank_with(hits: DataFrame, query: str, text: str, scorer: Callable[[str, list[str]], list[float]], top_k: int, most: int = 50) -> DataFrame:
    """Rerank by a scorer of (query, texts); hits come back as they are when there are no more than ``top_k`` or the scorer fails.

    At most ``most`` hits are scored, in one task; ``rerank_score`` is their normalised score, or ``score`` where
    they were not reranked.
    """
    cand = hits.orderBy(F.desc("score"), "id").limit(most)
    schema = T.StructType([*hits.schema.fields, T.StructField("_raw", T.DoubleType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(it))  # at most ``most`` rows
        raw: list = [None] * len(p)
        if len(p) > top_k:
            try:
                raw = [float(x) for x in scorer(query, [t or "" for t in p[text]])]
            except Exception:
                raw = [None] * len(p)
        yield p.assign(_raw=pd.Series(raw, index=p.index, dtype="float64"))

    scored = cand.coalesce(1).mapInPandas(run, schema)
    w = Window.partitionBy()
    low, high = F.min("_raw").over(w), F.max("_raw").over(w)
    norm = F.when(F.col("_raw").isNull(), F.col("score")).when(high > low, (F.col("_raw") - low) / (high - low)).otherwise(1.0)
    return scored.withColumn("rerank_score", norm).drop("_raw").orderBy(F.desc("rerank_score"), F.desc("score"), "id").limit(top_k)
