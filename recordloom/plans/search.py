"""The search pipeline: understand, two legs, fuse, filter, one hit per record, access, order, cut."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.intent import QueryIntent, fallback_words, understand
from recordloom.operators import acl, filters, hybrid, lexical, vector
from recordloom.session import stage


@dataclass
class Store:
    """Tables a search runs on: chunks with a unique ``id``, their English postings, access tables, and stored cells of their vectors."""

    chunks: DataFrame
    index: DataFrame
    record_acl: DataFrame | None = None
    members: DataFrame | None = None
    user_groups: DataFrame | None = None
    cells: vector.Cells | None = None


def search(store: Store, query: str, embed: Callable[[str], Sequence[float]], now: datetime, top_k: int = 20, min_score: float = 0.3, user: int | None = None, metadata: dict[str, str] | None = None, filter_first: bool = False) -> DataFrame:
    """Hits of a natural-language query, best first, or by date when the query asks for earliest or latest.

    With ``filter_first`` all filters and access rules apply before the legs are cut, which gives the best hits
    among the allowed. Without it, for parity only, filters and access rules apply to the fused hits, so allowed
    hits below the cut of the legs are lost, and a date range that leaves nothing is dropped. With stored cells the
    semantic leg looks into the nearest of them only, otherwise at every vector.
    """
    intent: QueryIntent = understand(query, now, top_k, min_score)
    chunks = filters.entity_filter(store.chunks)
    if filter_first:
        # ids of the allowed chunks, found once: both legs and the hits are joined with them
        allowed = stage(_allowed(_filtered(chunks, intent, metadata, False), store, user).select("id"), "allowed")
    else:
        allowed = None
    fetch = hybrid.expanded_limit(intent.limit)
    asked = embed(intent.query)
    if store.cells is not None:
        vectors, column = store.cells.near(asked), "v"
    else:
        vectors, column = chunks.select("id", "vector"), "vector"
    if allowed is not None:
        vectors = vectors.join(allowed, "id", "left_semi")
    # one matrix product per Arrow batch; each task gives at most ``fetch`` rows
    semantic = vector.top_k(vectors, "id", column, asked, fetch, 0.0)
    found = lexical.search(store.index, intent.query, limit=None if filter_first else fetch, analyzer=lexical.english_term)
    if allowed is not None:
        found = found.join(allowed, "id", "left_semi").orderBy(F.desc("score"), "id").limit(fetch)
    # at most ``fetch`` narrow rows, which are looked at twice and joined with hits of the same number
    held = found.select("id", "score").collect()
    found = chunks.sparkSession.createDataFrame(held, found.select("id", "score").schema)
    words = fallback_words(intent.query)
    if len(intent.query) > 5 and words and not held:
        texts = chunks.join(allowed, "id", "left_semi") if allowed is not None else chunks
        fused = hybrid.fuse_like(semantic, lexical.like_fallback(texts, "id", "chunk_content", words, min(fetch, 100)), intent.limit, intent.min_score)
    else:
        fused = hybrid.fuse(semantic, found, intent.limit, intent.min_score)
    # at most 1000 narrow rows: wide columns are joined only now
    hits = chunks.join(F.broadcast(fused.select("id", "score", "semantic", "lexical")), "id")
    if not filter_first:
        hits = _allowed(_filtered(stage(hits, "hits"), intent, metadata, True), store, user)
    best = hybrid.best_per_record(hits)
    order: list[Column] = [F.desc("score"), F.col("id")]
    if intent.earliest:
        order = [F.asc_nulls_last("date_created"), *order]
    elif intent.latest:
        order = [F.desc_nulls_last("date_created"), *order]
    return best.orderBy(*order).limit(max(1, min(100, top_k)))


def _filtered(hits: DataFrame, intent: QueryIntent, metadata: dict[str, str] | None, fallback: bool) -> DataFrame:
    hits = filters.file_type_filter(hits, intent.file_types)
    hits = filters.date_filter(hits, "date_created", intent.start, intent.end, fallback)
    return filters.metadata_filter(hits, metadata or {})


def _allowed(hits: DataFrame, store: Store, user: int | None) -> DataFrame:
    if store.record_acl is None:
        return hits
    if user is None:
        return hits.where(acl.is_unrestricted(F.col("acl")))
    return acl.apply_acl(hits, store.record_acl, store.members, store.user_groups, user)
