"""Context for questions about records: neighbour windows, budgets, ordered unions and prompts.

Sequences are whole numbers per record; ties within a sequence are ordered by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.models import Generator, generate_table
from recordloom.operators import lexical, vector

CONTEXT_BUDGET = 120_272
SYNTHESIS_BUDGET = 121_632
SUMMARY_CHARS, SUMMARY_CHUNKS = 50_000, 50


def neighbours(anchors: DataFrame, chunks: DataFrame, record: str, seq: str, reach: int = 2) -> DataFrame:
    """Chunks within ``reach`` of an anchor ``(record, seq)``, each once, with ``is_anchor``; an equi-join on the wanted sequences."""
    wanted = anchors.select(record, F.col(seq).cast("long").alias("_a")).distinct()
    wanted = wanted.select(record, F.explode(F.sequence(F.col("_a") - reach, F.col("_a") + reach)).alias("_s"), "_a")
    wanted = wanted.groupBy(record, "_s").agg(F.max(F.col("_s") == F.col("_a")).alias("is_anchor"))
    c = chunks.withColumn("_s", F.col(seq).cast("long"))
    return c.join(wanted, [record, "_s"]).drop("_s")


def budget_prefix(rows: DataFrame, partition: list[str], order: list[str], text: str, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """Rows in order while their summed characters stay within the budget; the first that would exceed it ends the prefix."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running_chars", F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).over(w)).where(F.col("running_chars") <= budget)


def priority_union(first: DataFrame, second: DataFrame, id_col: str, rank: str, k: int = 5) -> DataFrame:
    """Hits of the first list by rank, then unseen ones of the second, k in all, with ``source`` and ``place``. Both lists are top-k results."""
    both = first.select(id_col, rank).withColumn("source", F.lit(1)).unionByName(second.select(id_col, rank).withColumn("source", F.lit(2)))
    best = both.groupBy(id_col).agg(F.min(F.struct("source", rank)).alias("b"))
    flat = best.select(id_col, F.col("b.source").alias("source"), F.col(f"b.{rank}").alias(rank)).orderBy("source", rank, id_col).limit(k)
    return flat.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("source", rank, id_col)))


def synthesis_prompt(hits: DataFrame, question: str, title: str, content: str, score: str = "score", top: int = 5, budget: int = SYNTHESIS_BUDGET) -> DataFrame:
    """One row ``prompt``: the best ``top`` hits, each cut to an equal share of the budget, the question last."""
    best = hits.orderBy(F.desc(score), "id").limit(top)
    w = Window.partitionBy()
    share = F.floor(F.lit(budget) / F.count("*").over(w)).cast("int")
    ranked = best.withColumn("_n", F.row_number().over(Window.partitionBy().orderBy(F.desc(score), "id"))).withColumn("_share", share)
    part = F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), F.coalesce(title, F.lit("")), F.lit("\n"), F.substr(F.coalesce(content, F.lit("")), F.lit(1), F.col("_share")))
    parts = ranked.agg(F.sort_array(F.collect_list(F.struct("_n", part.alias("p")))).alias("ps"))
    return parts.select(F.concat(F.lit("Records:\n"), F.array_join(F.transform("ps", lambda x: x["p"]), "\n\n"), F.lit(f"\n\nQuestion: {question}")).alias("prompt"))


def record_summary_context(chunks: DataFrame, record: str, seq: str, content: str) -> DataFrame:
    """``(record, context)``: the first chunks of each record in order, joined and cut to a length."""
    w = Window.partitionBy(record).orderBy(seq, "id")
    first = chunks.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= SUMMARY_CHUNKS)
    joined = first.groupBy(record).agg(F.sort_array(F.collect_list(F.struct("_n", F.col(content).alias("c")))).alias("cs"))
    return joined.select(record, F.substring(F.array_join(F.transform("cs", lambda x: x["c"]), "\n\n"), 1, SUMMARY_CHARS).alias("context"))


def labelled_chunk(seq: Column, page: Column, index: Column, content: Column, anchor: Column) -> Column:
    """A chunk with its place, marked when it is an anchor."""
    mark = F.when(anchor, " RELEVANT").otherwise("")
    return F.concat(F.lit("[Sequence "), seq.cast("string"), F.lit(", Page "), page.cast("string"), F.lit(", Index "), index.cast("string"), F.lit("]"), mark, F.lit("\n"), content)


def qa_context(anchors: DataFrame, chunks: DataFrame, budget: int = CONTEXT_BUDGET) -> DataFrame:
    """``(record_uri, context)``: windows around the anchors of each record, in sequence, within the budget."""
    near = neighbours(anchors, chunks, "record_uri", "chunk_sequence")
    kept = budget_prefix(near, ["record_uri"], ["chunk_sequence", "id"], "chunk_content", budget)
    line = labelled_chunk(F.col("chunk_sequence"), F.col("page_number"), F.col("chunk_index"), F.coalesce("chunk_content", F.lit("")), F.col("is_anchor"))
    got = kept.groupBy("record_uri").agg(F.sort_array(F.collect_list(F.struct("chunk_sequence", "id", line.alias("t")))).alias("ts"))
    return got.select("record_uri", F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n").alias("context"))


def record_answer(chunks: DataFrame, index: DataFrame, question: str, vector_of: Sequence[float] | None, generator: Generator, anchors: int = 5, least: float = 0.2) -> DataFrame:
    """``(record_uri, prompt, answer, answer_error)``: the chunks of a record, its best for the question by both legs, their context, and a model's answer.

    ``index`` holds English postings by chunk ``id``. Chunks found by words come first, then the most similar ones that
    reach ``least``; a record without any anchor is answered from its first chunks.
    """
    ids = chunks.select("id")
    words = lexical.search(index, question, "any", None, lexical.english_term).join(ids, "id", "left_semi").orderBy(F.desc("score"), "id").limit(anchors).select("id", F.col("score").alias("rank"))
    near = vector.top_k(chunks, "id", "vector", vector_of, anchors, least).select("id", F.col("score").alias("rank")) if vector_of is not None else words.limit(0)
    best = priority_union(words.withColumn("rank", -F.col("rank")), near.withColumn("rank", -F.col("rank")), "id", "rank", anchors)
    found = chunks.join(F.broadcast(best.select("id")), "id", "left_semi").select("record_uri", "chunk_sequence")
    first = chunks.where(F.col("chunk_sequence") < anchors).select("record_uri", "chunk_sequence")
    use = found.union(first.join(found.select("record_uri").distinct(), "record_uri", "left_anti"))
    prompt = F.concat(F.col("context"), F.lit(f"\n\nQuestion: {question}"))
    return generate_table(qa_context(use, chunks).select("record_uri", prompt.alias("prompt")), "prompt", generator)
