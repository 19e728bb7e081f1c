"""Mix documents of several sources to target shares of all tokens by systematic sampling.

A recipe asks each source for a share of the mix. The mix of a recipe has ``total_tokens`` tokens, by default
as many as its sources hold. A source of t tokens that must give share * total is used
``rate = min(share * total / t, max_repeats)`` times on average; where the cap binds, the target cannot be
reached and the report says so. Within a source the documents stand in order of size, the expected copies are
summed along that order, one random offset is added, and a document is given once for each whole number its
stretch of the sum crosses: floor(rate) or ceil(rate) copies each, never more than ``max_repeats``. The order
by size keeps the tokens of any such sample close to rate * t.

Scale: tokens are counted once. Ranks within a source come from a range-partitioned pass, so a source that holds a
third of all rows is spread over many tasks.

Defined results: documents without a source, or of a source that no recipe names, are left out; null and
empty texts have 0 tokens and are sampled like others; a source named by a recipe but without tokens gets
rate 0 and is reported as unreachable; repeated texts are separate documents.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.ranks import rank_within
from recordloom.session import bounded_broadcast, stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pattern that belongs to the vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_TARGETS = 100_000
_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str):
    """The byte-pair encoder of a rank file, loaded once per worker from its path or from the files sent with the job."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        path = vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary))
        if not os.path.exists(path):
            raise FileNotFoundError(f"no vocabulary at {vocabulary}: give the path of a rank file of a public tokenizer as `vocabulary`")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[vocabulary] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def _count(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary).encode_ordinary
    for batch in batches:
        sizes = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of each document; a vocabulary on the driver is sent to the executors."""
    if os.path.exists(vocabulary):
        docs.sparkSession.sparkContext.addFile(vocabulary)
    return docs.select("doc_id", "source", "text").mapInArrow(lambda it: _count(it, vocabulary), "doc_id long, source string, n_tokens long")


def ranked(counts: DataFrame) -> DataFrame:
    """``(doc_id, source, n_tokens, k)`` with k = 1, 2, ... along (n_tokens, doc_id) within each source."""
    return rank_within(counts, "source", ["n_tokens", "doc_id"])


def rates(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``(recipe, source, target_share, max_repeats, available_tokens, rate, reachable)`` for each target."""
    held = counts.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("documents"))
    t = targets.select("recipe", "source", "target_share", "max_repeats").join(held, "source", "left").fillna(0, ["available_tokens", "documents"])
    size = F.lit(int(total_tokens)) if total_tokens else F.sum("available_tokens").over(Window.partitionBy("recipe"))
    t = t.withColumn("wanted", F.col("target_share") * size)
    rate = F.when(F.col("available_tokens") > 0, F.least(F.col("wanted") / F.col("available_tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))
    return t.withColumn("rate", rate).withColumn("reachable", F.col("wanted") <= F.col("max_repeats") * F.col("available_tokens"))


def _given(docs: DataFrame, targets: DataFrame, total_tokens: int | None, seed: int, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """Ranked documents of the named sources, staged, and ``(doc_id, ..., recipe, copies)`` of those that are given."""
    named = targets.select("source").where("source is not null").distinct()
    # staged, since range partitioning looks at its input twice
    counts = stage(token_counts(docs.join(bounded_broadcast(named, MAX_TARGETS), "source", "left_semi"), vocabulary), "tokens")
    order = stage(ranked(counts), "ranked")
    plan = rates(order, targets, total_tokens).select("recipe", "source", "rate")
    # one random offset per recipe and source, from the seed
    offset = F.pmod(F.xxhash64(F.lit(seed), "recipe", "source"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    plan = bounded_broadcast(stage(plan.withColumn("u", offset), "rates"), MAX_TARGETS)
    copies = (F.floor(F.col("rate") * F.col("k") + F.col("u")) - F.floor(F.col("rate") * (F.col("k") - 1) + F.col("u"))).cast("int")
    return order, order.join(plan, "source").withColumn("copies", copies).where("copies > 0")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(recipe, source, doc_id, copy, n_tokens)``: the documents of each mix, one row per copy."""
    _, given = _given(docs, targets, total_tokens, seed, vocabulary)
    return given.select("recipe", "source", "doc_id", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "n_tokens")


def mix_report(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, vocabulary: str = VOCABULARY) -> DataFrame:
    """Target and actual share of each source of each recipe, and whether the target could be reached."""
    order, given = _given(docs, targets, total_tokens, seed, vocabulary)
    got = given.groupBy("recipe", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.sum("copies").alias("copies"))
    t = rates(order, targets, total_tokens)
    t = t.join(got, ["recipe", "source"], "left").fillna(0, ["mix_tokens", "copies"])
    actual = F.try_divide(F.col("mix_tokens"), F.sum("mix_tokens").over(Window.partitionBy("recipe")))
    return t.select("recipe", "source", "target_share", "max_repeats", "documents", "available_tokens", "rate", "reachable", "copies", "mix_tokens", actual.alias("actual_share"))
