"""Interfaces of model calls with deterministic offline defaults, and their use over tables."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol, TypeVar

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

R = TypeVar("R")


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class HashingEmbedder:
    """Feature hashing of words with signs (Weinberger et al. 2009), scaled to length 1; a text without words gives zeros."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out


class LookupEmbedder:
    """Vectors from a table of known texts, as an embedder that runs elsewhere leaves them; unknown texts fail."""

    def __init__(self, known: dict[str, list[float]], dim: int):
        self.known, self.dim = known, dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.known[t] for t in texts]


class ExtractiveGenerator:
    """Answers with the first sentence of the context that shares most words with the question."""

    def generate(self, prompt: str) -> str:
        body, _, question = prompt.rpartition("Question:")
        asked = set(question.lower().split())
        sentences = [s.strip() for s in body.replace("\n", " ").split(". ") if s.strip()]
        return max(sentences, key=lambda s: len(asked & set(s.lower().split())), default="")


def with_retry(call: Callable[[], R], attempts: int = 5, base: float = 1.0, retry_on: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), sleep: Callable[[float], None] = time.sleep, seed: int | None = None) -> R:
    """Call again with doubling waits and jitter while a transient error comes up; the last error is raised."""
    rng = random.Random(seed)
    for k in range(attempts):
        try:
            return call()
        except retry_on:
            if k == attempts - 1:
                raise
            sleep(base * 2**k + rng.random() * base)
    raise ValueError("attempts must be at least 1")


def embed_table(df: DataFrame, text: str, embedder: Embedder, attempts: int = 5, base: float = 1.0) -> DataFrame:
    """The table with ``vector`` and ``embed_error``: a failed row or a blank one has a null vector and a reason.

    Transient errors of a batch are tried again with growing waits; a batch that fails otherwise is tried row by row.
    """
    columns = df.columns

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            texts = p[text].tolist()
            vectors: list = [None] * len(texts)
            errors: list = [None if t and str(t).strip() else "blank text" for t in texts]
            todo = [i for i, e in enumerate(errors) if e is None]
            try:
                got = with_retry(lambda: embedder.embed([texts[i] for i in todo]), attempts, base)
                for i, v in zip(todo, got):
                    vectors[i] = v
            except Exception:
                for i in todo:
                    try:
                        vectors[i] = embedder.embed([texts[i]])[0]
                    except Exception as x:
                        errors[i] = f"{type(x).__name__}: {x}"[:200]
            yield p[columns].assign(vector=vectors, embed_error=errors)

    return df.mapInPandas(run, _schema(df))


def generate_table(df: DataFrame, prompt: str, generator: Generator, attempts: int = 5, base: float = 1.0) -> DataFrame:
    """The table with ``answer`` and ``answer_error``: one call per prompt, tried again on transient errors; a blank prompt has no answer."""
    from pyspark.sql import types as T

    columns = df.columns

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            answers: list = []
            for t in p[prompt]:
                if not t or not str(t).strip():
                    answers.append((None, "blank prompt"))
                    continue
                try:
                    answers.append((with_retry(lambda: generator.generate(t), attempts, base), None))
                except Exception as x:
                    answers.append((None, f"{type(x).__name__}: {x}"[:200]))
            yield p[columns].assign(answer=[a for a, _ in answers], answer_error=[e for _, e in answers])

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("answer", T.StringType()), T.StructField("answer_error", T.StringType())]))


def correct_table(df: DataFrame, key: str, text: str, generator: Generator, most: int = 2000) -> DataFrame:
    """``(key, corrected)`` of the severely corrupt texts: pieces of whole lines within ``most`` characters are corrected one by one.

    A piece whose correction fails stays as it is.
    """
    from pyspark.sql import functions as F

    from recordloom.functions.text import pack_lines, severely_corrupted

    pieces = df.where(severely_corrupted(text)).select(key, F.posexplode(pack_lines(text, most)).alias("_n", "_piece"))
    done = generate_table(pieces, "_piece", generator).withColumn("_t", F.coalesce("answer", "_piece"))
    joined = done.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_n", "_t"))).alias("_p"))
    return joined.select(key, F.array_join(F.transform("_p", lambda x: x["_t"]), "\n").alias("corrected"))


def _schema(df: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("embed_error", T.StringType())])
