"""Model catalogue and resolution, and hooks for encoders and rerankers that need no particular library."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.ranking import sigmoid, yes_no

#: Environment variable that names the embedding model.
MODEL_VARIABLE = "FATHOMLINE_MODEL"


@dataclass(frozen=True)
class Model:
    """One entry: dimension 0 marks a reranker; prefixes stand before queries and documents of asymmetric models."""

    name: str
    dimension: int
    max_tokens: int = 512
    query_prefix: str = ""
    document_prefix: str = ""


def catalog(limits: DataFrame) -> DataFrame:
    """(model_name, kind, dimension, max_tokens): models of model_limits, dimension 0 being a reranker's; a null dimension counts as 0."""
    dim = F.coalesce("dimension", F.lit(0))
    return limits.where("model_name IS NOT NULL").select("model_name", F.when(dim == 0, "reranker").otherwise("embedder").alias("kind"), dim.alias("dimension"), "max_tokens")


def resolve(models: Mapping[str, Model], argument: str | None = None, configured: str | None = None, default: str | None = None, environment: Mapping[str, str] = os.environ) -> Model:
    """The model asked for: argument, then environment, then configuration, then default; blank names count as none. Unknown ones raise."""
    name = next((n.strip() for n in (argument, environment.get(MODEL_VARIABLE), configured, default) if n and n.strip()), None)
    if name is None:
        raise ValueError("no model is named")
    if name not in models:
        raise ValueError(f"unknown model {name}; known are {', '.join(sorted(models))}")
    return models[name]


def with_prefix(text: Column, model: Model, query: bool = False) -> Column:
    """The text as the model wants it: a query or a document."""
    return F.concat(F.lit(model.query_prefix if query else model.document_prefix), text)


def rerank_prompt(query: Column, document: Column, task: str) -> Column:
    """The question put to a yes/no model about one pair."""
    return F.format_string("<Instruct>: %s\n<Query>: %s\n<Document>: %s", F.lit(task), F.coalesce(query, F.lit("")), F.coalesce(document, F.lit("")))


def score_pairs(pairs: DataFrame, scorer: Callable[[], Callable[[list[str], list[str]], np.ndarray]], kind: str = "cross_encoder", query: str = "query", text: str = "content_preview", batch: int = 32) -> DataFrame:
    """`pairs` with reranker_score double in [0, 1]. `scorer` is called once per task and returns scores of queries and texts.

    A cross encoder gives one raw score a pair, read through the logistic function; a causal model gives (yes, no) logits,
    read as the probability of yes. A batch whose scoring fails has null scores, so ranking falls back to the recall order.
    """
    if kind not in ("cross_encoder", "causal_lm"):
        raise ValueError(f"unknown kind of reranker {kind}")

    @F.pandas_udf("array<double>")
    def raw(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = scorer()
        for q, t in batches:
            out: list = []
            for i in range(0, len(q), batch):
                part = list(q.iloc[i : i + batch].fillna("")), list(t.iloc[i : i + batch].fillna(""))
                try:
                    got = np.asarray(score(*part), np.float64)
                    out += [list(np.atleast_1d(x)) for x in got]
                except Exception:  # a model may fail in any way; the caller sees null
                    out += [None] * len(part[0])
            yield pd.Series(out)

    logits = pairs.withColumn("_raw", raw(F.col(query), F.col(text)))
    value = sigmoid(F.col("_raw")[0]) if kind == "cross_encoder" else yes_no(F.col("_raw")[0], F.col("_raw")[1])
    return logits.withColumn("reranker_score", F.when(F.col("_raw").isNotNull(), value)).drop("_raw")


def overlap_scorer() -> Callable[[list[str], list[str]], np.ndarray]:
    """A scorer without a model: four times the share of the query's words that the text holds, less two."""

    def score(queries: list[str], texts: list[str]) -> np.ndarray:
        out = []
        for q, t in zip(queries, texts):
            words = set(q.lower().split())
            out.append(4 * len(words & set(t.lower().split())) / max(1, len(words)) - 2)
        return np.array(out)

    return score
