"""Scores: similarity, keyword relevance, fusion and explainable boosts, as column expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions.text import intents, name_tokens

RRF_K = 60
BM25_K1, BM25_B = 1.2, 0.75
#: Words that make a query an instruction rather than a name.
ACTION_WORDS = ("find", "search", "get", "show", "list", "how", "what", "where", "when", "create", "build", "make", "handle", "process", "manage", "implement")
#: Boosts by chunk type for queries that say "class", look like a name, or neither.
TYPE_BOOSTS = {
    "class": {"class": 1.3, "function": 1.05, "method": 1.05, "module": 0.9},
    "entity": {"class": 1.15, "function": 1.1, "method": 1.1, "module": 0.92},
    "other": {"class": 1.05, "function": 1.1, "method": 1.1, "module": 0.95},
}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine clipped at 0; null if a vector is null, of another width or all zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.greatest(F.lit(0.0), dot(a, b) / norm))


def bm25_idf(df: Column, total: Column) -> Column:
    return F.log(1 + (total - df + 0.5) / (df + 0.5))


def bm25_norm(length: Column, mean_length: Column) -> Column:
    return BM25_K1 * (1 - BM25_B + BM25_B * length / mean_length)


def bm25(idf, tf, norm):
    """Weight of a term in a text, of columns or of arrays."""
    return idf * tf * (BM25_K1 + 1) / (tf + norm)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x))))


def yes_no(yes: Column, no: Column) -> Column:
    """Probability of yes among two logits, clamped to [0, 1]."""
    top = F.greatest(yes, no)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(yes - top) / (F.exp(yes - top) + F.exp(no - top))))


def is_entity(query: Column) -> Column:
    """Whether a query reads like a name: at most three tokens, no action word, camel case or at most two tokens."""
    t = name_tokens(query)
    calm = ~F.arrays_overlap(t, F.array(*[F.lit(w) for w in ACTION_WORDS]))
    return (F.size(t) <= 3) & calm & (query.rlike("[A-Z][a-z]+[A-Z]") | (F.size(t) <= 2))


def _by_type(chunk_type: Column, table: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for kind, boost in table.items():
        out = F.when(chunk_type == kind, F.lit(boost)).otherwise(out)
    return out


def type_boost(query: Column, chunk_type: Column) -> Column:
    says = F.lower(query).contains("class")
    return F.when(says, _by_type(chunk_type, TYPE_BOOSTS["class"])).when(is_entity(query), _by_type(chunk_type, TYPE_BOOSTS["entity"])).otherwise(_by_type(chunk_type, TYPE_BOOSTS["other"]))


def name_boost(query: Column, name: Column) -> Column:
    q, n = F.array_distinct(name_tokens(query)), F.array_distinct(name_tokens(name))
    share = F.size(F.array_intersect(q, n)) / F.size(q)
    by_share = F.when(share >= 0.8, 1.3).when(share >= 0.5, 1.2).when(share >= 0.3, 1.1).when(share > 0, 1.05).otherwise(1.0)
    return F.when(F.coalesce(name, F.lit("")) == "", 1.0).when(F.lower(query) == F.lower(name), 1.4).when(F.size(q) == 0, 1.0).otherwise(by_share)


def path_boost(query: Column, path: Column) -> Column:
    flat = F.regexp_replace(F.lower(path), r"[/\\]", " ")
    hits = F.size(F.array_intersect(F.array_distinct(name_tokens(query)), F.array_distinct(name_tokens(flat))))
    return F.when(path.isNull(), 1.0).otherwise(1 + 0.05 * hits)


def rank_score(similarity: Column, query: Column, chunk_type: Column, name: Column, path: Column, tags: Column, docstring: Column, reranked: bool = False) -> Column:
    """Similarity times all boosts; each boost moves half as far from 1 after a reranker."""
    damp = 0.5 if reranked else 1.0
    shared = F.size(F.array_intersect(intents(query), F.coalesce(tags, F.array().cast("array<string>"))))
    told = F.coalesce(docstring, F.lit("")) != ""
    doc = F.when(told & is_entity(query) & (chunk_type == "module"), 1.02).when(told, 1.05).otherwise(1.0)
    score = similarity
    for boost in (type_boost(query, chunk_type), name_boost(query, name), path_boost(query, path), 1 + 0.1 * shared, doc):
        score = score * (1 + (boost - 1) * damp)
    return score
