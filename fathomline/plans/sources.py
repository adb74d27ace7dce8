"""Queries over chunkers, embedders and the event stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import models, text
from fathomline.functions.current import current_rows
from fathomline.functions.embedding import embed, hash_encoder
from fathomline.plans.retrieval import asked, chunks, hits
from fathomline.sources import chunking
from fathomline.sources.tables import table
from fathomline.streaming.refresh import windowed_counts


def _files(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(table(spark, d, "source_files"), ["file_path"], "modified_at", {"relative_path": F.regexp_replace("relative_path", r"\\", "/"), "content": F.col("content")})


def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of every current source file."""
    return chunking.chunk_files(_files(spark, d)).where("chunk_type IN ('function', 'method', 'class', 'type', 'interface', 'module')").select("chunk_id", "relative_path", "chunk_type", "name", "parent_name", "start_line", "end_line", F.size("calls").alias("n_calls"))


def code_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Functions, classes and types of the files that have chunks, by name and first line."""
    f = _files(spark, d).where(F.lower("relative_path").rlike(r"\.(py|js|ts|go|java)$"))
    indexed = table(spark, d, "chunks").select(F.regexp_replace("relative_path", r"\\", "/").alias("relative_path")).distinct()
    found = chunking.chunk_files(f.join(indexed, "relative_path", "left_semi")).where("chunk_type IN ('function', 'class', 'type') AND name IS NOT NULL")
    return found.where("parent_name IS NULL OR chunk_type <> 'function'").select("relative_path", "chunk_type", "name", "start_line").distinct()


def model_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The model catalogue: embedders and rerankers of model_limits."""
    return models.catalog(table(spark, d, "model_limits"))


def rerank_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The question put to a yes/no reranker for every current hit that has a chunk."""
    h = hits(spark, d, "similarity_score").join(asked(spark, d).select("query_id", "query"), "query_id").join(chunks(spark, d, "content_preview"), "chunk_id")
    prompt = models.rerank_prompt(F.col("query"), F.col("content_preview"), "Find code that answers the query")
    return h.select("query_id", "chunk_id", F.md5(prompt).alias("prompt_hash"))


def rerank_scored(spark: SparkSession, d: str) -> DataFrame:
    """T5 with a scorer: hits scored by the words they share with the query, through the hook for cross encoders."""
    h = hits(spark, d, "similarity_score").join(asked(spark, d).select("query_id", "query"), "query_id").join(chunks(spark, d, "content_preview"), "chunk_id")
    return models.score_pairs(h.select("query_id", "chunk_id", "query", "content_preview"), models.overlap_scorer).select("query_id", "chunk_id", F.round("reranker_score", 6).alias("score"))


def sanitised_recall(spark: SparkSession, d: str) -> DataFrame:
    """recall_k as a whole number above zero, 50 otherwise."""
    return asked(spark, d).select("query_id", text.positive_int(F.col("recall_k"), 50).alias("recall_k"))


def json_defaults(spark: SparkSession, d: str) -> DataFrame:
    """How many calls each symbol's metadata lists; none where it is null or malformed."""
    calls = text.json_or(F.col("metadata_json"), "calls array<string>", F.struct(F.array().cast("array<string>").alias("calls")))["calls"]
    s = table(spark, d, "symbols").where("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"])
    return s.select("chunk_id", F.coalesce(F.size(calls), F.lit(0)).alias("n")).select("chunk_id", F.greatest("n", F.lit(0)).alias("n_calls"))


def skipped_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Current files that any run skipped: how many, their bytes, and how many are no longer known."""
    s = table(spark, d, "index_runs").select(F.explode("skipped_files").alias("s")).select(F.col("s.file").alias("file_path")).where("file_path IS NOT NULL").distinct()
    f = current_rows(table(spark, d, "source_files"), ["file_path"], "modified_at", {"size_bytes": F.col("size_bytes")})
    both = s.join(f.select("file_path", "size_bytes"), "file_path", "left")
    return both.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"), F.sum(F.col("size_bytes").isNull().cast("int")).alias("n_unknown"))


def run_details(spark: SparkSession, d: str) -> DataFrame:
    """At most two skipped files of each run, and whether there were more."""
    r = table(spark, d, "index_runs").dropDuplicates(["run_id"]).select("run_id", text.first_details(F.col("skipped_files"), 2).alias("x"))
    return r.select("run_id", F.size("x.items").alias("n_shown"), "x.truncated", F.col("x.n").alias("n_skipped"))


def config_entries(spark: SparkSession, d: str) -> DataFrame:
    """Sections, lists and entries of configuration files with their key paths."""
    f = _files(spark, d).where(F.lower("relative_path").rlike(r"\.(ya?ml|json|toml)$"))
    return chunking.chunk_files(f).select("relative_path", "chunk_type", "name", "start_line", F.length("content").alias("n_chars"))


def md_sections(spark: SparkSession, d: str) -> DataFrame:
    """Markdown sections by built-in operators alone."""
    f = _files(spark, d).where(F.lower("relative_path").endswith(".md"))
    return chunking.markdown_sections(f).select(F.col("path").alias("relative_path"), F.lower("name").alias("name"), "start_line")


def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """P5, X12 and the embedder hook: a hashed unit vector per current chunk."""
    c = current_rows(table(spark, d, "chunks"), ["chunk_id"], "indexed_at", {k: F.col(k) for k in ("content", "chunk_type", "parent_name", "docstring")})
    v = embed(c, lambda: hash_encoder(64))
    return v.select("chunk_id", F.size("vector").alias("width"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("norm"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The streaming aggregate over the stored events."""
    return windowed_counts(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES = (code_chunks, code_definitions, model_catalog, rerank_prompts, rerank_scored, sanitised_recall, json_defaults, skipped_bytes, run_details, config_entries, md_sections, embedded_chunks, event_windows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_CHUNKS = "SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) = 1"
_PAIRS = f"h AS (SELECT DISTINCT query_id, chunk_id FROM search_hits), q AS (SELECT query_id, query FROM search_queries QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY asked_at DESC) = 1), c AS ({_CHUNKS}), x AS (SELECT h.query_id, h.chunk_id, query, content_preview FROM h JOIN q USING (query_id) JOIN c USING (chunk_id))"


def oracle_sql() -> dict[str, str]:
    return {
        "md_sections": "SELECT replace(relative_path, chr(92), '/') relative_path, name, start_line FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) = 1) WHERE chunk_type = 'section'",
        "code_definitions": f"""WITH c AS ({_CHUNKS}) SELECT DISTINCT replace(relative_path, chr(92), '/') relative_path, chunk_type, name, start_line FROM c
WHERE chunk_type IN ('function', 'class', 'type') AND name <> '' AND regexp_matches(lower(relative_path), '\\.(py|js|ts|go|java)$')""",
        "model_catalog": "SELECT model_name, CASE WHEN coalesce(dimension, 0) = 0 THEN 'reranker' ELSE 'embedder' END kind, coalesce(dimension, 0) dimension, max_tokens FROM model_limits WHERE model_name IS NOT NULL",
        "rerank_prompts": f"WITH {_PAIRS} SELECT query_id, chunk_id, md5('<Instruct>: Find code that answers the query' || chr(10) || '<Query>: ' || coalesce(query, '') || chr(10) || '<Document>: ' || coalesce(content_preview, '')) prompt_hash FROM x",
        "rerank_scored": f"""WITH {_PAIRS}, w AS (SELECT query_id, chunk_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(query, '')), '\\s+'), lambda t: t <> '')) a, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(content_preview, '')), '\\s+'), lambda t: t <> '')) b FROM x)
SELECT query_id, chunk_id, round(1 / (1 + exp(-(4.0 * len(list_intersect(a, b)) / greatest(1, len(a)) - 2))), 6) score FROM w""",
        "sanitised_recall": "SELECT query_id, CASE WHEN recall_k > 0 THEN recall_k ELSE 50 END recall_k FROM search_queries QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY asked_at DESC) = 1",
        "json_defaults": "SELECT chunk_id, coalesce(CASE WHEN json_valid(metadata_json) THEN json_array_length(metadata_json, '$.calls') END, 0)::INT n_calls FROM (SELECT chunk_id, any_value(metadata_json) metadata_json FROM symbols GROUP BY 1)",
        "skipped_bytes": "WITH s AS (SELECT DISTINCT x.file f FROM (SELECT unnest(skipped_files) x FROM index_runs) WHERE x.file IS NOT NULL), c AS (SELECT file_path, size_bytes FROM source_files QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY modified_at DESC) = 1) SELECT count(*) n_files, coalesce(sum(size_bytes), 0)::BIGINT n_bytes, count(*) FILTER (WHERE size_bytes IS NULL) n_unknown FROM s LEFT JOIN c ON f = file_path",
        "run_details": "SELECT run_id, least(2, coalesce(len(s), 0))::INT n_shown, coalesce(len(s), 0) > 2 truncated, coalesce(len(s), 0)::INT n_skipped FROM (SELECT run_id, any_value(skipped_files) s FROM index_runs GROUP BY 1)",
        "event_windows": "SELECT date_trunc('hour', ts) window_start, event_type, count(*) n FROM events GROUP BY 1, 2",
    }
