"""Queries of the training-data operators: every one runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions.current import current_rows
from fathomline.llm import doc_pairs, handwritten, leakage, packing, rank_fusion, shared_spans, similar_vectors, splitting, syntax_check
from fathomline.operators.search import similar_to_many
from fathomline.sources.tables import table

MODEL, WIDTH = "lantern-embed-64", 64
SCORES = ["similarity_score", "vector_score", "bm25_score", "reranker_score"]
CHUNK_LIMIT, CHUNK_OVERLAP, WINDOW_TOKENS = 4000, 200, 2048
PROXIMITY_SLACK = 3


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return similar_vectors.clean_vectors(table(spark, d, "chunk_vectors"), MODEL, WIDTH)


def _raw_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Rows to fit split planes on: stale ones among them do no harm."""
    return table(spark, d, "chunk_vectors").where((F.col("model_name") == MODEL) & similar_vectors.fit_vector(WIDTH)).select("embedding")


def _near_classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return similar_vectors.similar_classes(_vectors(spark, d), 0.95, trees=2, probes=16, more_probes=4, leaf_rows=1024, basis=_raw_vectors(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks whose vectors have a cosine of 0.95 or more."""
    return similar_vectors.expand_pairs(*_near_classes(spark, d)).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with a copy or a partner at 0.95 or more: its class of equal vectors and its number of partners outside it."""
    return similar_vectors.class_links(*_near_classes(spark, d)).withColumnRenamed("id", "chunk_id")


def p1_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest of every vector whose id hash is divisible by 50, among all vectors."""
    near = similar_vectors.knn(_vectors(spark, d), 10, queries=F.crc32("id") % 50 == 0, trees=4, probes=320, more_probes=80, basis=_raw_vectors(spark, d))
    return near.select(F.col("id").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"), F.col("rank").cast("int").alias("rank"))


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    """One row: how many of the exact 10 nearest (all vectors against the same queries, in blocks) p1_topk finds."""
    rows = _vectors(spark, d).withColumnRenamed("id", "chunk_id").groupBy("embedding").agg(F.min("chunk_id").alias("chunk_id"), F.max((F.crc32("chunk_id") % 50 == 0).cast("int")).alias("ask"))
    exact = similar_to_many(rows, rows.where("ask = 1"), 10).select(F.col("seed_id").alias("chunk_id"), F.col("chunk_id").alias("neighbour_id"), F.lit(1).alias("hit"))
    both = exact.join(p1_topk(spark, d).select("chunk_id", "neighbour_id", F.lit(1).alias("got")), ["chunk_id", "neighbour_id"], "left")
    return both.agg(F.count_distinct("chunk_id").alias("n_queries"), F.count("*").alias("n_exact"), F.round(F.count("got") / F.count("*"), 4).alias("recall"))


def _language(path: Column) -> Column:
    """The chunk's language by the extension of its file."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    names = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown"}
    return F.coalesce(*[F.when(ext == e, F.lit(n)) for e, n in names.items()])


def _current_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Current chunks; only content above the limit is carried along, the rest is never needed."""
    long = F.when(F.length("content") > CHUNK_LIMIT, F.col("content"))
    return current_rows(table(spark, d, "chunks"), ["chunk_id"], "indexed_at", {"content": long, "start_line": F.col("start_line"), "lang": F.when(long.isNotNull(), _language(F.col("file_path")))})


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(_current_chunks(spark, d), "chunk_id", "content", CHUNK_LIMIT, CHUNK_OVERLAP, "start_line", language="lang")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the splitter cuts: those above the limit."""
    return _pieces(spark, d).where("piece = 1").select("chunk_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces with offsets, lines and text."""
    return _pieces(spark, d)


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every split chunk: its pieces, whether they tile the content, keep the limit and the overlap, and end on the chunk's last line."""
    p = _pieces(spark, d)
    w = Window.partitionBy("chunk_id").orderBy("piece")
    step = p.select("*", F.lag("end").over(w).alias("_end"), F.lag("begin").over(w).alias("_begin"))
    fits = (F.col("end") - F.col("begin") <= CHUNK_LIMIT) & (F.length("content") == F.col("end") - F.col("begin"))
    meets = F.col("_end").isNull() & (F.col("begin") == 0) | (F.col("begin") <= F.col("_end")) & (F.col("_end") - F.col("begin") <= CHUNK_OVERLAP) & (F.col("begin") > F.col("_begin")) & (F.col("end") > F.col("_end"))
    return step.groupBy("chunk_id").agg(F.count("*").alias("n_pieces"), F.max("end").alias("n_chars"), F.bool_and(fits & meets).alias("sound"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line")).select("chunk_id", (F.col("n_pieces") > 1).alias("cut"), "n_chars", "sound", "first_line", "last_line")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Code files that no one on the project wrote by hand."""
    return handwritten.not_handwritten(table(spark, d, "source_files")).where("flagged").select("file_path")


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every current code file with its notice, the forest's probability and the verdict."""
    return handwritten.not_handwritten(table(spark, d, "source_files")).withColumn("probability", F.round("probability", 4))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that every dialect grammar of their language rejects."""
    return syntax_check.syntax_verdicts(table(spark, d, "source_files")).where("NOT parses").select("file_path")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Invalid files per project and language, with the share that the index runs hint at."""
    return syntax_check.syntax_rates(syntax_check.syntax_verdicts(table(spark, d, "source_files")), table(spark, d, "index_runs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods whose own documentation is not trivial."""
    return doc_pairs.documented_functions(table(spark, d, "chunks"), table(spark, d, "source_files")).where("doc_chunk_id = chunk_id").select("chunk_id")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and description pairs, documentation lent by separate declarations included."""
    return doc_pairs.documented_functions(table(spark, d, "chunks"), table(spark, d, "source_files"), content=True)


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    hits = current_rows(table(spark, d, "search_hits"), ["query_id", "chunk_id"], "retrieved_at", {s: F.col(s) for s in SCORES})
    floor = current_rows(table(spark, d, "search_queries"), ["query_id"], "asked_at", {"min_reranker_score": F.col("min_reranker_score")}).drop("asked_at")
    part = hits.join(floor, "query_id").where("reranker_score IS NOT NULL AND (min_reranker_score IS NULL OR reranker_score >= min_reranker_score)")
    return rank_fusion.borda(part.select("query_id", "chunk_id", *SCORES), "query_id", "chunk_id", SCORES)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Hits among the three highest of their query in each score, of queries with more than eight hits."""
    top = " AND ".join(f"place_{s} <= 3" for s in SCORES)
    return _ranking(spark, d).where(f"n_items > 8 AND {top}").select("query_id", "chunk_id")


def p7_ranking(spark: SparkSession, d: str) -> DataFrame:
    """One order per query."""
    return _ranking(spark, d).select("query_id", "chunk_id", "present", F.round("points", 6).alias("points"), "position")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents, measured in tokens, placed in windows."""
    counts = packing.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(counts.select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size")), WINDOW_TOKENS).withColumnRenamed("item", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: how full the windows are, with the counts that must be zero. An id must be placed once."""
    return packing.fill_report(p8_containers(spark, d).withColumnRenamed("doc_id", "item"), WINDOW_TOKENS)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with 15 or more consecutive words of an evaluation item."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text").select("doc_id", "item_id").distinct()


def p9_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every maximal shared run of words and every chain of nearby shorter runs, with their length and places."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text", slack=PROXIMITY_SLACK)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a span of 200 or more characters that stands in another document."""
    return shared_spans.docs_with_shared_spans(table(spark, d, "documents"), "doc_id", "text")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of every document stands elsewhere in spans of 200 or more characters."""
    return shared_spans.shared_shares(table(spark, d, "documents"), "doc_id", "text")


QUERIES = (p1_found, p1_links, p1_topk, p1_recall, p3_found, p3_pieces, p3_checks, p4_found, p4_scores, p5_found, p5_rates, p6_found, p6_pairs, p7_found, p7_ranking, p8_containers, p8_fill, p9_found, p9_matches, p10_found, p10_shares)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_VECTORS = f"""
WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) r FROM chunk_vectors) WHERE r = 1),
v AS (SELECT chunk_id, list_transform(embedding, lambda x: x::DOUBLE) e FROM c WHERE model_name = '{MODEL}' AND len(embedding) = {WIDTH}
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
"""
_HITS = """
WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY retrieved_at DESC) r FROM search_hits) WHERE r = 1),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY asked_at DESC) r FROM search_queries) WHERE r = 1),
p AS (SELECT h.* FROM h JOIN q USING (query_id) WHERE reranker_score IS NOT NULL AND (min_reranker_score IS NULL OR reranker_score >= min_reranker_score)),
n AS (SELECT query_id, count(*) n FROM p GROUP BY 1),
l AS (SELECT query_id, chunk_id, 's' s, similarity_score v FROM p UNION ALL SELECT query_id, chunk_id, 'v', vector_score FROM p UNION ALL SELECT query_id, chunk_id, 'b', bm25_score FROM p UNION ALL SELECT query_id, chunk_id, 'r', reranker_score FROM p),
k AS (SELECT query_id, chunk_id, s, rank() OVER (PARTITION BY query_id, s ORDER BY v DESC) place, count(*) OVER (PARTITION BY query_id, s, v) ties, count(*) OVER (PARTITION BY query_id, s) m FROM l WHERE v IS NOT NULL AND NOT isnan(v))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _VECTORS + """SELECT a.chunk_id chunk_id_a, b.chunk_id chunk_id_b FROM v a JOIN v b ON a.chunk_id < b.chunk_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95""",
        "p1_links": _VECTORS + """, c2 AS (SELECT e, min(chunk_id) class_id, count(*) copies FROM v GROUP BY e),
l AS (SELECT a.class_id, sum(b.copies) n FROM c2 a JOIN c2 b ON a.class_id <> b.class_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95 GROUP BY 1)
SELECT v.chunk_id, class_id, copies, coalesce(n, 0)::BIGINT n_links FROM v JOIN c2 USING (e) LEFT JOIN l USING (class_id) WHERE copies > 1 OR n IS NOT NULL""",
        "p3_found": f"SELECT chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) r FROM chunks) WHERE r = 1 AND length(content) > {CHUNK_LIMIT}",
        "p3_checks": f"""SELECT chunk_id, true cut, length(content)::INT n_chars, true sound, start_line first_line,
 (start_line + len(regexp_extract_all(rtrim(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || ' ', ' '), chr(10))) - CASE WHEN regexp_matches(content, '[' || chr(13) || chr(10) || ']$') THEN 1 ELSE 0 END)::INT last_line
FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) r FROM chunks) WHERE r = 1 AND length(content) > {CHUNK_LIMIT}""",
        "p5_found": """WITH f AS (SELECT DISTINCT file_path FROM source_files WHERE regexp_matches(lower(file_path), '\\.(py|js|ts|go|java|json|yaml|yml)$'))
SELECT file_path FROM f WHERE file_path NOT IN (SELECT file_path FROM chunks WHERE file_path IS NOT NULL)""",
        "p7_found": _HITS + "SELECT query_id, chunk_id FROM k JOIN n USING (query_id) WHERE place <= 3 AND n > 8 GROUP BY 1, 2 HAVING count(*) = 4",
        "p7_ranking": _HITS + """, w AS (SELECT p.query_id, p.chunk_id, n.n, (SELECT 0) z FROM p JOIN n USING (query_id)),
t AS (SELECT w.query_id, w.chunk_id, any_value(w.n) n, count(k.s)::INT present, sum(CASE WHEN k.s IS NULL THEN 0 ELSE 1 - (k.place - 1 + k.ties / 2.0) / k.m END) + 0.5 * (4 - count(k.s)) share FROM w LEFT JOIN k ON k.query_id = w.query_id AND k.chunk_id = w.chunk_id GROUP BY 1, 2)
SELECT query_id, chunk_id, present, round(share * n, 6) points, row_number() OVER (PARTITION BY query_id ORDER BY round(share * n, 9) DESC, chunk_id) position FROM t""",
        "p9_found": """
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) w FROM documents),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 14], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 13)) k FROM d WHERE len(w) >= 15)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 14], ' ') g FROM (SELECT item_id, w, unnest(range(1, len(w) - 13)) k FROM i WHERE len(w) >= 15))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    }
