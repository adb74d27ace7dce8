"""Retrieval, filter, projection and statistics queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import ranking, text
from fathomline.functions.current import current_rows
from fathomline.operators import search, stats
from fathomline.sources.tables import table

MODEL, WIDTH, K = "lantern-embed-64", 64, 20
META = ("relative_path", "project_name", "folder_structure", "chunk_type", "name", "parent_name", "docstring", "start_line", "end_line", "content_preview", "tags")


def chunks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Current chunks, `cols` only."""
    return current_rows(table(spark, d, "chunks"), ["chunk_id"], "indexed_at", {c: F.col(c) for c in cols or META}).drop("indexed_at")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Current vectors of the main model with sound components."""
    rows = current_rows(table(spark, d, "chunk_vectors"), ["chunk_id"], "indexed_at", {"model_name": F.col("model_name"), "embedding": F.col("embedding")})
    e = F.col("embedding")
    return rows.where((F.col("model_name") == MODEL) & (F.size(e) == WIDTH) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x)) & F.exists(e, lambda x: x != 0)).select("chunk_id", "embedding")


def hits(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Current search hits."""
    names = cols or ("similarity_score", "vector_score", "bm25_score", "reranker_score")
    return current_rows(table(spark, d, "search_hits"), ["query_id", "chunk_id"], "retrieved_at", {c: F.col(c) for c in names}).drop("retrieved_at")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(table(spark, d, "search_queries"), ["query_id"], "asked_at", {c: F.col(c) for c in ("query", "recall_k", "min_reranker_score")}).drop("asked_at")


def _seed(spark: SparkSession, d: str) -> DataFrame:
    """The chunk of smallest id that has a vector: the example query of the single-query searches."""
    return vectors(spark, d).groupBy().agg(F.min(F.struct("chunk_id", "embedding")).alias("s")).select("s.chunk_id", "s.embedding")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact cosine top-k with previews."""
    return search.vector_topk(vectors(spark, d), _seed(spark, d).select("embedding").scalar(), K)


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """T1 with F8: the filter applies before the limit, so k results remain."""
    wanted = chunks(spark, d, "relative_path", "chunk_type").where(search.chunk_filter(file_pattern=["src/**", "lib/*.ts"], chunk_type="method")).select("chunk_id")
    return search.vector_topk(vectors(spark, d).join(wanted, "chunk_id", "left_semi"), _seed(spark, d).select("embedding").scalar(), K)


def every_50th(col: str = "chunk_id"):
    """The query set of searches that ask for many rows: ids whose hash is divisible by 50."""
    return F.conv(F.substring(F.md5(col), 1, 6), 16, 10).cast("int") % 50 == 0


def similar_to(spark: SparkSession, d: str) -> DataFrame:
    """T4 for every chunk whose id hash is divisible by 50, against all rows; chunks are not their own neighbours."""
    rows = vectors(spark, d)
    return search.similar_to_many(rows, rows.where(every_50th()), 5)


def similar_context(spark: SparkSession, d: str) -> DataFrame:
    """The two chunks most similar to each of these, as the context of a result."""
    rows = vectors(spark, d)
    seeds = rows.where(every_50th())
    return search.with_context(seeds.select("chunk_id"), search.similar_to_many(rows, seeds, 3))


def _keywords(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = chunks(spark, d, "content_preview")
    return search.postings(c), search.corpus_stats(c)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Keyword top-k of every search query over the previews."""
    return search.bm25_topk(*_keywords(spark, d), asked(spark, d).select("query_id", "query"), 10).withColumn("rank", F.col("rank").cast("int"))


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Vector and keyword lists of the example chunk, fused."""
    seed = _seed(spark, d)
    near = search.ranked(search.vector_topk(vectors(spark, d), seed.select("embedding").scalar(), 50).withColumn("q", F.lit(1)), "similarity", ["q"], 50)
    words = chunks(spark, d, "name").join(seed.select("chunk_id"), "chunk_id").select(F.lit(1).alias("query_id"), F.coalesce("name", F.lit("")).alias("query"))
    keyed = search.bm25_topk(*_keywords(spark, d), words, 50).withColumnRenamed("query_id", "q")
    return search.rrf([near, keyed], ["q"], K).select("chunk_id", "score", F.col("rank").cast("int").alias("rank"))


def rank_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Boosted scores of every current hit of sound similarity, with rank."""
    h = hits(spark, d, "similarity_score").where("similarity_score IS NOT NULL AND NOT isnan(similarity_score)").join(asked(spark, d).select("query_id", "query"), "query_id").join(chunks(spark, d, "chunk_type", "name", "relative_path", "tags", "docstring"), "chunk_id")
    score = ranking.rank_score(F.col("similarity_score"), F.col("query"), F.col("chunk_type"), F.col("name"), F.col("relative_path"), F.col("tags"), F.col("docstring"))
    out = h.select("query_id", "chunk_id", F.round("similarity_score", 6).alias("similarity"), F.round(score, 6).alias("rank_score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "chunk_id")))


def dedup_best(spark: SparkSession, d: str) -> DataFrame:
    """The best row per query and chunk of the raw hits."""
    raw = table(spark, d, "search_hits").where("similarity_score IS NOT NULL AND NOT isnan(similarity_score)").select("query_id", "chunk_id", "hit_id", "similarity_score").distinct()
    return search.dedup_best(raw, ["query_id"], [F.desc("similarity_score"), F.col("hit_id")])


def per_file_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most two hits per file before all others, ten per query."""
    h = hits(spark, d, "similarity_score").where("similarity_score IS NOT NULL AND NOT isnan(similarity_score)").join(chunks(spark, d, "relative_path"), "chunk_id")
    return search.per_file_cap(h, ["query_id"], "relative_path", "similarity_score", 2).where("position <= 10").select("query_id", "chunk_id", "relative_path", "position")


def rerank_minscore(spark: SparkSession, d: str) -> DataFrame:
    """Recall by similarity, floor on the reranker's score, then the top five."""
    h = hits(spark, d, "similarity_score", "reranker_score").where("similarity_score IS NOT NULL AND NOT isnan(similarity_score)").join(asked(spark, d).select("query_id", "min_reranker_score"), "query_id")
    out = search.rerank(h, ["query_id"], "reranker_score", 50, 5, F.col("min_reranker_score"))
    return out.select("query_id", "chunk_id", F.round("reranker_score", 6).alias("reranker_score"), F.round("vector_similarity", 6).alias("vector_similarity"), "rank")


def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    """Paths by globs; the underscore is literal."""
    return chunks(spark, d, "relative_path").where(search.chunk_filter(file_pattern=["src/**/*_*.py", "lib/?*.go", "kettle_"])).select("chunk_id")


def chunk_type_filter(spark: SparkSession, d: str) -> DataFrame:
    """F4."""
    return chunks(spark, d, "chunk_type").where(search.chunk_filter(chunk_type="class")).select("chunk_id")


def folder_filter(spark: SparkSession, d: str) -> DataFrame:
    """F5."""
    return chunks(spark, d, "folder_structure").where(search.chunk_filter(folder_structure=["kettle", "lib"])).select("chunk_id")


def tag_filter(spark: SparkSession, d: str) -> DataFrame:
    """tags and a type together."""
    return chunks(spark, d, "tags", "chunk_type").where(search.chunk_filter(tags=["async", "go"], chunk_type="function")).select("chunk_id")


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids rebuilt from their parts."""
    c = chunks(spark, d, "relative_path", "start_line", "end_line", "chunk_type", "name")
    return c.select("chunk_id", text.chunk_id(F.col("relative_path"), F.col("start_line"), F.col("end_line"), F.col("chunk_type"), F.col("name")).alias("rebuilt"))


def previews(spark: SparkSession, d: str) -> DataFrame:
    """P2 over whole contents."""
    return chunks(spark, d, "content").select("chunk_id", text.preview(F.col("content")).alias("preview"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    """P6."""
    return chunks(spark, d, "content").select("chunk_id", text.snippet(F.col("content")).alias("snippet"))


def result_rows(spark: SparkSession, d: str) -> DataFrame:
    """Results in the shape a client gets them."""
    h = hits(spark, d, "similarity_score").where("similarity_score IS NOT NULL AND NOT isnan(similarity_score)").join(chunks(spark, d, "relative_path", "start_line", "end_line", "chunk_type"), "chunk_id")
    return h.select("query_id", F.col("relative_path").alias("file"), F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")).alias("lines"), F.col("chunk_type").alias("kind"), F.round("similarity_score", 2).alias("score"), "chunk_id")


def folder_paths(spark: SparkSession, d: str) -> DataFrame:
    """Folder names derived from relative paths."""
    return chunks(spark, d, "relative_path").select("chunk_id", F.array_join(text.folders(F.col("relative_path")), "|").alias("folders"))


def query_expand(spark: SparkSession, d: str) -> DataFrame:
    """X1, X2."""
    return asked(spark, d).select("query_id", text.expand_query(F.trim("query")).alias("expanded"))


def intent_detect(spark: SparkSession, d: str) -> DataFrame:
    """X3."""
    return asked(spark, d).select("query_id", F.array_join(text.intents(F.col("query")), ",").alias("intents"))


def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    """X4 and the entity test of the ranking."""
    return asked(spark, d).select("query_id", F.array_join(text.name_tokens(F.col("query")), " ").alias("tokens"), ranking.is_entity(F.col("query")).alias("is_entity"))


def score_maths(spark: SparkSession, d: str) -> DataFrame:
    """Sigmoid of the keyword score, yes-no probability of two scores."""
    h = hits(spark, d).where("bm25_score IS NOT NULL AND NOT isnan(bm25_score) AND vector_score IS NOT NULL AND NOT isnan(vector_score)")
    return h.select("query_id", "chunk_id", F.round(ranking.sigmoid(F.col("bm25_score") - 10), 6).alias("p_sigmoid"), F.round(ranking.yes_no(F.col("vector_score"), F.lit(0.5)), 6).alias("p_yes"))


def stats_summary(spark: SparkSession, d: str) -> DataFrame:
    """G1, G6."""
    return stats.summary(chunks(spark, d, "relative_path", "chunk_type", "project_name"))


def stats_files(spark: SparkSession, d: str) -> DataFrame:
    """G2."""
    return stats.count_by(chunks(spark, d, "relative_path"), "relative_path")


def stats_folders_top10(spark: SparkSession, d: str) -> DataFrame:
    """G3."""
    return stats.count_elements(chunks(spark, d, "folder_structure"), "folder_structure", "folder", 10)


def stats_types(spark: SparkSession, d: str) -> DataFrame:
    """G4."""
    return stats.count_by(chunks(spark, d, "chunk_type"), "chunk_type")


def stats_tags_top20(spark: SparkSession, d: str) -> DataFrame:
    """G5."""
    return stats.count_elements(chunks(spark, d, "tags"), "tags", "tag", 20)


def suggestions(spark: SparkSession, d: str) -> DataFrame:
    """P13."""
    return stats.suggestions(chunks(spark, d, "tags", "chunk_type"), "t")


def result_file_counts(spark: SparkSession, d: str) -> DataFrame:
    """Results with the number of chunks in their file."""
    c = chunks(spark, d, "relative_path")
    n = stats.count_by(c, "relative_path").withColumnRenamed("n_chunks", "chunks_in_file")
    return hits(spark, d, "similarity_score").join(c, "chunk_id").join(n, "relative_path").select("query_id", "chunk_id", "chunks_in_file")


def skipped_files(spark: SparkSession, d: str) -> DataFrame:
    """Files skipped per reason over all index runs."""
    s = table(spark, d, "index_runs").dropDuplicates(["run_id"]).select(F.explode("skipped_files").alias("s"))
    return s.groupBy(F.col("s.reason").alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("s.file").alias("n_files"))


QUERIES = (
    vector_topk, vector_topk_filtered, similar_to, similar_context, bm25_topk, hybrid_rrf, rank_boosted, dedup_best, per_file_cap, rerank_minscore, glob_filter, chunk_type_filter, folder_filter, tag_filter, chunk_ids, previews, snippets,
    result_rows, folder_paths, query_expand, intent_detect, query_tokens, score_maths, stats_summary, stats_files, stats_folders_top10, stats_types, stats_tags_top20, suggestions, result_file_counts, skipped_files,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


CHUNKS = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) r FROM chunks WHERE chunk_id IS NOT NULL) WHERE r = 1)"
_VECTORS = f"""v AS (SELECT chunk_id, list_transform(embedding, lambda x: x::DOUBLE) e FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) r FROM chunk_vectors) WHERE r = 1 AND model_name = '{MODEL}'
 AND len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
_HITS = "h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY retrieved_at DESC) r FROM search_hits) WHERE r = 1)"
_ASKED = "q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY asked_at DESC) r FROM search_queries) WHERE r = 1)"
_SOUND = "similarity_score IS NOT NULL AND NOT isnan(similarity_score)"
_SIM = "round(greatest(0.0, list_cosine_similarity(v.e, s.e)), 6)"
_PARTS = r"regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(t, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '[_\-]', ' ', 'g'), '\s+')"
_TOKENS = r"regexp_extract_all(lower(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '[_\-]', ' ', 'g')), '[\p{{L}}\p{{N}}_]+')"
_BM25 = r"""
p AS (SELECT chunk_id, regexp_extract_all(lower(content_preview), '[\p{L}\p{N}]+') t FROM c WHERE content_preview IS NOT NULL),
i AS (SELECT chunk_id, len, term, count(*) tf FROM (SELECT chunk_id, len(t) len, unnest(t) term FROM p) GROUP BY 1, 2, 3),
n AS (SELECT avg(len) a, count(*) n FROM (SELECT DISTINCT chunk_id, len FROM i)), df AS (SELECT term, count(*) df FROM i GROUP BY 1),
w0 AS (SELECT query_id, unnest(string_split_regex(trim(query), '\s+')) t FROM qq), w1 AS (SELECT query_id, t x FROM w0 UNION ALL SELECT query_id, unnest(""" + _PARTS + r""") FROM w0),
w AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(x), '[\p{L}\p{N}]+')) term FROM w1),
b AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / n.a))), 6) score FROM w JOIN i USING (term) JOIN df USING (term), n GROUP BY 1, 2)"""
_TYPES = {k: "CASE chunk_type " + " ".join(f"WHEN '{t}' THEN {b}" for t, b in v.items()) + " ELSE 1.0 END" for k, v in ranking.TYPE_BOOSTS.items()}
_ENTITY = "(len(qt) <= 3 AND NOT list_has_any(qt, [" + ", ".join(f"'{w}'" for w in ranking.ACTION_WORDS) + "]) AND (regexp_matches(query, '[A-Z][a-z]+[A-Z]') OR len(qt) <= 2))"


def _like(path: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"{path} LIKE '{text.glob_to_like(p)}' ESCAPE '\\'" for p in patterns) + ")"


def _intent(name: str) -> str:
    return f"CASE WHEN regexp_matches(lower(query), '{'|'.join(text.INTENTS[name])}') THEN '{name}' END"


_INTENTS = "list_filter([" + ", ".join(_intent(n) for n in text.INTENTS) + "], lambda x: x IS NOT NULL)"


_NEAR = f"s AS (SELECT * FROM v WHERE ('0x' || substr(md5(chunk_id), 1, 6))::INT % 50 = 0), p AS (SELECT s.chunk_id seed_id, v.chunk_id, {_SIM} similarity FROM v JOIN s ON v.chunk_id <> s.chunk_id), nn AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY similarity DESC, chunk_id)::INT rank FROM p)"


def oracle_sql() -> dict[str, str]:
    top = f"SELECT v.chunk_id, {_SIM} similarity FROM v, s"
    seed = "s AS (SELECT * FROM v ORDER BY chunk_id LIMIT 1)"
    glob = ["src/**/*_*.py", "lib/?*.go", "kettle_"]
    share = "(len(list_intersect(list_distinct(qt), list_distinct(nt)))::DOUBLE / len(list_distinct(qt)))"
    name = f"CASE WHEN coalesce(name, '') = '' THEN 1.0 WHEN lower(query) = lower(name) THEN 1.4 WHEN len(qt) = 0 THEN 1.0 WHEN {share} >= 0.8 THEN 1.3 WHEN {share} >= 0.5 THEN 1.2 WHEN {share} >= 0.3 THEN 1.1 WHEN {share} > 0 THEN 1.05 ELSE 1.0 END"
    flat = "regexp_replace(lower(relative_path), '[/\\\\]', ' ', 'g')"
    boosted = f"""similarity_score * CASE WHEN contains(lower(query), 'class') THEN {_TYPES['class']} WHEN {_ENTITY} THEN {_TYPES['entity']} ELSE {_TYPES['other']} END * {name} * (1 + 0.05 * len(list_intersect(list_distinct(qt), list_distinct(pt))))
 * (1 + 0.1 * len(list_intersect({_INTENTS}, coalesce(tags, [])))) * CASE WHEN coalesce(docstring, '') = '' THEN 1.0 WHEN {_ENTITY} AND chunk_type = 'module' THEN 1.02 ELSE 1.05 END"""
    first_line = r"regexp_replace(coalesce(list_filter(regexp_split_to_array(content, '\r\n|\n|\r'), lambda x: regexp_matches(x, '\S'))[1], ''), '\s+', ' ', 'g')"
    return {
        "vector_topk": f"WITH {_VECTORS}, {seed} {top} ORDER BY similarity DESC, v.chunk_id LIMIT {K}",
        "vector_topk_filtered": f"WITH {CHUNKS}, {_VECTORS}, {seed} {top} WHERE v.chunk_id IN (SELECT chunk_id FROM c WHERE chunk_type = 'method' AND {_like('relative_path', ['src/**', 'lib/*.ts'])}) ORDER BY similarity DESC, v.chunk_id LIMIT {K}",
        "similar_to": f"WITH {_VECTORS}, {_NEAR} SELECT seed_id, chunk_id, similarity, rank FROM nn WHERE rank <= 5",
        "similar_context": f"WITH {_VECTORS}, {_NEAR} SELECT seed_id chunk_id, list(chunk_id ORDER BY rank) context FROM nn WHERE rank <= 2 GROUP BY 1",
        "bm25_topk": f"WITH {CHUNKS}, {_ASKED}, qq AS (SELECT query_id, query FROM q), {_BM25} SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT rank FROM b) WHERE rank <= 10",
        "hybrid_rrf": f"""WITH {CHUNKS}, {_VECTORS}, {seed}, qq AS (SELECT 1 query_id, coalesce(name, '') query FROM c WHERE chunk_id = (SELECT chunk_id FROM s)), {_BM25},
 x AS (SELECT chunk_id, row_number() OVER (ORDER BY similarity DESC, chunk_id) r FROM ({top}) QUALIFY r <= 50), y AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) r FROM b QUALIFY r <= 50),
 f AS (SELECT chunk_id, round(sum(1.0 / (60 + r)), 9) score FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY 1) SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id)::INT rank FROM f QUALIFY rank <= {K}""",
        "rank_boosted": f"""WITH {CHUNKS}, {_HITS}, {_ASKED}, x AS (SELECT h.query_id, h.chunk_id, similarity_score, query, chunk_type, name, relative_path, tags, docstring, {_TOKENS.format('query')} qt, {_TOKENS.format("coalesce(name, '')")} nt, {_TOKENS.format(flat)} pt
 FROM h JOIN q USING (query_id) JOIN c USING (chunk_id) WHERE {_SOUND}), y AS (SELECT query_id, chunk_id, round(similarity_score, 6) similarity, round({boosted}, 6) rank_score FROM x) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, chunk_id)::INT rank FROM y""",
        "dedup_best": f"SELECT query_id, chunk_id, hit_id, similarity_score FROM search_hits WHERE {_SOUND} QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY similarity_score DESC, hit_id) = 1",
        "per_file_cap": f"WITH {CHUNKS}, {_HITS}, x AS (SELECT query_id, h.chunk_id, c.relative_path, similarity_score s, row_number() OVER (PARTITION BY query_id, c.relative_path ORDER BY similarity_score DESC, h.chunk_id) > 2 o FROM h JOIN c USING (chunk_id) WHERE {_SOUND}) SELECT query_id, chunk_id, relative_path, row_number() OVER (PARTITION BY query_id ORDER BY o, s DESC, chunk_id)::INT AS position FROM x QUALIFY position <= 10",
        "rerank_minscore": f"""WITH {_HITS}, {_ASKED}, x AS (SELECT h.*, greatest(0, least(1, coalesce(min_reranker_score, 0))) f FROM h JOIN q USING (query_id) WHERE {_SOUND} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, chunk_id) <= 50)
 SELECT query_id, chunk_id, round(reranker_score, 6) reranker_score, round(similarity_score, 6) vector_similarity, row_number() OVER (PARTITION BY query_id ORDER BY x.reranker_score DESC, chunk_id)::INT rank FROM x WHERE reranker_score IS NOT NULL AND NOT isnan(reranker_score) AND (f = 0 OR reranker_score >= f) QUALIFY rank <= 5""",
        "glob_filter": f"WITH {CHUNKS} SELECT chunk_id FROM c WHERE {_like('relative_path', glob)}",
        "chunk_type_filter": f"WITH {CHUNKS} SELECT chunk_id FROM c WHERE chunk_type = 'class'",
        "folder_filter": f"WITH {CHUNKS} SELECT chunk_id FROM c WHERE list_has_any(folder_structure, ['kettle', 'lib'])",
        "tag_filter": f"WITH {CHUNKS} SELECT chunk_id FROM c WHERE list_has_any(tags, ['async', 'go']) AND chunk_type = 'function'",
        "chunk_ids": f"WITH {CHUNKS} SELECT chunk_id, relative_path || ':' || start_line || '-' || end_line || ':' || chunk_type || CASE WHEN coalesce(name, '') <> '' THEN ':' || name ELSE '' END rebuilt FROM c",
        "previews": f"WITH {CHUNKS} SELECT chunk_id, CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END preview FROM c",
        "snippets": f"WITH {CHUNKS}, l AS (SELECT chunk_id, trim({first_line}) s FROM c) SELECT chunk_id, CASE WHEN length(s) > 160 THEN substring(s, 1, 157) || '...' ELSE s END snippet FROM l",
        "result_rows": f"WITH {CHUNKS}, {_HITS} SELECT query_id, c.relative_path AS file, start_line || '-' || end_line AS lines, chunk_type kind, round(similarity_score, 2) score, h.chunk_id FROM h JOIN c USING (chunk_id) WHERE {_SOUND}",
        "folder_paths": f"WITH {CHUNKS} SELECT chunk_id, array_to_string(string_split(replace(relative_path, '\\', '/'), '/')[:-2], '|') folders FROM c",
        "query_expand": f"""WITH {_ASKED}, w0 AS (SELECT query_id, generate_subscripts(a, 1) i, unnest(a) t FROM (SELECT query_id, string_split_regex(trim(query), '\\s+') a FROM q)), w1 AS (SELECT query_id, i, 0 j, t x FROM w0 UNION ALL SELECT query_id, i, generate_subscripts(b, 1), unnest(b) FROM (SELECT query_id, i, {_PARTS} b FROM w0)),
 w AS (SELECT query_id, x, min((i, j)) o FROM w1 WHERE x <> '' GROUP BY 1, 2) SELECT query_id, string_agg(x, ' ' ORDER BY o) expanded FROM w GROUP BY 1""",
        "intent_detect": f"WITH {_ASKED} SELECT query_id, coalesce(array_to_string({_INTENTS}, ','), '') intents FROM q",
        "query_tokens": f"WITH {_ASKED}, t AS (SELECT query_id, query, {_TOKENS.format('query')} qt FROM q) SELECT query_id, array_to_string(qt, ' ') tokens, {_ENTITY} is_entity FROM t",
        "score_maths": f"WITH {_HITS} SELECT query_id, chunk_id, round(1 / (1 + exp(-greatest(-20.0, least(20.0, bm25_score - 10)))), 6) p_sigmoid, round(exp(vector_score) / (exp(vector_score) + exp(0.5)), 6) p_yes FROM h WHERE bm25_score IS NOT NULL AND NOT isnan(bm25_score) AND vector_score IS NOT NULL AND NOT isnan(vector_score)",
        "stats_summary": f"WITH {CHUNKS} SELECT count(*) total_chunks, count(DISTINCT relative_path) files_indexed, count(DISTINCT chunk_type) n_types, count(DISTINCT project_name) n_projects FROM c",
        "stats_files": f"WITH {CHUNKS} SELECT relative_path, count(*) n_chunks FROM c GROUP BY 1",
        "stats_folders_top10": f"WITH {CHUNKS} SELECT folder, count(*) n_chunks FROM (SELECT unnest(folder_structure) folder FROM c) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "stats_types": f"WITH {CHUNKS} SELECT chunk_type, count(*) n_chunks FROM c GROUP BY 1",
        "stats_tags_top20": f"WITH {CHUNKS} SELECT tag, count(*) n_chunks FROM (SELECT unnest(tags) tag FROM c) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
        "suggestions": f"WITH {CHUNKS}, t AS (SELECT tag, count(*) n FROM (SELECT unnest(tags) tag FROM c) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), a AS (SELECT 0 o, n, tag v, 'Find ' || tag || ' related code' s FROM t WHERE contains(lower(tag), 't') UNION ALL SELECT 1, count(*), chunk_type, 'Show all ' || chunk_type || 's' FROM c WHERE contains(lower(chunk_type), 't') GROUP BY chunk_type) SELECT s suggestion FROM a ORDER BY o, n DESC, v LIMIT 5",
        "result_file_counts": f"WITH {CHUNKS}, {_HITS}, n AS (SELECT relative_path, count(*) k FROM c GROUP BY 1) SELECT query_id, h.chunk_id, k chunks_in_file FROM h JOIN c USING (chunk_id) JOIN n USING (relative_path)",
        "skipped_files": "SELECT s.reason reason, count(*) n, count(DISTINCT s.file) n_files FROM (SELECT unnest(skipped_files) s FROM (SELECT run_id, any_value(skipped_files) skipped_files FROM index_runs GROUP BY 1)) GROUP BY 1",
    }
