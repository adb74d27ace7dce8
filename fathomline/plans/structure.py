"""Graph and snapshot queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.current import current_rows
from fathomline.operators import graph, ignore, snapshots
from fathomline.plans.retrieval import every_50th, hits
from fathomline.sources.tables import table

CUTOFF = "2024-09-01"
ROOT_RULES = ["assets/", "!src/**/assets/", "*.bundle.js", "/static/*"]
EXTRA_RULES = ["**/gen/*.py"]


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").where("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"])


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.clean_edges(table(spark, d, "edges"))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol whose id hash is divisible by 50: the seeds of the neighbourhood queries."""
    return _symbols(spark, d).where(every_50th()).select("chunk_id")


def symbols_by_name(spark: SparkSession, d: str) -> DataFrame:
    """symbols whose name several symbols share."""
    s = _symbols(spark, d)
    many = s.where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n_same")).where("n_same > 1")
    return s.join(many, "name").select("name", "chunk_id", "symbol_type", "n_same")


def symbols_of_file(spark: SparkSession, d: str) -> DataFrame:
    """the symbols of the file with the most of them, in order."""
    s = _symbols(spark, d)
    top = s.groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").limit(1)
    return s.join(top, "file_path", "left_semi").orderBy("start_line", "chunk_id").select("chunk_id", "name", "start_line", "end_line")


def edges_contains(spark: SparkSession, d: str) -> DataFrame:
    """J2, N6."""
    return graph.contains_edges(_symbols(spark, d))


def edges_inherits(spark: SparkSession, d: str) -> DataFrame:
    """J1."""
    return graph.inherits_edges(_symbols(spark, d))


def edges_calls_capped(spark: SparkSession, d: str) -> DataFrame:
    """J3, G14."""
    return graph.call_edges(_symbols(spark, d))


def callers(spark: SparkSession, d: str) -> DataFrame:
    """N2, N5, incoming calls of every symbol."""
    s = _symbols(spark, d)
    return graph.neighbours(_edges(spark, d), s, s, "incoming", "calls")


def callees(spark: SparkSession, d: str) -> DataFrame:
    """N2, N5, outgoing calls of every symbol."""
    s = _symbols(spark, d)
    return graph.neighbours(_edges(spark, d), s, s, "outgoing", "calls")


def caller_counts(spark: SparkSession, d: str) -> DataFrame:
    """Callers and callees of every symbol that has one."""
    return graph.call_counts(_edges(spark, d), _symbols(spark, d))


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    """The edges at every symbol whose id hash is divisible by 50, both ways."""
    return graph.edges_of(_edges(spark, d), _seeds(spark, d), "both")


def bfs_2hop(spark: SparkSession, d: str) -> DataFrame:
    """Symbols within two structural steps of every symbol whose id hash is divisible by 50."""
    return graph.reach(_edges(spark, d).where("edge_type <> 'calls'"), _seeds(spark, d), 2)


def subgraph_priority(spark: SparkSession, d: str) -> DataFrame:
    """The ten most telling edges of each seed's neighbourhood."""
    return graph.subgraph(_edges(spark, d), _seeds(spark, d), 1, 10)


def subgraph_omitted(spark: SparkSession, d: str) -> DataFrame:
    """What a truncation to three edges leaves out, by type, over all seeds."""
    return graph.omitted_by_type(_edges(spark, d), _seeds(spark, d), 1, 3)


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """G8."""
    return graph.graph_stats(_symbols(spark, d), _edges(spark, d))


def enrich_hints(spark: SparkSession, d: str) -> DataFrame:
    """At most ten edges per search result."""
    return graph.hints(hits(spark, d, "similarity_score"), _edges(spark, d)).select("chunk_id", "other_id", "edge_type", "direction", "position")


def delete_by_file(spark: SparkSession, d: str) -> DataFrame:
    """K8: edges left once the symbols of every file whose path hash is divisible by 50 are gone."""
    s = _symbols(spark, d)
    return graph.delete_files(s, _edges(spark, d), s.where(every_50th("file_path")).select("file_path"))[1].select("source_chunk_id", "target_chunk_id", "edge_type")


def upsert_symbols(spark: SparkSession, d: str) -> DataFrame:
    """K6: classes renamed by an upsert."""
    s = _symbols(spark, d).select("chunk_id", "name", "symbol_type", "file_path")
    return graph.upsert_symbols(s, s.where("symbol_type = 'class'").withColumn("name", F.upper("name")))


def insert_edges(spark: SparkSession, d: str) -> DataFrame:
    """K7: derived edges added to the stored ones, known ones once."""
    return graph.insert_edges(_edges(spark, d), graph.contains_edges(_symbols(spark, d)))


def _files(spark: SparkSession, d: str, before: str | None = None) -> DataFrame:
    f = table(spark, d, "source_files")
    if before:
        f = f.where(F.col("modified_at") < F.lit(before).cast("timestamp"))
    return current_rows(f, ["file_path"], "modified_at", {"content": F.col("content")}).select(F.regexp_replace("file_path", r"^/srv/checkouts/", "").alias("path"), "content")


def _hashes(spark: SparkSession, d: str, before: str | None = None) -> DataFrame:
    return snapshots.file_hashes(_files(spark, d, before), "path")


def snapshot_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash and size of every current file."""
    return _hashes(spark, d)


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """The tree at a cutoff against the current one."""
    return snapshots.diff(_hashes(spark, d, CUTOFF), _hashes(spark, d))


def merkle_dirs(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of all directories."""
    return snapshots.directory_hashes(_hashes(spark, d)).select("path", "hash", "depth", "n_files", "size")


def changed_dirs(spark: SparkSession, d: str) -> DataFrame:
    """J6."""
    return snapshots.changed_directories(snapshots.directory_hashes(_hashes(spark, d, CUTOFF)), snapshots.directory_hashes(_hashes(spark, d)))


def change_patterns(spark: SparkSession, d: str) -> DataFrame:
    """G12."""
    return snapshots.change_patterns(snapshot_diff(spark, d))


def tree_stats(spark: SparkSession, d: str) -> DataFrame:
    """G9."""
    return snapshots.tree_stats(_hashes(spark, d))


def ignore_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Files by the layer that ignores them."""
    f = table(spark, d, "source_files").select("relative_path").distinct()
    v = ignore.verdicts(f, "relative_path", ROOT_RULES, {"src": ["*_vendor*/", "!keep.py"]}, EXTRA_RULES)
    return v.groupBy(F.coalesce("ignored_by", F.lit("kept")).alias("verdict")).agg(F.count("*").alias("n_files"))


QUERIES = (
    symbols_by_name, symbols_of_file, edges_contains, edges_inherits, edges_calls_capped, callers, callees, caller_counts, edges_of, bfs_2hop, subgraph_priority, subgraph_omitted, graph_stats, enrich_hints, delete_by_file, upsert_symbols, insert_edges,
    snapshot_hash, snapshot_diff, merkle_dirs, changed_dirs, change_patterns, tree_stats, ignore_verdicts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_S = "s AS (SELECT DISTINCT * FROM symbols)"
_E = "e AS (SELECT DISTINCT source_chunk_id a, target_chunk_id b, lower(trim(edge_type)) k FROM edges WHERE lower(trim(edge_type)) IN ('contains', 'inherits', 'imports', 'calls') AND source_chunk_id IS NOT NULL AND target_chunk_id IS NOT NULL)"
_HASH = "('0x' || substr(md5({}), 1, 6))::INT % 50 = 0"
_HUB = "hub AS (SELECT chunk_id x FROM s WHERE " + _HASH.format("chunk_id") + ")"
_U = "u AS (SELECT a f, b t FROM e UNION SELECT b, a FROM e)"
_PRIO = "CASE k WHEN 'contains' THEN 0 WHEN 'inherits' THEN 1 WHEN 'imports' THEN 1 WHEN 'calls' THEN 2 ELSE 99 END"
_CONT = "nm AS (SELECT file_path, name, arg_max(chunk_id, (start_line, chunk_id)) p FROM s WHERE name <> '' GROUP BY 1, 2), co AS (SELECT DISTINCT p source_chunk_id, chunk_id target_chunk_id, 'contains' edge_type FROM s JOIN nm ON nm.file_path = s.file_path AND nm.name = s.parent_name WHERE s.parent_name <> '' AND p <> chunk_id)"


def _snap(name: str, before: str | None = None) -> str:
    cut = f"WHERE modified_at < TIMESTAMP '{before}'" if before else ""
    return f"{name} AS (SELECT replace(file_path, '/srv/checkouts/', '') path, sha256(coalesce(content, replace(file_path, '/srv/checkouts/', ''))) hash, coalesce(strlen(content), 0)::BIGINT size FROM (SELECT * FROM source_files {cut} QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY modified_at DESC) = 1))"


def _dirs(name: str, files: str, deepest: int = 9) -> str:
    """Directory hashes level by level, as unrolled CTEs."""
    parts = [f"{name}_{deepest + 1} AS (SELECT path, hash, size, 1::BIGINT n, len(string_split(path, '/'))::INT d, true leaf FROM {files})"]
    for lv in range(deepest, -1, -1):
        parts.append(f"""{name}_{lv} AS (SELECT * FROM {name}_{lv + 1} UNION ALL SELECT dir, sha256(regexp_extract(dir, '[^/]*$') || string_agg(hash, '' ORDER BY hash)), sum(size)::BIGINT, sum(n)::BIGINT, {lv}, false FROM (SELECT regexp_replace(path, '/?[^/]*$', '') dir, hash, size, n FROM {name}_{lv + 1} WHERE d = {lv + 1}) GROUP BY dir)""")
    return ", ".join(parts) + f", {name} AS (SELECT path, hash, d AS depth, n AS n_files, size FROM {name}_0 WHERE NOT leaf)"


#: Folders that always count as ignored, spelled out once more for the SQL side.
_ALWAYS_DIRS = "\\.git|\\.hg|\\.svn|\\.venv|venv|env|\\.env|\\.direnv|node_modules|\\.pnpm-store|\\.yarn|__pycache__|\\.pytest_cache|\\.mypy_cache|\\.ruff_cache|\\.pytype|\\.ipynb_checkpoints|build|dist|out|public|\\.next|\\.nuxt|\\.svelte-kit|\\.angular|\\.astro|\\.vite|\\.cache|\\.parcel-cache|\\.turbo|coverage|\\.coverage|\\.nyc_output|\\.gradle|\\.idea|\\.vscode|\\.docusaurus|\\.vercel|\\.serverless|\\.terraform|\\.mvn|\\.tox|target|bin|obj"


def oracle_sql() -> dict[str, str]:
    sub = f"{_S}, {_E}, {_HUB}, {_U}, rc AS (SELECT x seed, x n, 0 h FROM hub UNION ALL SELECT DISTINCT x, t, 1 FROM hub JOIN u ON f = x WHERE t <> x), ed AS (SELECT r1.seed, a, b, k, least(r1.h, r2.h) hop FROM e JOIN rc r1 ON r1.n = a JOIN rc r2 ON r2.n = b AND r2.seed = r1.seed), ps AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY {_PRIO}, hop, a, b, k) p FROM ed)"
    diff = f"{_snap('o', CUTOFF)}, {_snap('n')}, df AS (SELECT coalesce(o.path, n.path) path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.hash <> n.hash THEN 'modified' ELSE 'unchanged' END change FROM o FULL JOIN n ON o.path = n.path)"
    return {
        "symbols_by_name": f"WITH {_S} SELECT name, chunk_id, symbol_type, n_same FROM (SELECT *, count(*) OVER (PARTITION BY name) n_same FROM s WHERE name IS NOT NULL) WHERE n_same > 1",
        "symbols_of_file": f"WITH {_S} SELECT chunk_id, name, start_line, end_line FROM s WHERE file_path = (SELECT file_path FROM s GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
        "edges_contains": f"WITH {_S}, {_CONT} SELECT * FROM co",
        "edges_inherits": f"WITH {_S} SELECT DISTINCT a.chunk_id source_chunk_id, b.chunk_id target_chunk_id, 'inherits' edge_type FROM s a JOIN s b ON a.parent_name = b.name WHERE a.parent_name <> '' AND a.file_path <> b.file_path AND b.symbol_type IN ('class', 'interface', 'trait')",
        "edges_calls_capped": f"WITH {_S}, c AS (SELECT DISTINCT chunk_id, unnest(from_json(json_extract(metadata_json, '$.calls'), '[\"VARCHAR\"]')) callee FROM s WHERE metadata_json IS NOT NULL), f AS (SELECT name FROM s WHERE name <> '' GROUP BY 1 HAVING count(*) <= 8) SELECT DISTINCT c.chunk_id source_chunk_id, s.chunk_id target_chunk_id, 'calls' edge_type FROM c JOIN s ON s.name = c.callee WHERE s.name IN (SELECT name FROM f) AND c.chunk_id <> s.chunk_id",
        "callers": f"WITH {_S}, {_E} SELECT DISTINCT b seed_id, a chunk_id, s.name, s.symbol_type, s.file_path FROM e JOIN s z ON z.chunk_id = b JOIN s ON s.chunk_id = a WHERE k = 'calls'",
        "caller_counts": f"WITH {_S}, {_E}, c AS (SELECT DISTINCT a, b FROM e WHERE k = 'calls' AND a IN (SELECT chunk_id FROM s) AND b IN (SELECT chunk_id FROM s)), i AS (SELECT b x, count(*) n FROM c GROUP BY 1), o AS (SELECT a x, count(*) n FROM c GROUP BY 1) SELECT coalesce(i.x, o.x) chunk_id, coalesce(i.n, 0) n_callers, coalesce(o.n, 0) n_callees FROM i FULL JOIN o ON i.x = o.x",
        "edges_of": f"WITH {_S}, {_E}, {_HUB} SELECT x node, a source_chunk_id, b target_chunk_id, k edge_type, 'outgoing' direction FROM e JOIN hub ON a = x UNION ALL SELECT x, a, b, k, 'incoming' FROM e JOIN hub ON b = x",
        "callees": f"WITH {_S}, {_E} SELECT DISTINCT a seed_id, b chunk_id, s.name, s.symbol_type, s.file_path FROM e JOIN s z ON z.chunk_id = a JOIN s ON s.chunk_id = b WHERE k = 'calls'",
        "bfs_2hop": f"WITH {_S}, {_E}, {_HUB}, u AS (SELECT a f, b t FROM e WHERE k <> 'calls' UNION SELECT b, a FROM e WHERE k <> 'calls'), r AS (SELECT x seed_id, x chunk_id, 0 hop FROM hub UNION ALL SELECT x, t, 1 FROM hub JOIN u ON f = x UNION ALL SELECT x, v.t, 2 FROM hub JOIN u ON u.f = x JOIN u v ON v.f = u.t) SELECT seed_id, chunk_id, min(hop) hop FROM r GROUP BY 1, 2",
        "subgraph_priority": f"WITH {sub} SELECT seed seed_id, a source_chunk_id, b target_chunk_id, k edge_type, hop, p::INT AS position FROM ps WHERE p <= 10",
        "subgraph_omitted": f"WITH {sub} SELECT k edge_type, count(*) n_omitted FROM ps WHERE p > 3 GROUP BY 1",
        "ignore_verdicts": rf"""WITH p AS (SELECT DISTINCT replace(relative_path, chr(92), '/') p, relative_path r FROM source_files),
v AS (SELECT r, CASE WHEN regexp_matches(p, '(^|/)({_ALWAYS_DIRS})/') OR regexp_matches(p, '(\.pyc|\.pyo)(/|$)|(^|/)(\.DS_Store|Thumbs\.db)(/|$)') THEN 'always'
 WHEN regexp_matches(p, '\.bundle\.js(/|$)') OR regexp_matches(p, '^static/[^/]+(/|$)') OR regexp_matches(p, '(^|/)assets/') AND NOT regexp_matches(p, '^src/(.*/)?assets/') THEN 'gitignore'
 WHEN p LIKE 'src/%' AND regexp_matches(p[5:], '(^|/)[^/]*_vendor[^/]*/') AND NOT regexp_matches(p[5:], '(^|/)keep\.py(/|$)') THEN 'nested' WHEN regexp_matches(p, '^(.*/)?gen/[^/]*\.py(/|$)') THEN 'extra' ELSE 'kept' END verdict FROM p)
SELECT verdict, count(*) n_files FROM v GROUP BY 1""",
        "graph_stats": f"WITH {_S}, {_E} SELECT 'symbol' kind, symbol_type AS value, count(*) n FROM s GROUP BY 2 UNION ALL SELECT 'edge', k, count(*) FROM e GROUP BY 2",
        "enrich_hints": f"WITH {_E}, h AS (SELECT DISTINCT chunk_id FROM search_hits), x AS (SELECT a chunk_id, b other_id, k, 'outgoing' direction FROM e UNION ALL SELECT b, a, k, 'incoming' FROM e) SELECT chunk_id, other_id, k edge_type, direction, row_number() OVER (PARTITION BY chunk_id ORDER BY {_PRIO}, other_id, direction, k)::INT AS position FROM x WHERE chunk_id IN (SELECT chunk_id FROM h) QUALIFY position <= 10",
        "delete_by_file": f"WITH {_S}, {_E}, g AS (SELECT chunk_id FROM s WHERE {_HASH.format('file_path')}) SELECT a source_chunk_id, b target_chunk_id, k edge_type FROM e WHERE a NOT IN (SELECT chunk_id FROM g) AND b NOT IN (SELECT chunk_id FROM g)",
        "upsert_symbols": f"WITH {_S} SELECT chunk_id, CASE WHEN symbol_type = 'class' THEN upper(name) ELSE name END AS name, symbol_type, file_path FROM s",
        "insert_edges": f"WITH {_S}, {_E}, {_CONT} SELECT a source_chunk_id, b target_chunk_id, k edge_type FROM e UNION SELECT * FROM co",
        "snapshot_hash": f"WITH {_snap('n')} SELECT path, hash, size FROM n",
        "snapshot_diff": f"WITH {diff} SELECT * FROM df",
        "merkle_dirs": f"WITH {_snap('n')}, {_dirs('m', 'n')} SELECT * FROM m",
        "changed_dirs": f"WITH {_snap('o', CUTOFF)}, {_snap('n')}, {_dirs('mo', 'o')}, {_dirs('mn', 'n')} SELECT mn.path FROM mn LEFT JOIN mo ON mo.path = mn.path WHERE mo.path IS NULL OR mo.hash <> mn.hash",
        "change_patterns": f"WITH {diff}, c AS (SELECT path FROM df WHERE change <> 'unchanged') SELECT 'extension' kind, CASE WHEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) = '' THEN 'no_extension' ELSE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) END AS value, count(*) n FROM c GROUP BY 2 UNION ALL SELECT 'directory', CASE WHEN regexp_replace(path, '/?[^/]*$', '') = '' THEN 'root' ELSE regexp_replace(path, '/?[^/]*$', '') END, count(*) FROM c GROUP BY 2",
        "tree_stats": f"WITH {_snap('n')}, {_dirs('m', 'n')} SELECT (SELECT count(*) FROM n) n_files, count(*) n_dirs, (SELECT count(*) FROM n) + count(*) n_nodes, (SELECT sum(size)::BIGINT FROM n) bytes, max(CASE WHEN path = '' THEN hash END) root_hash FROM m",
    }
