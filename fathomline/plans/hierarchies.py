"""Queries over the symbol trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators.hierarchy import descendant_counts, descendants, resolve_forest, symbol_links
from fathomline.session import stored
from fathomline.sources.tables import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return symbol_links(table(spark, d, "symbols"), table(spark, d, "edges"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every symbol in a tree of either type."""
    f = resolve_forest(_links(spark, d))
    return f.select(F.col("kind").alias("edge_type"), F.col("node").alias("chunk_id"), F.coalesce("root", F.lit("")).alias("root_chunk_id"), "depth")


def _with_paths(spark: SparkSession, d: str) -> DataFrame:
    return resolve_forest(_links(spark, d), paths=True).where("NOT looped")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path from the root of every symbol that has one, and the number of its descendants."""
    f = stored(_with_paths(spark, d))
    out = f.join(descendant_counts(f), ["kind", "node"], "left")
    return out.select(F.col("kind").alias("edge_type"), F.col("node").alias("chunk_id"), F.col("root").alias("root_chunk_id"), "depth", F.array_join("path", " > ").alias("path"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a symbol and a descendant with their distance."""
    p = descendants(_with_paths(spark, d))
    return p.select(F.col("kind").alias("edge_type"), F.col("ancestor").alias("chunk_id"), F.col("descendant").alias("descendant_chunk_id"), F.col("distance").cast("int").alias("distance"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_paths, p2_descendants)}


_LINKS = """
WITH RECURSIVE s AS (SELECT DISTINCT chunk_id, name, file_path, parent_name FROM symbols),
e0 AS (SELECT lower(trim(edge_type)) k, CASE WHEN lower(trim(edge_type)) = 'contains' THEN target_chunk_id ELSE source_chunk_id END c,
 CASE WHEN lower(trim(edge_type)) = 'contains' THEN source_chunk_id ELSE target_chunk_id END p, indexed_at FROM edges WHERE lower(trim(edge_type)) IN ('contains', 'inherits')),
e1 AS (SELECT k, c, arg_max(p, (indexed_at, p)) p FROM e0 WHERE c IN (SELECT chunk_id FROM s) AND p IN (SELECT chunk_id FROM s) GROUP BY 1, 2),
u AS (SELECT file_path, name, min(chunk_id) o FROM s GROUP BY 1, 2 HAVING count(*) = 1),
g AS (SELECT 'contains' k, s.chunk_id c, u.o p FROM s JOIN u ON u.file_path = s.file_path AND u.name = s.parent_name WHERE s.parent_name <> '' AND u.o <> s.chunk_id AND s.chunk_id NOT IN (SELECT c FROM e1 WHERE k = 'contains')),
l AS (SELECT * FROM e1 UNION ALL SELECT * FROM g),
t AS (SELECT DISTINCT k, p n FROM l UNION SELECT k, c FROM l),
w AS (SELECT t.k, t.n root, t.n, 0 depth, t.n path FROM t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.k = t.k AND l.c = t.n) UNION ALL SELECT w.k, w.root, l.c, w.depth + 1, w.path || ' > ' || l.c FROM w JOIN l ON l.k = w.k AND l.p = w.n)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _LINKS + "SELECT t.k edge_type, t.n chunk_id, coalesce(w.root, '') root_chunk_id, coalesce(w.depth, -1)::INT depth FROM t LEFT JOIN w ON w.k = t.k AND w.n = t.n",
        "p2_paths": _LINKS + ", a AS (SELECT k, n, unnest(string_split(path, ' > ')) anc FROM w), b AS (SELECT k, anc, count(*) - 1 nd FROM a GROUP BY 1, 2) SELECT w.k edge_type, w.n chunk_id, w.root root_chunk_id, w.depth::INT depth, w.path, b.nd n_descendants FROM w JOIN b ON b.k = w.k AND b.anc = w.n",
        "p2_descendants": _LINKS + ", a AS (SELECT k, n, depth, unnest(string_split(path, ' > ')) anc, generate_subscripts(string_split(path, ' > '), 1) i FROM w) SELECT k edge_type, anc chunk_id, n descendant_chunk_id, (depth - i + 1)::INT distance FROM a WHERE i <= depth",
    }
