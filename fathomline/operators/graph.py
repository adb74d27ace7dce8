"""The symbol graph: building edges, lookups, bounded neighbourhoods, maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.session import cut

EDGE_TYPES = ("contains", "inherits", "imports", "calls")
PARENT_TYPES = ("class", "interface", "trait")
#: A called name with more matches than this says nothing about which one is meant.
MAX_CALL_MATCHES = 8
MAX_EDGES = 200


def priority(edge_type: Column) -> Column:
    """Which edges survive truncation: containment first, calls last."""
    return F.when(edge_type == "contains", 0).when(edge_type.isin("inherits", "imports"), 1).when(edge_type == "calls", 2).otherwise(99)


def clean_edges(edges: DataFrame) -> DataFrame:
    """(source_chunk_id, target_chunk_id, edge_type): known types read without case and blanks, each edge once."""
    kind = F.lower(F.trim("edge_type"))
    return edges.select("source_chunk_id", "target_chunk_id", kind.alias("edge_type")).where(F.col("edge_type").isin(*EDGE_TYPES) & F.col("source_chunk_id").isNotNull() & F.col("target_chunk_id").isNotNull()).distinct()


def upsert_symbols(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """All symbols, a new row in place of an old one with its key. Of several new rows with one key the greatest counts."""
    cols = old.columns
    rest = [c for c in cols if c != key]
    latest = new.select(*cols).groupBy(key).agg(F.max(F.struct(*rest)).alias("m")).select(key, *[F.col(f"m.`{c}`").alias(c) for c in rest]).select(*cols)
    return old.join(latest.select(key), key, "left_anti").select(*cols).unionByName(latest)


def insert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones added; known (source, target, type) and unknown types are left out."""
    return clean_edges(old).unionByName(clean_edges(new)).distinct()


def delete_files(symbols: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) without the symbols of paths(file_path) and without edges that touch one."""
    gone = symbols.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("chunk_id").distinct()
    left = symbols.join(paths.select("file_path").distinct(), "file_path", "left_anti").select(*symbols.columns)
    kept = edges.join(gone.withColumnRenamed("chunk_id", "source_chunk_id"), "source_chunk_id", "left_anti").join(gone.withColumnRenamed("chunk_id", "target_chunk_id"), "target_chunk_id", "left_anti")
    return left, kept.select(*edges.columns)


def source_edges(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """All derived edges that leave the files of sources(relative_path), with that path: (source, target, type, relative_path).

    A containing symbol lies in the file of what it contains; parents and called symbols may lie in any file.
    """
    own = symbols.join(sources.select("relative_path").distinct(), "relative_path", "left_semi")
    at = own.select(F.col("chunk_id").alias("source_chunk_id"), "relative_path").dropDuplicates(["source_chunk_id"])
    edges = contains_edges(own).unionByName(inherits_edges(symbols, own)).unionByName(call_edges(symbols, sources=own))
    return edges.join(at, "source_chunk_id").select("source_chunk_id", "target_chunk_id", "edge_type", "relative_path")


def contains_edges(symbols: DataFrame) -> DataFrame:
    """Parent to child within a file by parent_name; of several symbols of a name the last in the file is the parent."""
    names = symbols.where("name <> ''").groupBy("file_path", F.col("name").alias("parent_name")).agg(F.max(F.struct("start_line", "chunk_id")).alias("p")).select("file_path", "parent_name", F.col("p.chunk_id").alias("source_chunk_id"))
    kids = symbols.where("parent_name <> ''").select("file_path", "parent_name", F.col("chunk_id").alias("target_chunk_id"))
    return kids.join(names, ["file_path", "parent_name"]).where("source_chunk_id <> target_chunk_id").select("source_chunk_id", "target_chunk_id", F.lit("contains").alias("edge_type")).distinct()


def inherits_edges(symbols: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Symbol (of `sources`, if given) to the class-like symbols of its parent_name in other files."""
    tops = symbols.where(F.col("symbol_type").isin(*PARENT_TYPES)).select(F.col("name").alias("parent_name"), F.col("chunk_id").alias("target_chunk_id"), F.col("file_path").alias("_f"))
    kids = (symbols if sources is None else sources).where("parent_name <> ''").select("parent_name", F.col("chunk_id").alias("source_chunk_id"), "file_path")
    return kids.join(tops, "parent_name").where(F.col("file_path") != F.col("_f")).select("source_chunk_id", "target_chunk_id", F.lit("inherits").alias("edge_type")).distinct()


def call_names(symbols: DataFrame) -> DataFrame:
    """(chunk_id, callee): the names a symbol's metadata lists under "calls", each once."""
    calls = F.from_json(F.get_json_object("metadata_json", "$.calls"), "array<string>")
    return symbols.select("chunk_id", F.explode(calls).alias("callee")).where("callee <> ''").distinct()


def call_edges(symbols: DataFrame, max_matches: int = MAX_CALL_MATCHES, sources: DataFrame | None = None) -> DataFrame:
    """Caller (of `sources`, if given) to every symbol of a called name, names with more than `max_matches` symbols left out.

    The limit is applied to the name table before the join, so no name can blow it up.
    """
    ids = symbols.where("name <> ''").select("name", "chunk_id").distinct()
    few = ids.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") <= max_matches).select("name")
    targets = ids.join(few, "name", "left_semi").select(F.col("name").alias("callee"), F.col("chunk_id").alias("target_chunk_id"))
    hits = call_names(symbols if sources is None else sources).withColumnRenamed("chunk_id", "source_chunk_id").join(targets, "callee")
    return hits.where("source_chunk_id <> target_chunk_id").select("source_chunk_id", "target_chunk_id", F.lit("calls").alias("edge_type")).distinct()


def edges_of(edges: DataFrame, nodes: DataFrame, direction: str = "both", edge_type: str | None = None) -> DataFrame:
    """(node, source, target, type, direction): edges at each of nodes(chunk_id); in both directions a loop counts twice."""
    e = edges.select("source_chunk_id", "target_chunk_id", "edge_type")
    e = e if edge_type is None else e.where(F.col("edge_type") == edge_type)
    ids = nodes.select(F.col("chunk_id").alias("node")).distinct()
    at = lambda end, name: e.withColumn("node", F.col(end)).join(ids, "node", "left_semi").withColumn("direction", F.lit(name))
    out, into = at("source_chunk_id", "outgoing"), at("target_chunk_id", "incoming")
    return {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction]


def call_counts(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(chunk_id, n_callers, n_callees): distinct known symbols at the other end of each symbol's calls."""
    ids = symbols.select("chunk_id").distinct()
    calls = edges.where("edge_type = 'calls'").select(F.col("source_chunk_id").alias("a"), F.col("target_chunk_id").alias("b")).distinct()
    calls = calls.join(ids.select(F.col("chunk_id").alias("a")), "a", "left_semi").join(ids.select(F.col("chunk_id").alias("b")), "b", "left_semi")
    ends = calls.select(F.col("b").alias("chunk_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(calls.select(F.col("a").alias("chunk_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("chunk_id").agg(F.sum("i").alias("n_callers"), F.sum("o").alias("n_callees"))


def neighbours(edges: DataFrame, symbols: DataFrame, seeds: DataFrame, direction: str, edge_type: str) -> DataFrame:
    """(seed_id, chunk_id, name, symbol_type, file_path): symbols at the other end of a seed's edges; missing ones drop out."""
    near, far = ("target_chunk_id", "source_chunk_id") if direction == "incoming" else ("source_chunk_id", "target_chunk_id")
    e = edges.where(F.col("edge_type") == edge_type).select(F.col(near).alias("seed_id"), F.col(far).alias("chunk_id")).distinct()
    e = e.join(seeds.select(F.col("chunk_id").alias("seed_id")).distinct(), "seed_id", "left_semi")
    return e.join(symbols.select("chunk_id", "name", "symbol_type", "file_path").dropDuplicates(["chunk_id"]), "chunk_id").select("seed_id", "chunk_id", "name", "symbol_type", "file_path")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed_id, chunk_id, hop): nodes within `depth` undirected steps of each seed, one join per step for all seeds."""
    both = edges.select(F.col("source_chunk_id").alias("chunk_id"), F.col("target_chunk_id").alias("_to")).unionByName(edges.select(F.col("target_chunk_id").alias("chunk_id"), F.col("source_chunk_id").alias("_to"))).distinct()
    frontier = seeds.select(F.col("chunk_id").alias("seed_id"), "chunk_id").distinct().withColumn("hop", F.lit(0))
    seen = frontier
    for hop in range(1, max(0, depth) + 1):
        step = frontier.join(both, "chunk_id").select("seed_id", F.col("_to").alias("chunk_id")).distinct()
        frontier = cut(step.join(seen.select("seed_id", "chunk_id"), ["seed_id", "chunk_id"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def ordered_subgraph(edges: DataFrame, seeds: DataFrame, depth: int, edge_type: str | None = None) -> DataFrame:
    """(seed_id, source, target, type, hop, position): all edges among a seed's neighbourhood, placed by priority, hop and ends.

    An edge's hop is that of its nearer end; both ends must lie within `depth`.
    """
    e = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    r = reach(e, seeds, depth)
    a = r.select("seed_id", F.col("chunk_id").alias("source_chunk_id"), F.col("hop").alias("_a"))
    b = r.select("seed_id", F.col("chunk_id").alias("target_chunk_id"), F.col("hop").alias("_b"))
    inside = e.join(a, "source_chunk_id").join(b, ["seed_id", "target_chunk_id"]).withColumn("hop", F.least("_a", "_b"))
    order = Window.partitionBy("seed_id").orderBy(priority(F.col("edge_type")), "hop", "source_chunk_id", "target_chunk_id", "edge_type")
    return inside.withColumn("position", F.row_number().over(order)).select("seed_id", "source_chunk_id", "target_chunk_id", "edge_type", "hop", "position")


def kept_edges(max_edges: int) -> int:
    """How many edges a truncated neighbourhood keeps."""
    return max(1, min(MAX_EDGES, max_edges))


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int, max_edges: int = MAX_EDGES, edge_type: str | None = None) -> DataFrame:
    """The first max_edges rows of ordered_subgraph for each seed."""
    return ordered_subgraph(edges, seeds, depth, edge_type).where(F.col("position") <= kept_edges(max_edges))


def hints(results: DataFrame, edges: DataFrame, cap: int = 10) -> DataFrame:
    """(chunk_id, other_id, edge_type, direction, position): at most `cap` edges per result by priority."""
    out = edges.select(F.col("source_chunk_id").alias("chunk_id"), F.col("target_chunk_id").alias("other_id"), "edge_type", F.lit("outgoing").alias("direction"))
    into = edges.select(F.col("target_chunk_id").alias("chunk_id"), F.col("source_chunk_id").alias("other_id"), "edge_type", F.lit("incoming").alias("direction"))
    all_ = out.unionByName(into).join(results.select("chunk_id").distinct(), "chunk_id", "left_semi")
    order = Window.partitionBy("chunk_id").orderBy(priority(F.col("edge_type")), "other_id", "direction", "edge_type")
    return all_.withColumn("position", F.row_number().over(order)).where(F.col("position") <= cap)


def graph_stats(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, value, n): symbols by type and edges by type."""
    s = symbols.groupBy(F.col("symbol_type").alias("value")).agg(F.count("*").alias("n")).select(F.lit("symbol").alias("kind"), "value", "n")
    e = edges.groupBy(F.col("edge_type").alias("value")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "value", "n")
    return s.unionByName(e)


def omitted_by_type(edges: DataFrame, seeds: DataFrame, depth: int, max_edges: int, edge_type: str | None = None) -> DataFrame:
    """(edge_type, n_omitted): all edges of the seeds' neighbourhoods that the truncation to max_edges leaves out."""
    return ordered_subgraph(edges, seeds, depth, edge_type).where(F.col("position") > kept_edges(max_edges)).groupBy("edge_type").agg(F.count("*").alias("n_omitted"))
