"""The service's tools as methods: each takes plain values, returns DataFrames or plain dicts."""

from __future__ import annotations

import math
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import models, ranking, text
from fathomline.functions.embedding import hash_vector
from fathomline.operators import graph, search, stats
from fathomline.operators.indexing import IndexConfig, IndexReport, delete_snapshot, index_files, snapshots_of
from fathomline.operators.store import IndexStore
from fathomline.session import stored
from fathomline.sources.files import scan, walk

#: The project that index_test_project writes.
SAMPLE_PROJECT = {
    "shop/basket.py": "class Basket:\n    \"\"\"Items chosen so far.\"\"\"\n\n    def add(self, item):\n        return append(self, item)\n\n\ndef append(basket, item):\n    return [*basket, item]\n",
    "shop/web.ts": "export class Page {\n  render(title: string): string {\n    return title;\n  }\n}\n",
    "shop/settings.json": '{"service": {"port": 80}, "name": "shop"}\n',
    "README.md": "# Shop\n\nA sample.\n",
}

MAX_K, RECALL_K = 100, 50
SIMILAR_FIELDS = ("file_path", "relative_path", "chunk_type", "name", "parent_name", "start_line", "end_line", "content_preview", "tags")


class CodeIndex:
    """One index: index_directory, search, find_similar, graph context, callers, status, projects, clearing."""

    def __init__(self, spark: SparkSession, root: str, config: IndexConfig | None = None):
        self.spark, self.config, self.store = spark, config or IndexConfig.load(), IndexStore(spark, root)
        self.project: str | None = None
        self.roots: dict[str, str] = {}

    def index_directory(self, path: str, project: str, incremental: bool = True, include: list[str] | None = None, rules: list[str] = ()) -> IndexReport:
        """Indexes a folder under its own rule files; a change of rules or settings indexes it as a whole."""
        found = walk(self.spark, path, [*self.config.ignore_rules, *rules])
        files = scan(self.spark, path, project, include=include, exclude_extensions=self.config.exclude_extensions, found=found)
        with self.store.lock():
            self.roots[project] = path
            return index_files(self.store, files, project, self.config, incremental=incremental, rules=found[0].signature)

    def index_test_project(self, folder: str) -> IndexReport:
        """Writes a small project of several languages into `folder` and indexes it as `sample`."""
        for name, text_ in SAMPLE_PROJECT.items():
            target = os.path.join(folder, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "w") as f:
                f.write(text_)
        return self.index_directory(folder, "sample")

    def auto_reindex_if_needed(self, project: str, max_age_minutes: float = 5) -> IndexReport | None:
        """Brings a project indexed through this object up to date if its snapshot is older than that; None if nothing was due."""
        age = self.snapshot_age(project)
        if project not in self.roots or age is not None and age <= 60 * max_age_minutes:
            return None
        return self.index_directory(self.roots[project], project)

    def snapshot_age(self, project: str) -> float | None:
        """Seconds since a project's last snapshot, None without one."""
        r = snapshots_of(self.store).where(F.col("project_name") == project).select(text.age_seconds(F.col("last_snapshot")).alias("s")).first()
        return None if r is None else float(r["s"])

    def list_snapshots(self) -> DataFrame:
        return snapshots_of(self.store)

    def delete_snapshot(self, project: str) -> None:
        with self.store.lock():
            delete_snapshot(self.store, project)

    def indexing_stats(self) -> dict:
        """The totals stored by the last run, and the age of each project's snapshot."""
        have = self.store.read("stats")
        return {"totals": have.first().asDict() if have is not None else {}, "projects": {r["project_name"]: r["s"] for r in snapshots_of(self.store).select("project_name", text.age_seconds(F.col("last_snapshot")).alias("s")).collect()}}

    def search(self, query: str, k: int = 5, max_results_per_file: int | None = None, hybrid: bool = True, include_context: bool = False, auto_reindex: bool = False, max_age_minutes: float = 5, scorer: Callable | None = None, min_reranker_score: float = 0.0, **filters: object) -> DataFrame:
        """Ranked chunks: file, lines, kind, name, score, chunk_id, snippet. Ordered by boosted score, showing the plain one.

        Without a project filter all projects are searched, unless switch_project chose one. `scorer` reranks the recalled
        chunks (see models.score_pairs); if it fails the recall order stands. `include_context` adds the ids of two similar chunks.
        """
        filters.setdefault("project_name", self.project)
        if auto_reindex and filters["project_name"]:
            self.auto_reindex_if_needed(str(filters["project_name"]), max_age_minutes)
        if not query or not query.strip():
            raise ValueError("the query is blank")
        if not 1 <= k <= MAX_K:
            raise ValueError(f"k must lie between 1 and {MAX_K}")
        rows = self.store.chunks().where(search.chunk_filter(**filters))
        vec = F.array(*[F.lit(float(x)) for x in hash_vector(query, self.config.width)])
        near = search.ranked(search.vector_topk(rows.select("chunk_id", F.col("vector").alias("embedding")), vec, RECALL_K).withColumn("q", F.lit(1)), "similarity", ["q"], RECALL_K)
        if hybrid:
            asked = self.spark.range(1).select(F.lit(1).alias("query_id"), F.lit(query).alias("query"))
            keyed = search.bm25_topk(search.postings(rows, "text"), search.corpus_stats(rows, "text"), asked, RECALL_K).withColumnRenamed("query_id", "q")
            found = search.rrf([near, keyed], ["q"], RECALL_K).select("chunk_id", F.col("score").alias("similarity"))
        else:
            found = near.select("chunk_id", "similarity")
        full = found.join(rows.drop("vector"), "chunk_id").withColumn("q", F.lit(1))
        reranked = False
        if scorer is not None:
            scored = stored(models.score_pairs(full.withColumn("query", F.lit(query)), scorer))
            reranked = not scored.where("reranker_score IS NOT NULL").isEmpty()
            full = scored.where((F.col("reranker_score") >= min_reranker_score)).withColumn("similarity", F.col("reranker_score")).drop("query", "reranker_score") if reranked else scored.drop("query", "reranker_score")
        score = ranking.rank_score(F.col("similarity"), F.lit(query), F.col("chunk_type"), F.col("name"), F.col("relative_path"), F.col("tags"), F.col("docstring"), reranked)
        order = search.per_file_cap(search.dedup_best(full.withColumn("rank_score", score), ["q"], [F.desc("rank_score")]), ["q"], "relative_path", "rank_score", max_results_per_file or RECALL_K)
        out = order.orderBy("position").limit(k)
        context = []
        if include_context:
            near_rows = self.store.chunks().select("chunk_id", F.col("vector").alias("embedding"))
            seeds = near_rows.join(out.select("chunk_id"), "chunk_id", "left_semi")
            out, context = search.with_context(out, search.similar_to_many(near_rows, seeds, 3)).orderBy("position"), ["context"]
        return out.select(F.col("relative_path").alias("file"), F.concat_ws("-", "start_line", "end_line").alias("lines"), F.col("chunk_type").alias("kind"), "name", F.round("similarity", 4).alias("score"), "rank_score", "chunk_id", text.snippet(F.col("content_preview")).alias("snippet"), F.lit(reranked).alias("reranked"), *context)

    def find_similar(self, chunk_id: str, k: int = 5) -> DataFrame:
        """Chunks most like a stored one; empty if it is missing."""
        if not 1 <= k <= MAX_K:
            raise ValueError(f"k must lie between 1 and {MAX_K}")
        rows = self.store.chunks()
        seed = rows.where(F.col("chunk_id") == chunk_id).select("vector").first()
        if seed is None:
            return rows.where("false").select("chunk_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"), *SIMILAR_FIELDS)
        near = search.vector_topk(rows.where(F.col("chunk_id") != chunk_id).select("chunk_id", F.col("vector").alias("embedding")), F.array(*[F.lit(float(x)) for x in seed[0]]), k)
        return search.ranked(near.withColumn("_q", F.lit(1)), "similarity", ["_q"], k).drop("_q").join(rows.select("chunk_id", *SIMILAR_FIELDS), "chunk_id").orderBy("rank")

    def graph_context(self, chunk_id: str, max_depth: int = 1, max_edges: int = 100, edge_type: str | None = None) -> dict:
        """{found, edges, symbols}: the neighbourhood of a symbol."""
        if edge_type is not None and edge_type not in graph.EDGE_TYPES:
            raise ValueError(f"unknown edge type {edge_type}")
        for name, value in (("max_depth", max_depth), ("max_edges", max_edges)):
            if isinstance(value, bool) or not isinstance(value, int) or value < 0:
                raise ValueError(f"{name} must be a whole number, not below 0")
        symbols, edges = self.store.read("symbols"), self.store.read("edges")
        if symbols is None or edges is None or not symbols.where(F.col("chunk_id") == chunk_id).limit(1).count():
            return {"found": False, "edges": [], "symbols": []}
        seed = symbols.where(F.col("chunk_id") == chunk_id).select("chunk_id")
        placed = stored(graph.ordered_subgraph(edges, seed, max_depth, edge_type).drop("seed_id"))
        kept = graph.kept_edges(max_edges)
        sub = placed.where(F.col("position") <= kept).orderBy("position").collect()
        omitted = {r["edge_type"]: r["count"] for r in placed.where(F.col("position") > kept).groupBy("edge_type").count().collect()}
        ids = {chunk_id, *(r["source_chunk_id"] for r in sub), *(r["target_chunk_id"] for r in sub)}
        named = symbols.where(F.col("chunk_id").isin(sorted(ids))).select("chunk_id", "name", "symbol_type", "file_path").collect()
        note = f"{sum(omitted.values())} edges are left out; ask for one edge_type or more edges" if omitted else ""
        return {"found": True, "edges": [r.asDict() for r in sub], "symbols": [r.asDict() for r in named], "total_edges": len(sub) + sum(omitted.values()), "truncated": bool(omitted), "omitted_by_type": omitted, "note": note}

    def search_callers(self, chunk_id: str, direction: str = "callers") -> DataFrame:
        symbols, edges = self.store.read("symbols"), self.store.read("edges")
        seed = symbols.where(F.col("chunk_id") == chunk_id)
        parts = [graph.neighbours(edges, symbols, seed, way, "calls").withColumn("relation", F.lit(name)) for name, way in (("callers", "incoming"), ("callees", "outgoing")) if direction in (name, "both")]
        if not parts:
            raise ValueError("direction is callers, callees or both")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def status(self) -> dict:
        """Totals, health and whether chunks and graph agree."""
        chunks, symbols = self.store.chunks(), self.store.read("symbols")
        total = stats.summary(chunks).first().asDict()
        reasons = []
        if symbols is None:
            reasons.append("no graph")
        elif symbols.join(chunks.select("chunk_id"), "chunk_id", "left_anti").limit(1).count():
            reasons.append("symbols without chunks")
        v = self.store.version()
        return {**total, **self.store.health(), "sync": "degraded" if reasons else "synced", "reasons": reasons, "age_seconds": math.inf if v is None else time.time() - v["written"]}

    def call_counts(self, chunk_id: str) -> dict:
        """{callers, callees}: how many there are."""
        symbols, edges = self.store.read("symbols"), self.store.read("edges")
        mine = edges.where((F.col("source_chunk_id") == chunk_id) | (F.col("target_chunk_id") == chunk_id))
        r = graph.call_counts(mine, symbols).where(F.col("chunk_id") == chunk_id).first()
        return {"callers": r["n_callers"] if r else 0, "callees": r["n_callees"] if r else 0}

    def search_by_file_pattern(self, query: str, patterns: list[str], k: int = 5) -> DataFrame:
        return self.search(query, k, file_pattern=patterns)

    def search_by_chunk_type(self, query: str, chunk_type: str, k: int = 5) -> DataFrame:
        return self.search(query, k, chunk_type=chunk_type)

    def switch_project(self, project: str | None) -> None:
        """Searches stay within this project from now on; None lifts that."""
        if project is not None and self.store.chunks().where(F.col("project_name") == project).limit(1).isEmpty():
            raise ValueError(f"unknown project {project}")
        self.project = project

    def projects(self) -> DataFrame:
        return self.store.chunks().groupBy("project_name").agg(F.count("*").alias("n_chunks"), F.countDistinct("relative_path").alias("n_files"))

    def suggestions(self, partial: str) -> list[str]:
        return [r[0] for r in stats.suggestions(self.store.chunks(), partial).collect()]

    def needs_reindex(self, max_age_minutes: float = 5) -> bool:
        return self.status()["age_seconds"] > 60 * max_age_minutes

    def clear_index(self) -> dict:
        done = self.store.clear()
        return {"success": all(done.values()), **done}

    def remove_project(self, project: str) -> dict:
        """Removes a project's rows from every table."""
        with self.store.lock():
            mine = F.col("project_name") == project
            gone = stored(self.store.read("symbols").where(mine).select(F.col("relative_path").alias("path")).distinct()) if self.store.read("symbols") is not None else None
            for name, path in (("chunks", "relative_path"), ("symbols", "relative_path"), ("snapshot", "path"), ("files", "relative_path")):
                have = self.store.read(name)
                if have is not None:
                    self.store.update(name, have.where("false"), have.where(mine).select(F.col(path).alias("path")).distinct(), mine)
            symbols, edges = self.store.read("symbols"), self.store.read("edges")
            if gone is not None and edges is not None:
                ids = symbols.select("chunk_id")
                lost = edges.join(ids.withColumnRenamed("chunk_id", "source_chunk_id"), "source_chunk_id", "left_anti").unionByName(edges.join(ids.withColumnRenamed("chunk_id", "target_chunk_id"), "target_chunk_id", "left_anti")).select(F.col("relative_path").alias("path")).distinct()
                touched = stored(lost.unionByName(gone).distinct())
                self.store.update("edges", graph.source_edges(symbols, touched.withColumnRenamed("path", "relative_path")), touched)
        return {"success": True, "project": project}
