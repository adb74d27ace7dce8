"""Incremental indexing: difference by content hash, re-chunk and re-embed what changed, write a new version, then the snapshot."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.embedding import embed, hash_encoder
from fathomline.operators import graph, snapshots, stats
from fathomline.operators.store import IndexStore
from fathomline.session import stored
from fathomline.sources.chunking import MAX_CONFIG_BYTES, MAX_CONFIG_LINES, chunk_files, skipped


#: Files that a report names; the rest is counted.
DETAILS = 50


@dataclass
class IndexConfig:
    """What decides how files are chunked; another signature forces a full rebuild."""

    exclude_extensions: tuple[str, ...] = ()
    max_structured_file_bytes: int = MAX_CONFIG_BYTES
    max_structured_file_lines: int = MAX_CONFIG_LINES
    ignore_rules: tuple[str, ...] = ()
    width: int = 64

    def signature(self, rules: dict[str, str | None] | None = None) -> str:
        """Changes with every setting and, where given, with the texts of the rule files."""
        return hashlib.sha256(json.dumps([asdict(self), rules or {}], sort_keys=True).encode()).hexdigest()

    @classmethod
    def load(cls, text: str | None = None, environment: Mapping[str, str] = os.environ) -> IndexConfig:
        """Settings of one project: environment, then the project's file (JSON), then the defaults.

        Limits of 0 or less are off; values that are no whole numbers, and a file that does not parse, count as not given.
        Extensions are read without case, with or without their dot.
        """
        try:
            given = json.loads(text) if text else {}
        except ValueError:
            given = {}
        given = given if isinstance(given, dict) else {}

        def limit(name: str, default: int) -> int:
            for value in (environment.get("FATHOMLINE_" + name.upper()), given.get(name)):
                if isinstance(value, bool) or value is None:
                    continue
                try:
                    return max(0, int(value)) if float(value) == int(float(value)) else default
                except (TypeError, ValueError, OverflowError):
                    continue
            return default

        exts = environment.get("FATHOMLINE_EXCLUDE_EXTENSIONS")
        exts = exts.split(",") if exts is not None else given.get("exclude_extensions")
        exts = tuple(sorted({"." + x.strip().lower().lstrip(".") for x in exts if isinstance(x, str) and x.strip(" .")})) if isinstance(exts, list) else ()
        rules = given.get("ignore_rules")
        return cls(exts, limit("max_structured_file_bytes", MAX_CONFIG_BYTES), limit("max_structured_file_lines", MAX_CONFIG_LINES), tuple(x for x in rules if isinstance(x, str)) if isinstance(rules, list) else ())


@dataclass
class IndexReport:
    files_added: int = 0
    files_removed: int = 0
    files_modified: int = 0
    chunks_added: int = 0
    chunks_removed: int = 0
    full: bool = False
    success: bool = True
    errors: list[str] = field(default_factory=list)
    skipped_files: list[tuple[str, str]] = field(default_factory=list)
    skipped_total: int = 0
    skipped_bytes: int = 0
    skipped_truncated: bool = False


def index_files(store: IndexStore, files: DataFrame, project: str, config: IndexConfig | None = None, encoder: Callable | None = None, incremental: bool = True, rules: dict[str, str | None] | None = None, partial: bool = False) -> IndexReport:
    """Brings the store up to date with `files` (file_path, relative_path, content); returns what changed.

    Only the buckets of changed files are written. With `partial` the files given are not all of them: none counts as removed.
    Unchanged files keep their chunks; the new chunks, graph and snapshot become visible one pointer swap each, the snapshot
    last, so an interrupted run is repeated by the next one. A modified file that no longer yields any chunk keeps its old
    ones and is reported.
    """
    config = config or IndexConfig()
    files = files.withColumn("relative_path", F.regexp_replace("relative_path", r"\\", "/"))
    signature = config.signature(rules)
    encode = encoder or (lambda: hash_encoder(config.width))
    report = IndexReport()
    now = snapshots.file_hashes(files).withColumn("project_name", F.lit(project)).withColumn("signature", F.lit(signature)).withColumn("written", F.current_timestamp())
    old = store.read("snapshot")
    mine = None if old is None else old.where(F.col("project_name") == project)
    if mine is None or not incremental or mine.where(F.col("signature") != signature).limit(1).count():
        report.full = True
        base = now.where("false").select("path", "hash")
    else:
        base = mine.select("path", "hash")
        if partial:
            base = base.join(now.select("path"), "path", "left_semi")
    changes = snapshots.diff(base, now).where("change <> 'unchanged'").persist()
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    report.files_added, report.files_removed, report.files_modified = (counts.get(k, 0) for k in ("added", "removed", "modified"))
    have = store.chunks()
    if counts or report.full:
        todo = files.join(changes.where("change <> 'removed'").select(F.col("path").alias("relative_path")), "relative_path", "left_semi")
        limits = {"max_bytes": config.max_structured_file_bytes, "max_lines": config.max_structured_file_lines}
        left_out = skipped(todo, **limits)
        totals = left_out.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
        report.skipped_files = [(r["path"], r["reason"]) for r in left_out.orderBy("path").limit(DETAILS).collect()]
        report.skipped_total, report.skipped_bytes, report.skipped_truncated = totals["n"], totals["b"], totals["n"] > DETAILS
        chunks = chunk_files(todo, **limits).join(files.select("relative_path", "file_path").dropDuplicates(["relative_path"]), "relative_path").withColumn("project_name", F.lit(project)).persist()
        lost = changes.where("change = 'modified'").select(F.col("path").alias("relative_path")).join(chunks.select("relative_path").distinct(), "relative_path", "left_anti").join(have.where(F.col("project_name") == project).select("relative_path").distinct(), "relative_path", "left_semi")
        kept = [r[0] for r in lost.limit(DETAILS).collect()]
        report.errors = [f"{p}: no chunks; the old ones are kept" for p in kept]
        replaced = changes.select("path").join(lost.select(F.col("relative_path").alias("path")), "path", "left_anti")
        same_project = F.col("project_name") == project
        if report.full:
            replaced = replaced.unionByName(have.where(same_project).select(F.col("relative_path").alias("path")).distinct())
        replaced = stored(replaced.distinct())
        report.chunks_removed = have.where(same_project).join(replaced.select(F.col("path").alias("relative_path")), "relative_path", "left_semi").count()
        vectors = embed(chunks, encode)
        fresh = chunks.join(vectors, "chunk_id").select(
            F.coalesce("content_preview", F.lit("")).alias("text"), "vector", "file_path", "relative_path", "chunk_type", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("parent_name", F.lit("")).alias("parent_name"), F.coalesce("docstring", F.lit("")).alias("docstring"),
            "start_line", "end_line", "tags", "folder_structure", F.array().cast("array<string>").alias("decorators"), F.array().cast("array<string>").alias("imports"), "content_preview", "chunk_id", "project_name", "content", "complexity_score",
        )
        report.chunks_added = chunks.count()
        store.update("chunks", fresh, replaced, same_project)
        _write_graph(store, chunks, project, report.full, replaced)
        chunks.unpersist()
    store.update("snapshot", now, now.select("path").unionByName(changes.select("path")) if counts or old is None else now.select("path"), F.col("project_name") == project)
    changes.unpersist()
    store.write(stats.summary(store.chunks()).withColumn("written", F.current_timestamp()), "stats")
    return report


def snapshots_of(store: IndexStore) -> DataFrame:
    """(project_name, n_files, bytes, last_snapshot, signature): one row per project, newest first."""
    have = store.read("snapshot")
    if have is None:
        return store.spark.createDataFrame([], "project_name string, n_files long, bytes long, last_snapshot timestamp, signature string")
    return have.groupBy("project_name").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max("written").alias("last_snapshot"), F.max("signature").alias("signature")).orderBy(F.desc("last_snapshot"))


def delete_snapshot(store: IndexStore, project: str) -> None:
    """Forgets a project's snapshot, so its next run indexes everything again."""
    have = store.read("snapshot")
    if have is not None:
        mine = F.col("project_name") == project
        store.update("snapshot", have.where("false"), have.where(mine).select("path"), mine)


def _write_graph(store: IndexStore, chunks: DataFrame, project: str, full: bool, replaced: DataFrame) -> None:
    """Symbols of the changed files replace their old ones; edges are derived again for these files and for those that name one of their symbols."""
    mine = F.col("project_name") == project
    new = stored(chunks.where("name <> ''").select("chunk_id", "name", F.col("chunk_type").alias("symbol_type"), "file_path", "relative_path", "start_line", "end_line", "parent_name", F.to_json(F.struct("calls")).alias("metadata_json"), "project_name").dropDuplicates(["chunk_id"]))
    old = store.read("symbols")
    gone = replaced if not full or old is None else old.where(mine).select(F.col("relative_path").alias("path")).distinct().unionByName(new.select(F.col("relative_path").alias("path")).distinct())
    gone = stored(gone.select("path").distinct())
    names = new.select("name")
    if old is not None:
        names = names.unionByName(old.where(mine).join(gone.select(F.col("path").alias("relative_path")), "relative_path", "left_semi").select("name"))
    names = stored(names.distinct())
    store.update("symbols", new, gone, mine)
    symbols = store.read("symbols")
    by_parent = symbols.select("relative_path", F.col("parent_name").alias("name")).join(names, "name", "left_semi").select("relative_path")
    by_call = graph.call_names(symbols).withColumnRenamed("callee", "name").join(names, "name", "left_semi").join(symbols.select("chunk_id", "relative_path"), "chunk_id").select("relative_path")
    touched = stored(by_parent.unionByName(by_call).unionByName(gone.select(F.col("path").alias("relative_path"))).distinct())
    store.update("edges", graph.source_edges(symbols, touched), touched.select(F.col("relative_path").alias("path")))
