"""Content snapshots of file trees: hashes, differences, directory hashes and change patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.session import cut


def file_hashes(files: DataFrame, path: str = "relative_path", content: str = "content") -> DataFrame:
    """(path, hash, size): SHA-256 and bytes of each file; a file that can't be read (null) has the hash of its path and size 0."""
    body = F.col(content)
    return files.select(F.col(path).alias("path"), F.sha2(F.coalesce(body, F.col(path)), 256).alias("hash"), F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("size"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed, modified or unchanged by hash."""
    o, n = old.select("path", F.col("hash").alias("_o")), new.select("path", F.col("hash").alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "modified").otherwise("unchanged")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"))


def _parent(path: str):
    return F.regexp_replace(path, r"/?[^/]*$", "")


def directory_hashes(hashes: DataFrame) -> DataFrame:
    """(path, hash, depth, n_files, size) of every directory, '' being the root.

    A directory's hash is SHA-256 of its name followed by its children's hashes in order. Levels are solved
    from the deepest up, one aggregation each. Child names take no part, so renaming a file in place changes nothing.
    """
    depth = F.size(F.split("path", "/"))
    nodes = cut(hashes.select("path", "hash", "size", F.lit(1).cast("long").alias("n_files"), depth.alias("depth")))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    pending, out = nodes, None
    for level in range(deepest, 0, -1):
        at = pending.where(F.col("depth") == level)
        dirs = at.groupBy(_parent("path").alias("dir")).agg(F.array_join(F.sort_array(F.collect_list("hash")), "").alias("kids"), F.sum("n_files").alias("n_files"), F.sum("size").alias("size"))
        dirs = cut(dirs.select(F.col("dir").alias("path"), F.sha2(F.concat(F.regexp_extract("dir", r"[^/]*$", 0), "kids"), 256).alias("hash"), "size", "n_files", F.lit(level - 1).alias("depth")))
        out = dirs if out is None else out.unionByName(dirs)
        pending = pending.where(F.col("depth") < level).unionByName(dirs) if level > 1 else pending
    if out is None:
        return nodes.where("false").select("path", "hash", "depth", "n_files", "size")
    return out.select("path", "hash", "depth", "n_files", "size")


def changed_directories(old: DataFrame, new: DataFrame) -> DataFrame:
    """Directories of `new` that are absent or different in `old` (both from directory_hashes)."""
    o = old.select("path", F.col("hash").alias("_o"))
    return new.join(o, "path", "left").where("_o IS NULL OR _o <> hash").select("path")


def change_patterns(changes: DataFrame) -> DataFrame:
    """(kind, value, n): changed files by extension and by directory."""
    c = changes.where("change <> 'unchanged'")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    by_ext = c.groupBy(F.when(ext == "", "no_extension").otherwise(ext).alias("value")).agg(F.count("*").alias("n")).select(F.lit("extension").alias("kind"), "value", "n")
    parent = _parent("path")
    by_dir = c.groupBy(F.when(parent == "", "root").otherwise(parent).alias("value")).agg(F.count("*").alias("n")).select(F.lit("directory").alias("kind"), "value", "n")
    return by_ext.unionByName(by_dir)


def tree_stats(hashes: DataFrame) -> DataFrame:
    """One row: files, directories, nodes, bytes and the root hash."""
    d = directory_hashes(hashes)
    files = hashes.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    dirs = d.agg(F.count("*").alias("n_dirs"), F.max(F.when(F.col("path") == "", F.col("hash"))).alias("root_hash"))
    both = files.select("n_files", "bytes", F.lit(1).alias("_k")).join(dirs.withColumn("_k", F.lit(1)), "_k")
    return both.select("n_files", "n_dirs", (F.col("n_files") + F.col("n_dirs")).alias("n_nodes"), "bytes", "root_hash")


def latest_per_project(snapshots: DataFrame, keep: int) -> DataFrame:
    """The `keep` newest snapshots (project_name, written) of each project, newest first within it."""
    w = Window.partitionBy("project_name").orderBy(F.desc("written"))
    return snapshots.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")
