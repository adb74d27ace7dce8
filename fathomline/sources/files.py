"""Directory scans as binary-file reads of the folders that no rule ignores."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.text import glob_match
from fathomline.operators.ignore import ALWAYS, RuleSet, rule_ignores, verdicts
from fathomline.sources.languages import EXTENSIONS

#: Rule files: in any folder, and at the top only.
RULE_FILE, TOP_RULE_FILE = ".gitignore", ".cursorignore"
MAX_RULE_BYTES = 1 << 20


def walk(spark: SparkSession, root: str, rules: list[str] = (), dynamic: list[str] = ()) -> tuple[RuleSet, list[str]]:
    """(rules found under `root`, folders that none of them ignores), on any file system Spark can read.

    Folders are listed from the top, ignored ones are not entered, so nothing below them is read or listed again. Rule
    files that cannot be read, or are larger than a megabyte, count as empty.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def lines(path) -> list[str] | None:
        try:
            if not fs.exists(path) or fs.getFileStatus(path).getLen() > MAX_RULE_BYTES:
                return None
            stream = fs.open(path)
            try:
                return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace").splitlines()
            finally:
                stream.close()
        except Exception:
            return None

    own, last = lines(jvm.org.apache.hadoop.fs.Path(top, RULE_FILE)), lines(jvm.org.apache.hadoop.fs.Path(top, TOP_RULE_FILE))
    hash_of = lambda x: None if x is None else hashlib.sha256("\n".join(x).encode()).hexdigest()
    base, extra = [*(own or []), *rules], last or []
    nested: dict[str, tuple[str, ...]] = {}
    kept, todo = [root], [("", top)]
    while todo:
        name, path = todo.pop()
        try:
            children = fs.listStatus(path)
        except Exception:  # a folder that may not be read is passed over
            continue
        for child in children:
            if not child.isDirectory():
                continue
            leaf = child.getPath().getName()
            rel = f"{name}/{leaf}" if name else leaf
            scopes = [(d, r) for d, r in nested.items() if rel.startswith(d + "/")]
            if (
                any(leaf.endswith(p[1:]) if p.startswith("*") else leaf == p for p in dynamic) or rule_ignores(rel + "/", list(ALWAYS)) or rule_ignores(rel + "/", base)
                or any(rule_ignores(rel[len(d) + 1 :] + "/", list(r)) for d, r in scopes) or rule_ignores(rel + "/", extra)
            ):
                continue
            mine = lines(jvm.org.apache.hadoop.fs.Path(child.getPath(), RULE_FILE))
            if mine is not None:
                nested[rel] = tuple(mine)
            kept.append(child.getPath().toString())
            todo.append((rel, child.getPath()))
    return RuleSet(tuple(base), nested, tuple(extra), {"gitignore_hash": hash_of(own), "cursorignore_hash": hash_of(last)}), kept


def scan(spark: SparkSession, root: str, project: str, rules: list[str] = (), nested: dict[str, list[str]] | None = None, extra: list[str] = (), include: list[str] | None = None, exclude_extensions: tuple[str, ...] = (), dynamic: list[str] = (), found: tuple[RuleSet, list[str]] | None = None) -> DataFrame:
    """(file_path, relative_path, project_name, content, size_bytes, modified_at) of the supported files under `root`.

    The folder's own rule files hold (see walk; `found` is its result if it is known), `rules`, `nested` and `extra` come on
    top. Content is decoded as UTF-8 (bad bytes become U+FFFD). Paths are decided before any content is read.
    """
    own, folders = found or walk(spark, root, rules, dynamic)
    raw = spark.read.format("binaryFile").load(folders)
    path = F.regexp_replace("path", r"^file:/*", "/")
    files = raw.select(path.alias("file_path"), F.regexp_replace(path, "^" + root.rstrip("/").replace(".", r"\.") + "/", "").alias("relative_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    allowed = [e for e in EXTENSIONS if e not in exclude_extensions]
    files = files.where(F.lower(F.regexp_extract("relative_path", r"(\.[^./]+)$", 1)).isin(allowed))
    files = verdicts(files, "relative_path", list(own.root), {**{d: list(r) for d, r in own.nested.items()}, **(nested or {})}, [*own.extra, *extra], list(dynamic)).where("ignored_by IS NULL").drop("ignored_by")
    if include:
        files = files.where(glob_match(F.col("relative_path"), include))
    return files.select("file_path", "relative_path", F.lit(project).alias("project_name"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), "size_bytes", "modified_at")
