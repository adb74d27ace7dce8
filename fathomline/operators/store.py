"""A versioned chunk index on plain Parquet, on any file system Spark can write: immutable bucket folders and one pointer file that is swapped last.

Rows lie in buckets by the hash of their file's path. A change of some files rewrites the buckets of these files and no
others; the pointer names the folder of every bucket, so versions share what did not change.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COLUMNS = (
    "text string, vector array<float>, file_path string, relative_path string, chunk_type string, name string, parent_name string, docstring string, start_line int, end_line int, tags array<string>, "
    "folder_structure array<string>, decorators array<string>, imports array<string>, content_preview string, chunk_id string, project_name string, content string, complexity_score double"
)
TABLES = ("chunks", "symbols", "edges", "snapshot", "stats", "files")
#: The path column that deals a table's rows to buckets; other tables are one piece.
PATHS = {"chunks": "relative_path", "symbols": "relative_path", "edges": "relative_path", "snapshot": "path", "files": "relative_path"}
BUCKETS = 64


class _Files:
    """The few file operations that are needed, through Hadoop's interface."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.root.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(self.root)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        except Py4JJavaError as e:  # other failures may pass and are not taken for a missing table
            if "ChecksumException" in e.java_exception.getClass().getName():
                raise ValueError(f"{name} is damaged") from None
            raise
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if there is one."""
        try:
            stream = self.fs.create(self.path(name), False)
        except Exception:
            if self.fs.exists(self.path(name)):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def swap(self, name: str, text: str) -> None:
        """Replaces a file in one step."""
        temporary = f".{name}.{uuid.uuid4().hex}"
        self.create(temporary, text)
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf).rename(self.path(temporary), self.path(name), how)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def list(self, name: str = "") -> list[tuple[str, bool, float]]:
        """(name, whether a folder, time of the last change in seconds)."""
        at = self.path(name) if name else self.root
        return [(s.getPath().getName(), s.isDirectory(), s.getModificationTime() / 1000) for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def size(self) -> int:
        return self.fs.getContentSummary(self.root).getLength()


class IndexStore:
    """Tables `chunks`, `symbols`, `edges`, `snapshot`, `stats`, `files` under one folder that all executors can reach.

    A writer builds new bucket folders beside the current ones and then replaces the pointer, so readers never see half a
    change and a failed write leaves nothing behind but an unused folder. One writer at a time holds the lock file.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets, self.files = spark, root, buckets, _Files(spark, root)
        self.files.fs.mkdirs(self.files.root)

    def _bucket(self, table: str, path: str | None = None) -> Column:
        return F.pmod(F.xxhash64(path or PATHS[table]), F.lit(self.buckets)).cast("int") if table in PATHS else F.lit(0)

    def version(self, table: str = "chunks") -> dict | None:
        """{written, schema, buckets: {number: folder}}; None without a table, or if its pointer cannot be read."""
        try:
            got = json.loads(self.files.read(f"{table}.current.json") or "null")
            return got if isinstance(got, dict) and "buckets" in got else None
        except ValueError:
            return None

    def read(self, table: str = "chunks", only: list[int] | None = None) -> DataFrame | None:
        """The current version [of some buckets], None if there is none."""
        v = self.version(table)
        if v is None:
            return None
        schema = StructType.fromJson(v["schema"])
        folders = [f"{self.files.root.toString()}/{f}" for b, f in v["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def chunks(self) -> DataFrame:
        got = self.read("chunks")
        return self.spark.createDataFrame([], COLUMNS) if got is None else got

    def chunk(self, chunk_id: str) -> DataFrame:
        """The row of one id, without its vector."""
        return self.chunks().where(F.col("chunk_id") == chunk_id).drop("vector").limit(1)

    def _put(self, df: DataFrame, table: str) -> dict[str, str]:
        """Writes the rows into new bucket folders; {number: folder}."""
        folder = f"{table}-{time.strftime('%Y%m%d%H%M%S')}-{uuid.uuid4().hex[:8]}"
        dealt = df.withColumn("bucket_no", self._bucket(table))
        if table in PATHS:
            dealt = dealt.hint("rebalance", "bucket_no")
        dealt.write.mode("errorifexists").partitionBy("bucket_no").parquet(f"{self.files.root.toString()}/{folder}")
        return {name.split("=")[1]: f"{folder}/{name}" for name, is_folder, _ in self.files.list(folder) if is_folder and name.startswith("bucket_no=")}

    def _point(self, table: str, schema: StructType, buckets: dict[str, str]) -> dict:
        entry = {"written": time.time(), "table": table, "schema": json.loads(schema.json()), "buckets": buckets}
        self.files.swap(f"{table}.current.json", json.dumps(entry))
        return entry

    def write(self, df: DataFrame, table: str = "chunks") -> dict:
        """Replaces a whole table."""
        return self._point(table, df.schema, self._put(df, table))

    def update(self, table: str, fresh: DataFrame, paths: DataFrame | None, within: Column | None = None) -> dict:
        """Puts `fresh` in place of the rows of paths(path) [among the rows `within`]; only the buckets touched are read and written.

        Without `paths` nothing is removed. A table that is not there yet is made.
        """
        v = self.version(table)
        if v is None:
            return self.write(fresh, table)
        marks = fresh.select(self._bucket(table).alias("b"))
        if paths is not None:
            marks = marks.unionByName(paths.select(self._bucket(table, "path").alias("b")))
        touched = sorted(r.b for r in marks.distinct().collect())  # at most one number for each bucket
        if not touched:
            return v
        old = self.read(table, touched)
        if paths is not None:
            gone = paths.select(F.col("path").alias(PATHS[table])).distinct()
            stays = old.where(~within).unionByName(old.where(within).join(gone, PATHS[table], "left_anti").select(*old.columns)) if within is not None else old.join(gone, PATHS[table], "left_anti").select(*old.columns)
        else:
            stays = old
        both = stays.unionByName(fresh, allowMissingColumns=True)
        written = self._put(both, table)
        kept = {b: f for b, f in v["buckets"].items() if int(b) not in touched}
        return self._point(table, both.schema, {**kept, **written})

    def append(self, rows: DataFrame) -> int:
        """Adds chunks; an empty batch does nothing, a width other than the stored one raises."""
        n = rows.count()
        if not n:
            return 0
        width = {r[0] for r in rows.select(F.size("vector")).distinct().limit(2).collect()}
        have = self.read()
        known = {r[0] for r in have.select(F.size("vector")).limit(1).collect()} if have is not None else width
        if len(width) > 1 or width != (known or width):
            raise ValueError(f"vector width {sorted(width)} does not fit {sorted(known)}")
        self.update("chunks", rows, None)
        return n

    def delete_files(self, paths: DataFrame, project: str | None = None) -> int:
        """Drops chunks of the paths (path column against file_path or relative_path) [in a project]; returns how many."""
        have = self.read()
        if have is None:
            return 0
        mine = F.lit(True) if project is None else F.coalesce(F.col("project_name") == project, F.lit(False))
        rows = have.where(mine).select("relative_path", "file_path")
        asked = paths.select("path").distinct()
        hit = rows.join(asked, F.col("relative_path") == F.col("path"), "left_semi").unionByName(rows.join(asked, F.col("file_path") == F.col("path"), "left_semi"))
        gone = hit.select(F.col("relative_path").alias("path")).distinct().persist()
        n = have.where(mine).join(gone.select(F.col("path").alias("relative_path")), "relative_path", "left_semi").count()
        if n:
            self.update("chunks", have.where("false"), gone, mine)
        gone.unpersist()
        return n

    def compact(self, keep_seconds: float = 86400, files: int | None = None) -> int:
        """Rewrites the chunks into one folder a bucket if `files` is given, and removes folders no version of the last day names; returns their number."""
        have = self.read()
        if have is not None and files:
            self.write(have)
        live = {f.split("/")[0] for t in TABLES if (v := self.version(t)) for f in v["buckets"].values()}
        removed = 0
        for name, is_folder, changed in self.files.list():
            if is_folder and name not in live and time.time() - changed >= keep_seconds:
                self.files.delete(name)
                removed += 1
        return removed

    def clear(self) -> dict[str, bool]:
        """Drops every table; success per table."""
        done = {}
        for table in TABLES:
            try:
                v = self.version(table)
                self.files.delete(f"{table}.current.json")
                for folder in {f.split("/")[0] for f in v["buckets"].values()} if v else ():
                    self.files.delete(folder)
                done[table] = True
            except Exception:
                done[table] = False
        return done

    def health(self) -> dict[str, int]:
        """Bytes and number of stored folders."""
        return {"bytes": self.files.size(), "versions": sum(is_folder for _, is_folder, _ in self.files.list())}

    @contextmanager
    def lock(self, wait: float = 0.0) -> Iterator[None]:
        """The writer's lock; raises TimeoutError if another holds it for longer than `wait` seconds."""
        until = time.time() + wait
        while not self.files.create(".lock", str(time.time())):
            if time.time() >= until:
                raise TimeoutError("the index is being written")
            time.sleep(0.05)
        try:
            yield
        finally:
            self.files.delete(".lock")
