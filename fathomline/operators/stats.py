"""Index statistics and search suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by(chunks: DataFrame, col: str) -> DataFrame:
    return chunks.groupBy(col).agg(F.count("*").alias("n_chunks"))


def count_elements(chunks: DataFrame, col: str, name: str, top: int | None = None) -> DataFrame:
    """Chunks per element of an array column, the `top` most frequent first (ties by name)."""
    out = chunks.select(F.explode(col).alias(name)).groupBy(name).agg(F.count("*").alias("n_chunks"))
    return out if top is None else out.orderBy(F.desc("n_chunks"), name).limit(top)


def summary(chunks: DataFrame) -> DataFrame:
    """One row of totals; only narrow columns are read."""
    return chunks.agg(F.count("*").alias("total_chunks"), F.countDistinct("relative_path").alias("files_indexed"), F.countDistinct("chunk_type").alias("n_types"), F.countDistinct("project_name").alias("n_projects"))


def suggestions(chunks: DataFrame, partial: str, limit: int = 5) -> DataFrame:
    """(position, suggestion): tags, then chunk types, that contain the text, by frequency."""
    low = partial.lower()
    tags = count_elements(chunks, "tags", "v", 20).where(F.lower("v").contains(low)).select(F.lit(0).alias("o"), "n_chunks", "v", F.format_string("Find %s related code", "v").alias("suggestion"))
    types = count_by(chunks, "chunk_type").where(F.lower("chunk_type").contains(low)).select(F.lit(1).alias("o"), "n_chunks", F.col("chunk_type").alias("v"), F.format_string("Show all %ss", "chunk_type").alias("suggestion"))
    return tags.unionByName(types).orderBy("o", F.desc("n_chunks"), "v").limit(limit).select("suggestion")
