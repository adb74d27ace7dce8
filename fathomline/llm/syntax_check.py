"""Source files that do not parse: every dialect grammar of the file's language runs on one graph-structured stack."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.current import current_rows
from fathomline.llm.syntax.languages import language

#: Languages by extension; the extension of file_path decides, the language column is not trusted.
EXTENSIONS = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "json": "json", "yaml": "yaml", "yml": "yaml"}


def extension(path: Column | str) -> Column:
    """Lower-case extension of a path without the dot, '' if it has none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def syntax_verdicts(files: DataFrame) -> DataFrame:
    """(file_path, project_name, language, parses boolean, dialect) of each current file of a supported language.

    `files` holds file_path, project_name, content, modified_at. A null content counts as empty; an empty text is valid
    unless the grammar needs a token (JSON, Go).
    `dialect` names the start rule that derived the text. Files of other extensions are left out.
    """
    cur = current_rows(files, ["file_path"], "modified_at", {"project_name": F.col("project_name"), "content": F.coalesce("content", F.lit(""))})
    cur = cur.select("file_path", "project_name", "content", extension("file_path").alias("ext")).where(F.col("ext").isin(list(EXTENSIONS)))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            won = []
            for text, ext in zip(pdf["content"], pdf["ext"]):
                lang = language(ext)
                got = lang.scan(text, lang.grammar)
                won.append(None if got is None else lang.grammar.accepts(got[0], lang.starts, got[1])[0])
            yield pd.DataFrame({"file_path": pdf["file_path"], "project_name": pdf["project_name"], "language": [EXTENSIONS[e] for e in pdf["ext"]], "parses": [w is not None for w in won], "dialect": [w[6:] if w else None for w in won]})

    return cur.mapInPandas(check, "file_path string, project_name string, language string, parses boolean, dialect string")


def syntax_rates(verdicts: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(project_name, language, n_files, n_invalid, invalid_rate, n_hinted): rates per project and language.

    n_hinted counts flagged files that index_runs.chunking_errors (`file_path: message`) also name; it is a hint, never evidence.
    """
    v = verdicts
    if runs is not None:
        named = runs.select(F.explode("chunking_errors").alias("e")).select(F.regexp_extract("e", r"^(.*?\.[A-Za-z0-9]+):\s", 1).alias("file_path")).where("file_path <> ''").distinct().withColumn("hint", F.lit(1))
        v = v.join(named, "file_path", "left")
    else:
        v = v.withColumn("hint", F.lit(None).cast("int"))
    bad = F.when(~F.col("parses"), 1).otherwise(0)
    return v.groupBy("project_name", "language").agg(F.count("*").alias("n_files"), F.sum(bad).alias("n_invalid"), F.sum(bad * F.coalesce("hint", F.lit(0))).alias("n_hinted")).select("project_name", "language", "n_files", "n_invalid", F.round(F.col("n_invalid") / F.col("n_files"), 6).alias("invalid_rate"), "n_hinted")
