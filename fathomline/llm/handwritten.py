"""Generated, minified or vendored source files: a random forest over content features, trained on notices it cannot see.

Labels come from what the features leave out. A header comment that names a generator or an upstream release is cut away
before anything is measured; the share of literals and the length of lines, which tell data blobs and minified scripts,
are no features either. Whether a path follows a convention for third-party or generated code is a feature and no label:
such files train only if they carry a notice, so that the forest learns from these what the place is worth. Files without
a notice outside such places are the other class. A file is flagged if the forest says so or it carries evidence of its
own (a notice, a conventional place): the text of a third-party copy is like any other.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.current import current_rows
from fathomline.llm.syntax_check import extension
from fathomline.session import cut

CODE = ("py", "js", "ts", "jsx", "tsx", "go", "java", "kt", "rs", "c", "h", "cc", "cpp", "hpp", "cs", "rb", "php", "swift", "scala", "lua", "css")
#: Folders that hold third-party copies, and generator outputs, by common convention (fixed values).
VENDOR_DIRS = ("vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "node_modules", "bower_components", "site-packages", "deps", "external", "externals", "extern")
GENERATED_DIRS = ("gen", "generated", "__generated__", "autogen")
GENERATED_NAME = r"(?:\.(?:gen|generated|g|pb|pb\.gw|min|bundle|designer)\.[A-Za-z]+|_pb2(?:_grpc)?\.pyi?|_(?:gen|generated)\.[A-Za-z]+|(?:Grpc|OuterClass)\.java|\.pb\.(?:go|cc|h))$"
#: Header notices (fixed values). They count only in the comments before the first and after the last code.
NOTICE = re.compile(
    r"code generated by\b.*do not edit|\bauto-?generated\b(?! (?:method|function|constructor|getter|setter|stub))|<auto-generated|@generated\b|\bgenerated (?:on build|from|automatically|code)\b|^\W*generated by\b|do not (?:modify|edit)\b.*(?:output of|generated)|"
    r"(?:file|code|source) (?:was|is|has been) (?:\w+ )?(?:produced|generated) by (?:the |a )?\S+|upstream copy|\bthird-party: \S+ v?\d|vendored (?:from|copy)|copied (?:verbatim|unchanged|unmodified|as is) from|copied from upstream",
    re.I | re.M,
)
BANNER = re.compile(r"^/\*!")
_COMMENT_HEAD = {"py": re.compile(r"\s*(?:#[^\n]*(?:\n|$)\s*)+"), "": re.compile(r"\s*(?:(?://[^\n]*(?:\n|$)|/\*(?:[^*]|\*(?!/))*\*/)\s*)+")}
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.){16,}\"|'(?:[^'\\\n]|\\.){16,}'|-?\b(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?)\b,?")
_SHAPE = re.compile(r"\w+")
_BLANKS = re.compile(r"\s")
#: What the forest sees, and what the labels are read from.
FEATURES = ("compression", "entropy", "identifier_length", "short_identifiers", "comment_density", "spaces", "repeated_shapes")
PLACES = ("third_party_path", "generated_path")


def split_header(text: str, ext: str) -> tuple[str, str]:
    """(comments before the first and after the last code, the code between)."""
    m = _COMMENT_HEAD["py" if ext in ("py", "rb") else ""].match(text)
    head, body = (text[: m.end()], text[m.end() :]) if m else ("", text)
    marks = ("#",) if ext in ("py", "rb") else ("//", "/*", "*")
    lines = body.split("\n")
    last = len(lines)
    while last and (not lines[last - 1].strip() or lines[last - 1].startswith(marks) or lines[last - 1].strip() == "*/"):
        last -= 1
    return head + "\n" + "\n".join(lines[last:]), "\n".join(lines[:last])


def features(body: str, ext: str) -> tuple[list[float], float, float]:
    """(the numbers in FEATURES, share of literals, characters a line) of a text without its header comments."""
    raw = body.encode("utf-8", "replace")
    n = max(1, len(body))
    tokens = _TOKEN.findall(body)
    total = max(1, len(tokens))
    counts = Counter(tokens)
    entropy = -sum(c / total * math.log2(c / total) for c in counts.values())
    names = [(t, c) for t, c in counts.items() if t[0].isalpha() or t[0] == "_"]
    uses = max(1, sum(c for _, c in names))
    lines = [x for x in body.split("\n") if x.strip()]
    rows = max(1, len(lines))
    mark = "#" if ext in ("py", "rb") else "//"
    comments = sum(1 for x in lines if x.lstrip().startswith((mark, "*", "/*")))
    shapes = Counter(_SHAPE.sub("w", x.strip()) for x in lines if len(x) < 400)
    top = max((c for s, c in shapes.items() if len(s) > 3), default=0)
    literals = sum(len(x) for x in _LITERAL.findall(body))
    seen = [len(zlib.compress(raw, 1)) / max(1, len(raw)), entropy, sum(len(t) * c for t, c in names) / uses, sum(c for t, c in names if len(t) <= 2) / uses, comments / rows, len(_BLANKS.findall(body)) / n, top / rows]
    return seen, literals / n, n / rows


def _in(path: Column, folders: tuple[str, ...]) -> Column:
    return path.rlike("(?:^|/)(?:" + "|".join(d.replace("-", r"\-") for d in folders) + ")/")


def places(path: Column | str) -> list[Column]:
    """Whether a path lies in a folder that convention keeps for third-party code; in one for generated code, or has such a name."""
    p = F.regexp_replace(path, r"\\", "/")
    return [_in(p, VENDOR_DIRS).cast("double").alias("third_party_path"), (_in(p, GENERATED_DIRS) | p.rlike(GENERATED_NAME)).cast("double").alias("generated_path")]


def file_features(files: DataFrame) -> DataFrame:
    """(file_path, notice string, PLACES..., FEATURES...) of each current code file; notice is null, 'header', 'literals', 'dense' or 'path'.

    `files` holds file_path, relative_path, content, modified_at. Configuration and Markdown are left out; a null content
    counts as empty. 'path' stands only where no other notice does.
    """
    cur = current_rows(files, ["file_path"], "modified_at", {"relative_path": F.col("relative_path"), "content": F.coalesce("content", F.lit(""))})
    cur = cur.select("file_path", *places(F.coalesce("relative_path", "file_path")), "content", extension("file_path").alias("ext")).where(F.col("ext").isin(list(CODE)))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, third, gen, text, ext in zip(pdf["file_path"], pdf["third_party_path"], pdf["generated_path"], pdf["content"], pdf["ext"]):
                if "\r" in text:
                    text = text.replace("\r\n", "\n").replace("\r", "\n")
                head, body = split_header(text, ext)
                row, literal_share, line = features(body, ext)
                told = NOTICE.search(head) or (BANNER.match(head) and line > 200)
                notice = "header" if told else "literals" if len(body) > 400 and literal_share > 0.75 else "dense" if len(body) > 400 and line > 200 else "path" if third or gen else None
                out.append((path, notice, third, gen, *row))
            yield pd.DataFrame(out, columns=["file_path", "notice", *PLACES, *FEATURES])

    return cur.mapInPandas(measure, "file_path string, notice string, " + ", ".join(f"{f} double" for f in (*PLACES, *FEATURES)))


def fit_forest(labelled: DataFrame, trees: int = 40, label_weight: float = 0.5, seed: int = 11):
    """The forest for labelled(label, PLACES..., FEATURES...); all rows with a label weigh `label_weight` times as much as all others."""
    from pyspark.ml.classification import RandomForestClassifier

    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    weight = label_weight * sizes[0.0] / sizes[1.0]
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", weightCol="_w", numTrees=trees, maxDepth=7, minInstancesPerNode=min(5, 1 + int(sizes[1.0]) // 20), subsamplingRate=0.8, featureSubsetStrategy="0.6", seed=seed)
    return forest.fit(_vector(labelled.withColumn("_w", F.when(F.col("label") > 0, weight).otherwise(1.0))))


def _vector(table: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=[*PLACES, *FEATURES], outputCol="_x", handleInvalid="keep").transform(table)


def training_rows(table: DataFrame) -> DataFrame:
    """Rows of file_features with their label: 1 with a notice, 0 without one; files known by their place alone are left out."""
    return table.where("notice IS NULL OR notice <> 'path'").withColumn("label", F.when(F.col("notice").isNotNull(), 1.0).otherwise(0.0))


def not_handwritten(files: DataFrame, max_training_rows: int = 20_000, trees: int = 40, label_weight: float = 0.5, threshold: float = 0.5, seed: int = 11) -> DataFrame:
    """(file_path, notice, probability double, flagged boolean) of each current code file.

    The forest is fitted on at most `max_training_rows` labelled files (those of smallest path hash, on
    average exactly so many, a documented bound) and applied to all. Without both
    kinds of label the forest is left out and notices decide alone (probability 0 or 1).
    """
    from pyspark.ml.functions import vector_to_array

    table = cut(file_features(files))
    train = training_rows(table).withColumn("_h", F.xxhash64("file_path"))
    n = train.count()
    if n > max_training_rows:  # a hash range rather than a sorted limit: no task or driver gathers more than the bound
        train = train.where(F.col("_h") < int(-(2**63) + 2**64 * max_training_rows / n))
    model = fit_forest(train, trees, label_weight, seed)
    notice = F.col("notice").isNotNull()
    if model is None:
        return table.select("file_path", "notice", F.when(notice, 1.0).otherwise(0.0).alias("probability"), notice.alias("flagged"))
    scored = model.transform(_vector(table)).withColumn("probability", vector_to_array("probability")[1])
    return scored.select("file_path", "notice", "probability", (notice | (F.col("probability") >= threshold)).alias("flagged"))
