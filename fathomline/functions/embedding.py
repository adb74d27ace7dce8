"""Text for embedding and a deterministic embedder that needs no model; model hooks take the same shape."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMBER_TYPES = ("method", "constructor", "property", "function")
MAX_CHARS, DOC_CHARS, MARK = 6000, 300, "    # ... (truncated) ..."
#: Of a long content: lines at its head and share of the room they may take, lines at its tail, characters kept for the mark.
HEAD_LINES, HEAD_SHARE, TAIL_LINES, MARK_ROOM = 20, 0.7, 10, 20


def _running(sizes: Column, start: Column) -> Column:
    """Running totals of a short array of lengths, from `start` on."""
    return F.slice(F.aggregate(sizes, F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))), 2, F.greatest(F.size(sizes), F.lit(0)))


def embedding_text(content: Column, chunk_type: Column, parent: Column, doc: Column, max_chars: int = MAX_CHARS) -> Column:
    """What is embedded for a chunk: its owner's name, its documentation, then its content within `max_chars`.

    A content beyond the room left keeps its first lines up to 70 % of the room and as many last lines as fit behind a
    mark; one of three lines or fewer is cut off. Null counts as empty.
    """
    owner = F.when((parent != "") & chunk_type.isin(*MEMBER_TYPES), F.concat(F.lit("# In "), parent, F.lit(":")))
    quoted = F.when(doc != "", F.concat(F.lit('"""'), F.when(F.length(doc) > DOC_CHARS, F.concat(F.substring(doc, 1, DOC_CHARS), F.lit("..."))).otherwise(doc), F.lit('"""')))
    body = F.coalesce(content, F.lit(""))
    taken = F.coalesce(F.length(owner), F.length(quoted), F.lit(0))
    room = F.lit(max_chars - 10) - taken
    lines = F.split(body, "\n", -1)
    n = F.size(lines)
    first = F.slice(lines, 1, F.least(F.floor(n / 2), F.lit(HEAD_LINES)).cast("int"))
    reach = _running(F.transform(first, lambda x: F.length(x) + 1), taken)
    head = F.size(F.filter(reach, lambda r: r <= room * HEAD_SHARE))
    spent = F.when(head > 0, F.element_at(reach, F.greatest(head, F.lit(1)))).otherwise(taken)
    many = F.least(F.floor(n / 3), F.lit(TAIL_LINES)).cast("int")
    last = F.reverse(F.slice(lines, F.greatest(n - many + 1, F.lit(1)), many))
    back = _running(F.transform(last, F.length), F.lit(0))  # without line ends: one for each line but the first, at least one
    tail = F.size(F.filter(F.transform(back, lambda s, k: s + F.greatest(k, F.lit(1))), lambda s: s <= room - spent - MARK_ROOM))
    shortened = F.concat_ws("\n", F.slice(lines, 1, head), F.lit(MARK), F.slice(lines, n - tail + 1, tail))
    fit = F.when(F.length(body) <= room, body).when(n > 3, shortened).otherwise(F.concat(body.substr(F.lit(1), F.greatest(room, F.lit(0))), F.lit("...")))
    return F.concat_ws("\n", owner, quoted, fit)


def hash_vector(text: str, width: int) -> np.ndarray:
    """Unit vector of hashed token counts; the zero vector for a text without tokens."""
    v = np.zeros(width, np.float32)
    for t in re.findall(r"[^\W_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower()):
        h = hashlib.md5(t.encode()).digest()
        v[int.from_bytes(h[:4], "little") % width] += 1 if h[4] & 1 else -1
    n = float(np.linalg.norm(v))
    return v / n if n else v


def hash_encoder(width: int) -> Callable[[list[str]], np.ndarray]:
    return lambda texts: np.stack([hash_vector(t, width) for t in texts]) if texts else np.zeros((0, width), np.float32)


def embed(chunks: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "", batch: int = 32) -> DataFrame:
    """chunks with `vector array<float>`. `encoder` is called once per task and returns the function that encodes a list of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for pdf in batches:
            texts = pdf["text"].tolist()
            vectors: list[np.ndarray] = []
            for i in range(0, len(texts), batch):
                vectors += list(np.asarray(encode(texts[i : i + batch]), np.float32))
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "vector": vectors})

    text = F.concat(F.lit(prefix), embedding_text(F.col("content"), F.col("chunk_type"), F.col("parent_name"), F.col("docstring")))
    return chunks.select("chunk_id", text.alias("text")).mapInPandas(run, "chunk_id string, vector array<float>")


def check_width(vectors: DataFrame, width: int, col: str = "vector") -> DataFrame:
    """`vectors`, failing at run time on a row of another width."""
    bad = F.concat(F.lit("vector of another width: "), F.size(col).cast("string"))
    return vectors.withColumn(col, F.when(F.size(col) == width, F.col(col)).otherwise(F.raise_error(bad).cast("array<float>")))
