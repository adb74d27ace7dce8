"""Filling fixed-capacity containers with items by sum-of-squares online packing.

Each shard of documents (a hash of the id, so any order of arrival gives the same result) is packed on its own: the
level array holds how many open containers are filled to each level, and each item goes to the level that leaves the
smallest sum of squared counts. Only the last, partly filled containers of a shard waste space, so waste falls with
the items a shard holds.
"""

from __future__ import annotations

import ast
import base64
import functools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.session import cut

TOKENIZERS = "/opt/tokenizers"
SHARD_ITEMS = 20_000


@functools.cache
def vocabulary(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> tuple[str, dict[bytes, int]]:
    """(pattern that cuts a text into words, ranks) of the public byte-level BPE in `folder`; its module is read, not run."""
    with open(os.path.join(folder, "__init__.py")) as f:
        tree = ast.parse(f.read())
    pattern = next(ast.literal_eval(n.value) for n in tree.body if isinstance(n, ast.Assign) and any(getattr(t, "id", "") == "PATTERN" for t in n.targets))
    with open(os.path.join(folder, name), "rb") as f:
        return pattern, {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def make_encoder(pattern: str, ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    return make_encoder(*vocabulary(folder, name))


_encoders: dict[str, object] = {}


def token_counts(docs: DataFrame, doc_id: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id long, n_tokens long) of every row's whole text; a null or empty text has 0 tokens.

    The vocabulary (a public file of fixed size) is read on the driver and travels with the job.
    """
    shared, mark = docs.sparkSession.sparkContext.broadcast(vocabulary(folder, name)), uuid.uuid4().hex

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoders.get(mark)
        if enc is None:  # one for each process
            _encoders.clear()
            _encoders[mark] = enc = make_encoder(*shared.value)
        for pdf in batches:
            texts = pdf["t"]
            yield pd.DataFrame({"doc_id": pdf["d"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in texts]})

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t")).mapInPandas(count, "doc_id long, n_tokens long")


class Levels:
    """The level array of sum-of-squares packing with the open containers of each level."""

    def __init__(self, capacity: int):
        self.capacity, self.counts, self.open, self.made = capacity, np.zeros(capacity + 1, np.int64), {}, 0

    def place(self, size: int) -> int:
        """Number of the container that takes an item of `size` <= capacity."""
        c, cap = self.counts, self.capacity
        old = c[1 : cap - size + 1]  # levels that the item still fits on
        level = 0
        if len(old):
            # change of the sum of squares, halved: one container leaves level h and joins level h + size; full ones do not count
            gain = c[1 + size : cap + 1] - old + 1
            gain[-1] = -old[-1]  # filled to the brim: it leaves and joins nothing (old + 1/2 - 1)
            gain = np.where(old > 0, gain, np.iinfo(np.int64).max)
            best = int(gain.argmin())
            fresh = c[size] if size < cap else -1
            if old[best] > 0 and gain[best] <= fresh:
                level = best + 1
        if level:
            box = self.open[level].pop()
            c[level] -= 1
        else:
            box, self.made = self.made, self.made + 1
        if level + size < cap:
            c[level + size] += 1
            self.open.setdefault(level + size, []).append(box)
        return box


def pack(items: DataFrame, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(item, part, size, container, fill): `items(item long, size long)` in containers of `capacity`, none above it.

    An item larger than the capacity is cut into full parts and a rest (part 0, 1, ...); any other stays whole. Items of
    size 0 or null take no space and are left out; repeated ids are packed once for each row. The container id is
    "shard-number"; fill is the container's total. An empty input gives an empty result.
    """
    whole = cut(items.where("size > 0").select("item", "size"))  # two numbers a row; the sizes are not measured again
    parts = whole.select("item", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / capacity).cast("int") - 1)).alias("part"), F.col("size"))
    parts = parts.select("item", "part", F.least(F.lit(capacity), F.col("size") - F.col("part") * capacity).cast("long").alias("size"))
    full = parts.where(F.col("size") == capacity).withColumn("container", F.concat_ws("-", F.lit("full"), F.col("item").cast("string"), F.col("part").cast("string")))
    rest = parts.where(F.col("size") < capacity)
    n = rest.count()
    shards = max(1, -(-n // shard_items))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mix", "item", "part"], kind="stable")
        lv = Levels(capacity)
        boxes = [lv.place(s) for s in pdf["size"].tolist()]
        return pd.DataFrame({"item": pdf["item"], "part": pdf["part"], "size": pdf["size"], "container": [f"{s}-{b}" for s, b in zip(pdf["shard"], boxes)]})

    mixed = rest.withColumn("mix", F.xxhash64("item", "part")).withColumn("shard", F.pmod("mix", F.lit(shards)).cast("int"))
    placed = mixed.groupBy("shard").applyInPandas(fill, "item long, part int, size long, container string")
    out = placed.unionByName(full.select("item", "part", "size", "container"))
    return out.withColumn("fill", F.sum("size").over(Window.partitionBy("container")).cast("long"))


def fill_report(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, placed tokens, share of the space used, containers above the capacity, items split though they would fit."""
    boxes = placed.groupBy("container").agg(F.sum("size").alias("used"))
    items = placed.groupBy("item").agg(F.sum("size").alias("total"), F.count("*").alias("parts"))
    a = boxes.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum((F.col("used") > capacity).cast("int")), F.lit(0)).alias("n_over"))
    b = items.agg(F.count("*").alias("n_items"), F.coalesce(F.sum(((F.col("parts") > 1) & (F.col("total") <= capacity)).cast("int")), F.lit(0)).alias("n_torn"))
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").select("n_items", "n_containers", "n_tokens", F.round(F.coalesce(F.try_divide(F.col("n_tokens"), F.col("n_containers") * capacity), F.lit(0.0)), 4).alias("fill"), "n_over", "n_torn")
