"""The k most similar vectors of every vector: a random-projection forest searched through one priority queue.

Every level of a tree projects on one random direction; every node splits at the median of the sample rows that
reach it, so leaves stay balanced whatever the clusters are. A query walks all trees at once, best first: one queue
ordered by the squared distance to the crossed split planes. The side a query lies on keeps its parent's priority,
so the `probes` leaves which the shared queue would pop are exactly the survivors of a beam that keeps the `probes`
best nodes over all trees at each level; that form runs on whole batches in numpy. Rows travel as int8 codes, once
to each subtree where a query has probes, each with its code's distance from the vector: a coded score is off by no more
than two such distances. Survivors of the coded scores are ranked again by exact double cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.session import stored

SUBTREE_LEVELS = 6
#: Depth up to which `probes` alone holds; each level below it adds `more_probes`.
SHALLOW_LEVELS = 7
#: Sample rows below which a node's own median is not fitted, and the bounds of the sample itself.
NODE_SAMPLE, LEAST_SAMPLE, MOST_SAMPLE = 4, 32_768, 262_144


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two float arrays of equal width, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def fit_vector(width: int) -> Column:
    """Whether `embedding` has the width, no null, NaN or infinite component, and is not all zero."""
    e = F.col("embedding")
    return (F.size(e) == width) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)


def clean_vectors(rows: DataFrame, model: str | None, width: int) -> DataFrame:
    """(id string, embedding) of the current rows fit for cosine: right model and width, no null or NaN, not all zero.

    `rows` holds chunk_id, embedding, model_name, indexed_at; a chunk's latest row decides whether it takes part (ties on
    the time: the greatest model name and vector). An unfit row counts in that choice without its vector.
    """
    fit = fit_vector(width) if model is None else (F.col("model_name") == model) & fit_vector(width)
    row = F.struct("indexed_at", "model_name", F.when(fit, F.col("embedding")).alias("embedding"))
    return rows.where("chunk_id IS NOT NULL").groupBy(F.col("chunk_id").alias("id")).agg(F.max(row).alias("r")).select("id", F.col("r.embedding").alias("embedding")).where("embedding IS NOT NULL")


class Forest:
    """Directions (trees, levels, width) with split points: the median of each node's sample rows as long as it has
    some, below that one median a level for all nodes."""

    def __init__(self, sample: np.ndarray, trees: int, levels: int, seed: int):
        rng = np.random.default_rng(seed)
        self.trees, self.levels = trees, levels
        width = sample.shape[1]
        self.fitted = int(min(levels, np.log2(max(len(sample), NODE_SAMPLE) / NODE_SAMPLE)))
        self.directions = rng.normal(size=(trees, levels, width)).astype(np.float32)
        for t in range(trees):  # directions of up to `width` levels stand at right angles
            n = min(levels, width)
            if n:
                self.directions[t, :n] = np.linalg.qr(self.directions[t, :n].T)[0].T
            self.directions[t] /= np.maximum(np.linalg.norm(self.directions[t], axis=1, keepdims=True), 1e-30)
        self.splits = [np.zeros((trees, 1 << lv), np.float32) for lv in range(self.fitted)]
        self.medians = np.zeros((trees, levels), np.float32)
        for t in range(trees if len(sample) else 0):
            node = np.zeros(len(sample), np.int64)
            shown = sample @ self.directions[t].T
            self.medians[t] = np.median(shown, axis=0)
            for lv in range(self.fitted):
                order = np.lexsort((shown[:, lv], node))
                ends = np.searchsorted(node[order], np.arange(1 << lv), "right")
                begins = np.searchsorted(node[order], np.arange(1 << lv), "left")
                mid = order[np.minimum((begins + ends) // 2, len(order) - 1)]
                self.splits[lv][t] = np.where(ends > begins, shown[mid, lv], self.medians[t, lv])
                node = node * 2 + (shown[:, lv] >= self.splits[lv][t][node])

    def split(self, level: int, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        return self.splits[level][tree, node] if level < self.fitted else self.medians[tree, level]

    def homes(self, shown: np.ndarray) -> np.ndarray:
        """Leaf (rows, trees) of each row, from its projections (rows, trees, levels)."""
        node = np.zeros(shown.shape[:2], np.int64)
        tree = np.broadcast_to(np.arange(self.trees)[None, :], node.shape)
        for lv in range(self.levels):
            node = node * 2 + (shown[:, :, lv] >= self.split(lv, tree, node))
        return node

    def search(self, shown: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(tree, leaf) arrays (rows, <= probes) that the shared queue pops first; tree -1 pads."""
        n = len(shown)
        tree = np.tile(np.arange(self.trees), (n, 1))
        node, cost = np.zeros_like(tree), np.zeros(tree.shape, np.float32)
        row = np.arange(n)[:, None]
        for lv in range(self.levels):
            margin = shown[row, tree, lv] - self.split(lv, tree, node)
            near = node * 2 + (margin >= 0)
            tree, node = np.hstack([tree, tree]), np.hstack([near, near ^ 1])
            cost = np.hstack([cost, cost + margin * margin])
            if tree.shape[1] > probes:
                keep = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
                tree, node, cost = (np.take_along_axis(x, keep, 1) for x in (tree, node, cost))
        return tree, node


def _near(
    vectors: DataFrame, k: int | None, queries: Column | None, min_cosine: float | None, trees: int, probes: int, leaf_rows: int, sample_rows: int | None, seed: int, basis: DataFrame | None, more_probes: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b, cosine) of vector hashes, nodes (key, id, embedding) of the hashes in them); without k all pairs at `min_cosine`."""
    basis = vectors if basis is None else basis
    rows = vectors.select(F.xxhash64("embedding").alias("key"), "id", "embedding", (F.lit(True) if queries is None else queries).alias("ask"))
    n = basis.count()
    sample_rows = sample_rows or int(min(MOST_SAMPLE, max(LEAST_SAMPLE, n // 128)))
    hashed = basis.select("embedding", F.xxhash64("embedding").alias("_h"))
    if n > sample_rows:  # only about as many rows as are wanted reach the driver, whatever the number of tasks
        hashed = hashed.where(F.col("_h") < int(-(2**63) + 2**64 * min(1.0, 1.05 * sample_rows / n)))
    first = hashed.orderBy("_h").limit(sample_rows).select("embedding").toArrow().column(0).combine_chunks()
    sample = first.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(first), -1) if len(first) else np.zeros((0, 1), np.float32)
    sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-30)
    levels = int(max(0, np.ceil(np.log2(max(n, 1) / leaf_rows))))
    probes += more_probes * max(0, levels - SHALLOW_LEVELS)
    forest = Forest(sample, trees, levels, seed)
    low = min(levels, SUBTREE_LEVELS)
    all_ask = queries is None

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values("ask", ascending=False).drop_duplicates("key")  # copies are one node; one that asks stands for them
            for at in range(0, len(pdf), 8192):
                part = pdf.iloc[at : at + 8192]
                x = np.array(part["embedding"].tolist(), np.float32)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                shown = np.stack([x @ d.T for d in forest.directions], 1)
                home = forest.homes(shown)
                code = np.rint(x * (127 / np.abs(x).max(1, keepdims=True))).astype(np.int8)
                coded = code.astype(np.float32)
                off = np.linalg.norm(x - coded / np.linalg.norm(coded, axis=1, keepdims=True), axis=1) + np.float32(1e-6)
                key, n = part["key"].to_numpy(), len(part)
                asks = np.arange(n) if all_ask else np.flatnonzero(part["ask"].to_numpy())
                row = np.repeat(np.arange(n), trees)
                group = (np.arange(trees)[None, :] << 32) + (home >> low)
                mark = [(row, group.ravel(), (home & ((1 << low) - 1)).ravel(), np.zeros(n * trees, np.uint64))]
                if len(asks):
                    tree, leaf = forest.search(shown[asks], probes)
                    width = tree.shape[1]
                    mark.append((np.repeat(asks, width), ((tree << 32) + (leaf >> low)).ravel(), np.full(len(asks) * width, -1), np.uint64(1) << (leaf & ((1 << low) - 1)).ravel().astype(np.uint64)))
                r, g, h, m = (np.concatenate(c) for c in zip(*mark))
                order = np.lexsort((g, r))
                r, g, h, m = r[order], g[order], h[order], m[order]
                first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (g[1:] != g[:-1])])
                mask, spot = np.bitwise_or.reduceat(m, first), np.maximum.reduceat(h, first)
                r, g = r[first], g[first]
                yield pd.DataFrame({"grp": g, "key": key[r], "code": [c.tobytes() for c in code[r]], "off": off[r], "home": spot.astype(np.int16), "mask": mask.view(np.int64)})

    take = None if k is None else k + 4

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = pdf["mask"].to_numpy().view(np.uint64)
        if not all_ask:  # one batch may ask for a vector that others only hold
            order = np.argsort(pdf["key"].to_numpy(), kind="stable")
            pdf, mask = pdf.iloc[order], mask[order]
            first = np.flatnonzero(np.r_[True, np.diff(pdf["key"].to_numpy()) != 0])
            pdf, mask = pdf.iloc[first], np.bitwise_or.reduceat(mask, first)
        else:
            once = ~pdf["key"].duplicated().to_numpy()
            pdf, mask = pdf[once], mask[once]
        x = np.frombuffer(b"".join(pdf["code"]), np.int8).reshape(len(pdf), -1).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        key, home, off = pdf["key"].to_numpy(), pdf["home"].to_numpy(), pdf["off"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for leaf in np.unique(home[home >= 0]):
            data = np.flatnonzero(home == leaf)
            ask = np.flatnonzero((mask >> np.uint64(leaf)) & np.uint64(1))
            for i in range(0, len(ask), 2048):
                q = ask[i : i + 2048]
                for j in range(0, len(data), 4096):
                    c = data[j : j + 4096]
                    s = x[q] @ x[c].T
                    if min_cosine is not None:
                        a, b = np.nonzero(s >= min_cosine - off[q].max() - off[c].max())
                        near_ = s[a, b] >= min_cosine - off[q[a]] - off[c[b]]
                        a, b = a[near_], b[near_]
                    elif len(c) > take:
                        b = np.argpartition(-s, take - 1, axis=1)[:, :take].ravel()
                        a = np.repeat(np.arange(len(q)), take)
                    else:
                        a, b = np.repeat(np.arange(len(q)), len(c)), np.tile(np.arange(len(c)), len(q))
                    out.append((key[q[a]], key[c[b]], s[a, b]))
        a, b, s = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        ok = a != b
        got = pd.DataFrame({"a": a[ok], "b": b[ok], "s": s[ok]})
        if len(got) and take is not None:
            got = got.sort_values(["a", "s", "b"], ascending=[True, False, True]).groupby("a").head(take)
        return got

    spread_rows = rows.select("key", "embedding", "ask").mapInPandas(spread, "grp long, key long, code binary, off float, home short, mask long")
    near = spread_rows.groupBy("grp").applyInPandas(score, "a long, b long, s float").groupBy("a", "b").agg(F.max("s").alias("s"))
    if take is not None:
        best = Window.partitionBy("a").orderBy(F.desc("s"), "b")
        near = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= take)
    near = stored(near.select("a", "b"))
    wanted = near.select(F.col("a").alias("key")).unionByName(near.select(F.col("b").alias("key"))).distinct()
    nodes = rows.select("key", "id", "embedding").join(wanted, "key", "left_semi").groupBy("key").agg(F.min("id").alias("id"), F.first("embedding").alias("embedding"))
    left = nodes.select(F.col("key").alias("a"), F.col("embedding").alias("_ea"))
    right = nodes.select(F.col("key").alias("b"), F.col("embedding").alias("_eb"))
    exact = near.join(left, "a").join(right, "b").select("a", "b", cosine("_ea", "_eb").alias("cosine"))
    if min_cosine is not None:
        exact = exact.where(F.col("cosine") >= min_cosine)
    return exact, nodes


def knn(
    vectors: DataFrame, k: int, queries: Column | None = None, min_cosine: float | None = None, trees: int = 3, probes: int = 24,
    leaf_rows: int = 256, sample_rows: int | None = None, seed: int = 7, basis: DataFrame | None = None, more_probes: int = 0,
) -> DataFrame:
    """(id, neighbour, cosine, rank): for each distinct vector that `queries` selects, its k nearest among all.

    `vectors` is (id string, embedding array<float>) without unfit vectors (see clean_vectors). Rows with the very same
    vector are one node, named by its smallest id; it asks if one of them does. `min_cosine` drops weaker neighbours
    early. Ties rank by neighbour id. An empty table gives an empty result. The split planes are fitted on the
    vectors of smallest hash in `basis` (default: `vectors`; raw rows spare a shuffle): `sample_rows` of them, by
    default one row in 128 but at least 32,768 and at most 262,144 (64 MB at 64 floats), a fixed bound. Every row is
    indexed, and the depth follows the number of rows; levels deeper than the sample reaches split at one median.
    """
    pairs, nodes = _near(vectors, k, queries, min_cosine, trees, probes, leaf_rows, sample_rows, seed, basis, more_probes)
    names = nodes.select("key", "id")
    out = pairs.join(names.withColumnRenamed("key", "a"), "a").join(names.select(F.col("key").alias("b"), F.col("id").alias("neighbour")), "b")
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return out.select("id", "neighbour", "cosine").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_classes(
    vectors: DataFrame, min_cosine: float, trees: int = 3, probes: int = 24, leaf_rows: int = 256, sample_rows: int | None = None, seed: int = 7, basis: DataFrame | None = None, more_probes: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), a < b, of class ids; members (id, class_id)): pairs of classes at `min_cosine` or more, found through the leaves that every distinct vector probes.

    A class holds the ids with the very same vector and is named by the smallest; copies are not expanded into pairs. No
    vector's partners are cut at a number. Each level of depth below SHALLOW_LEVELS adds `more_probes`, since a pair
    is parted more often in a deeper tree.
    """
    pairs, _ = _near(vectors, None, None, min_cosine, trees, probes, leaf_rows, sample_rows, seed, basis, more_probes)
    keyed = vectors.select(F.xxhash64("embedding").alias("key"), "id")
    names = keyed.groupBy("key").agg(F.min("id").alias("class_id"))
    members = keyed.join(names, "key").select("id", "class_id")
    named = pairs.select("a", "b").join(names.select(F.col("key").alias("a"), F.col("class_id").alias("_x")), "a").join(names.select(F.col("key").alias("b"), F.col("class_id").alias("_y")), "b")
    return named.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct(), members


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of ids behind similar_classes, those within a class included; grows with the square of a class's copies."""
    mine = lambda c: members.select(F.col("class_id").alias(c), F.col("id").alias("_" + c))
    across = links.join(mine("a"), "a").join(mine("b"), "b").select("_a", "_b")
    same = members.where("id <> class_id").select("class_id").distinct()
    copies = members.join(same, "class_id", "left_semi")
    within = copies.select("class_id", F.col("id").alias("_a")).join(copies.select("class_id", F.col("id").alias("_b")), "class_id").where("_a < _b").select("_a", "_b")
    both = across.unionByName(within)
    return both.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))


def class_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, copies, n_links): one row for each id that has a copy or a similar class; n_links counts the similar ids of other classes."""
    sizes = members.groupBy("class_id").agg(F.count("*").alias("copies"))
    ends = links.select(F.col("a").alias("class_id"), F.col("b").alias("_o")).unionByName(links.select(F.col("b").alias("class_id"), F.col("a").alias("_o")))
    n = ends.join(sizes.select(F.col("class_id").alias("_o"), F.col("copies").alias("_n")), "_o").groupBy("class_id").agg(F.sum("_n").alias("n_links"))
    per = sizes.join(n, "class_id", "left").where("copies > 1 OR n_links IS NOT NULL")
    return members.join(per, "class_id").select("id", "class_id", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
