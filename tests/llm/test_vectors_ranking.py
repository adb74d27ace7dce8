import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import queries
from fathomline.llm.rank_fusion import borda
from fathomline.llm.similar_vectors import class_links, clean_vectors, expand_pairs, knn, similar_classes
from tests.compare import DATA

V = "id string, embedding array<float>"


def similar_pairs(df, least, **how):
    return expand_pairs(*similar_classes(df, least, **how))


def clustered(n, seed=3, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 40 + 1, width))
    x = centres[rng.integers(len(centres), size=n)] + 0.5 * rng.normal(size=(n, width))
    for i in range(0, n - 1, 9):
        x[i + 1] = x[i] + 0.05 * rng.normal(size=width)
    return x.astype(np.float32)


def test_recall_and_pairs_against_brute_force(spark):
    x = clustered(1500)
    df = spark.createDataFrame([(f"v{i:05}", [float(y) for y in r]) for i, r in enumerate(x)], V)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    got = knn(df, 5, trees=4, probes=40, leaf_rows=64).toPandas()
    hit = sum((g.cosine >= np.sort(s[int(i[1:])])[-5] - 1e-9).sum() for i, g in got.groupby("id"))
    assert hit / (5 * len(x)) >= 0.9
    a, b = np.where(np.triu(s, 1) >= 0.99)
    want = {(f"v{i:05}", f"v{j:05}") for i, j in zip(a, b)}
    found = {(r.a, r.b) for r in similar_pairs(df, 0.99, trees=3, probes=24, leaf_rows=64).collect()}
    assert found <= want and len(found) >= 0.98 * len(want)


def test_copies_queries_ties_and_empty(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [2.0, 0.0]), ("d", [0.0, 1.0]), ("e", [1.0, 0.01])]
    df = spark.createDataFrame(rows, V)
    assert {(r.a, r.b) for r in similar_pairs(df, 0.95).collect()} == {(x, y) for x in "abce" for y in "abce" if x < y}
    near = knn(df, 2, queries=F.col("id") == "b").collect()
    assert {r.id for r in near} == {"a"} and [r.neighbour for r in sorted(near, key=lambda r: r["rank"])] == ["c", "e"]
    assert knn(df.where("false"), 3).count() == 0 and similar_pairs(df.where("false"), 0.9).count() == 0


def test_classes_count_links(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [2.0, 0.0]), ("d", [0.0, 1.0]), ("e", [1.0, 0.01]), ("f", [0.0, 1.0])]
    got = {r.id: (r.class_id, r.copies, r.n_links) for r in class_links(*similar_classes(spark.createDataFrame(rows, V), 0.95)).collect()}
    assert got == {"a": ("a", 2, 2), "b": ("a", 2, 2), "c": ("c", 1, 3), "e": ("e", 1, 3), "d": ("d", 2, 0), "f": ("d", 2, 0)}


@pytest.mark.parametrize("width", [3, 200])
def test_coded_scores_lose_no_pair(spark, width):
    """One leaf holds all rows, so the allowance of the codes alone decides what is lost: nothing, at any width."""
    rng = np.random.default_rng(width)
    x = (rng.normal(size=width) * np.exp(rng.normal(size=width)) + 0.3 * rng.normal(size=(250, width))).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.triu(unit @ unit.T, 1)
    least = float(np.quantile(s[s > 0], 0.7))
    want = {(f"v{i:03}", f"v{j:03}") for i, j in zip(*np.where(s >= least + 1e-9))}
    got = {(r.a, r.b) for r in similar_pairs(spark.createDataFrame([(f"v{i:03}", [float(y) for y in r]) for i, r in enumerate(x)], V), least).collect()}
    assert want <= got and len(got) <= len(want) + 1


def test_masks_of_batches_are_joined(spark):
    """The 64th leaf of a subtree is the sign bit of its mask: a vector whose copies ask and do not ask in different batches keeps its probes."""
    x = clustered(2000, width=8)
    rows = [(f"v{i:05}", [float(y) for y in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows + [("w" + i[1:], r) for i, r in rows], V).repartition(13)
    got = knn(df, 3, queries=F.col("id").startswith("w") & (F.crc32("id") % 3 == 0), trees=2, probes=64, leaf_rows=32).toPandas()
    asked = {tuple(r[1]) for r in df.where(F.col("id").startswith("w") & (F.crc32("id") % 3 == 0)).collect()}
    assert got.id.nunique() == len(asked) and (got.groupby("id").size() == 3).all()


def test_a_third_of_all_rows_alike(spark):
    x = clustered(600)
    df = spark.createDataFrame([(f"v{i:05}", [float(y) for y in (x[0] if i % 3 == 0 else x[i])]) for i in range(len(x))], V)
    got = knn(df, 3, leaf_rows=32).toPandas()
    assert got.id.nunique() == 401 and (got["rank"] <= 3).all()


def test_all_pairs_of_a_dense_cluster(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=16) + 0.01 * rng.normal(size=(60, 16))).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:02}", [float(y) for y in r]) for i, r in enumerate(x)], V)
    got = {(r.a, r.b) for r in similar_pairs(df, 0.95).collect()}
    assert got == {(f"v{i:02}", f"v{j:02}") for j in range(60) for i in range(j)}


def test_more_probes_follow_the_depth(spark):
    x = clustered(3000)
    df = spark.createDataFrame([(f"v{i:05}", [float(y) for y in r]) for i, r in enumerate(x)], V)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {(f"v{i:05}", f"v{j:05}") for i, j in zip(*np.where(np.triu(unit @ unit.T, 1) >= 0.99))}
    few, more = ({(r.a, r.b) for r in similar_pairs(df, 0.99, trees=2, probes=1, leaf_rows=2, more_probes=m).collect()} for m in (0, 16))
    assert few < more <= want and len(more) >= 0.98 * len(want)


def test_pairs_query_widens_its_search_with_the_depth(spark, monkeypatch):
    seen = {}
    empty = spark.createDataFrame([], "a string, b string"), spark.createDataFrame([], "id string, class_id string")
    monkeypatch.setattr(queries.similar_vectors, "similar_classes", lambda v, c, **how: seen.update(how) or empty)
    queries.p1_found(spark, DATA)
    assert seen["probes"] >= 16 and seen["more_probes"] > 0


def test_only_current_and_sound_vectors(spark):
    t = [dt.datetime(2024, 1, i) for i in (1, 2)]
    rows = [("a", [1.0, 2.0], "m", t[0]), ("a", [3.0, 4.0], "m", t[1]), ("a", [3.0, 4.0], "m", t[1]), ("b", [1.0, 1.0], "m", t[0]), ("b", [1.0, 1.0, 1.0], "other", t[1]), ("n", None, "m", t[0]), ("z", [0.0, 0.0], "m", t[0]), ("x", [float("nan"), 1.0], "m", t[0]), ("y", [None, 1.0], "m", t[0]), (None, [1.0, 1.0], "m", t[0]), ("i", [float("inf"), 1.0], "m", t[0])]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, model_name string, indexed_at timestamp").withColumn("id", F.lit("clash"))
    assert [(r.id, r.embedding) for r in clean_vectors(df, "m", 2).collect()] == [("a", [3.0, 4.0])]


def brute(rows, names):
    out = {}
    for q in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == q]
        points = dict.fromkeys((r[1] for r in mine), 0.0)
        for k, _ in enumerate(names):
            have = [(r[1], r[2 + k]) for r in mine if r[2 + k] is not None and not math.isnan(r[2 + k])]
            for i in points:
                v = dict(have).get(i)
                if v is None:
                    points[i] += len(mine) / 2
                else:
                    above, ties = sum(x > v for _, x in have), sum(x == v for _, x in have)
                    points[i] += len(mine) * (1 - (above + ties / 2) / len(have))
        for n, (i, p) in enumerate(sorted(points.items(), key=lambda x: (-round(x[1], 9), x[0]))):
            out[q, i] = (n + 1, round(p, 6))
    return out


@pytest.mark.parametrize("hot", [50_000, 4])
def test_borda_against_brute_force(spark, hot):
    rng = np.random.default_rng(5)
    val = lambda scale: None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else float(np.round(rng.random() * scale))
    rows = [(q, f"i{i:03}", val(10), val(1000)) for q, n in ((1, 120), (2, 3), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "q int, item string, a double, b double").withColumn("position", F.lit("clash"))
    got = {(r.q, r.item): (r.position, round(r.points, 6)) for r in borda(df, "q", "item", ["a", "b"], hot_rows=hot).collect()}
    assert got == brute(rows, ["a", "b"])


def test_borda_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "y", float("nan")), (None, "z", 1.0), (1, None, 2.0)], "q int, item string, a double")
    assert [(r.item, r.position, r.place_a) for r in borda(df, "q", "item", ["a"]).orderBy("position").collect()] == [("x", 1, None), ("y", 2, None)]
    assert borda(df.where("false"), "q", "item", ["a"]).count() == 0
