import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fathomline.functions.current import current_rows
from fathomline.operators import graph, ignore, search, snapshots, stats
from fathomline.plans import retrieval, structure

E = "source_chunk_id string, target_chunk_id string, edge_type string"
S = "chunk_id string, name string, symbol_type string, file_path string, start_line int, end_line int, parent_name string, metadata_json string"


def test_current_rows_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "n"), (None, 5, "q"), ("a", 2, "z")], "id string, t int, v string")
    assert {(r.id, r.t, r.v) for r in current_rows(df, ["id"], "t").collect()} == {("a", 2, "z"), ("b", None, "n")}


def test_vector_search_filter_before_limit(spark):
    v = spark.createDataFrame([(f"c{i}", [1.0, float(i), 0.0], i % 7 == 0) for i in range(35)] + [("zero", [0.0] * 3, True), ("wide", [1.0] * 4, True), ("null", None, True)], "chunk_id string, embedding array<float>, keep boolean")
    q = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    assert [r.chunk_id for r in search.vector_topk(v, q, 3, F.col("keep")).collect()] == ["c0", "c7", "c14"]
    sound = v.where("chunk_id NOT IN ('zero', 'wide', 'null')")
    near = search.similar_to_many(sound.select("chunk_id", "embedding"), sound.where("chunk_id = 'c3'"), 2).collect()
    assert [r.chunk_id for r in near] == ["c4", "c5"] and all(r.seed_id == "c3" for r in near)


def test_similar_to_many_against_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    x = rnd.integers(-2, 3, size=(500, 6)).astype(float)  # many ties and copies
    x[~x.any(1), 0] = 1
    ids = [f"c{i:03}" for i in range(len(x))]
    df = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in zip(ids, x)], "chunk_id string, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(np.maximum(u @ u.T, 0), 6)
    monkeypatch.setattr(retrieval, "vectors", lambda *_: df)
    for got, want in ((search.similar_to_many(df, df, 5, cell=120), range(500)), (retrieval.similar_to(spark, ""), [i for i in range(500) if int(hashlib.md5(ids[i].encode()).hexdigest()[:6], 16) % 50 == 0])):
        near = {(r.seed_id, r["rank"]): (r.chunk_id, round(r.similarity, 6)) for r in got.collect()}
        assert len(want) > 5 and near == {(ids[i], n + 1): (ids[j], float(s[i, j])) for i in want for n, j in enumerate(sorted((j for j in range(500) if j != i), key=lambda j: (-s[i, j], j))[:5])}


def test_bm25_rrf_cap_and_dedup(spark):
    c = spark.createDataFrame([("1", "get user by id"), ("2", "user user table"), ("3", "nothing here"), ("4", None), ("5", "")], "chunk_id string, content_preview string")
    q = spark.createDataFrame([(1, "getUserById"), (2, "absent"), (3, "")], "query_id int, query string")
    got = search.bm25_topk(search.postings(c), search.corpus_stats(c), q, 5).collect()
    assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"])] == ["1", "2"]
    fused = search.rrf([spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "q int, chunk_id string, rank int"), spark.createDataFrame([(1, "b", 1)], "q int, chunk_id string, rank int")], ["q"], 5).collect()
    assert [(r.chunk_id, r.score) for r in fused] == [("b", round(1 / 62 + 1 / 61, 9)), ("a", round(1 / 61, 9))]
    h = spark.createDataFrame([(1, f"c{i}", "f" if i < 4 else "g", 1.0 - i / 10) for i in range(6)], "q int, chunk_id string, path string, s double")
    order = [r.chunk_id for r in search.per_file_cap(h, ["q"], "path", "s", 2).orderBy("position").collect()]
    assert order == ["c0", "c1", "c4", "c5", "c2", "c3"]
    assert search.dedup_best(h.unionByName(h), ["q"], [F.desc("s")]).count() == 6


def _keyword_tables(spark, n_chunks, n_queries, seed):
    """Chunks of few lengths and skewed words, so many scores tie; queries of one to six words, some unknown."""
    rnd = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in np.minimum(rnd.zipf(1.4, n), 60)]
    c = [(f"c{i:05}", " ".join(["all", *word(rnd.integers(0, 8))])) for i in rnd.permutation(n_chunks)]
    q = [(i, " ".join(word(rnd.integers(1, 7))) + (" all" if i % 3 else " none")) for i in range(n_queries)] + [(n_queries, "all"), (n_queries + 1, "none"), (n_queries + 2, "")]
    return c, q, spark.createDataFrame(c, "chunk_id string, content_preview string"), spark.createDataFrame(q, "query_id long, query string")


def _bm25_by_hand(c, q, k):
    texts = {i: Counter(t.split()) for i, t in c}
    mean, df = sum(x.total() for x in texts.values()) / len(texts), Counter(w for x in texts.values() for w in x)
    out = {}
    for i, t in q:
        scores = {}
        for name, x in texts.items():
            if held := [w for w in sorted(set(t.split())) if w in x]:
                scores[name] = round(sum(math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * x[w] * 2.2 / (x[w] + 1.2 * (0.25 + 0.75 * x.total() / mean)) for w in held), 6)
        out |= {(i, r + 1): (n, scores[n]) for r, n in enumerate(sorted(scores, key=lambda n: (-scores[n], n))[:k])}
    return out


def test_bm25_cells_against_brute_force(spark):
    c, q, chunks, queries = _keyword_tables(spark, 400, 60, 3)
    for k, cell in ((5, (500, 500, 1)), (5, (70, 13, 1)), (3, (9, 40, 8)), (500, (150, 25, 1))):
        got = search.bm25_topk(search.postings(chunks), search.corpus_stats(chunks), queries, k, cell).collect()
        assert {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in got} == _bm25_by_hand(c, q, k), (k, cell)


def test_bm25_keeps_chunks_of_words_that_say_little(spark):
    """Of a word that all chunks hold the weight is nearly 0."""
    far = 400_000
    corpus = spark.sql(f"SELECT 2.0D AS mean_length, {far}L AS total")
    index = spark.createDataFrame([("all", f"c{i}", 2, 1) for i in range(3)] + [("both", f"c{i}", 2, 1) for i in range(3)], "term string, chunk_id string, length int, tf long")
    index = index.unionByName(spark.range(far - 3).selectExpr("explode(array('all', 'both')) AS term", "concat('d', id) AS chunk_id", "2 AS length", "1L AS tf"))
    got = search.bm25_topk(index, corpus, spark.createDataFrame([(1, "all both")], "query_id int, query string"), 4).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c0", "c1", "c2", "d0"]


def test_bm25_makes_no_row_of_each_query_and_chunk(spark):
    def written():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    c, q, chunks, queries = _keyword_tables(spark, 3000, 300, 5)
    before = written()
    assert search.bm25_topk(search.postings(chunks), search.corpus_stats(chunks), queries, 5).count() > 1500
    pairs = sum(bool(a & b) for a in (set(t.split()) for _, t in q) for b in (set(t.split()) for _, t in c))
    assert pairs > 500_000 and written() - before < pairs / 10


def test_min_score_precedes_topk(spark):
    h = spark.createDataFrame([(1, f"c{i}", i / 10, 1 - i / 10) for i in range(10)] + [(1, "n", 0.9, None), (1, "x", 0.9, float("nan"))], "q int, chunk_id string, similarity_score double, r double")
    assert [x.chunk_id for x in search.rerank(h, ["q"], "r", 50, 3, 0.85).orderBy("rank").collect()] == ["c0", "c1"]


def test_graph_building(spark):
    s = spark.createDataFrame(
        [("c1", "Base", "class", "a.py", 1, 9, None, None), ("m1", "run", "method", "a.py", 2, 3, "Base", '{"calls": ["go", "many"]}'), ("k2", "Kid", "class", "b.py", 1, 5, "Base", None), ("g", "go", "function", "b.py", 7, 8, "", None), ("c1b", "Base", "class", "a.py", 20, 29, None, "{bad")]
        + [(f"n{i}", "many", "function", f"f{i}.py", 1, 2, None, None) for i in range(9)], S)
    assert {(r[0], r[1]) for r in graph.contains_edges(s).collect()} == {("c1b", "m1")}
    assert {(r[0], r[1]) for r in graph.inherits_edges(s).collect()} == {("k2", "c1"), ("k2", "c1b")}
    assert {(r[0], r[1]) for r in graph.call_edges(s).collect()} == {("m1", "g")}  # nine symbols are called many: too many to tell


def test_subgraph_keeps_containment_first(spark):
    e = spark.createDataFrame([("a", f"x{i}", "calls") for i in range(5)] + [("a", "p", "contains"), ("p", "q", "contains"), ("a", "a", "calls")], E)
    seed = spark.createDataFrame([("a",)], "chunk_id string")
    assert graph.subgraph(e, seed, 1, 2).orderBy("position").first()["edge_type"] == "contains"
    assert {(r.source_chunk_id, r.target_chunk_id) for r in graph.subgraph(e, seed, 0).collect()} == {("a", "a")}
    assert {r.chunk_id: r.hop for r in graph.reach(e, seed, 2).collect()}["q"] == 2
    both = graph.edges_of(e, seed).where("source_chunk_id = target_chunk_id")
    assert sorted(r.direction for r in both.collect()) == ["incoming", "outgoing"] and graph.edges_of(e, seed, "outgoing", "contains").count() == 1


def test_every_omitted_edge_counts(spark, monkeypatch):
    e = spark.createDataFrame([("hub", f"x{i:03}", "calls") for i in range(450)] + [(f"x{i:03}", "hub", "inherits") for i in range(30)], E)
    monkeypatch.setattr(structure, "_edges", lambda s, d: e)
    monkeypatch.setattr(structure, "_seeds", lambda s, d: s.createDataFrame([("hub",)], "chunk_id string"))
    assert {(r.edge_type, r.n_omitted) for r in structure.subgraph_omitted(spark, "").collect()} == {("calls", 450), ("inherits", 27)}
    seed = structure._seeds(spark, "")
    assert {(r.edge_type, r.n_omitted) for r in graph.omitted_by_type(e, seed, 1, 50).collect()} == {("calls", 430)}
    assert graph.subgraph(e, seed, 1, 999).count() == graph.MAX_EDGES


def test_upsert_and_delete(spark):
    s = spark.createDataFrame([("1", "a", "f"), ("2", "b", "g")], "chunk_id string, name string, file_path string")
    assert {(r[0], r[1]) for r in graph.upsert_symbols(s, spark.createDataFrame([("2", "B", "g"), ("3", "c", "g")], s.schema)).collect()} == {("1", "a"), ("2", "B"), ("3", "c")}
    left, edges = graph.delete_files(s, spark.createDataFrame([("1", "2", "calls"), ("1", "1", "calls")], E), spark.createDataFrame([("g",), ("gone",)], "file_path string"))
    assert [r.chunk_id for r in left.collect()] == ["1"] and edges.count() == 1


def test_snapshots(spark):
    f = lambda rows: snapshots.file_hashes(spark.createDataFrame(rows, "relative_path string, content string"))
    old, new = f([("a/x.py", "1"), ("a/y.py", "2"), ("z", "3")]), f([("a/x.py", "1"), ("a/w.py", "2"), ("z", "4"), ("n", None)])
    assert {(r.path, r.change) for r in snapshots.diff(old, new).collect()} == {("a/x.py", "unchanged"), ("a/y.py", "removed"), ("a/w.py", "added"), ("z", "modified"), ("n", "added")}
    roots = [{r.path: r.hash for r in snapshots.directory_hashes(x).collect()} for x in (old, new)]
    assert roots[0]["a"] == roots[1]["a"] and roots[0][""] != roots[1][""]  # renaming in place leaves the folder's hash
    assert snapshots.directory_hashes(f([])).count() == 0
    deep = snapshots.directory_hashes(f([("/".join("d" * 70) + "/x", "1")])).collect()
    assert len(deep) == 71 and {r.n_files for r in deep} == {1}


def test_ignore_rules(spark):
    p = spark.createDataFrame([(x,) for x in ("node_modules/a.js", "src/a.log", "src/keep.log", "src/b.py", "src/sub/gen/c.py", "docs/x.md", "a.pyc", "src\\build\\z.py")], "relative_path string")
    got = {r.relative_path: r.ignored_by for r in ignore.verdicts(p, root=["*.log", "!keep.log", "/docs/"], nested={"src": ["gen/"]}).collect()}
    assert got == {"node_modules/a.js": "always", "src/a.log": "gitignore", "src/keep.log": None, "src/b.py": None, "src/sub/gen/c.py": "nested", "docs/x.md": "gitignore", "a.pyc": "always", "src\\build\\z.py": "always"}


def test_runtime_patterns_come_first(spark):
    p = spark.createDataFrame([(x,) for x in ("a/snap/x.py", "a/b.tmp", "snap", "asnap/x", "node_modules/b.tmp")], "relative_path string")
    got = {r.relative_path: r.ignored_by for r in ignore.verdicts(p, dynamic=["snap", "*.tmp"]).collect()}
    assert got == {"a/snap/x.py": "runtime", "a/b.tmp": "runtime", "snap": "runtime", "asnap/x": None, "node_modules/b.tmp": "runtime"}


def test_context_and_call_counts(spark):
    near = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("a", "z", 3), ("b", "x", 1)], "seed_id string, chunk_id string, rank int")
    got = search.with_context(spark.createDataFrame([("a",), ("c",)], "chunk_id string"), near).collect()
    assert {r.chunk_id: r.context for r in got} == {"a": ["y", "x"], "c": []}
    s = spark.createDataFrame([(x,) for x in "abc"], "chunk_id string")
    e = spark.createDataFrame([("a", "b", "calls"), ("a", "b", "calls"), ("c", "b", "calls"), ("a", "gone", "calls"), ("a", "c", "contains")], E)
    assert {(r.chunk_id, r.n_callers, r.n_callees) for r in graph.call_counts(e, s).collect()} == {("a", 0, 1), ("b", 2, 0), ("c", 0, 1)}


def test_stats(spark):
    c = spark.createDataFrame([("1", "a", "class", "p", ["x", "test"]), ("2", "a", "function", "p", None), ("3", "b", "test_case", "p", [])], "chunk_id string, relative_path string, chunk_type string, project_name string, tags array<string>")
    assert stats.summary(c).first()["files_indexed"] == 2
    assert [r[0] for r in stats.suggestions(c, "TEST").collect()] == ["Find test related code", "Show all test_cases"]
