import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.api import CodeIndex
from fathomline.operators.store import IndexStore
from fathomline.functions.embedding import embedding_text
from fathomline.functions.models import Model, overlap_scorer, resolve, score_pairs, with_prefix
from fathomline.operators.indexing import IndexConfig, index_files
from fathomline.sources.chunking import chunk_files, chunk_text, markdown_sections
from fathomline.sources.files import walk
from fathomline.streaming.refresh import SCHEMA, refresh_stream

SAMPLES = {
    "a.py": ("@d\nclass A:\n    def m(self):\n        return f(1)\n\ndef g(): pass\n", [("class", "A", 1, 4), ("method", "m", 3, 4), ("function", "g", 6, 6)]),
    "a.ts": ("import x from 'y';\nexport interface I { a: string }\nclass A {\n  m(x: number): void {\n    if (x) { f('}') }\n  }\n}\nconst h = async (a) => {\n  return a;\n};\n", [("interface", "I", 2, 2), ("class", "A", 3, 7), ("method", "m", 4, 6), ("function", "h", 8, 10)]),
    "a.go": ("package p\n\ntype T struct {\n\tA int\n}\n\nfunc (t *T) M() error {\n\treturn nil\n}\n\nfunc F() {}\n", [("type", "T", 3, 5), ("method", "M", 7, 9), ("function", "F", 11, 11)]),
    "a.java": ("package p;\npublic class A {\n    @Override\n    public int f(int x) throws E {\n        return x;\n    }\n}\n", [("class", "A", 2, 7), ("method", "f", 3, 6)]),
    "a.rs": ("pub struct S { a: i32 }\nimpl S {\n    pub fn f(&self) -> i32 { 1 }\n}\nfn g() {}\n", [("struct", "S", 1, 1), ("impl", "S", 2, 4), ("method", "f", 3, 3), ("function", "g", 5, 5)]),
    "a.c": ("#include <x.h>\nint f(int a) {\n  return a;\n}\nstruct s {\n  int x;\n};\n", [("function", "f", 2, 4), ("struct", "s", 5, 7)]),
    "a.cs": ("namespace N {\n  public class C {\n    public int F(int a) { return a; }\n  }\n}\n", [("namespace", "N", 1, 5), ("class", "C", 2, 4), ("method", "F", 3, 3)]),
    "a.kt": ("class K {\n  suspend fun f(): Int {\n    return 1\n  }\n}\n", [("class", "K", 1, 5), ("method", "f", 2, 4)]),
    "a.php": ("<?php\nclass P {\n  public function f($a) {\n    return $a;\n  }\n}\n", [("class", "P", 2, 6), ("method", "f", 3, 5)]),
    "a.swift": ("class S {\n  func f() {\n    print(1)\n  }\n}\n", [("class", "S", 1, 5), ("method", "f", 2, 4)]),
    "a.rb": ("class R\n  def f(a)\n    if a\n      1\n    end\n  end\nend\n", [("class", "R", 1, 7), ("method", "f", 2, 6)]),
    "a.lua": ("local function f(a)\n  if a then\n    return 1\n  end\nend\n", [("function", "f", 1, 5)]),
    "a.sql": ("CREATE TABLE t (\n  a int\n);\ncreate view v as select 1;\n", [("table", "t", 1, 3), ("view", "v", 4, 4)]),
    "a.sh": ("f() {\n  echo 1\n}\n", [("function", "f", 1, 3)]),
    "a.css": (".a {\n  x: y;\n}\n", [("style_rule", ".a", 1, 3)]),
    "a.tf": ('resource "x" "y" {\n  a = 1\n}\n', [("block", "resource x y", 1, 3)]),
    "a.hs": ("module M where\nf :: Int -> Int\nf x = x\n\ndata D = A | B\n", [("function", "f", 2, 3), ("data", "D", 5, 5)]),
    "a.html": ("<html><head>\n<script>\nif (a < b) {}\n</script></head>\n<body><b>x\n</html>\n", [("element", "<head>", 1, 4), ("element", "<script>", 2, 4), ("element", "<body>", 5, 6)]),
    "a.md": ("intro\n# One\ntext\n```\n# no\n```\n## Two\n", [("section", "Preamble", 1, 1), ("section", "One", 2, 6), ("section", "Two", 7, 8)]),
    "a.toml": ("x = 1\n[t]\ny = [1]\n[u.v]\nw = 2\n", [("config_entry", "x", 1, 3), ("config_section", "t", 2, 6), ("config_section", "t.y", 3, 6), ("config_section", "u", 4, 6), ("config_section", "u.v", 4, 6)]),
    "a.yaml": ("- 1\n- a: 2\n- [3]\n", [("config_item", "[0]", 1, 4), ("config_list", "[1]", 1, 3), ("config_list", "[2]", 1, 3)]),
    "b.yaml": ("a:\n  b:\n    - c: 1\n---\n---\nd: 2\n", [("config_section", "document_1.a", 1, 4), ("config_section", "document_1.a.b", 2, 4), ("config_list", "document_1.a.b[0]", 2, 4), ("config_entry", "document_2.d", 6, 7)]),
    "b.ts": ("export type A = string;\ntype B<T> = {\n  x: T }\nconst f = (a: number): number => a + 1;\nconst g = x =>\n  x;\nlet n = 3;\n", [("type", "A", 1, 1), ("type", "B", 2, 3), ("function", "f", 4, 4), ("function", "g", 5, 6)]),
    "b.go": ("package p\n\ntype X int\ntype F func(a int) error\ntype Y = map[string]int\n\nvar z = 3\n", [("type", "X", 3, 3), ("type", "F", 4, 4), ("type", "Y", 5, 5)]),
    "b.java": ("interface I {\n    /** x */\n    int k(int a) throws E;\n    String NAME = f(1);\n}\n@interface Q { }\nrecord R(int a) { }\n", [("interface", "I", 1, 5), ("method", "k", 3, 3), ("annotation", "Q", 6, 6), ("record", "R", 7, 7)]),
    "b.rs": ("struct S;\npub struct T(i32);\nmod m;\nuse a::b;\n", [("struct", "S", 1, 1), ("struct", "T", 2, 2), ("module", "m", 3, 3)]),
    "b.kt": ("data class P(val x: Int)\nobject O {\n  val y = 1\n}\nfun String.f(): Int = 1\n", [("class", "P", 1, 1), ("object", "O", 2, 4), ("property", "y", 3, 3), ("function", "f", 5, 5)]),
    "b.scala": ("case class P(x: Int)\nobject O {\n  def f(a: Int) = a\n  type T = Int\n}\n", [("class", "P", 1, 1), ("object", "O", 2, 5), ("method", "f", 3, 3), ("type", "T", 4, 4)]),
    "b.css": ('@charset "utf-8";\n@import url(x.css);\n@media print {\n  a { b: c }\n}\n', [("charset", '@charset "utf-8"', 1, 1), ("import", "@import url(x.css)", 2, 2), ("media_query", "@media print", 3, 5), ("style_rule", "a", 4, 4)]),
    "b.php": ("<?php\ninterface I {\n  public function f($a): int;\n}\n", [("interface", "I", 2, 4), ("method", "f", 3, 3)]),
    "a.jsx": ("function A(p) {\n  return <div a={p > 1}>\n    <b/>\n  </div>;\n}\nconst x = a < b;\nrender(<A\n  z='1'/>);\n", [("function", "A", 1, 5), ("jsx_self_closing_element", "A", 7, 8)]),
    "a.svelte": ("<script>\n  function f(a) {\n    return a;\n  }\n</script>\n<p>x</p>\n<style>\np { a: b }\n</style>\n", [("script", "<script>", 1, 5), ("function", "f", 2, 4), ("style", "<style>", 7, 9)]),
    "b.py": ("x = 1\n", [("module", None, 1, 2)]),
}


@pytest.mark.parametrize("path", SAMPLES)
def test_chunks_per_language(path):
    text, want = SAMPLES[path]
    assert [(r["chunk_type"], r["name"], r["start_line"], r["end_line"]) for r in chunk_text(text, path)] == want


def test_tags_follow_the_head(spark):
    rows = [("a.py", "async def f():\n    pass\n"), ("b.py", "def f():\n    async def g(): pass\n"), ("a.ts", "export class A<T> {\n  x(): void { g() }\n}\n"), ("a.js", "export async function f() {}\nfunction* g() {}\n"), ("a.kt", "suspend fun String.f(): Int {\n  return 1\n}\n"), ("a.swift", "extension S {\n  func f() {}\n}\n"), ("a.tsx", "const A = () => { return <b/>; };\n"), ("a.json", '{"a": {"b": 1}, "c": 2}'), ("b.json", "{"), ("a.md", "x\n")]
    df = spark.createDataFrame(rows, "relative_path string, content string")
    got = {(r.relative_path, r.name): r.tags for r in chunk_files(df).collect()}
    assert got == {
        ("a.py", "f"): ["async", "python"], ("b.py", "f"): ["python"], ("a.ts", "A"): ["export", "generic", "typescript"], ("a.ts", "x"): ["typescript"], ("a.js", "f"): ["async", "export", "javascript"], ("a.js", "g"): ["generator", "javascript"],
        ("a.kt", "f"): ["async", "extension", "kotlin"], ("a.swift", "S"): ["extension", "swift"], ("a.swift", "f"): ["swift"], ("a.tsx", "A"): ["component", "tsx"], ("a.json", "a"): ["json", "config", "mapping", "top_level"], ("a.json", "c"): ["json", "config", "entry", "top_level"], ("b.json", None): ["json", "config", "raw"], ("a.md", None): ["markdown"],
    }


def python_embedding_text(content, kind, parent, doc, limit):
    """The rule of embedding_text, counted out line by line."""
    owner = f"# In {parent}:" if parent and kind in ("method", "constructor", "property", "function") else None
    quoted = None if not doc else '"""' + (doc if len(doc) <= 300 else doc[:300] + "...") + '"""'
    taken = len(next((x for x in (owner, quoted) if x is not None), ""))
    room, lines = limit - 10 - taken, content.split("\n")
    if len(content) > room:
        if len(lines) <= 3:
            content = content[:room] + "..."
        else:
            heads = [k for k in range(min(len(lines) // 2, 20) + 1) if taken + sum(len(x) + 1 for x in lines[:k]) <= 0.7 * room or k == 0]
            head = max(heads)
            spent = taken + sum(len(x) + 1 for x in lines[:head])
            tail = max(k for k in range(min(len(lines) // 3, 10) + 1) if k == 0 or sum(map(len, lines[-k:])) + max(k - 1, 1) <= room - spent - 20)
            content = "\n".join([*lines[:head], "    # ... (truncated) ...", *(lines[-tail:] if tail else [])])
    return "\n".join(x for x in (owner, quoted, content) if x is not None)


def test_embedding_text(spark):
    rnd = random.Random(3)
    rows = [("x", "function", None, None), ("", "class", "P", ""), (None, None, None, None), ("a\n" * 90, "method", "P", "d" * 400), ("y" * 900, "method", "P", "doc")]
    rows += [("\n".join("é" * rnd.randrange(0, rnd.choice([5, 60, 200])) for _ in range(rnd.randrange(1, 70))), rnd.choice(["method", "class"]), rnd.choice(["Par", "", None]), rnd.choice([None, "doc"])) for _ in range(120)]
    df = spark.createDataFrame(rows, "content string, kind string, parent string, doc string")
    for limit in (300, 6000):
        got = df.select(embedding_text(F.col("content"), F.col("kind"), F.col("parent"), F.col("doc"), limit).alias("t")).collect()
        assert [r.t for r in got] == [python_embedding_text(c or "", k, p, d, limit) for c, k, p, d in rows]


def test_unreadable_texts():
    assert chunk_text("def f(:", "a.py") == [] and chunk_text(None, "a.py") == [] and chunk_text("  ", "a.go") == [] and chunk_text("x", "a.bin") == []
    assert [r["chunk_type"] for r in chunk_text("{bad", "a.json")] == ["document"]
    assert chunk_text("class A:\n  def m(self):\n    return f(g(1)) + f(2)\n", "a.py")[1]["calls"] == ["f", "g"]


def test_markdown_plan_agrees(spark):
    df = spark.createDataFrame([("a.md", SAMPLES["a.md"][0]), ("b.md", None), ("c.md", "")], "relative_path string, content string")
    got = markdown_sections(df).orderBy("start_line").collect()
    assert [(r.name, r.start_line) for r in got] == [("Preamble", 1), ("One", 2), ("Two", 7)]


def test_index_search_and_refresh(spark, tmp_path):
    src = tmp_path / "src"
    (src / "pkg").mkdir(parents=True)
    (src / "node_modules").mkdir()
    (src / "pkg" / "user.py").write_text("class UserStore:\n    def load_user(self, key):\n        return fetch(key)\n\ndef fetch(key):\n    return key\n")
    (src / "pkg" / "other.py").write_text("def paint(colour):\n    return colour\n")
    (src / "node_modules" / "x.js").write_text("function hidden() {}\n")
    ix = CodeIndex(spark, str(tmp_path / "index"))
    first = ix.index_directory(str(src), "demo")
    assert first.full and first.files_added == 2 and first.chunks_added == 4
    assert ix.index_directory(str(src), "demo").chunks_added == 0
    hit = ix.search("load user", k=2).first()
    assert hit["name"] in ("load_user", "UserStore") and hit["file"] == "pkg/user.py"
    ids = {r.name: r.chunk_id for r in ix.store.chunks().select("name", "chunk_id").collect()}
    assert [r.chunk_id for r in ix.search_callers(ids["fetch"]).collect()] == [ids["load_user"]]
    ctx = ix.graph_context(ids["UserStore"])
    assert ctx["found"] and {e["edge_type"] for e in ctx["edges"]} == {"contains"} and not ix.graph_context("none")["found"]
    assert ids["paint"] not in [r.chunk_id for r in ix.find_similar(ids["paint"], 2).collect()]
    (src / "pkg" / "other.py").write_text("def paint(colour, tone):\n    return colour\n\ndef mix():\n    return paint(1, 2)\n")
    again = ix.index_directory(str(src), "demo")
    assert (again.files_modified, again.chunks_added, again.chunks_removed, again.full) == (1, 2, 1, False)
    assert ix.status()["sync"] == "synced" and ix.status()["total_chunks"] == 5
    with pytest.raises(ValueError):
        ix.search(" ")
    with pytest.raises(ValueError):
        ix.search("x", k=0)
    assert ix.remove_project("demo")["success"] and ix.store.chunks().count() == 0
    assert ix.clear_index()["success"]


def test_store_width_delete_lock_and_compaction(spark, tmp_path):
    st = IndexStore(spark, str(tmp_path))
    row = lambda i, w: ("t", [1.0] * w, f"/r/{i}.py", f"{i}.py", "function", "n", "", "", 1, 2, [], [], [], [], "p", f"id{i}", "p", "c", 0.0)
    from fathomline.operators.store import COLUMNS

    make = lambda rows: spark.createDataFrame(rows, COLUMNS)
    assert st.append(make([])) == 0 and st.append(make([row(1, 4), row(2, 4)])) == 2
    with pytest.raises(ValueError):
        st.append(make([row(3, 5)]))
    assert st.delete_files(spark.createDataFrame([("1.py",), ("/r/9.py",)], "path string")) == 1
    assert st.chunk("id2").count() == 1 and st.chunk("id1").count() == 0
    assert st.compact(keep_seconds=0, files=1) >= 1 and st.chunks().count() == 1
    with st.lock(), pytest.raises(TimeoutError), st.lock():
        pass


def test_streaming_refresh(spark, tmp_path):
    rows = pd.DataFrame({"file_path": ["/a.py", "/a.py", "/b.md"], "relative_path": ["a.py", "a.py", "b.md"], "project_name": ["p"] * 3, "content": ["def old(): pass\n", "def new(): pass\n", "# T\n"], "modified_at": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-01"])})
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    st = IndexStore(spark, str(tmp_path / "ix"))
    q = refresh_stream(spark, str(tmp_path / "in"), st, "p", str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert {r.name for r in st.chunks().select("name").collect()} == {"new", "T"}


def test_rule_files_settings_and_refresh(spark, tmp_path):
    src = tmp_path / "src"
    for name, body in {
        ".gitignore": "*.gen.py\n/out2/\n", ".cursorignore": "secret/\n", "pkg/.gitignore": "local_*\n!local_keep.py\n", "a.py": "def alpha_one():\n    return beta_two()\n", "b.gen.py": "def gone(): pass\n", "out2/c.py": "def gone(): pass\n",
        "secret/d.py": "def gone(): pass\n", "pkg/local_x.py": "def gone(): pass\n", "pkg/local_keep.py": "def kept_here(): pass\n", "pkg/deep/local_y.py": "def gone(): pass\n", "node_modules/e.js": "function gone() {}\n", "big.json": "[" + "1,\n" * 40 + "1]",
    }.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(body)
    rules, folders = walk(spark, str(src))
    assert rules.nested == {"pkg": ("local_*", "!local_keep.py")} and rules.extra == ("secret/",) and rules.signature["gitignore_hash"] and rules.signature["cursorignore_hash"]
    assert sorted(f.rsplit("src", 1)[1].strip("/") for f in folders) == ["", "pkg", "pkg/deep"]
    ix = CodeIndex(spark, str(tmp_path / "ix"), IndexConfig(max_structured_file_lines=10))
    first = ix.index_directory(str(src), "demo")
    assert first.full and first.files_added == 3 and (first.skipped_total, first.skipped_truncated) == (1, False) and first.skipped_bytes > 80
    assert {r.name for r in ix.store.chunks().collect()} == {"alpha_one", "kept_here"}
    assert ix.auto_reindex_if_needed("demo", 5) is None and ix.auto_reindex_if_needed("other", 0) is None
    (src / ".gitignore").write_text("")
    again = ix.auto_reindex_if_needed("demo", -1)
    assert again.full and {r.name for r in ix.store.chunks().collect()} == {"alpha_one", "kept_here", "gone"}
    got = ix.search("alpha_one", include_context=True, scorer=overlap_scorer).collect()
    assert got[0]["name"] == "alpha_one" and got[0].reranked and len(got[0].context) == 2

    def broken():
        raise_ = lambda q, t: 1 / 0
        return raise_

    assert not ix.search("alpha_one", scorer=broken).first().reranked
    ix.index_test_project(str(tmp_path / "sample"))
    assert [r.project_name for r in ix.list_snapshots().collect()] == ["sample", "demo"] and set(ix.indexing_stats()["projects"]) == {"sample", "demo"}
    assert {r.file for r in ix.search("basket").collect()} & {"shop/basket.py"}
    ix.switch_project("demo")
    assert not {r.file for r in ix.search("basket").collect()} & {"shop/basket.py"}
    ix.delete_snapshot("demo")
    assert ix.snapshot_age("demo") is None and ix.snapshot_age("sample") >= 0
    ctx = ix.graph_context(ix.store.read("symbols").where("name = 'Basket'").first().chunk_id, 1, 0)
    assert ctx["found"] and len(ctx["edges"]) == 1 and ctx["total_edges"] >= 1
    with pytest.raises(ValueError):
        ix.graph_context("x", True)
    with pytest.raises(ValueError):
        ix.switch_project("nowhere")


def test_other_separators_do_not_double_chunks(spark, tmp_path):
    schema = "file_path string, relative_path string, content string"
    store = IndexStore(spark, str(tmp_path / "ix"))
    index_files(store, spark.createDataFrame([("/r/a/x.py", "a\\x.py", "def f(): pass\n"), ("/r/b.py", "b.py", "def g(): pass\n")], schema), "p")
    index_files(store, spark.createDataFrame([("/r/a/x.py", "a\\x.py", "def f2(): pass\n"), ("/r/b.py", "b.py", "def g(): pass\n")], schema), "p")
    assert sorted(r.chunk_id for r in store.chunks().collect()) == ["a/x.py:1-1:function:f2", "b.py:1-1:function:g"]
    index_files(store, spark.createDataFrame([("/r/b.py", "b.py", "def g(): pass\n")], schema), "p")
    assert [r.chunk_id for r in store.chunks().collect()] == ["b.py:1-1:function:g"]


def test_settings_precedence():
    assert IndexConfig.load(None, {}) == IndexConfig()
    text = '{"max_structured_file_lines": 7, "max_structured_file_bytes": "x", "exclude_extensions": ["JSON", ".md", 3]}'
    got = IndexConfig.load(text, {})
    assert (got.max_structured_file_lines, got.max_structured_file_bytes, got.exclude_extensions) == (7, IndexConfig().max_structured_file_bytes, (".json", ".md"))
    got = IndexConfig.load(text, {"FATHOMLINE_MAX_STRUCTURED_FILE_LINES": "-1", "FATHOMLINE_EXCLUDE_EXTENSIONS": "py"})
    assert (got.max_structured_file_lines, got.exclude_extensions) == (0, (".py",))
    assert IndexConfig.load("{bad", {"FATHOMLINE_MAX_STRUCTURED_FILE_BYTES": "1.5"}) == IndexConfig()
    assert IndexConfig().signature() != IndexConfig().signature({"gitignore_hash": "x"})


def test_models(spark):
    known = {m.name: m for m in (Model("a", 64, query_prefix="q: "), Model("b", 8))}
    assert resolve(known, "b", "a", "a", {"FATHOMLINE_MODEL": "a"}).name == "b" and resolve(known, " ", "b", None, {"FATHOMLINE_MODEL": "a"}).name == "a" and resolve(known, None, "b", "a", {}).name == "b"
    for bad in (("zzz",), ()):
        with pytest.raises(ValueError):
            resolve(known, *bad, environment={})
    df = spark.createDataFrame([("x y", "x z"), (None, None)], "query string, content_preview string")
    assert [r.t for r in df.select(with_prefix(F.coalesce("query", F.lit("")), known["a"], True).alias("t")).collect()] == ["q: x y", "q: "]
    got = [r.reranker_score for r in score_pairs(df, overlap_scorer).collect()]
    assert got[0] == 0.5 and 0 < got[1] < 0.2
    logits = lambda: lambda q, t: np.array([[2.0, 2.0]] * len(q))
    assert [r.reranker_score for r in score_pairs(df, logits, "causal_lm").collect()] == [0.5, 0.5]


def test_a_change_rewrites_its_buckets_only(spark, tmp_path):
    schema = "file_path string, relative_path string, content string"
    store = IndexStore(spark, str(tmp_path / "ix"), buckets=16)
    files = {f"m{i}.py": f"class C{i}(object):\n    def run{i}(self):\n        return later_defined()\n" for i in range(8)}
    df = lambda x: spark.createDataFrame([("/r/" + p, p, t) for p, t in x.items()], schema)
    index_files(store, df(files), "p")
    before = store.version("chunks")["buckets"]
    assert store.read("edges").where("edge_type = 'calls'").count() == 0
    files["m3.py"] = "def later_defined():\n    return 1\n"
    report = index_files(store, df(files), "p")
    after = store.version("chunks")["buckets"]
    assert (report.files_modified, report.chunks_removed, report.chunks_added) == (1, 2, 1) and sum(before[b] != after.get(b) for b in before) == 1
    calls = store.read("edges").where("edge_type = 'calls'").collect()  # unchanged callers see the new name
    assert len(calls) == 7 and {r.target_chunk_id for r in calls} == {"m3.py:1-2:function:later_defined"}
    got = {(r.source_chunk_id, r.target_chunk_id, r.edge_type) for r in store.read("edges").collect()}
    fresh = IndexStore(spark, str(tmp_path / "fresh"), buckets=16)
    index_files(fresh, df(files), "p")
    assert got == {(r.source_chunk_id, r.target_chunk_id, r.edge_type) for r in fresh.read("edges").collect()}
    assert store.delete_files(spark.createDataFrame([("m1.py",), ("/r/m2.py",)], "path string"), "p") == 4 and store.chunks().count() == 11
    (tmp_path / "ix" / "chunks.current.json").write_text("{bad")
    assert store.version() is None and store.chunks().count() == 0
    with store.lock(), pytest.raises(TimeoutError), store.lock():
        pass
