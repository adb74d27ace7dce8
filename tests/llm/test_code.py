import ast
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from fathomline.llm.doc_pairs import code_doc_pairs, documented_functions, function_docs, is_trivial, parameters, signature
from fathomline.llm.handwritten import FEATURES, NOTICE, features, not_handwritten, split_header
from fathomline.llm.syntax.gll import Grammar
from fathomline.llm.syntax.languages import valid
from fathomline.llm.syntax_check import syntax_rates, syntax_verdicts

T = [dt.datetime(2024, 1, i) for i in range(1, 4)]
GOOD = {
    "py": ["", "# c\n", "if a:\n    b\nelse:\n    pass\n", "match x:\n    case {'a': 1, **r} if r: pass\n    case [1, *_]: pass\n", "def f(a, *, b: int = 3, **k) -> int:\n\treturn a if b else lambda: 0\n", "x = f\"{a!r:>{w}} {{}}\"\n", 'def f():\n    """<<<<<<< HEAD\n=======\n"""\n', "a = [\n1,\n# c\n2]\n", "try:\n    a\nexcept* E as e:\n    b\n", "(a, [b, *c.d]), e[0] = x = yield\n", "def f(a, /, b=1, *, c, **d): return lambda x, *y, z=1: (yield)\n", "f(*a, b, c=1, *d, **e, g=2)\n", "(a).b: int = 1\nx = y = z += 1\n".replace("x = y = z += 1", "(x) += 1"), "async def f():\n    async with a as (b, c), d as e.f: return [x async for x, *y in z if (w := x)]\n", "if x: pass\n# c\n    # d\nelse:\n  def g(): return 1\n", "type X = int\ntype = 1\nmatch(x)\nmatch = case = type\nprint(match[1], f'{a!r}', sep='')\n"],
    "js": ["a\nb\n", "const a = /x[/]y/g.test(b) / 2;", "let x = `a${b + `c${d}`}e`;", "class A { #p = 1; async *g() {} static {} }", "for (const [k, v] of o) { f(k) }", "export default class {}", "a = b\n++c", "[a, {b: c.d = 1}] = x; ({e} = y); a[0] ??= b => ({c} = {}) => c; (d).e = 1", "async (x) => await x; async(x); (a, b) => a", "let x = a\n/b/g", "/* x\n */ a /* y\n */ b"],
    "ts": ["interface A<T extends B = C> extends D { readonly x?: number; [k: string]: any }", "const f = <T,>(x: T): T => x; let c = d!; e!.f", "declare module 'x' { export const a: number }", "abstract class A { constructor(readonly x: number) { super() } abstract m(): void }", "let m: Map<string, number> = new Map<string, number>()"],
    "go": ["package a\n\nimport (\n\t\"b\"\n)\n\nfunc (t *T[K]) M(a, b int) (x int, err error) {\n\tif x := f(); x > 0 {\n\t} else {\n\t}\n\tfor i := range 10 {\n\t}\n\tz := []T{{1}, {A: 3}}\n\treturn\n}\n", "package a\nvar x = `<<<<<<< HEAD\n`\n"],
    "java": ["package a.b; import static c.D.*; public class A<T> { @X int f(final int... a) throws E { return switch (a) { case 1 -> 2; default -> 3; }; } }", "record R(int a) {}", "class A { Runnable r = () -> {}; }"],
    "json": ['{"a": [1, -2.5e3, true, null]}', "3"],
    "yaml": ["a: 1\nb:\n- x\n- y: z\n", "a: |\n  <<<<<<< HEAD\n  x: [\n", "a: {b: c, d: [e]}\n", "---\na: b\n...\n---\nc\n", ""],
}
BAD = {
    "py": ["def f(:\n  pass\n", "x = (1\n", "if x\n  y\n", '"abc\n', "for a in b:\nc\n", "<<<<<<< HEAD\nx=1\n", "x = 12abc\n", "class A:\n", "f'{'\n", "1 = x\n", "f() = 3\n", "f(a=1, 2)\n", "def f(a=1, b): pass\n", "del f()\n", "return 1\n", "class A:\n    return\n", "a + b += 1\n", "f(**k, *a)\n", "f(x for x in y, 1)\n", "for f() in x: pass\n", "def f(*): pass\n", "(a, 1) = x\n", "f() := 2\n", "x: int: 3\n"],
    "js": ["function f( { }", "let a = ;", "def f(a):\n  pass\n", "}", "`a${b", "<<<<<<< HEAD\n", "const x: number = 1;", "1 = x", "f() = 3;", "a + b = c;", "f(function () { a b });", "(a, 1) => a"],
    "ts": ["let a: = 1", "package a;\nclass B {}", "class A { m() { }"],
    "go": ["package a\nfunc f() {\n", "x := 1\n", "package a\nclass A {}\n", "package a\nfunc f() {}}\n"],
    "java": ["class A { void m() { int x = 1 } }", "class A {", "package a\nclass B {}"],
    "json": ['{"a": 1,}', "{a: 1}", "", "[1 2]"],
    "yaml": ["a: b: c\n", "a: [1\nb: 2\n", "a: 1\n\tb: 2\n", "<<<<<<< HEAD\na: 1\n", "- a\nb: c\n"],
}


@pytest.mark.parametrize("ext", GOOD)
def test_dialects(ext):
    assert [x for x in GOOD[ext] if not valid(x, ext)] == []
    assert [x for x in BAD[ext] if valid(x, ext)] == []
    assert valid("x", "txt") is None


def test_python_grammar_agrees_with_the_standard_parser(spark):
    import pathlib
    import random as rnd_module

    folder = pathlib.Path(rnd_module.__file__).parent
    wrong = []
    for path in sorted(folder.glob("*.py"))[:60]:
        text = path.read_text(encoding="utf-8", errors="replace")
        cuts = [text, text[: len(text) * 2 // 3], text.replace(":\n", "\n", 1)]
        for t in cuts:
            try:
                ast.parse(t)
                ok = True
            except (SyntaxError, ValueError):
                ok = False
            if valid(t, "py") != ok:
                wrong.append((path.name, ok, len(t)))
    assert len(wrong) <= 4, wrong


@pytest.mark.parametrize("ext, head", [("js", "f(function () {{ {} }});"), ("js", "f(() => {{ {} }});"), ("ts", "f((x: number) => {{ {} }});")])
def test_verdicts_do_not_depend_on_texts_read_before(ext, head):
    bad, good = head.format("a b"), head.format("a\nb")
    for order in ((bad, good, bad), (good, bad, good)):
        assert [valid(x, ext) for x in order] == [x == good for x in order]


def test_verdicts_do_not_depend_on_order():
    texts = [(x, e) for e in GOOD for x in GOOD[e] + BAD[e]]
    want = {t: valid(*t) for t in texts}
    for seed in range(3):
        random.Random(seed).shuffle(texts)
        assert {t: valid(*t) for t in texts} == want


def test_gll_is_general():
    g = Grammar("start_s : s ; s : s s | 'a' | ;")  # ambiguous, left recursive, nullable
    k = g.kinds["a"]
    for n in (0, 1, 7):
        assert g.accepts(bytes([k] * n + [0]), ["start_s"])[0] == "start_s"
    g = Grammar("start_e : e ; e : e '+' e | '(' e ')' | 'x' ;")
    code = lambda s: bytes([g.kinds[c] for c in s] + [0])
    assert g.accepts(code("x+(x+x)+x"), ["start_e"])[0] and not g.accepts(code("x+(x+x"), ["start_e"])[0]
    g = Grammar("start_a : 'x' 'y' ; start_b : 'x' 'z' ;")
    assert g.accepts(code2(g, "xz"), ["start_a", "start_b"])[0] == "start_b"


def code2(g, s):
    return bytes([g.kinds[c] for c in s] + [0])


def test_verdicts_and_rates(spark):
    rows = [("/a.py", "p", "x = 1\n", T[0]), ("/a.py", "p", "x = (\n", T[1]), ("/b.json", "p", "{}", T[0]), ("/c.md", "p", "(((", T[0]), ("/d.go", "q", None, T[0]), ("/e", "q", "x", T[0]), (None, "q", "x", T[0])]
    df = spark.createDataFrame(rows + rows[:2], "file_path string, project_name string, content string, modified_at timestamp").withColumn("ext", F.lit("clash"))
    v = syntax_verdicts(df)
    assert {(r.file_path, r.parses) for r in v.collect()} == {("/a.py", False), ("/b.json", True), ("/d.go", False)}
    runs = spark.createDataFrame([(["/a.py: bad token", "timeout"],), (None,)], "chunking_errors array<string>")
    got = {(r.project_name, r.language): (r.n_files, r.n_invalid, r.n_hinted) for r in syntax_rates(v, runs).collect()}
    assert got == {("p", "python"): (1, 1, 1), ("p", "json"): (1, 0, 0), ("q", "go"): (1, 1, 0)}
    assert syntax_verdicts(df.where("false")).count() == 0


@pytest.mark.parametrize("doc, trivial", [("Get user by id.", True), ("TODO: document", True), ("@param user_id\n@return", True), ("Args:\n  user_id: the user id", True), ("-----", True), ("", True), (None, True), ("See get_user_by_id.", True), ("Retries twice.", False), ("Höchstens neun.", False), ("TODO later\nNever blocks.", False), ("None of the retries may exceed the billing budget.", False), ("Summary of last month's invoices per tenant, newest first.", False), ("Description strings are escaped for HTML output.", False), ("Hack around the broken proxy: retries twice with backoff.", False), ("Todo items grouped by owner.", False), ("xxx: add a proper description before release 1.2", True), ("tbd - missing documentation for get_user_by_id", True), ("Docstring goes here.", True), ("Auto-generated method stub", True), ("get_user_by_id FIXME", True), ("N/A", True), ("No description.", True), ("FIXME write this up, see ticket a-1", True)])
def test_trivial(doc, trivial):
    assert is_trivial(doc, "get_user_by_id", ["self", "user_id: int = 3"]) is trivial


def test_signatures():
    assert signature(parameters("int f(final List<A> a, @X int b)", "f"), "java") == "(List<A>,int)"
    assert signature(parameters("def f(self, a, *args, b=(1, 2), **kw)", "f"), "py") == "(_,*,_,**)"
    assert signature(parameters("f(a: string, b?: Map<x, y>)", "f"), "ts") == "(string,Map<x,y>)"


def test_documentation_is_read_from_the_file(spark):
    py = "@d(1)\ndef f(a,\n      b={'x': 1}):  # c\n    # comment\n    r'''Half-open.'''\n    return 1\n\ndef g():\n    'x'.join(a)\n"
    go = "package p\n\n// F folds twice.\n//go:noinline\nfunc F() {}\n\n// far\n\nfunc G() {}\n"
    js = "/**\r\n * Never blocks.\r\n */\r\nfunction h() {}\r\n/* no */\r\nfunction i() {}\r\n"
    ja = "interface I {\n    /** Closes early. */\n    int k(int a);\n}\nclass I2 {\n    /** TODO */\n    int k(int a) { return 1; }\n}\n"
    files = spark.createDataFrame([("/f.py", py, T[1]), ("/f.py", "old", T[0]), ("/f.go", go, T[0]), ("/f.js", js, T[0]), ("/f.java", ja, T[0])], "file_path string, content string, modified_at timestamp")
    rows = [
        ("f", "/f.py", "f", None, "function", 1, "@d(1)\ndef f(a,\n      b={'x': 1}):"), ("g", "/f.py", "g", None, "function", 8, "def g():"), ("F", "/f.go", "F", "", "function", 5, "func F() {}"), ("G", "/f.go", "G", None, "function", 9, "func G() {}"),
        ("h", "/f.js", "h", None, "function", 4, "function h() {}"), ("i", "/f.js", "i", None, "function", 6, "function i() {}"), ("k1", "/f.java", "k", "I", "method", 3, "int k(int a);"), ("k2", "/f.java", "k", "I", "method", 7, "int k(int a) { return 1; }"),
        ("cls", "/f.py", "C", None, "class", 1, "x"), ("lost", "/gone.py", "z", None, "function", 1, "def z(): pass"), ("far", "/f.py", "y", None, "function", 999, "def y(): pass"), ("nul", "/f.py", None, None, "function", None, None),
    ]
    chunks = spark.createDataFrame([(*r, "p", T[0], None) for r in rows], "chunk_id string, file_path string, name string, parent_name string, chunk_type string, start_line int, content string, project_name string, indexed_at timestamp, end_line int").withColumn("doc", F.lit("clash"))
    docs = function_docs(chunks, files)
    got = {r.chunk_id: (r.doc and r.doc.strip(), r.trivial) for r in docs.collect()}
    assert got == {"f": ("Half-open.", False), "g": (None, True), "F": ("F folds twice.", False), "G": (None, True), "h": ("Never blocks.", False), "i": (None, True), "k1": ("Closes early.", False), "k2": ("TODO", True), "far": (None, True)}
    pairs = {r.chunk_id: r.doc_chunk_id for r in code_doc_pairs(docs).collect()}
    assert pairs == {"f": "f", "F": "F", "h": "h", "k1": "k1", "k2": "k1"}


def test_declarations_in_other_files_document_separate_definitions(spark):
    """Interface in one file, overloads apart by their types, definitions in another file of the same project."""
    decl = "interface I {\n    /** Closes early. */\n    int k(int a);\n    /** Closes late, after every reader. */\n    int k(String b);\n    /** m */\n    int m();\n}\n"
    impl = "class I {\n    int k(final int value) { return 1; }\n    @Override\n    int k(String other) { return 2; }\n    int m() { return 3; }\n    /** Own words win. */\n    int k(int a) { return 4; }\n}\n"
    files = spark.createDataFrame([("/d/I.java", decl, T[0]), ("/e/I.java", impl, T[0]), ("/q/I.java", impl, T[0])], "file_path string, content string, modified_at timestamp")
    rows = [("d1", "/d/I.java", "k", 3, 3, "p"), ("d2", "/d/I.java", "k", 5, 5, "p"), ("d3", "/d/I.java", "m", 7, 7, "p"), ("e1", "/e/I.java", "k", 2, 2, "p"), ("e2", "/e/I.java", "k", 3, 4, "p"), ("e3", "/e/I.java", "m", 5, 5, "p"), ("e4", "/e/I.java", "k", 7, 7, "p"), ("q1", "/q/I.java", "k", 2, 2, "other")]
    chunks = spark.createDataFrame([(c, f, n, "I", "method", a, b, p, T[0]) for c, f, n, a, b, p in rows + rows[:2]], "chunk_id string, file_path string, name string, parent_name string, chunk_type string, start_line int, end_line int, project_name string, indexed_at timestamp")
    got = {r.chunk_id: (r.doc_chunk_id, r.doc.strip(), r.content.strip()) for r in documented_functions(chunks, files, content=True).collect()}
    assert {c: g[0] for c, g in got.items()} == {"d1": "d1", "d2": "d2", "e1": "d1", "e2": "d2", "e4": "e4"}
    assert got["e2"][1:] == ("Closes late, after every reader.", "@Override\n    int k(String other) { return 2; }")
    assert documented_functions(chunks.where("false"), files).count() == 0


def test_long_heads_and_decorators(spark):
    quotes = "'" * 3
    py = "".join(f"@d({i})\n" for i in range(500)) + "def f(\n" + "".join(f"    a{i}=':',\n" for i in range(600)) + "):\n    " + quotes + "Words.\n" * 500 + quotes + "\n"
    files = spark.createDataFrame([("/f.py", py, T[0])], "file_path string, content string, modified_at timestamp")
    chunks = spark.createDataFrame([("f", "/f.py", "f", None, "function", 1, py.count("\n"), "p", T[0])], "chunk_id string, file_path string, name string, parent_name string, chunk_type string, start_line int, end_line int, project_name string, indexed_at timestamp")
    r = function_docs(chunks, files).first()
    assert r.doc == "Words.\n" * 500 and not r.trivial and r.signature.count("_") == 600


def test_handwritten(spark):
    getters = lambda n, s: "class A {\n" + "".join(f"    get{s}{i}() {{ return this.fields[{i}]; }}\n" for i in range(n)) + "}\n"
    hand = lambda i: f"import x{i} from './m{i}';\n\n// keeps the {i}th row\nexport function run{i}(alpha, beta) {{\n    if (alpha > {i}) {{\n        return beta.map((row) => row.value + {i * 7});\n    }}\n    log.info('done {i}', beta);\n    return alpha;\n}}\n"
    rows = [(f"/r/gen_{i}.js", "// Code generated by tool v1. DO NOT EDIT.\n" + getters(20 + i, "a")) for i in range(15)] + [(f"/r/src/h{i}.js", hand(i)) for i in range(40)]
    rows += [("/r/src/bare.js", getters(25, "q")), ("/r/vendor/v.js", hand(99)), ("/r/src/tail.js", hand(98) + "// AUTO-GENERATED FILE - changes will be lost\n"), ("/r/src/talks.js", hand(97).replace("'done 97'", "'Code generated by x. DO NOT EDIT.'")), ("/r/d.js", "export const a = [" + "0x1f, " * 300 + "];"), ("/r/gen/a.json", "{}"), ("/r/README.md", "x"), ("/r/null.js", None)]
    df = spark.createDataFrame([(p, p[1:], t, T[0]) for p, t in rows], "file_path string, relative_path string, content string, modified_at timestamp").withColumn("label", F.lit("clash"))
    got = {r.file_path: r.flagged for r in not_handwritten(df).collect()}
    assert all(got[f"/r/gen_{i}.js"] for i in range(15)) and not any(got[f"/r/src/h{i}.js"] for i in range(40))
    assert got["/r/src/bare.js"] and got["/r/vendor/v.js"] and got["/r/src/tail.js"] and got["/r/d.js"] and not got["/r/src/talks.js"] and not got["/r/null.js"]
    assert "/r/gen/a.json" not in got and "/r/README.md" not in got
    assert not_handwritten(df.where("false")).count() == 0
    assert split_header("# a\n# b\nx = 1\n# c\n", "py")[1].strip() == "x = 1" and len(features("", "py")[0]) == len(FEATURES)


@pytest.mark.parametrize("line, told", [("This file was written by Jane Doe in 2019", False), ("The code is created by our team", False), ("Code generated by x v1. DO NOT EDIT.", True), ("Copied unchanged from libx release 2", True), ("Needs the vendored parser from a/b", False), ("The table generated by x is kept by hand", False), ("@generated from a.idl", True)])
def test_notices(line, told):
    assert bool(NOTICE.search("// " + line)) is told


def test_forest_finds_files_whose_notices_are_blanked_out(spark):
    """Recall over generated, minified and data files that the forest has not seen, notices taken away."""
    from fathomline.llm.handwritten import _vector, file_features, fit_forest, training_rows
    from tests.compare import DATA

    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    rows = training_rows(file_features(spark.read.parquet(DATA.replace("0.001", "0.1") + "/source_files.parquet"))).withColumn("_h", F.pmod(F.xxhash64("file_path"), F.lit(2))).cache()
    model = fit_forest(rows.where("_h = 0"))
    seen = model.transform(_vector(rows.where("_h = 1"))).select("label", "notice", "generated_path", "prediction").collect()
    made = [r for r in seen if r.label > 0 and (r.notice != "header" or r.generated_path)]
    hand = [r for r in seen if r.label == 0]
    assert len(made) > 10 and sum(r.prediction for r in made) >= 0.95 * len(made) and sum(r.prediction for r in hand) <= 0.03 * len(hand)
