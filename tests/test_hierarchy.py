import datetime as dt
import random

import pytest

from fathomline.operators.hierarchy import descendant_counts, descendants, resolve_forest, symbol_links

SCHEMA = "kind string, node string, parent string"


def walk(rows):
    """Brute force: (kind, node) -> path from the root, None on or below a loop."""
    par = {(k, n): p for k, n, p in rows}
    par = {key: (p if (key[0], p) in par else None) for key, p in par.items()}
    out = {}
    for k, n in par:
        path, seen = [n], {n}
        while (p := par[k, path[-1]]) is not None and p not in seen:
            path.append(p)
            seen.add(p)
        out[k, n] = None if p is not None else path[::-1]
    return out


def check(spark, rows, every):
    got = {(r.kind, r.node): r for r in resolve_forest(spark.createDataFrame(rows, SCHEMA), every=every, paths=True).collect()}
    want = walk(rows)
    assert got.keys() == want.keys()
    for key, path in want.items():
        r = got[key]
        if path is None:
            assert r.looped and r.root is None and r.depth == -1 and r.path is None
        else:
            assert not r.looped and r.root == path[0] and r.depth == len(path) - 1 and r.path == path


@pytest.mark.parametrize("every", [2, 10**9])
def test_chains_trees_and_loops(spark, every):
    rnd = random.Random(every)
    rows = [("contains", f"a{i}", f"a{i - 1}" if i else None) for i in range(120)]
    rows += [("inherits", f"b{i}", f"b{rnd.randrange(60)}") for i in range(60)]
    rows += [("inherits", f"c{i}", f"c{(i + 1) % 40}") for i in range(40)]
    rows += [("y", "p", "q"), ("y", "q", "p"), ("y", "s", "s"), ("y", "t", "s"), ("y", "u", "missing"), ("contains", "c1", "a5")]
    check(spark, rows, every)


def test_empty_null_and_single(spark):
    assert resolve_forest(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = resolve_forest(spark.createDataFrame([("k", None, "x"), (None, "x", None), ("k", "x", None)], SCHEMA)).collect()
    assert [(r.node, r.root, r.depth) for r in rows] == [("x", "x", 0)]


def test_descendants(spark):
    f = resolve_forest(spark.createDataFrame([("k", "a", None), ("k", "b", "a"), ("k", "c", "b")], SCHEMA), paths=True)
    assert {(r.ancestor, r.descendant, r.distance) for r in descendants(f).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert {(r.node, r.n_descendants) for r in descendant_counts(f).collect()} == {("a", 2), ("b", 1)}
    assert descendant_counts(resolve_forest(spark.createDataFrame([("k", "x", "y"), ("k", "y", "x")], SCHEMA), paths=True)).count() == 0


def test_symbol_links(spark):
    t = [dt.datetime(2024, 1, i) for i in range(1, 4)]
    sym = spark.createDataFrame(
        [("A", "Top", "f1", None), ("A", "Top", "f1", None), ("B", "kid", "f1", "Top"), ("C", "low", "f1", "kid"), ("D", "own", "f2", "own"), ("E", "x", "f3", "twice"), ("F", "twice", "f3", ""), ("G", "twice", "f3", None), (None, "n", "f1", "Top")],
        "chunk_id string, name string, file_path string, parent_name string",
    )
    edges = spark.createDataFrame(
        [("A", "C", " Contains", t[0]), ("B", "C", "contains", t[1]), ("B", "A", "INHERITS", t[0]), ("A", "gone", "contains", t[2]), ("A", "B", "calls", t[2]), (None, "B", "contains", t[2])],
        "source_chunk_id string, target_chunk_id string, edge_type string, indexed_at timestamp",
    )
    got = {(r.kind, r.node, r.parent) for r in symbol_links(sym, edges).collect()}
    assert got == {("contains", "C", "B"), ("contains", "B", "A"), ("contains", "A", None), ("inherits", "B", "A"), ("inherits", "A", None)}
