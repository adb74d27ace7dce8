"""Parent-child links to full hierarchies by hash splitters and a reduced pointer graph.

Every node has at most one parent. Roots and a deterministic hash sample of the nodes are *splitters*. Each node
walks up to its next splitter (expected `every` steps, a fixed number of rounds); splitters then form a reduced
graph of about n/`every` pointers, which pointer doubling solves in log2(depth) rounds. Walks that meet no splitter
inside the fixed rounds are finished by doubling among themselves; what never meets one hangs on a loop
without a splitter. A loop that holds splitters shows up as reduced pointers that reach no root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.session import cut

#: Steps of the walk that one plan joins in a row.
WALK_STEPS = 4


def resolve_forest(links: DataFrame, every: int = 3, paths: bool = False) -> DataFrame:
    """Root, depth and (with `paths`) the path of each node of `links(kind, node, parent)`.

    `kind` names the tree type (nodes of different kinds never mix); `parent` null marks a root. Each (kind, node)
    must occur once; a parent that is no node counts as missing and makes the child a root. Null nodes are dropped.
    Result: kind, node, root, depth int, looped boolean [, path array<string> from root to node]. A node on a loop
    or below one has looped true, root null, depth -1 and a null path. An empty input gives an empty result.

    Inside, nodes are 64-bit hashes of (kind, node); names are joined back once at the end. A doubling round that
    finishes no node proves that the rest hangs on loops: were a node k steps from its end left, nodes at all smaller
    distances would have been, too. Trails that circle on a loop grow no longer than four times the deepest path, since the
    rounds end with it.
    """
    name = links.where(F.col("node").isNotNull() & F.col("kind").isNotNull()).select("kind", "node", F.xxhash64("kind", "node").alias("n"), F.when(F.col("parent").isNotNull(), F.xxhash64("kind", "parent")).alias("p"))
    known = name.select(F.col("n").alias("p"), F.lit(True).alias("_known"))
    base = name.join(known, "p", "left").select("kind", "node", "n", F.when(F.col("_known"), F.col("p")).alias("p"))
    base = cut(base.withColumn("splitter", F.col("p").isNull() | (F.pmod(F.xxhash64("n"), F.lit(every)) == 0)))
    step = _walk(base, paths)
    solved = _solve_reduced(base, step, paths)
    extra = ["path"] if paths else []
    at = solved.select(F.col("n").alias("cur"), "root", F.col("depth").alias("_d"), *[F.col("path").alias("_p")] * paths)
    inner = step.where("NOT splitter").join(at, "cur").select("n", "root", (F.col("_d") + F.col("steps")).alias("depth"), *[F.concat("_p", F.reverse("trail")).alias("path")] * paths)
    found = solved.unionByName(inner)
    top = base.where("p IS NULL").select(F.col("n").alias("root"), F.col("node").alias("_root"))
    named = found.join(top, "root").select("n", "_root", "depth", *extra)
    out = base.select("kind", "node", "n").join(named, "n", "left")
    return out.select("kind", "node", F.col("_root").alias("root"), F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"), F.col("_root").isNull().alias("looped"), *extra)


def _walk(base: DataFrame, paths: bool) -> DataFrame:
    """(n, splitter, cur, steps[, trail]): every node that has a parent with the next splitter above it.

    trail holds the names passed, the node's own first. Nodes whose walk meets no splitter are left out.
    """
    up = base.select(F.col("n").alias("cur"), F.col("p").alias("_up"), F.col("splitter").alias("_stop"), *[F.col("node").alias("_name")] * paths)
    walk = base.where("p IS NOT NULL").select("n", "splitter", F.col("p").alias("cur"), F.lit(1).alias("steps"), *[F.array("node").alias("trail")] * paths)
    for i in range(WALK_STEPS):
        met = walk.join(up, "cur")
        last = i == WALK_STEPS - 1  # the last join only looks at the node reached
        go = ~F.col("_stop") if not last else F.lit(False)
        walk = met.select(
            "n", "splitter", F.when(go, F.col("_up")).otherwise(F.col("cur")).alias("cur"), (F.col("steps") + go.cast("int")).alias("steps"), F.col("_stop").alias("stop"),
            *[F.when(go, F.concat("trail", F.array("_name"))).otherwise(F.col("trail")).alias("trail")] * paths,
        )
    walk = cut(walk)
    ended, active = walk.where("stop").drop("stop"), walk.where("NOT stop").drop("stop")
    left = active.count()
    while left:
        # an open walk stands at a node that is no splitter; it takes over what that node's own walk has reached
        def ahead(df: DataFrame, stop: bool) -> DataFrame:
            return df.where("NOT splitter").select(F.col("n").alias("cur"), F.col("cur").alias("_c"), F.col("steps").alias("_s"), F.lit(stop).alias("stop"), *[F.col("trail").alias("_t")] * paths)

        jump = active.join(ahead(active, False).unionByName(ahead(ended, True)), "cur")
        jump = cut(jump.select("n", "splitter", F.col("_c").alias("cur"), (F.col("steps") + F.col("_s")).alias("steps"), "stop", *[F.concat("trail", "_t").alias("trail")] * paths))
        ended, active = ended.unionByName(jump.where("stop").drop("stop")), jump.where("NOT stop").drop("stop")
        now = active.count()
        if now == left:
            break
        left = now
    return ended


def _solve_reduced(base: DataFrame, walked: DataFrame, paths: bool) -> DataFrame:
    """(n, root, depth[, path]) of every splitter that reaches a root, by pointer doubling over splitters only."""
    extra = ["path"] if paths else []
    solved = base.where("p IS NULL").select("n", F.col("n").alias("root"), F.lit(0).alias("depth"), *[F.array("node").alias("path")] * paths)
    open_ = walked.where("splitter").drop("splitter")
    left = open_.count()
    while left:
        ends = solved.select(F.col("n").alias("cur"), F.col("root").alias("_r"), F.col("depth").alias("_s"), F.lit(None).cast("long").alias("_c"), *[F.col("path").alias("_t")] * paths)
        hops = open_.select(F.col("n").alias("cur"), F.lit(None).cast("long").alias("_r"), F.col("steps").alias("_s"), F.col("cur").alias("_c"), *[F.col("trail").alias("_t")] * paths)
        hit = F.col("_r").isNotNull()
        step = open_.join(ends.unionByName(hops), "cur")  # a pointer into a walk without end drops out: its node is looped
        step = cut(step.select("n", F.col("_r").alias("root"), (F.col("steps") + F.col("_s")).alias("steps"), F.col("_c").alias("cur"), *[F.when(hit, F.concat("_t", F.reverse("trail"))).otherwise(F.concat("trail", "_t")).alias("trail")] * paths))
        solved = solved.unionByName(step.where("root IS NOT NULL").select("n", "root", F.col("steps").alias("depth"), *[F.col("trail").alias("path")] * paths))
        open_ = step.where("root IS NULL").select("n", "cur", "steps", *(["trail"] if paths else []))
        now = open_.count()
        if now == left:
            break
        left = now
    return solved.select("n", "root", "depth", *extra)


def descendants(forest: DataFrame) -> DataFrame:
    """All (kind, ancestor, descendant, distance) pairs of a forest resolved with `paths`; looped nodes have none."""
    pairs = forest.where("NOT looped").select("kind", F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("_at", "ancestor"))
    return pairs.where(F.col("_at") < F.col("depth")).select("kind", "ancestor", "descendant", (F.col("depth") - F.col("_at")).alias("distance"))


def descendant_counts(forest: DataFrame) -> DataFrame:
    """(kind, node, n_descendants) of every node of a forest resolved with `paths` that has a descendant.

    Every node counts once for each of its ancestors, as a 64-bit hash, and counts are summed on the map side: a root with a
    third of all nodes below it is one row a task.
    """
    above = F.slice("path", 1, F.greatest(F.col("depth"), F.lit(0)))
    marks = forest.where("NOT looped AND depth > 0").select(F.explode(F.transform(above, lambda x: F.xxhash64(F.col("kind"), x))).alias("n"))
    counts = marks.groupBy("n").agg(F.count("*").alias("n_descendants"))
    return forest.select("kind", "node", F.xxhash64("kind", "node").alias("n")).join(counts, "n").select("kind", "node", "n_descendants")


def symbol_links(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """links(kind, node, parent) of the `contains` and `inherits` trees over `symbols`, one row per type and symbol.

    edge_type is read without case and surrounding blanks; edges with an end outside `symbols` are dropped; the
    latest indexed_at (then the greatest parent id) wins per child. A `contains` child without a parent takes the one
    symbol of its file whose name equals its non-empty parent_name. Repeated symbols count once (greatest row).
    """
    syms = symbols.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max(F.struct("file_path", "name", "parent_name")).alias("s")).select("chunk_id", "s.*")
    ids = syms.select("chunk_id")
    kind = F.lower(F.trim(F.col("edge_type")))
    e = edges.select(kind.alias("kind"), "source_chunk_id", "target_chunk_id", "indexed_at").where("kind IN ('contains', 'inherits')")
    down = F.col("kind") == "contains"
    e = e.select("kind", F.when(down, F.col("target_chunk_id")).otherwise(F.col("source_chunk_id")).alias("node"), F.when(down, F.col("source_chunk_id")).otherwise(F.col("target_chunk_id")).alias("parent"), "indexed_at")
    e = e.join(ids.withColumnRenamed("chunk_id", "node"), "node", "left_semi").join(ids.withColumnRenamed("chunk_id", "parent"), "parent", "left_semi")
    e = e.groupBy("kind", "node").agg(F.max(F.struct("indexed_at", "parent")).alias("m")).select("kind", "node", F.col("m.parent").alias("parent"))
    named = syms.groupBy("file_path", "name").agg(F.count("*").alias("n"), F.min("chunk_id").alias("only")).where("n = 1").select("file_path", F.col("name").alias("parent_name"), F.col("only").alias("by_name"))
    orphan = syms.where("parent_name <> ''").join(e.where("kind = 'contains'").select(F.col("node").alias("chunk_id")), "chunk_id", "left_anti")
    guess = orphan.join(named, ["file_path", "parent_name"]).where("by_name <> chunk_id").select(F.lit("contains").alias("kind"), F.col("chunk_id").alias("node"), F.col("by_name").alias("parent"))
    have = cut(e.unionByName(guess))
    tops = have.select("kind", F.col("parent").alias("node")).distinct().join(have.select("kind", "node"), ["kind", "node"], "left_anti")
    return have.unionByName(tops.withColumn("parent", F.lit(None).cast("string")))
