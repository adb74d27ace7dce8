"""One ranking from several differently-scaled scores: Borda count over competition ranks.

Only the order within each score matters, so no score dominates by its range. A group (a query) may hold any share of
the rows: values are counted first (ties and copies collapse on the map side), groups beyond `hot_rows` rows
are cut into value ranges at their own quantiles, and ranks are running counts within a range plus the counts of
the ranges above. All other groups get the same ranks from windows within one shuffle by group. Both parts are in
every plan, over one stored copy of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.session import stored

HOT_ROWS = 50_000
RANGES = 1024


def _ranged(values: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Adds `_range`: 0 for small groups, else the number of the group's own quantiles below `v` (0..RANGES)."""
    cuts = [i / RANGES for i in range(1, RANGES)]
    hot = values.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*keys)
    at = values.join(hot, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx("v", F.array(*[F.lit(c) for c in cuts]), F.lit(2000)).alias("_cuts"))
    marked = values.join(at, keys, "left")
    return marked.withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("v"))), F.lit(0))).drop("_cuts")


def value_ranks(values: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, v, n, above, total): per distinct non-null `v` of each group its count, the rows above it and all rows.

    The competition rank of v is above + 1, the rank averaged over its ties above + (n + 1) / 2.
    """
    counted = values.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    counted = _ranged(counted, keys, hot_rows)
    per = counted.groupBy(*keys, "_range").agg(F.sum("n").alias("_in"))
    w = Window.partitionBy(*keys)
    per = per.select(*keys, "_range", (F.sum("_in").over(w.orderBy(F.desc("_range"))) - F.col("_in")).alias("_before"), F.sum("_in").over(w).alias("total"))
    run = F.sum("n").over(Window.partitionBy(*keys, "_range").orderBy(F.desc("v"))) - F.col("n")
    inside = counted.withColumn("_run", run)
    return inside.join(per, [*keys, "_range"]).select(*keys, "v", "n", (F.col("_run") + F.col("_before")).alias("above"), "total")


def _borda_by_group(rows: DataFrame, group: str, item: str, scores: list[str], weights: list[float]) -> DataFrame:
    """borda where every group fits one task: one shuffle by group, windows within it. Same result as by value ranges."""
    whole = Window.partitionBy("_g")
    share, cols = F.lit(0.0), {}
    for k, (s, weight) in enumerate(zip(scores, weights)):
        v = F.col(f"_s{k}")
        place = F.rank().over(whole.orderBy(F.desc_nulls_last(f"_s{k}")))
        ties, m = F.count("*").over(Window.partitionBy("_g", f"_s{k}")), F.count(v).over(whole)
        cols[f"place_{s}"] = F.when(v.isNotNull(), place).cast("long")
        share = share + F.lit(float(weight)) * F.coalesce(F.when(v.isNotNull(), 1 - (place - 1 + ties / 2) / m), F.lit(0.5))
    present = sum((F.col(f"_s{k}").isNotNull().cast("int") for k in range(len(scores))), F.lit(0))
    out = rows.select("_g", "_i", present.cast("int").alias("present"), F.round(share * F.count("*").over(whole), 9).alias("points"), F.count("*").over(whole).alias("n_items"), *[c.alias(n) for n, c in cols.items()])
    out = out.withColumn("position", F.row_number().over(whole.orderBy(F.desc("points"), "_i")).cast("long"))
    return out.select(F.col("_g").alias(group), F.col("_i").alias(item), "present", "points", "position", *cols, "n_items")


def borda(hits: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, item, present, points, position, place_<score>...): one order per group.

    `hits` has one row per (group, item); rows with a null key are dropped. place_<score> is the competition rank
    (1 = highest; ties share the lowest number), null where the score is null or NaN. A present score gives
    n * (1 - (r - 0.5) / m) points for the average rank r among m present of n items, a missing one the mid-rank's n / 2;
    weights multiply the points. position orders by points descending, then by item; it is 1..n without gaps.
    An empty input gives an empty result.
    """
    weights = weights or [1.0] * len(scores)
    g, i = F.col(f"`{group}`").alias("_g"), F.col(f"`{item}`").alias("_i")
    sound = lambda s: F.when(~F.isnan(F.col(f"`{s}`").cast("double")), F.col(f"`{s}`").cast("double"))
    base = stored(hits.where(F.col(f"`{group}`").isNotNull() & F.col(f"`{item}`").isNotNull()).select(g, i, *[sound(s).alias(f"_s{k}") for k, s in enumerate(scores)]))
    hot = base.groupBy("_g").agg(F.count("*").alias("_size")).where(F.col("_size") > hot_rows)
    cold = base.join(hot.select("_g"), "_g", "left_anti")
    small, large = _borda_by_group(cold, group, item, scores, weights), _borda_by_ranges(base.join(hot.select("_g"), "_g", "left_semi"), hot, group, item, scores, weights, hot_rows)
    return small.unionByName(large)


def _borda_by_ranges(base: DataFrame, sizes: DataFrame, group: str, item: str, scores: list[str], weights: list[float], hot_rows: int) -> DataFrame:
    """borda for groups of any size, by value ranges; `sizes` is (_g, _size)."""
    long = base.select("_g", "_i", F.explode(F.array(*[F.struct(F.lit(k).alias("s"), F.col(f"_s{k}").alias("v")) for k in range(len(scores))])).alias("x")).select("_g", "_i", "x.s", "x.v")
    ranks = value_ranks(long.where("v IS NOT NULL").select("_g", "s", "v"), ["_g", "s"], hot_rows)
    ranks = ranks.select("_g", "s", "v", (F.col("above") + 1).alias("place"), (1 - (F.col("above") + F.col("n") / 2) / F.col("total")).alias("share"))
    placed = long.join(ranks, ["_g", "s", "v"], "left")
    weight = reduce(lambda acc, kw: F.when(F.col("s") == kw[0], F.lit(float(kw[1]))).otherwise(acc), enumerate(weights), F.lit(0.0))
    wide = placed.groupBy("_g", "_i").agg(
        F.sum(weight * F.coalesce("share", F.lit(0.5))).alias("_share"), F.count("v").cast("int").alias("present"), *[F.max(F.when(F.col("s") == k, F.col("place"))).cast("long").alias(f"place_{s}") for k, s in enumerate(scores)],
    )
    wide = wide.join(sizes, "_g").withColumn("points", F.round(F.col("_share") * F.col("_size"), 9))
    order = value_ranks(wide.select("_g", F.col("points").alias("v")), ["_g"], hot_rows).select("_g", F.col("v").alias("points"), "above")
    tie = F.row_number().over(Window.partitionBy("_g", "points").orderBy("_i"))
    out = wide.join(order, ["_g", "points"]).withColumn("position", (F.col("above") + tie).cast("long"))
    return out.select(F.col("_g").alias(group), F.col("_i").alias(item), "present", "points", "position", *[f"place_{s}" for s in scores], F.col("_size").alias("n_items"))
