"""Current rows: of several rows with one key, the one with the latest time column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, keys: list[str], time_col: str, cols: dict[str, Column] | None = None) -> DataFrame:
    """One row per non-null key with the columns in `cols` (default: all others) of its latest row.

    Ties on the time go to the greatest remaining values, a null time loses to any other; both make the choice
    independent of row order. A max-aggregate combines on the map side, so neither exact copies nor a hot key
    reach one task as rows. `cols` may hold narrower expressions (a length, a condition) so that wide text which
    is not needed is never shuffled.
    """
    rest = {c: F.col(f"`{c}`") for c in df.columns if c not in (*keys, time_col)} if cols is None else cols
    picked = F.struct(F.col(f"`{time_col}`").alias("_at"), *[e.alias(n) for n, e in rest.items()])
    df = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    out = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max(picked).alias("_cur"))
    return out.select(*[F.col(f"`{k}`") for k in keys], F.col("_cur._at").alias(time_col), *[F.col(f"_cur.`{n}`").alias(n) for n in rest])
