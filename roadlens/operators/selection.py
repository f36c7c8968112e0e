"""Exact order statistics without a sort: ranks are found by counting, in intervals that narrow from pass to pass."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


def at_ranks(df: DataFrame, value: str, ranks: dict, group: str | None = None) -> dict:
    """{(group, rank): the value at that rank (from 0, ascending, nulls left out)}. ranks: {group: its ranks}; one group None without a group column.

    A pass counts the values of each interval in BUCKETS equal parts, in one aggregation for all ranks together; the part that holds a
    rank is the next interval, from its least to its greatest value. It ends when these are equal. Only counts reach the driver: BUCKETS rows for each rank at most.
    """
    spark = df.sparkSession
    g = F.lit("") if group is None else F.col(group)
    t = df.select(g.cast("string").alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    name = lambda k: "" if group is None else str(k)
    ends = {r["g"]: (r["n"], r["lo"], r["hi"]) for r in t.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    found, open_ = {}, {}
    for k, wanted in ranks.items():
        for rank in wanted:
            n, lo, hi = ends.get(name(k), (0, None, None))
            if 0 <= rank < n:
                open_[k, rank] = (rank, lo, hi)
    while open_:
        for key, (_, lo, hi) in list(open_.items()):
            if lo == hi:
                found[key] = lo
                del open_[key]
        if not open_:
            break
        keys = list(open_)
        asked = spark.createDataFrame([(i, name(k[0]), open_[k][1], open_[k][2]) for i, k in enumerate(keys)], "i int, g string, lo double, hi double")
        inside = t.join(F.broadcast(asked), "g").filter("v between lo and hi")
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS), F.lit(BUCKETS - 1))  # halves can't overflow
        counted = inside.groupBy("i", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for i, key in enumerate(keys):
            left = open_[key][0]
            for r in sorted((r for r in counted if r["i"] == i), key=lambda r: r["part"]):
                if left < r["n"]:
                    open_[key] = (left, r["lo"], r["hi"])
                    break
                left -= r["n"]
    return found


def quantiles(df: DataFrame, shares: dict[str, list[float]]) -> dict[tuple[str, float], float | None]:
    """{(column, share): its value} by linear interpolation between neighbours; None where a column has no values."""
    out = {}
    for column, wanted in shares.items():
        n = df.select(F.count(F.when(~F.isnan(F.col(column).cast("double")), 1))).first()[0]
        if not n:
            out |= {(column, q): None for q in wanted}
            continue
        places = {q: q * (n - 1) for q in wanted}
        at = at_ranks(df, column, {None: sorted({f(x) for x in places.values() for f in (math.floor, math.ceil)})})
        for q, x in places.items():
            lo, hi = math.floor(x), math.ceil(x)
            out[column, q] = at[None, lo] if lo == hi else (hi - x) * at[None, lo] + (x - lo) * at[None, hi]
    return out
