"""Joins that ordered data needs and a plain equi-join doesn't express."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], values: list[str], suffix: str = "") -> DataFrame:
    """For each left row the last right row at or before it, of the same `by`; null without one.

    One union and one window over `by`, so each side is sorted once and no pairs arise. Of right rows at one time the last by
    their values counts.
    """
    names = [f"{v}{suffix}" for v in values]
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    l = left.select(*by, F.col(left_on).alias("_at"), F.lit(1).alias("_side"), row.alias("_row"))
    r = right.select(*by, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.struct(*[F.col(v).alias(n) for v, n in zip(values, names)]).alias("_match"))
    both = l.withColumn("_match", F.lit(None).cast(r.schema["_match"].dataType)).unionByName(r.withColumn("_row", F.lit(None).cast(l.schema["_row"].dataType)))
    w = Window.partitionBy(*by).orderBy("_at", "_side", F.col("_match").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_match", ignorenulls=True).over(w)).filter("_side = 1")
    return found.select("_row.*", *[F.col(f"_found.{n}").alias(n) for n in names])


def next_match(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], values: list[str]) -> DataFrame:
    """For each left row the first right row strictly after it."""
    flip = lambda d, c: d.withColumn("_neg", -F.col(c) - (F.lit(1) if d is left else F.lit(0)))  # noqa: E731  an as-of join of mirrored time, one unit on
    return asof(flip(left, left_on), flip(right, right_on), "_neg", "_neg", by, values).drop("_neg")


def within_ranges(rows: DataFrame, ranges: DataFrame, at: str, start: str, end: str, by: list[str], most: int = 10_000) -> DataFrame:
    """Left join of rows to the registered ranges that hold them. Ranges are a hand-kept list; it is broadcast only if its
    count, checked here, is `most` or less, and meets by key otherwise."""
    small = ranges.limit(most + 1).count() <= most
    r = F.broadcast(ranges) if small else ranges
    same = [rows[b] == ranges[b] for b in by]
    cond = (rows[at] >= ranges[start]) & (rows[at] <= ranges[end])
    for s in same:
        cond = cond & s
    return rows.join(r, cond, "left").drop(*[ranges[b] for b in by])
