"""Bars of quotes, with their spreads, and fingerprints of recent prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bars as B


def quotes_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes derived from `events`: a walk of the middle with a spread."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    mid = F.lit(1_000_000) + F.sum(F.col("cents") - 4963).over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    half = F.lit(50) + F.pmod("cents", F.lit(97))
    return e.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("quote_id"), F.unix_micros("ts").alias("ts_us"), ((mid - half) / 10_000).alias("bid"), ((mid + half) / 10_000).alias("ask"))


def valid_quote(most: float = 0.1) -> Column:
    """Positive, uncrossed and no wider than `most` of the middle."""
    return (F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("bid") <= F.col("ask")) & (F.col("ask") - F.col("bid") <= most * (F.col("bid") + F.col("ask")) / 2)


def spread_bars(quotes: DataFrame, threshold: int = 250, most: float = 0.1) -> DataFrame:
    """Bars of the middle price; volume is none, and spreads are those of all its quotes, the closing one too."""
    fp = lambda c: F.round(c * 100_000_000).cast("long")
    ticks = quotes.filter(valid_quote(most)).select("symbol", "ts_us", F.col("quote_id").alias("agg_trade_id"), fp((F.col("bid") + F.col("ask")) / 2).alias("price_fp"), fp(F.col("ask") - F.col("bid")).alias("spread_fp"))
    order = F.struct("ts_us", "agg_trade_id")
    out = B.assigned(ticks, (threshold,)).groupBy(*B.BAR).agg(
        F.min_by("price_fp", order).alias("open_fp"), F.max("price_fp").alias("high_fp"), F.min("price_fp").alias("low_fp"), F.max_by("price_fp", order).alias("close_fp"), F.min("ts_us").alias("open_time"), F.max("ts_us").alias("close_time"),
        F.min("spread_fp").alias("spread_min_fp"), F.max("spread_fp").alias("spread_max_fp"), F.expr("sum(spread_fp) div count(1)").alias("spread_avg_fp"), F.count(F.lit(1)).alias("tick_count"), F.max("closes").alias("is_complete"),
    )
    return out.filter("is_complete").drop("is_complete")


def price_hash(trades: DataFrame, last: int = 8) -> DataFrame:
    """A fingerprint of each symbol's last prices, to tell whether a restart goes on from the same place."""
    w = Window.partitionBy("symbol").orderBy(F.col("ts_us").desc(), F.col("agg_trade_id").desc())
    recent = trades.withColumn("_n", F.row_number().over(w))
    prices = F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") <= last, F.struct("_n", "price_fp")))), lambda x: x["price_fp"])
    return recent.groupBy("symbol").agg(prices.alias("prices"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= last).select("symbol", F.xxhash64("prices").alias("price_hash"), "prices", "n")
