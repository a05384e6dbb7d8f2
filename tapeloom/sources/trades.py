"""Trade and quote sources. Prices and volumes are held as whole numbers of 1e-8 (`*_fp`), times as microseconds UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 100_000_000
COLUMNS = ("symbol", "agg_trade_id", "price_fp", "volume_fp", "first_trade_id", "last_trade_id", "ts_us", "is_buyer_maker")
CSV_SCHEMA = "a string, p string, q string, f string, l string, t string, m string"
JSON_SCHEMA = "a long, p string, q string, f long, l long, T long, m boolean"
#: Times below this are milliseconds.
MICROS_FROM = 10_000_000_000_000
FIRST_VALID, LAST_VALID = 946_684_800_000_000, 2_082_758_400_000_000  # 2000-01-01 and 2036-01-01


def fixed(value: Column) -> Column:
    """A decimal string or number as whole 1e-8 units, halves away from zero; signs are kept for values between -1 and 0."""
    return F.round(value.cast("decimal(28,12)") * SCALE, 0).cast("long")


def micros(ts: Column) -> Column:
    return F.when(ts < MICROS_FROM, ts * 1000).otherwise(ts)


def valid_time(ts: Column) -> Column:
    return ts.between(FIRST_VALID, LAST_VALID - 1)


def individual(first: str = "first_trade_id", last: str = "last_trade_id") -> Column:
    return F.col(last) - F.col(first) + 1


def canonical(df: DataFrame, symbol: str | Column) -> DataFrame:
    """Fills what a source may lack: volume from quantity, ids from each other, maker side false. `symbol` is one name, or a
    column of df."""
    have = set(df.columns)
    pick = lambda *names: next((F.col(n) for n in names if n in have), None)
    for needed, found in (("timestamp", pick("timestamp", "ts_us")), ("price", pick("price")), ("volume", pick("volume", "quantity"))):
        if found is None:
            raise ValueError(f"column {needed} is missing")
    ts = micros(pick("timestamp", "ts_us").cast("long"))
    trade = pick("agg_trade_id")
    trade = F.monotonically_increasing_id() if trade is None else trade.cast("long")
    first, last, maker = pick("first_trade_id"), pick("last_trade_id"), pick("is_buyer_maker")
    return df.select(
        (F.lit(symbol) if isinstance(symbol, str) else symbol).alias("symbol"), trade.alias("agg_trade_id"), fixed(pick("price")).alias("price_fp"), fixed(pick("volume", "quantity")).alias("volume_fp"),
        F.coalesce(first, trade).alias("first_trade_id") if first is not None else trade.alias("first_trade_id"),
        F.coalesce(last, trade).alias("last_trade_id") if last is not None else trade.alias("last_trade_id"),
        ts.alias("ts_us"), (F.coalesce(maker.cast("boolean"), F.lit(False)) if maker is not None else F.lit(False)).alias("is_buyer_maker"),
    )


def read_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Daily trade files: 7 columns by place (more are passed over), with or without a header line. Without a symbol those of
    all, in folders symbol=..."""
    raw = spark.read.schema(CSV_SCHEMA if symbol is not None else f"{CSV_SCHEMA}, symbol string").option("mode", "PERMISSIVE").csv(path).filter(F.col("a").rlike("^[0-9]+$"))
    return canonical(raw.select(F.col("a").alias("agg_trade_id"), F.col("p").alias("price"), F.col("q").alias("volume"), F.col("f").cast("long").alias("first_trade_id"), F.col("l").cast("long").alias("last_trade_id"), F.col("t").alias("timestamp"), (F.lower(F.trim("m")) == "true").alias("is_buyer_maker"), *(["symbol"] if symbol is None else [])), F.col("symbol") if symbol is None else symbol)


def from_json(rows: DataFrame, column: str, symbol: str | Column) -> DataFrame:
    """Trades from payloads {a, p, q, f, l, T, m}. `symbol` is one name, or a column of rows."""
    x = rows.select(F.from_json(column, JSON_SCHEMA).alias("j"), (F.lit(symbol) if isinstance(symbol, str) else symbol).alias("_symbol")).select("j.*", "_symbol")
    return canonical(x.select(F.col("a").alias("agg_trade_id"), F.col("p").alias("price"), F.col("q").alias("volume"), F.col("f").alias("first_trade_id"), F.col("l").alias("last_trade_id"), F.col("T").alias("timestamp"), F.col("m").alias("is_buyer_maker"), "_symbol"), F.col("_symbol"))


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    """Monthly quote files with a header: provider, symbol, time, bid, ask."""
    raw = spark.read.schema("provider string, symbol string, time timestamp, bid double, ask double").option("header", True).csv(path)
    return raw.select("symbol", F.unix_micros("time").alias("ts_us"), "bid", "ask")


def hour_chunk(ts: Column, hours: int = 6) -> Column:
    """Start, in microseconds, of the slice of a day that a time falls in."""
    day, step = 86_400_000_000, hours * 3_600_000_000
    inside = F.pmod(ts, F.lit(day))
    return ts - inside + F.floor(inside / step).cast("long") * step


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verified(digests: DataFrame, expected: DataFrame) -> DataFrame:
    """digests with `ok`: whether the expected (name, sha256) agrees; null where none is expected."""
    want = expected.select(F.col("name"), F.lower("sha256").alias("_want"))
    return digests.join(want, F.element_at(F.split("path", "/"), -1) == F.col("name"), "left").select("path", "length", "sha256", (F.col("sha256") == F.col("_want")).alias("ok"))


class TickStore:
    """Trades as Parquet by symbol and month. Appends drop ids that are there; reads prune months."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, trades: DataFrame) -> None:
        rows = trades.dropDuplicates(["symbol", "agg_trade_id"]).withColumn("year_month", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM"))
        try:
            there = self.spark.read.parquet(self.path).select("symbol", "agg_trade_id", "year_month")
        except Exception as missing:  # the first append
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            there = None
        if there is not None:  # a trade stands in the month of its time, so only the months at hand are read
            first, last = rows.agg(F.min("year_month"), F.max("year_month")).first()
            rows = rows.join(there.filter(F.col("year_month").between(first, last)).drop("year_month"), ["symbol", "agg_trade_id"], "left_anti")
        rows.repartition("symbol", "year_month").sortWithinPartitions("symbol", "ts_us", "agg_trade_id").write.mode("append").partitionBy("symbol", "year_month").parquet(self.path)

    def read(self, symbol: str | None, start_us: int, end_us: int) -> DataFrame:
        """Trades of one symbol, or of all (None)."""
        month = lambda us: F.date_format(F.timestamp_micros(F.lit(us)), "yyyy-MM")
        rows = self.spark.read.parquet(self.path).filter((F.lit(True) if symbol is None else F.col("symbol") == symbol) & F.col("year_month").between(month(start_us), month(end_us)) & F.col("ts_us").between(start_us, end_us))
        return rows.select(*COLUMNS)

    def coverage(self, start_us: int, end_us: int) -> DataFrame:
        """Of each symbol, the share of the asked time that its trades span."""
        rows = self.spark.read.parquet(self.path).filter(F.col("ts_us").between(start_us, end_us))
        return rows.groupBy("symbol").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count(F.lit(1)).alias("n_trades")).withColumn("coverage", (F.col("last_us") - F.col("first_us")) / F.lit(end_us - start_us))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades derived from the `events` table: each event type is a symbol whose price walks by its values."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    walk = F.sum((F.col("cents") - 4963) * 250_000).over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    return e.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("agg_trade_id"), (F.lit(1_000_000_000_000) + walk).alias("price_fp"), (F.col("cents") * 1_000_000).alias("volume_fp"),
        (F.col("event_id") * 3).alias("first_trade_id"), (F.col("event_id") * 3 + F.col("event_id") % 3).alias("last_trade_id"), F.unix_micros("ts").alias("ts_us"), (F.col("event_id") % 2 == 0).alias("is_buyer_maker"),
    )


def whole_parquet(spark: SparkSession, path: str) -> DataFrame:
    """path, length and `ok` of each Parquet file: whether it begins and ends as one must."""
    mark = F.lit(b"PAR1")
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", ((F.col("length") >= 12) & (F.substring("content", 1, 4) == mark) & (F.substring("content", -4, 4) == mark)).alias("ok"))
