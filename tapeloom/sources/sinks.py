"""Where bars go: a versioned Parquet store, panels, Arrow files, and what may not be stored."""

from __future__ import annotations

import io

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import BAR, ship
from ..operators.quality import latest
from ..plugins import emit


def storable() -> Column:
    """Times, price bounds, volume, counts and ids of a bar are as they must be."""
    return (F.col("close_time") > F.col("open_time")) & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.col("volume") > 0) & (F.col("individual_trade_count") > 0) & (F.col("last_trade_id") >= F.col("first_trade_id"))


def split_bad(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars that may be stored, and the dead letters with the reason."""
    reason = F.when(F.col("volume") < 0, "negative volume").when(F.col("high") < F.col("low"), "high under low").when(F.col("close_time") < F.col("open_time"), "closes before it opens")
    marked = bars.withColumn("_reason", reason)
    return marked.filter("_reason is null").drop("_reason"), marked.filter("_reason is not null").withColumnRenamed("_reason", "reason")


NEEDED = ("symbol", "threshold", "open_time", "close_time", "open", "high", "low", "close", "volume", "individual_trade_count", "first_trade_id", "last_trade_id")


def from_frame(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars from a frame that was written elsewhere: those that hold together, and the others with the reason."""
    missing = [c for c in NEEDED if c not in rows.columns]
    if missing:
        raise ValueError(f"column {', '.join(missing)} is missing")
    fault = F.when(F.expr(" or ".join(f"{c} is null" for c in NEEDED)), "null")
    for bad, reason in (("close_time <= open_time", "time"), ("high < greatest(open, close) or low > least(open, close)", "prices"), ("volume <= 0", "volume"), ("individual_trade_count <= 0", "count"), ("last_trade_id < first_trade_id", "ids")):
        fault = fault.when(F.expr(bad), reason)
    marked = rows.withColumn("reason", fault)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


class BarStore:
    """Bars as Parquet by generation, mode, symbol and threshold; a table of deletions, one of tokens and one of generations lie
    beside it.

    Writes append a version; reads take each bar's latest that no deletion of that version or a later one meets. `mode` names how
    the bars were cut (no segments, month, ...): a series has one, and a write of another raises. `compact` writes what can
    still be read as the next generation, and reads turn to it once its line is there.
    """

    def __init__(self, spark: SparkSession, path: str, mode: str = "none"):
        self.spark, self.path, self.mode = spark, path, mode

    def _beside(self, kind: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}-{kind}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def _note(self, kind: str, schema: str, *row) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.path}-{kind}")

    def generation(self) -> int:
        return self._beside("generations", "generation int").agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]

    def _rows(self) -> DataFrame | None:
        try:
            rows = self.spark.read.parquet(self.path)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            return None
        return rows.filter(F.col("generation") == self.generation())

    def write(self, bars: DataFrame, version: int, token: str | None = None) -> bool:
        """Appends the bars that may be stored. A token that has been written is passed over (False); one whose write was lost
        midway is written again, and reads take one row of each bar all the same."""
        if token is not None and not self._beside("tokens", "token string").filter(F.col("token") == token).isEmpty():
            return False
        good, _ = split_bad(bars)
        there = self._rows()
        if there is not None:
            other = there.filter(F.col("mode") != self.mode).select("symbol", "threshold", "mode").distinct().join(good.select("symbol", "threshold").distinct(), ["symbol", "threshold"]).first()
            if other is not None:
                raise ValueError(f"{other.symbol} at {other.threshold} is stored in mode {other['mode']}, not {self.mode}")
        self._append(good.withColumn("computed_at", F.lit(version).cast("long")), self.generation())
        if token is not None:
            self._note("tokens", "token string", token)
        emit("bars_stored", path=self.path, version=version)
        return True

    def _append(self, rows: DataFrame, generation: int) -> None:
        rows = rows.withColumns({"generation": F.lit(generation), "mode": F.lit(self.mode) if "mode" not in rows.columns else F.col("mode")})
        month = F.date_trunc("month", F.timestamp_micros("close_time"))  # deals a symbol with many bars over tasks
        rows.repartition("symbol", "threshold", month).write.mode("append").partitionBy("generation", "mode", "symbol", "threshold").parquet(self.path)

    def invalidate(self, symbol: str, version: int, threshold: int | None = None, start_us: int = 0, end_us: int = 1 << 62) -> None:
        """Deletes the bars of a symbol (of one threshold, or all) that open from start_us to end_us, up to that version."""
        self._note("deleted", "symbol string, threshold int, start_us long, end_us long, version long", symbol, threshold, start_us, end_us, version)
        emit("bars_deleted", path=self.path, symbol=symbol)

    def _live(self) -> DataFrame:
        rows, gone = self._rows(), self._beside("deleted", "symbol string, threshold int, start_us long, end_us long, version long").alias("g")
        if rows is None:
            raise ValueError("nothing is stored")
        meets = (F.col("r.symbol") == F.col("g.symbol")) & (F.col("g.threshold").isNull() | (F.col("r.threshold") == F.col("g.threshold"))) & F.col("r.open_time").between(F.col("g.start_us"), F.col("g.end_us")) & (F.col("r.computed_at") <= F.col("g.version"))
        return rows.alias("r").join(gone, meets, "left_anti")

    def read(self, since: int | None = None, until: int | None = None, least_version: int | None = None, mode: str | None = None) -> DataFrame:
        """Bars that close from `since` to `until`, of versions from least_version, of one mode or all."""
        rows = self._live()
        for given, keep in ((since, F.col("close_time") >= since), (until, F.col("close_time") <= until), (least_version, F.col("computed_at") >= least_version), (mode, F.col("mode") == mode)):
            if given is not None:
                rows = rows.filter(keep)
        return latest(rows, BAR, "computed_at").drop("computed_at", "generation", "mode")

    def compact(self, now_us: int | None = None, keep_us: int | None = None) -> None:
        """Writes the latest version of each bar that is not deleted as a generation of its own; with keep_us only bars that
        closed within that time before now_us. Writes meanwhile are not seen: one writer at a time."""
        rows, after = self._live(), self.generation() + 1
        if keep_us is not None:
            rows = rows.filter(F.col("close_time") >= now_us - keep_us)
        self._append(latest(rows, BAR, "computed_at").drop("generation"), after)
        self._note("generations", "generation int", after)


def panel(bars: DataFrame, features: list[str]) -> DataFrame:
    """ts, symbol, price.* and feature.* columns."""
    return bars.select(F.col("close_time").alias("ts"), "symbol", *[F.col(c).alias(f"price.{c}") for c in ("open", "high", "low", "close", "volume")], *[F.col(f).alias(f"feature.{f}") for f in features])


def backtest(bars: DataFrame) -> DataFrame:
    return bars.select(F.timestamp_micros("close_time").alias("Date"), *[F.col(c).alias(c.capitalize()) for c in ("open", "high", "low", "close", "volume")])


def to_arrow_files(bars: DataFrame, by: str = "symbol") -> DataFrame:
    """by, n, body: each batch of rows as an Arrow IPC stream."""
    ship(bars.sparkSession)
    at = bars.columns.index(by)

    def run(batches):
        for batch in batches:
            keys = batch.column(at)
            for key in sorted(keys.unique().drop_null().to_pylist()):
                part = batch.filter(pc.equal(keys, key))
                body = io.BytesIO()
                with pa.ipc.new_stream(body, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part.num_rows]), pa.array([body.getvalue()])], [by, "n", "body"])

    return bars.mapInArrow(run, f"{by} string, n long, body binary")


def arrow_sizes(bars: DataFrame) -> DataFrame:
    """Rows of each symbol as read back from Arrow streams."""
    ship(bars.sparkSession)

    def run(batches):
        for batch in batches:
            n = [pa.ipc.open_stream(b).read_all().num_rows for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["symbol", "n"])

    return to_arrow_files(bars).select("symbol", "body").mapInArrow(run, "symbol string, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
