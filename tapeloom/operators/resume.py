"""Bars that go on where earlier ones ended, and their population chunk by chunk.

The state of a key is its last bar as `aggregated` gives it: a complete one says that the next trade opens a bar, a forming one
holds all that its end needs. It is a table like any other; a batch joins it by key, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plugins import emit
from .bars import BAR, KEYS, aggregated, assigned, calendar_segment, priced, with_vwap
from .quality import last_n, latest

CARRY = ("volume_fp", "first_trade_id", "last_trade_id", "is_buyer_maker")
OPENING = ("open_fp", "open_time", "first_trade_id", "first_agg_trade_id")
CLOSING = ("close_fp", "close_time", "last_trade_id", "last_agg_trade_id", "is_complete", "data_source")
SUMS = ("volume_fp", "buy_volume_fp", "sell_volume_fp", "turnover_fp", "buy_turnover_fp", "sell_turnover_fp", "individual_trade_count", "agg_record_count", "buy_trade_count", "sell_trade_count")
HOUR = 3_600_000_000


def tails(bars: DataFrame) -> DataFrame:
    """The last bar of each symbol and threshold. Segments come in the order of time, so one that is over needs no state."""
    whole = F.struct(*[F.col(c) for c in bars.columns])
    return bars.groupBy("symbol", "threshold").agg(F.max_by(whole, F.struct("segment", "bar_id")).alias("_b")).select("_b.*")


def continued(trades: DataFrame, before: DataFrame | None, thresholds: Sequence[int] = (250,), segment: str | None = None, gate: bool = True, most_gap_us: int | None = HOUR) -> DataFrame:
    """Bars, as of `aggregated`, that trades end or open after the state `before` (None: no state). A forming bar that no trade
    came to is as it was; one whose next trade is later than `most_gap_us` (None: never) is dropped."""
    mode = calendar_segment(F.col("ts_us"), segment) if segment else None
    new = aggregated(assigned(trades, thresholds, mode, gate, CARRY, before, most_gap_us))
    if before is None:
        return new
    old = before.filter("not is_complete").select(*BAR, *[F.col(c).alias(f"_{c}") for c in before.columns if c not in BAR])
    both = new.join(old, BAR, "full")
    late = F.lit(False) if most_gap_us is None else F.col("open_time") - F.col("_close_time") > most_gap_us
    held = lambda c: F.when(~F.coalesce(late, F.lit(False)), F.col(f"_{c}"))
    merged = both.select(
        *BAR, *[F.coalesce(held(c), F.col(c)).alias(c) for c in OPENING], *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in CLOSING],
        F.greatest(held("high_fp"), "high_fp").alias("high_fp"), F.least(held("low_fp"), "low_fp").alias("low_fp"),
        *[(F.coalesce(held(c), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))).cast(new.schema[c].dataType).alias(c) for c in SUMS],
    )
    return with_vwap(merged).select(*new.columns)


def chunks(start_us: int, end_us: int, unit: str) -> Iterator[tuple[int, int]]:
    """Days, weeks from Sunday or calendar months (UTC) that meet a time from start_us up to, but without, end_us: first and next one's first."""
    if unit not in ("day", "week", "month"):
        raise ValueError(f"unit {unit}")
    day = 86_400_000_000
    at = start_us // day * day
    if unit == "week":
        at -= (at // day + 4) % 7 * day  # 1970-01-01 was a Thursday
    if unit == "month":
        first = datetime.fromtimestamp(start_us // 1_000_000, UTC)
        year, month = first.year, first.month
        at = int(datetime(year, month, 1, tzinfo=UTC).timestamp()) * 1_000_000
    while at < end_us:
        after = at + (7 * day if unit == "week" else day)
        if unit == "month":
            year, month = (year, month + 1) if month < 12 else (year + 1, 1)
            after = int(datetime(year, month, 1, tzinfo=UTC).timestamp()) * 1_000_000
        yield at, after
        at = after


class Population:
    """Bars below a folder, built chunk by chunk in the order of time.

    A chunk's bars are written first, then the state after it, then its line of progress; a chunk without that line has not been
    built, whatever its folders hold, and is written anew. So a run that was lost goes on with the chunk it was lost in.
    `most_gap_us` as in `continued`.
    """

    def __init__(self, spark: SparkSession, path: str, thresholds: Sequence[int] = (250,), segment: str | None = None, gate: bool = True, most_gap_us: int | None = HOUR):
        self.spark, self.path, self.thresholds, self.segment, self.gate, self.most_gap_us = spark, path, tuple(thresholds), segment, gate, most_gap_us

    def progress(self) -> DataFrame | None:
        """chunk, until, n_bars (complete) and n_forming of what has been built; None before anything has."""
        try:
            return self.spark.read.parquet(f"{self.path}/progress/chunk=*").select("chunk", "until", "n_bars", "n_forming")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None

    def reached(self) -> tuple[int, int] | None:
        """The last chunk that has been built, and where it ends."""
        done = self.progress()
        return None if done is None else tuple(done.agg(F.max("chunk"), F.max("until")).first())

    def run(self, read: Callable[[int, int], DataFrame], start_us: int, end_us: int, unit: str = "month", most: int | None = None, told: Callable[..., None] | None = None) -> int:
        """Builds the chunks from start_us to end_us that are missing, at most `most` of them; how many it built. `read` gives
        the trades from one time up to and with another. `told` is called with each chunk's progress."""
        at, n = self.reached(), 0
        if at is not None and next(chunks(start_us, end_us, unit), (start_us,))[0] > at[1]:
            raise ValueError("trades between the last chunk and these would be missing")
        for first, after in chunks(start_us, end_us, unit):
            if at is not None and first < at[1]:
                continue
            if n == most:
                break
            before = None if at is None else self.spark.read.parquet(f"{self.path}/tails/chunk={at[0]}")
            made = continued(read(first, after - 1), before, self.thresholds, self.segment, self.gate, self.most_gap_us)
            self._write(made, "bars", first)
            made = self.spark.read.parquet(f"{self.path}/bars/chunk={first}")
            self._write(tails(made if before is None else made.unionByName(before.filter("is_complete"))), "tails", first)
            found = made.agg(F.lit(first).alias("chunk"), F.lit(after).alias("until"), F.count_if("is_complete").alias("n_bars"), F.count_if(~F.col("is_complete")).alias("n_forming"))
            self._write(found, "progress", first)
            at, n = (first, after), n + 1
            emit("chunk_built", path=self.path, chunk=first, until=after)
            if told is not None:
                told(chunk=first, until=after)
        return n

    def _write(self, rows: DataFrame, kind: str, chunk: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/chunk={chunk}")

    def bars(self, include_incomplete: bool = False) -> DataFrame:
        """Bars with prices and features of all chunks that have been built; with the forming ones, each key's last and those
        that ended with their segment."""
        at = self.reached()
        if at is None:
            raise ValueError("nothing has been built")
        rows = self.spark.read.option("basePath", f"{self.path}/bars").parquet(f"{self.path}/bars").filter(F.col("chunk") <= at[0])
        if include_incomplete:
            return priced(latest(rows, BAR, "chunk"))
        return priced(rows.filter("is_complete"))

    def last_bars(self, n: int, read: Callable[[int, int], DataFrame], start_us: int, end_us: int, unit: str = "month") -> DataFrame:
        """The last n complete bars of each symbol and threshold, after building what is missing up to end_us."""
        self.run(read, start_us, end_us, unit)
        return last_n(self.bars(), n)
