"""Bars from a stream: the forming bar of each symbol and threshold is the state that lives between micro-batches.

Trades of a micro-batch are sorted by time and id within their key. What arrives before the last trade of its key is late: it
comes out with `late` set instead of changing a bar. State is lossless, so any split of a stream gives the bars of a batch.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bars import Walk, ship

STATE = "bar long, open_price long, open_ts long, last_ts long, last_id long, open_time long, close_time long, open_fp long, high_fp long, low_fp long, close_fp long, volume_fp long, buy_volume_fp long, trades long, records long, first_trade_id long, last_trade_id long"
OUT = "symbol string, threshold int, bar_id long, open_time long, close_time long, open_fp long, high_fp long, low_fp long, close_fp long, volume_fp long, buy_volume_fp long, sell_volume_fp long, individual_trade_count long, agg_record_count long, first_trade_id long, last_trade_id long, late boolean"


def _fold(gate: bool):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        symbol, threshold = key
        old = state.get if state.exists else (-1, None, 0, -(1 << 62), -1, *[None] * 12)
        walk = Walk(int(threshold), gate, old[0], old[1], old[2])
        last, forming = (old[3], old[4]), list(old[5:])
        new = pd.concat(list(frames)).sort_values(["ts_us", "agg_trade_id"])
        late = (new["ts_us"] < last[0]) | ((new["ts_us"] == last[0]) & (new["agg_trade_id"] <= last[1]))
        rows = [(symbol, threshold, -1, r.ts_us, r.ts_us, r.price_fp, r.price_fp, r.price_fp, r.price_fp, r.volume_fp, 0, 0, 0, 1, r.first_trade_id, r.last_trade_id, True) for r in new[late].itertuples()]
        new = new[~late]
        if len(new):
            price, ts, volume = (new[c].to_numpy() for c in ("price_fp", "ts_us", "volume_fp"))
            buy = np.where(new["is_buyer_maker"].to_numpy(bool), 0, volume)
            first, final = new["first_trade_id"].to_numpy(), new["last_trade_id"].to_numpy()
            ids, closes = walk.take(price, ts)
            cuts = np.flatnonzero(np.diff(ids)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                p, n = price[a:b], int((final[a:b] - first[a:b] + 1).sum())
                piece = [int(ts[a]), int(ts[b - 1]), int(p[0]), int(p.max()), int(p.min()), int(p[-1]), int(volume[a:b].sum()), int(buy[a:b].sum()), n, int(b - a), int(first[a]), int(final[b - 1])]
                f = forming
                forming = piece if f[0] is None else [f[0], piece[1], f[2], max(f[3], piece[3]), min(f[4], piece[4]), piece[5], f[6] + piece[6], f[7] + piece[7], f[8] + piece[8], f[9] + piece[9], f[10], piece[11]]
                if closes[b - 1]:
                    g = forming
                    rows.append((symbol, threshold, int(ids[a]), *g[:7], g[7], g[6] - g[7], g[8], g[9], g[10], g[11], False))
                    forming = [None] * 12
            last = (int(ts[-1]), int(new["agg_trade_id"].iloc[-1]))
        state.update((walk.bar, walk.open_price, walk.open_ts, *last, *forming))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return run


def streaming_bars(trades: DataFrame, thresholds: Sequence[int] = (250,), gate: bool = True) -> DataFrame:
    """Complete bars (and late trades) of a streaming DataFrame of trades."""
    ship(trades.sparkSession)
    keyed = trades.withColumn("threshold", F.explode(F.array(*[F.lit(int(t)) for t in thresholds])))
    return keyed.groupBy("symbol", "threshold").applyInPandasWithState(_fold(gate), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def _as_stream(spark: SparkSession, trades: DataFrame, folder: str, slices: int, only: range | None = None) -> DataFrame:
    """The trades (those of `only` some slices) written in order as a few files, read as a stream of one file at a time: what a
    micro-batch holds is bounded however much waits."""
    bounds = trades.agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b")).first()
    width = max(1, (bounds.b - bounds.a) // slices + 1) if bounds.a is not None else 1
    for k in only or range(slices):
        part = trades.filter(F.floor((F.col("ts_us") - F.lit(bounds.a)) / width) == k)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in")


def _drained(frame: DataFrame, folder: str, mode: str, run: str | None = None) -> str:
    """Runs a stream until its input is used up; each batch goes to its own folder, so that a repeated batch replaces itself.
    The same `run` goes on where it stopped."""
    run = run or uuid.uuid4().hex
    out = f"{folder}/out-{run}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state-{run}").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return out


def replayed_bars(spark: SparkSession, trades: DataFrame, folder: str, thresholds: Sequence[int] = (250,), slices: int = 3) -> DataFrame:
    """Bars of recorded trades by way of the stream."""
    out = _drained(streaming_bars(_as_stream(spark, trades, folder, slices), thresholds), folder, "append")
    return spark.read.parquet(out).filter("not late").drop("batch", "late")


def restarted_bars(spark: SparkSession, trades: DataFrame, folder: str, thresholds: Sequence[int] = (250,), slices: int = 4) -> DataFrame:
    """Bars of a stream that is stopped half way and started again with its checkpoint: forming bars live in its state."""
    for part in (range(slices // 2), range(slices // 2, slices)):
        stream = _as_stream(spark, trades, folder, slices, part)
        out = _drained(streaming_bars(stream, thresholds), folder, "append", "run")
    return spark.read.parquet(out).filter("not late").drop("batch", "late")


def batch_sizes(spark: SparkSession, trades: DataFrame, folder: str, slices: int = 4) -> DataFrame:
    """batch, n: the trades of each micro-batch of a stream whose whole input waits from the start."""
    out = _drained(_as_stream(spark, trades, folder, slices).select("symbol", "agg_trade_id"), folder, "append")
    return spark.read.parquet(out).groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n"))


def windowed(trades: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", session: str | None = None) -> DataFrame:
    """Trades of a stream by symbol and window of time: tumbling, sliding by `slide`, or sessions that end with a pause of
    `session`. A window comes out once the watermark, the newest time of the micro-batches before less `delay`, has passed its
    end, and its state goes with it; trades that come for a window that is out are passed over."""
    at = F.col("_at")
    window = F.session_window(at, session) if session else F.window(at, width, slide) if slide else F.window(at, width)
    rows = trades.withColumn("_at", F.timestamp_micros("ts_us")).withWatermark("_at", delay)
    sums = rows.groupBy("symbol", window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("volume_fp").alias("volume_fp"), F.min("price_fp").alias("low_fp"), F.max("price_fp").alias("high_fp"))
    return sums.select("symbol", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n", "volume_fp", "low_fp", "high_fp")


def replayed_windows(spark: SparkSession, trades: DataFrame, folder: str, slices: int = 3, **how) -> DataFrame:
    """The windows that recorded trades end, by way of the stream."""
    return spark.read.parquet(_drained(windowed(_as_stream(spark, trades, folder, slices), **how), folder, "append")).drop("batch")


def replayed_stats(spark: SparkSession, trades: DataFrame, folder: str, slices: int = 3) -> DataFrame:
    """Running statistics of each symbol at the end of the stream."""
    stream = _as_stream(spark, trades, folder, slices)
    out = _drained(stream.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("price_fp").alias("lowest"), F.max("price_fp").alias("highest")), folder, "complete")
    batches = spark.read.parquet(out)
    return batches.join(batches.agg(F.max("batch").alias("batch")), "batch").drop("batch")


def since(trades: DataFrame, minutes: float) -> DataFrame:
    """The trades of each symbol's last minutes, to replay."""
    from pyspark.sql import Window

    newest = F.max("ts_us").over(Window.partitionBy("symbol"))
    return trades.withColumn("_newest", newest).filter(F.col("ts_us") >= F.col("_newest") - int(minutes * 60_000_000)).drop("_newest")


def progress(query) -> dict:
    """Rows and batches of a running or ended stream."""
    done = [p for p in query.recentProgress]
    return {"batches": len(done), "rows_in": sum(p["numInputRows"] for p in done), "state_rows": max([s["numRowsTotal"] for p in done for s in p["stateOperators"]], default=0)}


def into_store(spark: SparkSession, bars: DataFrame, path: str, checkpoint: str):
    """Starts writing a stream of bars to a bar store. A batch's number is its version, so a batch that is repeated after a
    failure replaces itself when it is read; bars that may not be stored go to the dead letters beside it, and so does a batch
    that can't be written in four attempts (waits of 1, 2 and 4 seconds), for `replay_dead`."""
    from ..sources.paged import retried
    from ..sources.sinks import BarStore, split_bad

    store, run = BarStore(spark, path), f"r{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"

    def keep(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read several times; the state behind it is to be folded once
        try:
            kept(batch, number)
        finally:
            batch.unpersist()

    def kept(batch: DataFrame, number: int) -> None:
        known = batch.filter("not late").drop("late").withColumn("segment", F.lit(0).cast("long"))
        priced = known.select("*", *[(F.col(f"{c}_fp") / F.lit(1e8)).alias(c) for c in ("open", "high", "low", "close", "volume")])
        good, bad = split_bad(priced)
        try:
            retried(lambda: store.write(good, version=number, token=f"{run} {number}"), times=4)
        except Exception as failure:
            bad = bad.unionByName(good.withColumn("reason", F.lit(f"{UNWRITTEN}{type(failure).__name__}")))
        bad.write.mode("overwrite").parquet(f"{path}-dead/run={run}/batch={number}")

    return bars.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()


UNWRITTEN = "not written: "


def replay_dead(spark: SparkSession, path: str) -> int:
    """Writes the batches that could not be written to the store again; how many of them it had not held."""
    from ..sources.sinks import BarStore

    dead, store = spark.read.option("basePath", f"{path}-dead").parquet(f"{path}-dead").filter(F.col("reason").startswith(UNWRITTEN)), BarStore(spark, path)
    lost = sorted((r.run, r.batch) for r in dead.select("run", "batch").distinct().collect())  # one row for each failed batch
    return sum(store.write(dead.filter((F.col("run") == run) & (F.col("batch") == n)).drop("run", "batch", "reason"), version=n, token=f"{run} {n}") for run, n in lost)
