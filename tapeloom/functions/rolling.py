"""Rolling statistics, runs and technical indicators over bars, as window expressions; recursive ones fold over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["symbol", "threshold"]


def series(order: str = "bar_id"):
    return Window.partitionBy(*SERIES).orderBy(order)


def frame(n: int, order: str = "bar_id"):
    return series(order).rowsBetween(-n + 1, 0)


def full(value: Column, n: int, of: str, least: int | None = None, order: str = "bar_id") -> Column:
    """value, once the frame of n rows has `least` (n) values of column `of`."""
    return F.when(F.count(of).over(frame(n, order)) >= (least or n), value)


def sma(col: str, n: int, least: int | None = None) -> Column:
    return full(F.avg(col).over(frame(n)), n, col, least)


def rolling_std(col: str, n: int, least: int | None = None) -> Column:
    return full(F.stddev_samp(col).over(frame(n)), n, col, least)


def rolling_sum(col: str, n: int, least: int | None = None) -> Column:
    return full(F.sum(col).over(frame(n)), n, col, least)


def rolling_quantile(col: str, q: float, n: int, least: int | None = None) -> Column:
    return full(F.percentile(F.col(col), q).over(frame(n)), n, col, least)


def change(col: str = "close") -> Column:
    return F.col(col) - F.lag(col).over(series())


def log_return(col: str = "close") -> Column:
    return F.log(F.col(col) / F.lag(col).over(series()))


def rsi(gain: str, loss: str, n: int) -> Column:
    """Of columns of gains and losses; 100 without losses."""
    up, down = F.avg(gain).over(frame(n)), F.avg(loss).over(frame(n))
    return full(F.when(down == 0, F.lit(100.0)).otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + up / down)), n, gain)


def with_gains(bars: DataFrame, anchored: bool = False) -> DataFrame:
    """_gain and _loss of each bar's close against the one before, or against the series' first."""
    base = F.first("close").over(series().rowsBetween(Window.unboundedPreceding, 0)) if anchored else F.lag("close").over(series())
    first = F.row_number().over(series()) == 1
    return bars.withColumn("_d", F.when(~first, F.col("close") - base)).withColumn("_gain", F.greatest("_d", F.lit(0.0))).withColumn("_loss", F.greatest(-F.col("_d"), F.lit(0.0))).withColumn("_gain", F.when(F.col("_d").isNotNull(), F.col("_gain"))).withColumn("_loss", F.when(F.col("_d").isNotNull(), F.col("_loss")))


def true_range() -> Column:
    before = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def cci(n: int = 20) -> Column:
    """Commodity channel index of (high + low + close) / 3; 0 without deviation."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    values = F.collect_list(typical).over(frame(n))
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    off = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n
    return F.when(F.size(values) >= n, F.when(off == 0, F.lit(0.0)).otherwise((typical - mean) / (F.lit(0.015) * off)))


def recursive(bars: DataFrame, col: str, alpha: float, name: str, order: str = "bar_id") -> DataFrame:
    """Exponential mean x -> alpha * x + (1 - alpha) * before, seeded with the first value of each series.

    The recursion needs a series in order, so it runs over sorted partitions in Python, one number of state for a series.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    from ..operators.bars import runs, ship

    ship(bars.sparkSession)
    rows = bars.repartition(*SERIES).sortWithinPartitions(*SERIES, order)
    at = [bars.columns.index(c) for c in (*SERIES, col)]

    def run(batches):
        key, level = None, None
        for batch in batches:
            symbol, threshold, x = (batch.column(i).to_numpy(zero_copy_only=False) for i in at)
            out = np.empty(len(x))
            bounds = runs(symbol, threshold)
            for a, b in zip(bounds[:-1], bounds[1:]):
                if (symbol[a], threshold[a]) != key:
                    key, level = (symbol[a], threshold[a]), None
                for i, v in enumerate(x[a:b].tolist(), a):
                    level = v if level is None else alpha * v + (1 - alpha) * level
                    out[i] = level
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    return rows.mapInArrow(run, T.StructType([*bars.schema, T.StructField(name, T.DoubleType())]))


def ema(bars: DataFrame, n: int, col: str = "close", name: str | None = None) -> DataFrame:
    return recursive(bars, col, 2 / (n + 1), name or f"ema{n}")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    both = ema(ema(bars, fast, name="_fast"), slow, name="_slow").withColumn("macd", F.col("_fast") - F.col("_slow"))
    return ema(both, signal, "macd", "macd_signal").withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def rsi_wilder(bars: DataFrame, n: int = 14) -> DataFrame:
    gains = with_gains(bars).filter("_d is not null")
    both = recursive(recursive(gains, "_gain", 1 / n, "_up"), "_loss", 1 / n, "_down")
    return both.withColumn("rsi", F.when(F.row_number().over(series()) >= n, F.when(F.col("_down") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.col("_up") / F.col("_down"))))).drop("_d", "_gain", "_loss", "_up", "_down")


# ---------------------------------------------------------------- directions, runs, regimes


def direction(ties: str = "up") -> Column:
    return F.when(F.col("close") >= F.col("open") if ties == "up" else F.col("close") > F.col("open"), "U").otherwise("D")


def pattern(n: int, lookahead: bool = False, col: str = "direction") -> Column:
    """The directions of n bars, oldest first; with lookahead this bar and those after it, else those up to it."""
    parts = [F.lead(col, i).over(series()) if i else F.col(col) for i in range(n)] if lookahead else [F.lag(col, i).over(series()) if i else F.col(col) for i in range(n - 1, -1, -1)]
    return F.concat(*parts)


def with_run(bars: DataFrame, col: str = "direction") -> DataFrame:
    """run_id: which stretch of equal values a row is in."""
    turn = F.when(F.col(col) != F.lag(col).over(series()), 1).otherwise(0)
    return bars.withColumn("_turn", turn).withColumn("run_id", F.sum("_turn").over(series().rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_turn")


def run_lengths(bars: DataFrame, col: str = "direction") -> DataFrame:
    return with_run(bars, col).groupBy(*SERIES, "run_id", col).agg(F.count(F.lit(1)).alias("length"))


def reversal_probability(bars: DataFrame, most: int = 10, least: int = 30) -> DataFrame:
    """Of runs that reach length k, the share that ends there; the last run of a series is unfinished."""
    lengths = run_lengths(bars).withColumn("_last", F.max("run_id").over(Window.partitionBy(*SERIES))).filter("run_id < _last")
    reach = lengths.withColumn("k", F.explode(F.sequence(F.lit(1), F.least("length", F.lit(most)).cast("int"))))
    return reach.groupBy(*SERIES, "k").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("length") == F.col("k")).cast("int")).cast("long").alias("reversed")).filter(F.col("n") >= least).withColumn("p_reversal", F.col("reversed") / F.col("n"))


def trend_regime() -> Column:
    """Seven regimes of the 20 and 50 bar means and the 14 bar RSI; columns sma20, sma50, rsi14."""
    up, down = (F.col("close") > F.col("sma20")) & (F.col("sma20") > F.col("sma50")), (F.col("close") < F.col("sma20")) & (F.col("sma20") < F.col("sma50"))
    hot, cold = F.col("rsi14") > 70, F.col("rsi14") < 30
    known = F.col("sma50").isNotNull() & F.col("rsi14").isNotNull()
    return F.when(known, F.when(up & hot, "bull_hot").when(up & cold, "bull_cold").when(up, "bull_neutral").when(down & hot, "bear_hot").when(down & cold, "bear_cold").when(down, "bear_neutral").otherwise("chop"))


def level_regime(value: Column, low: Column | float, high: Column | float, names=("quiet", "active", "volatile")) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(value.isNull() | lo.isNull() | hi.isNull(), F.lit(None)).when(value < lo, names[0]).when(value > hi, names[2]).otherwise(names[1])


def rolling_correlation(rows: DataFrame, x: str, y: str, n: int = 24, least: int = 12, order: str = "hour", by: tuple = ()) -> DataFrame:
    """Mean product of deviations from the rolling means of each row's own frame, over the product of rolling deviations."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-n + 1, 0)
    means = rows.withColumn("_dx", F.col(x) - F.avg(x).over(w)).withColumn("_dy", F.col(y) - F.avg(y).over(w)).withColumn("_sx", F.stddev_samp(x).over(w)).withColumn("_sy", F.stddev_samp(y).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    cov = F.avg(F.col("_dx") * F.col("_dy")).over(w)
    return means.withColumn("rolling_corr", F.when(F.col("_n") >= least, F.when((F.col("_sx") > 0) & (F.col("_sy") > 0), cov / (F.col("_sx") * F.col("_sy"))))).drop("_dx", "_dy", "_sx", "_sy", "_n")
