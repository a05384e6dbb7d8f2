"""Summaries and research queries over bars."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions import series as N
from ..functions.tests import correlation
from . import joins as J
from .bars import FEATURES
from .quality import plausible

BY = ("symbol", "threshold")


def hourly(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*BY, F.floor(F.col("close_time") / 3_600_000_000).alias("hour")).agg(F.max_by("close", "bar_id").alias("close"), F.sum(F.col("close") / F.col("open") - 1).alias("ret"), F.max_by(R.direction(), "bar_id").alias("direction"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"))


def summary(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean_close"), F.stddev_samp("close").alias("std_close"), F.min("close").alias("min_close"), F.max("close").alias("max_close"), F.median("close").alias("median_close"),
        F.avg("volume").alias("mean_volume"), F.stddev_samp("volume").alias("std_volume"), F.sum("volume").alias("sum_volume"), F.sum("individual_trade_count").alias("trades"), F.min("open_time").alias("first"), F.max("close_time").alias("last"),
    )


def rolling_summary(bars: DataFrame, n: int = 20) -> DataFrame:
    rows = bars.withColumn("_m", F.avg("close").over(R.frame(n))).withColumn("_v", F.stddev_samp("close").over(R.frame(n))).withColumn("_r", F.col("close") / F.lag("close").over(R.series()) - 1)
    return rows.groupBy(*BY).agg(F.avg("_m").alias("mean_sma"), F.avg("_v").alias("mean_std"), F.stddev_samp("_r").alias("std_return"))


def price_summary(bars: DataFrame) -> DataFrame:
    share = lambda c: F.avg(c.cast("int"))
    spread = F.col("high") - F.col("low")
    return bars.groupBy(*BY).agg(F.avg(spread).alias("mean_range"), F.stddev_samp(spread).alias("std_range"), F.avg(F.col("close") - F.col("open")).alias("mean_change"), share(F.col("close") > F.col("open")).alias("bullish"), share(F.col("close") >= F.col("high")).alias("at_high"), share(F.col("close") <= F.col("low")).alias("at_low"))


def volume_summary(bars: DataFrame) -> DataFrame:
    ratio = F.col("buy_volume") / F.nullif(F.col("sell_volume"), F.lit(0.0))
    return bars.groupBy(*BY).agg(F.avg(ratio).alias("mean_ratio"), F.stddev_samp(ratio).alias("std_ratio"), F.sum("buy_volume").alias("buy"), F.sum("sell_volume").alias("sell"))


def coverage(bars: DataFrame) -> DataFrame:
    n, first, last = F.count(F.lit(1)), F.min("open_time"), F.max("close_time")
    return bars.groupBy(*BY).agg(n.alias("n"), first.alias("first"), last.alias("last"), (n / F.greatest((last - first) / 8.64e10, F.lit(1.0))).alias("bars_per_day"))


def price_stats(trades: DataFrame) -> DataFrame:
    p = F.col("price_fp") / F.lit(1e8)
    return trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.percentile(p, 0.5).alias("p50"), F.percentile(p, 0.95).alias("p95"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"), F.min(p).alias("lowest"), F.max(p).alias("highest"))


def queue_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backfill queue derived from `events`."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    status = F.when(F.col("event_id") % 4 == 0, "pending").when(F.col("event_id") % 4 == 1, "running").otherwise("done")
    return e.select(F.col("event_id").alias("job"), F.col("event_type").alias("symbol"), (F.col("user_id") % 10).alias("threshold"), status.alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("queued_us"))


def queue_status(queue: DataFrame) -> DataFrame:
    of = lambda s: F.col("status") == s
    return queue.groupBy("symbol").agg(*[F.count_if(of(s)).alias(s) for s in ("pending", "running", "done")], F.min(F.when(of("pending"), F.col("queued_us"))).alias("oldest_pending"), F.max(F.when(of("running"), F.col("queued_us"))).alias("newest_running"))


def last_days(trades: DataFrame, days: int) -> DataFrame:
    """Trades of the last days that have any."""
    newest = trades.agg(F.max(F.floor(F.col("ts_us") / 86_400_000_000)).alias("_last"))
    return trades.crossJoin(F.broadcast(newest)).filter(F.floor(F.col("ts_us") / 86_400_000_000) > F.col("_last") - days).drop("_last")  # one row


def nearest(rows: DataFrame, events: DataFrame, at: str, event_at: str, by: list[str], value: str) -> DataFrame:
    """Adds the event nearest in time (the smaller value of two as near), by two as-of joins instead of all pairs."""
    e = events.withColumn("_e", F.col(event_at)).withColumn("_v", -F.col(value))
    back = J.asof(rows, e, at, event_at, by, ["_e", "_v"], "_back")
    ahead = J.next_match(back, events.withColumn("_e", F.col(event_at)).withColumn("_v", -F.col(value)), at, event_at, by, ["_e", "_v"]).withColumnsRenamed({"_e": "_e_next", "_v": "_v_next"})
    left, right = F.col(at) - F.col("_e_back"), F.col("_e_next") - F.col(at)
    pick = F.when(right.isNull() | (left < right) | ((left == right) & (F.col("_v_back") > F.col("_v_next"))), F.col("_v_back")).otherwise(F.col("_v_next"))
    return ahead.withColumn(value, -F.coalesce(pick, F.col("_v_next"), F.col("_v_back"))).drop("_e_back", "_v_back", "_e_next", "_v_next")


def by_tercile(bars: DataFrame, col: str) -> DataFrame:
    """tercile (1 to 3) of a column among each symbol's bars."""
    cuts = bars.groupBy("symbol").agg(F.percentile(col, 1 / 3).alias("_lo"), F.percentile(col, 2 / 3).alias("_hi"))
    return bars.join(cuts, "symbol").withColumn("tercile", F.when(F.col(col) <= F.col("_lo"), 1).when(F.col(col) <= F.col("_hi"), 2).otherwise(3)).drop("_lo", "_hi")


def transitions(rows: DataFrame, state: str, name: str = "following") -> DataFrame:
    """Counts and probabilities of what state follows which."""
    n = rows.withColumn(name, F.lead(state).over(R.series())).filter(F.col(name).isNotNull()).groupBy("symbol", state, name).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("symbol", state)))


def aligned(bars: DataFrame, thresholds: tuple) -> DataFrame:
    """How the last bars of coarser thresholds agree with each bar of the finest."""
    fine, *coarse = thresholds
    rows = bars.filter(F.col("threshold") == fine).select("symbol", "bar_id", "close_time", "direction")
    names = ["direction"]
    for t in coarse:
        rows = J.asof(rows, bars.filter(F.col("threshold") == t).select("symbol", "close_time", F.col("direction").alias(f"_d{t}")), "close_time", "close_time", ["symbol"], [f"_d{t}"])
        names.append(f"_d{t}")
    ups, known = (sum((F.coalesce(f(n), F.lit(False)).cast("int") for n in names), F.lit(0)) for f in (lambda n: F.col(n) == "U", lambda n: F.col(n).isNotNull()))
    full, most = len(names), 2
    return rows.withColumn("alignment", F.when(ups == full, "aligned_up").when((ups == 0) & (known == full), "aligned_down").when(ups >= most, "partial_up").when(known - ups >= most, "partial_down").otherwise("mixed"))


def _rank_correlation(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2.0
    return rows.select(*by, rank(x).alias("_a"), rank(y).alias("_b")).groupBy(*by).agg(correlation("_a", "_b").alias("rho"), F.count(F.lit(1)).alias("n"))


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of average ranks."""
    return _rank_correlation(rows, x, y, by).drop("n")


def second_tier(bars: DataFrame, least: int = 100, weakest: float = 0.02, features_needed: int = 3) -> DataFrame:
    """Second-tier plausibility: of each feature the rank correlation with the next return (where there are more than `least`
    pairs), whether it is significant at 5 % and over `weakest`; of each series how many are, and whether the first tier and at
    least `features_needed` features pass. The limit of t is its expansion about the normal one, right to 1e-6 at these sizes."""
    ahead = F.lead("close").over(R.series()) / F.col("close") - 1
    long = bars.select(*BY, ahead.alias("ret"), *[F.col(f).cast("double").alias(f) for f in FEATURES]).unpivot([*BY, "ret"], list(FEATURES), "feature", "value")
    found = _rank_correlation(long.filter("ret is not null and value is not null and not isnan(value)"), "value", "ret", [*BY, "feature"]).filter(F.col("n") > least)
    z, df = 1.959963984540054, F.col("n") - 2
    limit = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)
    t = F.abs("rho") * F.sqrt(df / (1 - F.col("rho") * F.col("rho")))
    marked = found.withColumn("significant", F.coalesce((F.abs("rho") > weakest) & ((F.abs("rho") >= 1) | (t > limit)) & ~F.isnan("rho"), F.lit(False)))
    first = plausible(bars).select(*BY, F.col("passed").alias("tier1_passed"))
    counted = marked.withColumn("n_significant", F.count_if("significant").over(Window.partitionBy(*BY)))
    return counted.join(first, list(BY)).select(*BY, "feature", "n", "rho", "significant", "n_significant", (F.col("tier1_passed") & (F.col("n_significant") >= features_needed)).alias("passed"))


def mutual_information(rows: DataFrame, x: str, y: str, by: list[str], bins: int = 8) -> DataFrame:
    """Of two columns in equal-count bins, in nats."""
    cut = lambda c: F.ntile(bins).over(Window.partitionBy(*by).orderBy(c))
    cells = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, cut(x).alias("_x"), cut(y).alias("_y")).groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    total, px, py = (F.sum("_n").over(Window.partitionBy(*by, *k)) for k in ([], ["_x"], ["_y"]))
    return cells.withColumn("_t", total).withColumn("_px", px).withColumn("_py", py).groupBy(*by).agg(F.sum(F.col("_n") / F.col("_t") * F.log(F.col("_n") * F.col("_t") / (F.col("_px") * F.col("_py")))).alias("mutual_information"))


def unit_root(bars: DataFrame) -> DataFrame:
    """Dickey-Fuller regression of changes on levels of the close, with a constant: statistic, and whether it is under -2.86."""
    before = F.lag("close").over(R.series())
    rows = bars.select("symbol", before.alias("_x"), (F.col("close") - before).alias("_y")).filter("_x is not null")
    n, b = F.count(F.lit(1)), F.regr_slope("_y", "_x")
    rest = (F.regr_syy("_y", "_x") - b * F.regr_sxy("_y", "_x")) / (n - 2)
    return rows.groupBy("symbol").agg((b / F.sqrt(rest / F.regr_sxx("_y", "_x"))).alias("adf")).withColumn("stationary", F.col("adf") < -2.86)


def after_cost(rows: DataFrame, by: list, cost_bps: float) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("ret").alias("n"), (F.avg("ret") * 10_000 - cost_bps).alias("net_bps"), F.avg((F.abs("ret") * 10_000 > cost_bps).cast("int")).alias("share_over_cost"))


def momentum_walk_forward(rows: DataFrame, train_bars: int, test_bars: int, least: int = 20, k_end: int = 5, over: float = 0.05) -> DataFrame:
    """Of each fold to the end of the series: P(reverse|K=1) - P(reverse|K=k_end) of rising runs in the train_bars before it and
    in its test_bars, whether the first is over `over` and the second over 0. Runs are cut at the edges of both windows. As many
    runs as reach K are bars at place K of their run. A difference is null where fewer than `least` runs reach 1 or k_end."""
    if train_bars % test_bars:
        raise ValueError("train_bars is not a multiple of test_bars")
    blocks = train_bars // test_bars
    first = F.coalesce(F.lag("direction").over(R.series()) != F.col("direction"), F.lit(True))
    numbered = rows.withColumn("_i", F.row_number().over(R.series()) - 1).withColumn("_f", first)
    placed = numbered.withColumn("_start", F.max(F.when(F.col("_f"), F.col("_i"))).over(R.series().rowsBetween(Window.unboundedPreceding, 0)))
    block = F.floor(F.col("_i") / test_bars)
    # Each bar is in the training of `blocks` folds and in the test of one.
    each = placed.filter("direction = 'U'").select(*BY, "_i", "_start", F.explode(F.sequence(block - blocks, block)).alias("fold"), block.alias("_b")).filter("fold >= 0")
    test = F.col("_b") == F.col("fold") + blocks
    edge = F.when(test, (F.col("fold") + blocks) * test_bars).otherwise(F.col("fold") * test_bars)
    place = F.col("_i") - F.greatest("_start", edge) + 1
    ks = (1, 2, k_end, k_end + 1)
    counts = each.groupBy(*BY, "fold").agg(*[F.count_if((test == is_test) & (place == k)).alias(f"_{name}{k}") for name, is_test in (("train", False), ("test", True)) for k in ks])
    folds = placed.groupBy(*BY).agg(F.floor((F.count(F.lit(1)) - train_bars) / test_bars).alias("_n")).filter("_n > 0").select(*BY, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("fold"))
    n = lambda name, k: F.coalesce(F.col(f"_{name}{k}"), F.lit(0))
    delta = lambda name: F.when((n(name, 1) >= least) & (n(name, k_end) >= least), F.try_divide(n(name, k_end + 1), n(name, k_end)) - F.try_divide(n(name, 2), n(name, 1)))
    out = folds.join(counts, [*BY, "fold"], "left").select(*BY, "fold", delta("train").alias("train_delta"), delta("test").alias("test_delta"))
    return out.withColumn("predicted", F.col("train_delta") > over).withColumn("actual", F.col("test_delta") > 0).withColumn("correct", F.col("predicted") == F.col("actual"))


def _per_symbol(bars: DataFrame, run, schema: str) -> DataFrame:
    """A function of each series' closes in order. Bars are the condensed form of trades; a series' closes fit a task."""
    from .bars import ship

    ship(bars.sparkSession)
    return bars.select("symbol", "bar_id", "close").groupBy("symbol").applyInPandas(lambda p: run(p["symbol"].iloc[0], p.sort_values("bar_id")["close"].to_numpy()), schema)


def hurst_estimates(bars: DataFrame) -> DataFrame:
    """Rescaled range, detrended fluctuation and variance-time estimates for each symbol's closes."""

    def run(symbol, close):
        r = np.diff(np.log(close))
        lags = [k for k in (1, 2, 4, 8, 16, 32) if k * 4 < len(close)]
        spread = [np.log(np.var(np.log(close[k:]) - np.log(close[:-k]))) for k in lags]
        slope = float(np.polyfit(np.log(lags), spread, 1)[0]) / 2 if len(lags) > 1 else math.nan
        return pd.DataFrame([[symbol, len(close), N.hurst_rs(np.cumsum(r - r.mean())) if len(r) > 8 else math.nan, N.hurst_dfa(close / close[0]), slope]])

    return _per_symbol(bars, run, "symbol string, n long, hurst_rs double, hurst_dfa double, hurst_variance double")


class Adaptive:
    """The window of ADWIN: at most MOST buckets of each power of two values, oldest first; memory grows with the logarithm of
    the window. A bucket is the count, sum, sum of squared deviations, and maximum of its values."""

    MOST = 5

    def __init__(self):
        self.buckets = np.zeros((0, 4))

    def add(self, x: float) -> None:
        rows = [*self.buckets.tolist(), [1.0, x, 0.0, x]]
        end = len(rows)
        while end > self.MOST and rows[end - self.MOST - 1][0] == rows[end - 1][0]:  # one more than MOST of a size: join its two oldest
            k = end - self.MOST - 1
            (n, s, v, m), (n2, s2, v2, m2) = rows[k], rows[k + 1]
            rows[k : k + 2] = [[n + n2, s + s2, v + v2 + (s / n - s2 / n2) ** 2 * n * n2 / (n + n2), max(m, m2)]]
            end = k + 1
        self.buckets = np.array(rows)

    def cut(self, delta: float, least: int = 10, width: int = 20) -> bool:
        """Drops oldest buckets as long as the means before and after any border differ; whether any was dropped."""
        found = False
        while len(self.buckets) > 1:
            n, s, v, m = self.buckets.T
            size, total = n.sum(), s.sum()
            if size < width:
                break
            var = (v.sum() + (n * (s / n - total / size) ** 2).sum()) / size
            a, left = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
            b = size - a
            r, d = 1 / a + 1 / b, math.log(2 * math.log(size) / delta)
            hit = np.abs(left / a - (total - left) / b) > np.sqrt(2 * r * var * d) + 2 / 3 * r * d * m.max()
            if not (hit & (a >= least) & (b >= least)).any():
                break
            self.buckets, found = self.buckets[1:], True
        return found


def drift(bars: DataFrame, delta: float = 0.002) -> DataFrame:
    """Adaptive windowing (ADWIN) over squared logarithmic returns: the places where the mean changes. The window grows without
    limit until a cut; cuts are tried at the borders of its buckets after each return."""

    def run(symbol, close):
        window, found = Adaptive(), []
        for end, x in enumerate((np.diff(np.log(close)) ** 2).tolist(), 1):
            window.add(x)
            if window.cut(delta):
                found.append(end)
        return pd.DataFrame({"symbol": symbol, "at": np.array(found, np.int64)})

    return _per_symbol(bars, run, "symbol string, at long")


def persistence(bars: DataFrame, window: int = 50, lag: int = 1, dim: int = 3, step: int = 10) -> DataFrame:
    """Norms of the zero-dimensional persistence of delay-embedded returns over sliding windows: the lifetimes of components
    are the edges of the least spanning tree of the embedded points. A break shows as a jump of the norm."""

    def lifetimes(points: np.ndarray) -> np.ndarray:
        far = np.linalg.norm(points - points[0], axis=1)
        inside, out = np.zeros(len(points), bool), []
        inside[0] = True
        for _ in range(len(points) - 1):
            k = int(np.argmin(np.where(inside, np.inf, far)))
            out.append(far[k])
            inside[k] = True
            far = np.minimum(far, np.linalg.norm(points - points[k], axis=1))
        return np.array(out)

    def run(symbol, close):
        r, rows = np.diff(np.log(close)), []
        for end in range(window, len(r) + 1, step):
            w = r[end - window : end]
            life = lifetimes(np.stack([w[i * lag : len(w) - (dim - 1 - i) * lag] for i in range(dim)], axis=1))
            rows.append((symbol, end, float(life.sum()), float(np.sqrt((life**2).sum()))))
        return pd.DataFrame(rows, columns=["symbol", "at", "l1", "l2"])

    return _per_symbol(bars, run, "symbol string, at long, l1 double, l2 double")
