"""Queries over bars and trades: windows, indicators, joins, groups, patterns, statistics, store, checks, sources, sinks, streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions import scalar as C
from ..functions import tests as S
from ..operators import analytics as A
from ..operators import bars as B
from ..operators import joins as J
from ..operators import quality as Q
from ..sources import trades as T
from . import oracle as O
from .catalog import PLAIN, TRADES, bars, query, trades

ID = ["symbol", "bar_id"]
W = "WINDOW w AS (PARTITION BY symbol, threshold ORDER BY bar_id)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY symbol, threshold ORDER BY bar_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(sql: str, n: int, of: str = "close", least: int | None = None) -> str:
    return f"CASE WHEN count({of}) {frame(n)} >= {least or n} THEN {sql} {frame(n)} END"


def shared(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors reach: under spark.checkpoint.dir, or a local one where that is unset and
    driver and executors are one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def over(name: str, columns: dict[str, tuple], doubles: str = ""):
    """A query that adds window columns to bars: name -> (Spark column, SQL)."""

    @query(name, f"SELECT symbol, bar_id, {', '.join(f'{sql} AS {k}' for k, (_, sql) in columns.items())} FROM bars {W}", doubles, PLAIN)
    def _(s, d):
        return bars(s, d).select(*ID, *[c().alias(k) for k, (c, _) in columns.items()])


# ---------------------------------------------------------------- windows

over("win_lag", {"prev_close": (lambda: F.lag("close").over(R.series()), "lag(close) OVER w"), "prev_last_id": (lambda: F.lag("last_trade_id").over(R.series()).cast("double"), "(lag(last_trade_id) OVER w)::DOUBLE")}, "prev_close prev_last_id")
over("win_lead", {"next_close": (lambda: F.lead("close").over(R.series()), "lead(close) OVER w"), "fwd_ret_3": (lambda: F.lead("close", 3).over(R.series()) / F.col("close") - 1, "lead(close, 3) OVER w / close - 1")}, "next_close fwd_ret_3")
over("win_rownum", {"idx": (lambda: F.row_number().over(R.series()), "row_number() OVER w")})
over("win_named", {"prev_high": (lambda: F.lag("high").over(R.series()), "lag(high) OVER w"), "next_low": (lambda: F.lead("low").over(R.series()), "lead(low) OVER w")}, "prev_high next_low")
over("win_fwd_frame", {"fwd_std": (lambda: F.stddev_pop("close").over(R.series().rowsBetween(1, 10)), "stddev_pop(close) OVER (PARTITION BY symbol, threshold ORDER BY bar_id ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)")}, "fwd_std")
over("win_roll_mean", {"mean20": (lambda: R.sma("close", 20), full("avg(close)", 20))}, "mean20")
over("win_roll_std", {"std20": (lambda: R.rolling_std("close", 20), full("stddev_samp(close)", 20))}, "std20")
over("win_roll_sum", {"sum20": (lambda: R.rolling_sum("volume", 20), full("sum(volume)", 20, "volume"))}, "sum20")
over("win_roll_min1", {"mean20": (lambda: R.sma("close", 20, 1), f"avg(close) {frame(20)}"), "std20": (lambda: R.rolling_std("close", 20, 1), f"stddev_samp(close) {frame(20)}")}, "mean20 std20")
over("win_roll_quantile", {"q25": (lambda: R.rolling_quantile("close", 0.25, 100, 50), full("quantile_cont(close, 0.25)", 100, least=50)), "q75": (lambda: R.rolling_quantile("close", 0.75, 100, 50), full("quantile_cont(close, 0.75)", 100, least=50))}, "q25 q75")
over("win_htf_trend", {"ups": (lambda: F.count_if(F.col("close") >= F.col("open")).over(R.frame(12)), f"count(*) FILTER (close >= open) {frame(12)}")})
over("ind_sma", {"sma10": (lambda: R.sma("close", 10), full("avg(close)", 10))}, "sma10")

_EMA = lambda col, alpha, name, src: f"""{name}(symbol, bar_id, x, e) AS (SELECT symbol, bar_id, {col}, {col} FROM {src} WHERE bar_id = (SELECT min(bar_id) FROM {src} i WHERE i.symbol = {src}.symbol) UNION ALL
SELECT b.symbol, b.bar_id, b.{col}, {alpha} * b.{col} + (1 - {alpha}) * p.e FROM {name} p JOIN {src} b ON b.symbol = p.symbol AND b.bar_id = p.bar_id + 1)"""  # noqa: E731


@query("ind_ema", "SELECT symbol, bar_id, e AS ema9 FROM ema", "ema9", f"{PLAIN}, {_EMA('close', '0.2::DOUBLE', 'ema', 'bars')}")
def _(s, d):
    return R.ema(bars(s, d), 9, name="ema9").select(*ID, "ema9")


@query("win_ewm", "SELECT symbol, bar_id, e AS ewm FROM ema", "ewm", f"{PLAIN}, {_EMA('close', '0.1::DOUBLE', 'ema', 'bars')}")
def _(s, d):
    return R.recursive(bars(s, d), "close", 0.1, "ewm").select(*ID, "ewm")


@query("ind_macd", "SELECT m.symbol, m.bar_id, m.macd, s.e AS macd_signal, m.macd - s.e AS macd_hist FROM m JOIN sig s USING (symbol, bar_id)", "macd macd_signal macd_hist",
       f"{PLAIN}, {_EMA('close', '(2 / 13.0::DOUBLE)', 'fast', 'bars')}, {_EMA('close', '(2 / 27.0::DOUBLE)', 'slow', 'bars')}, m AS (SELECT f.symbol, f.bar_id, f.e - s.e AS macd FROM fast f JOIN slow s USING (symbol, bar_id)), {_EMA('macd', '0.2::DOUBLE', 'sig', 'm')}")
def _(s, d):
    return R.macd(bars(s, d)).select(*ID, "macd", "macd_signal", "macd_hist")


_GAINS = "g AS (SELECT *, CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(close - lag(close) OVER w, 0) END AS gain, CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(lag(close) OVER w - close, 0) END AS loss FROM bars WINDOW w AS (PARTITION BY symbol, threshold ORDER BY bar_id))"
_RSI = f"CASE WHEN count(gain) {frame(14)} >= 14 THEN CASE WHEN avg(loss) {frame(14)} = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + avg(gain) {frame(14)} / avg(loss) {frame(14)}) END END"


@query("ind_rsi", f"SELECT symbol, bar_id, {_RSI} AS rsi14 FROM g", "rsi14", f"{PLAIN}, {_GAINS}")
def _(s, d):
    return R.with_gains(bars(s, d)).select(*ID, R.rsi("_gain", "_loss", 14).alias("rsi14"))


@query("ind_rsi_anchored", f"SELECT symbol, bar_id, {_RSI} AS rsi14 FROM g", "rsi14", f"{PLAIN}, {_GAINS.replace('lag(close) OVER w IS NOT NULL', 'row_number() OVER w > 1').replace('lag(close) OVER w', 'first_value(close) OVER w')}")
def _(s, d):
    return R.with_gains(bars(s, d), anchored=True).select(*ID, R.rsi("_gain", "_loss", 14).alias("rsi14"))


@query("ind_rsi_wilder", "SELECT symbol, bar_id, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY bar_id) >= 14 THEN CASE WHEN l.e = 0 THEN 100.0 ELSE 100 - 100 / (1 + u.e / l.e) END END AS rsi FROM up u JOIN down l USING (symbol, bar_id)", "rsi",
       f"{PLAIN}, {_GAINS}, h AS (SELECT * FROM g WHERE gain IS NOT NULL), {_EMA('gain', '(1 / 14.0::DOUBLE)', 'up', 'h')}, {_EMA('loss', '(1 / 14.0::DOUBLE)', 'down', 'h')}")
def _(s, d):
    return R.rsi_wilder(bars(s, d)).select(*ID, "rsi")


@query("ind_cci", f"SELECT symbol, bar_id, CASE WHEN len(l) >= 20 THEN CASE WHEN list_avg(list_transform(l, lambda x: abs(x - list_avg(l)))) = 0 THEN 0.0 ELSE (tp - list_avg(l)) / (0.015 * list_avg(list_transform(l, lambda x: abs(x - list_avg(l))))) END END AS cci FROM (SELECT *, list(tp) {frame(20)} AS l FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars))", "cci", PLAIN)
def _(s, d):
    return bars(s, d).select(*ID, R.cci(20).alias("cci"))


_TR = "t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, ln(close / lag(close) OVER w) AS lr FROM bars WINDOW w AS (PARTITION BY symbol, threshold ORDER BY bar_id))"


@query("ind_atr", f"SELECT symbol, bar_id, {full('avg(tr)', 14, 'tr')} AS atr14 FROM t", "atr14", f"{PLAIN}, {_TR}")
def _(s, d):
    return bars(s, d).withColumn("_tr", R.true_range()).select(*ID, R.sma("_tr", 14).alias("atr14"))


@query("ind_rv", f"SELECT symbol, bar_id, {full('stddev_samp(lr)', 20, 'lr')} AS rv20 FROM t", "rv20", f"{PLAIN}, {_TR}")
def _(s, d):
    return bars(s, d).withColumn("_lr", R.log_return()).select(*ID, R.rolling_std("_lr", 20).alias("rv20"))


_DIR = "dir AS (SELECT *, CASE WHEN close >= open THEN 'U' ELSE 'D' END AS direction, lead(close) OVER w / close - 1 AS ret FROM bars WINDOW w AS (PARTITION BY symbol, threshold ORDER BY bar_id))"
_RUNS = f"{_DIR}, turned AS (SELECT *, CASE WHEN direction <> lag(direction) OVER (PARTITION BY symbol, threshold ORDER BY bar_id) THEN 1 ELSE 0 END AS turn FROM dir), runs AS (SELECT *, sum(turn) OVER (PARTITION BY symbol, threshold ORDER BY bar_id)::BIGINT AS run_id FROM turned)"


def directed(s, d, thresholds=(250,)) -> DataFrame:
    return bars(s, d, thresholds).withColumn("direction", R.direction()).withColumn("ret", F.lead("close").over(R.series()) / F.col("close") - 1)


@query("win_cumsum_islands", "SELECT symbol, bar_id, direction, run_id FROM runs", "", f"{PLAIN}, {_RUNS}")
def _(s, d):
    return R.with_run(directed(s, d)).select(*ID, "direction", "run_id")


@query("win_run_length", "SELECT symbol, threshold, k, count(*) AS n, count(*) FILTER (length = k) AS reversed, count(*) FILTER (length = k) / count(*) AS p_reversal FROM (SELECT l.symbol, l.threshold, l.length, unnest(range(1, least(length, 10) + 1))::INTEGER AS k FROM (SELECT *, max(run_id) OVER (PARTITION BY symbol, threshold) AS last FROM (SELECT symbol, threshold, run_id, count(*) AS length FROM runs GROUP BY symbol, threshold, run_id)) l WHERE run_id < last) GROUP BY symbol, threshold, k HAVING count(*) >= 10", "p_reversal", f"{PLAIN}, {_RUNS}")
def _(s, d):
    return R.reversal_probability(directed(s, d), least=10)


# ---------------------------------------------------------------- hours and joins

_HOUR = "hr AS (SELECT symbol, threshold, close_time // 3600000000 AS hour, arg_max(close, bar_id) AS close, sum(close / open - 1) AS ret, arg_max(CASE WHEN close >= open THEN 'U' ELSE 'D' END, bar_id) AS direction, sum(volume) AS volume, count(*) AS n FROM bars GROUP BY ALL)"


@query("gb_hourly", "SELECT * FROM hr", "close ret volume", f"{PLAIN}, {_HOUR}")
def _(s, d):
    return A.hourly(bars(s, d))


@query("jn_inner_hour", "SELECT a.hour, a.ret AS ret_a, b.ret AS ret_b FROM hr a JOIN hr b ON a.hour = b.hour WHERE a.symbol = 'click' AND b.symbol = 'view'", "ret_a ret_b", f"{PLAIN}, {_HOUR}")
def _(s, d):
    h = A.hourly(bars(s, d)).select("symbol", "hour", "ret")
    a, b = h.filter("symbol = 'click'").select("hour", F.col("ret").alias("ret_a")), h.filter("symbol = 'view'").select("hour", F.col("ret").alias("ret_b"))
    return a.join(b, "hour")


_CORR = """pair AS (SELECT a.hour, a.ret AS x, b.ret AS y FROM hr a JOIN hr b ON a.hour = b.hour WHERE a.symbol = 'click' AND b.symbol = 'view'),
dev AS (SELECT *, x - avg(x) OVER f AS dx, y - avg(y) OVER f AS dy, stddev_samp(x) OVER f AS sx, stddev_samp(y) OVER f AS sy, count(*) OVER f AS n FROM pair WINDOW f AS (ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
corr AS (SELECT hour, CASE WHEN n >= 12 AND sx > 0 AND sy > 0 THEN avg(dx * dy) OVER (ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) / (sx * sy) END AS rolling_corr FROM dev)"""


def correlated(s, d) -> DataFrame:
    h = A.hourly(bars(s, d)).select("symbol", "hour", "ret")
    pair = h.filter("symbol = 'click'").select("hour", F.col("ret").alias("x")).join(h.filter("symbol = 'view'").select("hour", F.col("ret").alias("y")), "hour").withColumn("pair", F.lit("click-view"))
    return R.rolling_correlation(pair, "x", "y", by=("pair",)).select("hour", "rolling_corr")


@query("win_roll_corr", "SELECT * FROM corr", "rolling_corr", f"{PLAIN}, {_HOUR}, {_CORR}")
def _(s, d):
    return correlated(s, d)


@query("rg_corr", "SELECT hour, CASE WHEN rolling_corr IS NULL THEN NULL WHEN rolling_corr < -0.3 THEN 'inverse' WHEN rolling_corr > 0.3 THEN 'coupled' ELSE 'free' END AS regime FROM corr", "", f"{PLAIN}, {_HOUR}, {_CORR}")
def _(s, d):
    return correlated(s, d).select("hour", R.level_regime(F.col("rolling_corr"), -0.3, 0.3, ("inverse", "free", "coupled")).alias("regime"))


_TWO = O.bars((250, 1000))


@query("jn_asof_back", "SELECT f.symbol, f.bar_id, c.bar_id::DOUBLE AS coarse_bar, c.close AS coarse_close FROM (SELECT * FROM bars WHERE threshold = 250) f ASOF LEFT JOIN (SELECT * FROM bars WHERE threshold = 1000) c ON f.symbol = c.symbol AND f.close_time >= c.close_time", "coarse_bar coarse_close", _TWO)
def _(s, d):
    b = bars(s, d, (250, 1000))
    coarse = b.filter("threshold = 1000").select("symbol", "close_time", F.col("bar_id").alias("coarse_bar"), F.col("close").alias("coarse_close"))
    return J.asof(b.filter("threshold = 250").select("symbol", "bar_id", "close_time"), coarse, "close_time", "close_time", ["symbol"], ["coarse_bar", "coarse_close"]).select(*ID, F.col("coarse_bar").cast("double").alias("coarse_bar"), "coarse_close")


@query("jn_next_asof", "SELECT c.symbol, c.bar_id, min(f.bar_id)::DOUBLE AS fine_bar FROM (SELECT * FROM bars WHERE threshold = 1000) c LEFT JOIN (SELECT * FROM bars WHERE threshold = 250) f ON f.symbol = c.symbol AND f.close_time > c.close_time GROUP BY ALL", "", _TWO)
def _(s, d):
    b = bars(s, d, (250, 1000))
    fine = b.filter("threshold = 250").select("symbol", "close_time", F.col("bar_id").alias("fine_bar"))
    return J.next_match(b.filter("threshold = 1000").select("symbol", "bar_id", "close_time"), fine, "close_time", "close_time", ["symbol"], ["fine_bar"]).select(*ID, F.col("fine_bar").cast("double").alias("fine_bar"))


@query("jn_index", "SELECT a.symbol, a.bar_id, b.close / a.open - 1 AS ret FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.bar_id = a.bar_id + 3", "ret", PLAIN)
def _(s, d):
    b = bars(s, d)
    later = b.select("symbol", (F.col("bar_id") - 3).alias("bar_id"), F.col("close").alias("_c"))
    return b.join(later, ID).select(*ID, (F.col("_c") / F.col("open") - 1).alias("ret"))


@query("jn_cross_scalar", "SELECT symbol, bar_id, volume > q AS large FROM bars, (SELECT quantile_cont(volume, 0.9) AS q FROM bars)", "", PLAIN)
def _(s, d):
    b = bars(s, d)
    return b.crossJoin(F.broadcast(b.agg(F.percentile("volume", 0.9).alias("_q")))).select(*ID, (F.col("volume") > F.col("_q")).alias("large"))  # one row


@query("jn_group_total", "SELECT symbol, direction, n / sum(n) OVER (PARTITION BY symbol) AS p FROM (SELECT symbol, direction, count(*) AS n FROM dir GROUP BY ALL)", "p", f"{PLAIN}, {_DIR}")
def _(s, d):
    n = directed(s, d).groupBy("symbol", "direction").agg(F.count(F.lit(1)).alias("n"))
    return n.select("symbol", "direction", (F.col("n") / F.sum("n").over(Window.partitionBy("symbol"))).alias("p"))


_KNOWN = "known AS (SELECT symbol, min(ts_us) + 86400000000 AS start_us, min(ts_us) + 172800000000 AS end_us, 'maintenance' AS reason FROM trades GROUP BY symbol)"


@query("jn_range_known_gap", "SELECT b.symbol, b.bar_id, k.reason FROM bars b LEFT JOIN known k ON k.symbol = b.symbol AND b.open_time BETWEEN k.start_us AND k.end_us", "", f"{PLAIN}, {_KNOWN}")
def _(s, d):
    known = trades(s, d).groupBy("symbol").agg((F.min("ts_us") + 86_400_000_000).alias("start_us"), (F.min("ts_us") + 172_800_000_000).alias("end_us"), F.lit("maintenance").alias("reason"))
    return J.within_ranges(bars(s, d).select("symbol", "bar_id", "open_time"), known, "open_time", "start_us", "end_us", ["symbol"]).select(*ID, "reason")


_MARKS = "marks AS (SELECT symbol, ts_us, min(agg_trade_id) AS id FROM trades GROUP BY ALL)"
_SIDES = "sides AS (SELECT b.symbol, b.bar_id, b.close_time, x.id AS back, b.close_time - x.ts_us AS before, y.id AS ahead, y.ts_us - b.close_time AS after FROM bars b ASOF LEFT JOIN marks x ON x.symbol = b.symbol AND x.ts_us <= b.close_time ASOF LEFT JOIN marks y ON y.symbol = b.symbol AND y.ts_us >= b.close_time)"


@query("jn_nearest_event", "SELECT symbol, bar_id, CASE WHEN ahead IS NULL OR before < after THEN back WHEN back IS NULL OR after < before THEN ahead ELSE least(back, ahead) END AS nearest FROM sides", "", f"{PLAIN}, {_MARKS}, {_SIDES}")
def _(s, d):
    marks = trades(s, d).select("symbol", "ts_us", F.col("agg_trade_id").alias("event"))
    return A.nearest(bars(s, d).select("symbol", "bar_id", "close_time"), marks, "close_time", "ts_us", ["symbol"], "event").select(*ID, F.col("event").alias("nearest"))


@query("jn_anti_dedup", "SELECT symbol, count(*) AS n FROM trades WHERE agg_trade_id NOT IN (SELECT agg_trade_id FROM trades WHERE agg_trade_id % 3 = 0) GROUP BY symbol", "", TRADES)
def _(s, d):
    t = trades(s, d)
    return t.join(t.filter("agg_trade_id % 3 = 0").select("symbol", "agg_trade_id"), ["symbol", "agg_trade_id"], "left_anti").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("jn_set_missing", "SELECT symbol, day FROM (SELECT symbol, unnest(range(min(ts_us // 86400000000), max(ts_us // 86400000000) + 1)) AS day FROM trades GROUP BY symbol) EXCEPT SELECT symbol, close_time // 86400000000 FROM bars", "", PLAIN)
def _(s, d):
    day = lambda c: F.floor(F.col(c) / 86_400_000_000)
    every = trades(s, d).groupBy("symbol").agg(F.min(day("ts_us")).alias("_a"), F.max(day("ts_us")).alias("_b")).select("symbol", F.explode(F.sequence("_a", "_b")).alias("day"))
    return every.join(bars(s, d).select("symbol", day("close_time").alias("day")).distinct(), ["symbol", "day"], "left_anti")


# ---------------------------------------------------------------- groups


@query("gb_basic", "SELECT symbol, threshold, count(*) AS n, avg(close) AS mean_close, stddev_samp(close) AS std_close, min(close) AS min_close, max(close) AS max_close, median(close) AS median_close, avg(volume) AS mean_volume, stddev_samp(volume) AS std_volume, sum(volume) AS sum_volume, sum(individual_trade_count)::BIGINT AS trades, min(open_time) AS first, max(close_time) AS last FROM bars GROUP BY ALL", "mean_close std_close min_close max_close median_close mean_volume std_volume sum_volume", PLAIN)
def _(s, d):
    return A.summary(bars(s, d))


@query("gb_rolling", f"SELECT symbol, threshold, avg(m) AS mean_sma, avg(v) AS mean_std, stddev_samp(r) AS std_return FROM (SELECT *, avg(close) {frame(20)} AS m, stddev_samp(close) {frame(20)} AS v, close / lag(close) OVER w - 1 AS r FROM bars {W}) GROUP BY ALL", "mean_sma mean_std std_return", PLAIN)
def _(s, d):
    return A.rolling_summary(bars(s, d))


@query("gb_quantiles", "SELECT symbol, threshold, quantile_cont(close, 0.1) AS p10, quantile_cont(close, 0.25) AS p25, quantile_cont(close, 0.5) AS p50, quantile_cont(close, 0.75) AS p75, quantile_cont(close, 0.9) AS p90 FROM bars GROUP BY ALL", "p10 p25 p50 p75 p90", PLAIN)
def _(s, d):
    return bars(s, d).groupBy("symbol", "threshold").agg(*[F.percentile("close", q / 100).alias(f"p{q}") for q in (10, 25, 50, 75, 90)])


@query("gb_price", "SELECT symbol, threshold, avg(high - low) AS mean_range, stddev_samp(high - low) AS std_range, avg(close - open) AS mean_change, avg((close > open)::INT) AS bullish, avg((close >= high)::INT) AS at_high, avg((close <= low)::INT) AS at_low FROM bars GROUP BY ALL", "mean_range std_range mean_change bullish at_high at_low", PLAIN)
def _(s, d):
    return A.price_summary(bars(s, d))


@query("gb_volume", "SELECT symbol, threshold, avg(buy_volume / sell_volume) AS mean_ratio, stddev_samp(buy_volume / sell_volume) AS std_ratio, sum(buy_volume) AS buy, sum(sell_volume) AS sell FROM (SELECT symbol, threshold, buy_volume, nullif(sell_volume, 0) AS sell_volume FROM bars) GROUP BY ALL", "mean_ratio std_ratio buy sell", PLAIN)
def _(s, d):
    return A.volume_summary(bars(s, d))


@query("gb_micro", "SELECT symbol, threshold, avg(trade_intensity) AS mean_intensity, avg(ofi) AS mean_ofi, stddev_samp(ofi) AS std_ofi, avg((close - vwap) / vwap * 100) AS vwap_deviation_pct FROM bars GROUP BY ALL", "mean_intensity mean_ofi std_ofi vwap_deviation_pct", PLAIN)
def _(s, d):
    return bars(s, d).groupBy("symbol", "threshold").agg(F.avg("trade_intensity").alias("mean_intensity"), F.avg("ofi").alias("mean_ofi"), F.stddev_samp("ofi").alias("std_ofi"), F.avg((F.col("close") - F.col("vwap")) / F.col("vwap") * 100).alias("vwap_deviation_pct"))


@query("gb_multi_symbol", "SELECT symbol, count(*) AS n, avg(close) AS mean_close, avg(ofi) AS mean_ofi FROM bars GROUP BY symbol", "mean_close mean_ofi", PLAIN)
def _(s, d):
    return bars(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean_close"), F.avg("ofi").alias("mean_ofi"))


@query("gb_dupes", "SELECT symbol, close_time // 3600000000 AS hour, count(*) AS n, min(open) AS lowest FROM bars GROUP BY ALL HAVING count(*) > 1", "lowest", PLAIN)
def _(s, d):
    return Q.duplicates(bars(s, d).withColumn("hour", F.floor(F.col("close_time") / 3_600_000_000)), ["symbol", "hour"]).select("symbol", "hour", "n", F.col("opens")[0].alias("lowest"))


@query("gb_coverage", "SELECT symbol, threshold, count(*) AS n, min(open_time) AS first, max(close_time) AS last, count(*) / greatest((max(close_time) - min(open_time)) / 8.64e10, 1) AS bars_per_day FROM bars GROUP BY ALL", "bars_per_day", PLAIN)
def _(s, d):
    return A.coverage(bars(s, d))


_QUEUE = "queue AS (SELECT event_id AS job, event_type AS symbol, user_id % 10 AS threshold, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' ELSE 'done' END AS status, epoch_us(ts)::BIGINT AS queued_us FROM events)"


@query("gb_queue", "SELECT symbol, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'done') AS done, min(queued_us) FILTER (status = 'pending') AS oldest_pending, max(queued_us) FILTER (status = 'running') AS newest_running FROM queue GROUP BY symbol", "", f"WITH {_QUEUE}")
def _(s, d):
    return A.queue_status(A.queue_from_events(s, d))


@query("gb_queue_merge", "SELECT symbol, array_to_string(list_sort(list(DISTINCT threshold)), ',') AS thresholds, count(*) AS jobs, min(queued_us) AS first FROM queue WHERE status = 'pending' GROUP BY symbol", "", f"WITH {_QUEUE}")
def _(s, d):
    return A.queue_from_events(s, d).filter("status = 'pending'").groupBy("symbol").agg(F.array_join(F.sort_array(F.collect_set("threshold")).cast("array<string>"), ",").alias("thresholds"), F.count(F.lit(1)).alias("jobs"), F.min("queued_us").alias("first"))


@query("gb_overflow", "SELECT symbol, count(*) FILTER (volume < 0) AS negative, count(*) AS n FROM bars GROUP BY symbol HAVING count(*) FILTER (volume < 0) = 0", "", PLAIN)
def _(s, d):
    return bars(s, d).groupBy("symbol").agg(F.count_if(F.col("volume") < 0).alias("negative"), F.count(F.lit(1)).alias("n")).filter("negative = 0")


@query("gb_pivot", "SELECT symbol, hour, count(*) FILTER (threshold = 250) AS n_250, count(*) FILTER (threshold = 1000) AS n_1000 FROM (SELECT *, close_time // 3600000000 AS hour FROM bars) GROUP BY ALL", "", _TWO)
def _(s, d):
    p = bars(s, d, (250, 1000)).groupBy("symbol", F.floor(F.col("close_time") / 3_600_000_000).alias("hour")).pivot("threshold", [250, 1000]).agg(F.count(F.lit(1)))
    return p.select("symbol", "hour", F.coalesce("250", F.lit(0)).alias("n_250"), F.coalesce("1000", F.lit(0)).alias("n_1000"))


_TERC = "cut AS (SELECT symbol, quantile_cont(ofi, 1 / 3.0) AS lo, quantile_cont(ofi, 2 / 3.0) AS hi FROM bars GROUP BY symbol), terc AS (SELECT d.*, CASE WHEN ofi <= lo THEN 1 WHEN ofi <= hi THEN 2 ELSE 3 END AS tercile FROM dir d JOIN cut USING (symbol))"


@query("gb_tercile", "SELECT symbol, tercile, count(ret) AS n, avg(ret) * 10000 AS mean_bps, stddev_samp(ret) AS std FROM terc GROUP BY ALL HAVING count(ret) >= 10", "mean_bps std", f"{PLAIN}, {_DIR}, {_TERC}")
def _(s, d):
    return A.by_tercile(directed(s, d), "ofi").groupBy("symbol", "tercile").agg(F.count("ret").alias("n"), (F.avg("ret") * 10_000).alias("mean_bps"), F.stddev_samp("ret").alias("std")).filter("n >= 10")


@query("gb_persistence", "SELECT *, n / sum(n) OVER (PARTITION BY symbol, tercile) AS p FROM (SELECT symbol, tercile, following, count(*) AS n FROM (SELECT *, lead(tercile) OVER (PARTITION BY symbol ORDER BY bar_id) AS following FROM terc) WHERE following IS NOT NULL GROUP BY symbol, tercile, following)", "p", f"{PLAIN}, {_DIR}, {_TERC}")
def _(s, d):
    return A.transitions(A.by_tercile(directed(s, d), "ofi"), "tercile", "following")


@query("gb_transition", "SELECT *, n / sum(n) OVER (PARTITION BY symbol, direction) AS p FROM (SELECT symbol, direction, following, count(*) AS n FROM (SELECT *, lead(direction) OVER (PARTITION BY symbol ORDER BY bar_id) AS following FROM dir) WHERE following IS NOT NULL GROUP BY symbol, direction, following)", "p", f"{PLAIN}, {_DIR}")
def _(s, d):
    return A.transitions(directed(s, d), "direction", "following")


@query("gb_overlap", "SELECT symbol, count(*) FILTER (gap < 0) AS overlapping, median(gap) AS median_gap, quantile_cont(gap, 0.05) AS p5, quantile_cont(gap, 0.95) AS p95 FROM (SELECT symbol, lead(open) OVER (PARTITION BY symbol ORDER BY bar_id) - close AS gap FROM bars) GROUP BY symbol", "median_gap p5 p95", PLAIN)
def _(s, d):
    g = bars(s, d).withColumn("gap", F.lead("open").over(R.series()) - F.col("close"))
    return g.groupBy("symbol").agg(F.count_if(F.col("gap") < 0).alias("overlapping"), F.median("gap").alias("median_gap"), F.percentile("gap", 0.05).alias("p5"), F.percentile("gap", 0.95).alias("p95"))


@query("gb_stream_stats", "SELECT symbol, count(*) AS n, quantile_cont(price_fp / 1e8, 0.5) AS p50, quantile_cont(price_fp / 1e8, 0.95) AS p95, avg(price_fp / 1e8) AS mean, stddev_samp(price_fp / 1e8) AS std, min(price_fp / 1e8) AS lowest, max(price_fp / 1e8) AS highest FROM trades GROUP BY symbol", "p50 p95 mean std lowest highest", TRADES)
def _(s, d):
    return A.price_stats(trades(s, d))


@query("gb_distinct", "SELECT count(DISTINCT symbol) AS symbols, count(DISTINCT (symbol, threshold)) AS pairs FROM bars", "", _TWO)
def _(s, d):
    return bars(s, d, (250, 1000)).agg(F.count_distinct("symbol").alias("symbols"), F.count_distinct("symbol", "threshold").alias("pairs"))


# ---------------------------------------------------------------- patterns, regimes, statistics

_P2 = "pat AS (SELECT *, lag(direction) OVER w || direction AS p2, lag(direction, 2) OVER w || lag(direction) OVER w || direction AS p3, strftime(make_timestamp(close_time), '%Y-%m') AS month FROM dir WINDOW w AS (PARTITION BY symbol, threshold ORDER BY bar_id))"


def patterned(s, d) -> DataFrame:
    return directed(s, d).withColumn("p2", R.pattern(2)).withColumn("p3", R.pattern(3)).withColumn("month", F.date_format(F.timestamp_micros("close_time"), "yyyy-MM"))


@query("pt_direction", "SELECT symbol, bar_id, direction FROM dir", "", f"{PLAIN}, {_DIR}")
def _(s, d):
    return directed(s, d).select(*ID, "direction")


for _n in (2, 3):

    @query(f"pt_{_n}bar", f"SELECT symbol, p{_n} AS pattern, count(ret) AS n, avg(ret) * 10000 AS mean_bps FROM pat WHERE p{_n} IS NOT NULL GROUP BY ALL", "mean_bps", f"{PLAIN}, {_DIR}, {_P2}")
    def _(s, d, n=_n):
        return patterned(s, d).filter(f"p{n} is not null").groupBy("symbol", F.col(f"p{n}").alias("pattern")).agg(F.count("ret").alias("n"), (F.avg("ret") * 10_000).alias("mean_bps"))


@query("pt_formation", "SELECT symbol, bar_id, lag(direction, 4) OVER w || lag(direction, 3) OVER w || lag(direction, 2) OVER w || lag(direction) OVER w || direction AS formation FROM dir WINDOW w AS (PARTITION BY symbol, threshold ORDER BY bar_id)", "", f"{PLAIN}, {_DIR}")
def _(s, d):
    return directed(s, d).select(*ID, R.pattern(5).alias("formation"))


_REG = f"reg AS (SELECT *, {full('avg(close)', 20)} AS sma20, {full('avg(close)', 50)} AS sma50, {_RSI} AS rsi14 FROM g)"
_REGIME = """CASE WHEN sma50 IS NULL OR rsi14 IS NULL THEN NULL WHEN close > sma20 AND sma20 > sma50 THEN CASE WHEN rsi14 > 70 THEN 'bull_hot' WHEN rsi14 < 30 THEN 'bull_cold' ELSE 'bull_neutral' END
WHEN close < sma20 AND sma20 < sma50 THEN CASE WHEN rsi14 > 70 THEN 'bear_hot' WHEN rsi14 < 30 THEN 'bear_cold' ELSE 'bear_neutral' END ELSE 'chop' END"""


@query("rg_sma_rsi", f"SELECT symbol, bar_id, {_REGIME} AS regime FROM reg", "", f"{PLAIN}, {_GAINS}, {_REG}")
def _(s, d):
    rows = R.with_gains(bars(s, d)).withColumn("sma20", R.sma("close", 20)).withColumn("sma50", R.sma("close", 50)).withColumn("rsi14", R.rsi("_gain", "_loss", 14))
    return rows.select(*ID, R.trend_regime().alias("regime"))


@query("rg_rv", f"SELECT symbol, bar_id, CASE WHEN rv IS NULL OR lo IS NULL THEN NULL WHEN rv < lo THEN 'quiet' WHEN rv > hi THEN 'volatile' ELSE 'active' END AS regime FROM (SELECT *, {full('quantile_cont(rv, 0.25)', 100, 'rv', 50)} AS lo, {full('quantile_cont(rv, 0.75)', 100, 'rv', 50)} AS hi FROM (SELECT *, {full('stddev_samp(lr)', 20, 'lr')} AS rv FROM t))", "", f"{PLAIN}, {_TR}")
def _(s, d):
    rows = bars(s, d).withColumn("_lr", R.log_return()).withColumn("rv", R.rolling_std("_lr", 20)).withColumn("_lo", R.rolling_quantile("rv", 0.25, 100, 50)).withColumn("_hi", R.rolling_quantile("rv", 0.75, 100, 50))
    return rows.select(*ID, R.level_regime(F.col("rv"), F.col("_lo"), F.col("_hi")).alias("regime"))


for _name, _num, _den, _lo, _hi, _labels in (("rg_volume", "volume", ("avg", "volume"), 0.5, 1.5, ("low", "normal", "high")), ("rg_duration", "duration_us", ("median", "duration_us"), 0.5, 2.0, ("fast", "normal", "slow"))):

    @query(_name, f"SELECT symbol, bar_id, CASE WHEN r IS NULL THEN NULL WHEN r < {_lo} THEN '{_labels[0]}' WHEN r > {_hi} THEN '{_labels[2]}' ELSE '{_labels[1]}' END AS regime FROM (SELECT *, {_num} / nullif(CASE WHEN count({_den[1]}) {frame(20)} >= 20 THEN {_den[0]}({_den[1]}) {frame(20)} END, 0) AS r FROM bars)", "", PLAIN)
    def _(s, d, num=_num, den=_den, lo=_lo, hi=_hi, labels=_labels):
        level = F.avg(den[1]) if den[0] == "avg" else F.percentile(F.col(den[1]), 0.5)
        rows = bars(s, d).withColumn("_m", R.full(level.over(R.frame(20)), 20, den[1]))
        return rows.select(*ID, R.level_regime(F.col(num) / F.nullif(F.col("_m").cast("double"), F.lit(0.0)), lo, hi, labels).alias("regime"))


@query("rg_ofi", "SELECT symbol, bar_id, CASE WHEN ofi < -0.3 THEN 'selling' WHEN ofi > 0.3 THEN 'buying' ELSE 'balanced' END AS regime FROM bars", "", PLAIN)
def _(s, d):
    return bars(s, d).select(*ID, R.level_regime(F.col("ofi"), -0.3, 0.3, ("selling", "balanced", "buying")).alias("regime"))


_ALIGN = "CASE WHEN ups = 3 THEN 'aligned_up' WHEN ups = 0 AND n = 3 THEN 'aligned_down' WHEN ups >= 2 THEN 'partial_up' WHEN n - ups >= 2 THEN 'partial_down' ELSE 'mixed' END"


@query("pt_align", f"SELECT symbol, bar_id, {_ALIGN} AS alignment FROM (SELECT f.symbol, f.bar_id, (f.direction = 'U')::INT + coalesce((m.direction = 'U')::INT, 0) + coalesce((c.direction = 'U')::INT, 0) AS ups, 1 + (m.direction IS NOT NULL)::INT + (c.direction IS NOT NULL)::INT AS n FROM (SELECT * FROM dir WHERE threshold = 250) f ASOF LEFT JOIN (SELECT * FROM dir WHERE threshold = 500) m ON f.symbol = m.symbol AND f.close_time >= m.close_time ASOF LEFT JOIN (SELECT * FROM dir WHERE threshold = 1000) c ON f.symbol = c.symbol AND f.close_time >= c.close_time)", "", f"{O.bars((250, 500, 1000))}, {_DIR}")
def _(s, d):
    return A.aligned(directed(s, d, (250, 500, 1000)), (250, 500, 1000)).select(*ID, "alignment")


@query("st_tstat", "SELECT symbol, p2 AS pattern, count(ret) AS n, avg(ret) / (stddev_samp(ret) / sqrt(count(ret))) AS t FROM pat WHERE p2 IS NOT NULL GROUP BY ALL", "t", f"{PLAIN}, {_DIR}, {_P2}")
def _(s, d):
    return patterned(s, d).filter("p2 is not null").groupBy("symbol", F.col("p2").alias("pattern")).agg(F.count("ret").alias("n"), S.tstat().alias("t"))


@query("st_robust", "SELECT p2 AS pattern, count(*) AS periods, count(*) >= 2 AND bool_and(abs(t) >= 1) AND (bool_and(t > 0) OR bool_and(t < 0)) AS is_robust FROM (SELECT p2, bar_id % 4 AS period, count(ret) AS n, avg(ret) / (stddev_samp(ret) / sqrt(count(ret))) AS t FROM pat WHERE p2 IS NOT NULL GROUP BY ALL) WHERE n >= 20 GROUP BY p2", "", f"{PLAIN}, {_DIR}, {_P2}")
def _(s, d):
    return S.robust(patterned(s, d).filter("p2 is not null").withColumn("period", F.col("bar_id") % 4), ["p2"], "period", least=20, t=1.0).withColumnRenamed("p2", "pattern")


def pvalues(s, d) -> DataFrame:
    t = patterned(s, d).filter("p3 is not null").groupBy("symbol", F.col("p3").alias("pattern")).agg(S.tstat().alias("t")).filter("t is not null")
    return t.select("symbol", "pattern", (F.lit(2.0) * (F.lit(1.0) - S.normal_cdf(F.abs("t")))).alias("p"))


_CDF = lambda z: f"CASE WHEN {z} >= 0 THEN 1.0 - phi_tail({z}) ELSE phi_tail(-({z})) END"
_TAIL = lambda z: f"(exp(-({z}) * ({z}) / 2.0) * 0.3989422804014327 * ((1.0 / (1.0 + 0.2316419 * abs({z}))) * (0.319381530 + (1.0 / (1.0 + 0.2316419 * abs({z}))) * (-0.356563782 + (1.0 / (1.0 + 0.2316419 * abs({z}))) * (1.781477937 + (1.0 / (1.0 + 0.2316419 * abs({z}))) * (-1.821255978 + (1.0 / (1.0 + 0.2316419 * abs({z}))) * 1.330274429))))))"
_PV = f"pv AS (SELECT symbol, pattern, 2.0 * {_TAIL('abs(t)')} AS p FROM (SELECT symbol, p3 AS pattern, avg(ret) / (stddev_samp(ret) / sqrt(count(ret))) AS t FROM pat WHERE p3 IS NOT NULL GROUP BY ALL HAVING count(ret) >= 2 AND stddev_samp(ret) > 0))"


@query("st_bh_fdr", "SELECT symbol, pattern, p, k <= (SELECT coalesce(max(k), 0) FROM (SELECT row_number() OVER (ORDER BY p) AS k, p, count(*) OVER () AS n FROM pv) WHERE p <= k / n * 0.2) AS significant FROM (SELECT *, row_number() OVER (ORDER BY p) AS k FROM pv)", "p", f"{PLAIN}, {_DIR}, {_P2}, {_PV}")
def _(s, d):
    return S.bh_fdr(pvalues(s, d), alpha=0.2)


@query("st_bonf", f"SELECT symbol, pattern, p < 0.05 / (SELECT count(*) FROM pv) AS significant FROM pv", "", f"{PLAIN}, {_DIR}, {_P2}, {_PV}")
def _(s, d):
    return pvalues(s, d).select("symbol", "pattern", (F.col("p") < F.lit(0.05) / F.count(F.lit(1)).over(Window.partitionBy())).alias("significant"))


_SH = "sh AS (SELECT symbol, count(ret) AS n, avg(ret) / stddev_samp(ret) AS sr, avg(ret) AS m, stddev_pop(ret) AS sp, list(ret) FILTER (ret IS NOT NULL) AS l FROM dir GROUP BY symbol), mo AS (SELECT *, list_avg(list_transform(l, lambda x: (x - m) ** 3)) / sp ** 3 AS skew, list_avg(list_transform(l, lambda x: (x - m) ** 4)) / sp ** 4 AS kurt FROM sh), pe AS (SELECT *, 1 - skew * sr + (kurt - 1) / 4 * sr * sr AS pen FROM mo), z AS (SELECT *, sr / sqrt(pen / (n - 1)) AS z, (sr - sqrt(2 * ln(10)) * sqrt(pen / (n - 1))) / sqrt(pen / (n - 1)) AS zd FROM pe)"
_PHI = lambda z: f"CASE WHEN {z} >= 0 THEN 1.0 - {_TAIL(z)} ELSE {_TAIL(z)} END"
for _name, _sql, _cols in (("st_sharpe", "sr", "sr"), ("st_psr", f"{_PHI('z')} AS psr", "psr"), ("st_dsr", f"{_PHI('zd')} AS dsr", "dsr"), ("st_mintrl", "CASE WHEN sr > 0 THEN 1 + pen * (1.6448536269514722 / sr) ** 2 END AS min_trl", "min_trl")):

    @query(_name, f"SELECT symbol, n, {_sql} FROM z", _cols, f"{PLAIN}, {_DIR}, {_SH}")
    def _(s, d, col=_cols):
        return S.sharpe(directed(s, d), ["symbol"]).select("symbol", "n", col)


@query("st_kelly", "SELECT symbol, count(ret) AS n, avg(ret) / (stddev_samp(ret) * stddev_samp(ret)) AS kelly, count(ret)::DOUBLE ** (2 * (1 - 0.6)) AS n_effective FROM dir GROUP BY symbol", "kelly n_effective", f"{PLAIN}, {_DIR}")
def _(s, d):
    return S.kelly(directed(s, d), ["symbol"], hurst=0.6)


@query("st_boot")
def _(s, d):
    return S.resampled(directed(s, d), ["symbol", "direction"]).select("symbol", "direction", "n", "ci_low", "ci_high")


@query("st_perm")
def _(s, d):
    return S.resampled(directed(s, d), ["symbol", "direction"]).select("symbol", "direction", "n", "p_perm")


@query("st_hurst_r")
def _(s, d):
    return A.hurst_estimates(bars(s, d))


@query("st_corr_matrix", "SELECT corr(ofi, price_impact) AS ofi_impact, corr(ofi, volume) AS ofi_volume, corr(price_impact, volume) AS impact_volume FROM bars", "ofi_impact ofi_volume impact_volume", PLAIN)
def _(s, d):
    return bars(s, d).agg(S.correlation("ofi", "price_impact").alias("ofi_impact"), S.correlation("ofi", "volume").alias("ofi_volume"), S.correlation("price_impact", "volume").alias("impact_volume"))


@query("st_spearman", "SELECT symbol, corr(a, b) AS rho FROM (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY ofi) + (count(*) OVER (PARTITION BY symbol, ofi) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY price_impact) + (count(*) OVER (PARTITION BY symbol, price_impact) - 1) / 2.0 AS b FROM bars) GROUP BY symbol", "rho", PLAIN)
def _(s, d):
    return A.spearman(bars(s, d), "ofi", "price_impact", ["symbol"])


@query("st_mi")
def _(s, d):
    return A.mutual_information(directed(s, d), "ofi", "ret", ["symbol"])


@query("st_adf")
def _(s, d):
    return A.unit_root(bars(s, d))


@query("st_adwin")
def _(s, d):
    return A.drift(bars(s, d))


@query("st_cost", "SELECT symbol, p2 AS pattern, count(ret) AS n, avg(ret) * 10000 - 2.0 AS net_bps, avg(((CASE WHEN ret > 0 THEN ret ELSE -ret END) * 10000 > 2.0)::INT) AS share_over_cost FROM pat WHERE p2 IS NOT NULL AND ret IS NOT NULL GROUP BY ALL", "net_bps share_over_cost", f"{PLAIN}, {_DIR}, {_P2}")
def _(s, d):
    return A.after_cost(patterned(s, d).filter("p2 is not null and ret is not null"), ["symbol", F.col("p2").alias("pattern")], 2.0)


_FOLDS = """placed AS (SELECT *, max(i) FILTER (fresh) OVER (PARTITION BY symbol ORDER BY i) AS run_from FROM (SELECT symbol, threshold, direction, row_number() OVER w - 1 AS i, coalesce(lag(direction) OVER w <> direction, true) AS fresh FROM dir WINDOW w AS (PARTITION BY symbol ORDER BY bar_id))),
folds AS (SELECT symbol, threshold, unnest(range((n - 160) // 40)) AS fold FROM (SELECT symbol, threshold, count(*) AS n FROM dir GROUP BY ALL HAVING count(*) >= 200)),
places AS (SELECT f.*, p.i >= fold * 40 + 160 AS test, p.i - greatest(p.run_from, CASE WHEN p.i >= fold * 40 + 160 THEN fold * 40 + 160 ELSE fold * 40 END) + 1 AS place FROM folds f LEFT JOIN placed p ON p.symbol = f.symbol AND p.direction = 'U' AND p.i >= fold * 40 AND p.i < fold * 40 + 200),
reached AS (SELECT symbol, threshold, fold, test, count(*) FILTER (place = 1) AS k1, count(*) FILTER (place = 2) AS k2, count(*) FILTER (place = 5) AS k5, count(*) FILTER (place = 6) AS k6 FROM places GROUP BY ALL),
deltas AS (SELECT symbol, threshold, fold, max(CASE WHEN k1 >= 1 AND k5 >= 1 THEN k6 / k5 - k2 / k1 END) FILTER (NOT test) AS train_delta, max(CASE WHEN k1 >= 1 AND k5 >= 1 THEN k6 / k5 - k2 / k1 END) FILTER (test) AS test_delta FROM reached GROUP BY ALL)"""


#: 160 bars of training, 40 of test and a single run as least sample, as the test tables' series are short.
@query("st_wfo", "SELECT *, train_delta > 0.05 AS predicted, test_delta > 0 AS actual, (train_delta > 0.05) = (test_delta > 0) AS correct FROM deltas", "train_delta test_delta", f"{PLAIN}, {_DIR}, {_FOLDS}")
def _(s, d):
    return A.momentum_walk_forward(directed(s, d), 160, 40, least=1)


# ---------------------------------------------------------------- top-k, store, sets


@query("tk_last_n", "SELECT symbol, bar_id, close, total FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY close_time DESC, bar_id DESC) AS k, count(*) OVER (PARTITION BY symbol) AS total FROM bars) WHERE k <= 10", "close", PLAIN)
def _(s, d):
    b = bars(s, d)
    return Q.last_n(b.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("symbol"))), 10).select(*ID, "close", "total")


@query("tk_last_before", "SELECT symbol, arg_max(bar_id, close_time) AS bar_id FROM bars WHERE close_time < (SELECT (min(ts_us) + max(ts_us)) // 2 FROM trades) GROUP BY symbol", "", PLAIN)
def _(s, d):
    mid = trades(s, d).agg(F.floor((F.min("ts_us") + F.max("ts_us")) / 2).alias("_m"))
    return bars(s, d).crossJoin(F.broadcast(mid)).filter("close_time < _m").groupBy("symbol").agg(F.max_by("bar_id", "close_time").alias("bar_id"))  # one row


@query("tk_minmax", "SELECT symbol, min(open_time) AS oldest, max(close_time) AS newest, max(last_agg_trade_id) AS high_water FROM bars GROUP BY symbol", "", PLAIN)
def _(s, d):
    return bars(s, d).groupBy("symbol").agg(F.min("open_time").alias("oldest"), F.max("close_time").alias("newest"), F.max("last_agg_trade_id").alias("high_water"))


@query("tk_count", "SELECT symbol, count(*) AS n FROM bars WHERE close_time < 1706000000000000 GROUP BY symbol", "", PLAIN)
def _(s, d):
    return bars(s, d).filter("close_time < 1706000000000000").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("tk_longest", "SELECT symbol, bar_id, duration_us FROM bars ORDER BY duration_us DESC, symbol, bar_id LIMIT 100", "", PLAIN)
def _(s, d):
    return bars(s, d).select(*ID, "duration_us").orderBy(F.col("duration_us").desc(), "symbol", "bar_id").limit(100)


@query("tk_status", "SELECT job, symbol, status, queued_us FROM queue ORDER BY queued_us DESC, job LIMIT 50", "", f"WITH {_QUEUE}")
def _(s, d):
    return A.queue_from_events(s, d).select("job", "symbol", "status", "queued_us").orderBy(F.col("queued_us").desc(), "job").limit(50)


@query("so_concat", "SELECT symbol, bar_id, open_time FROM bars", "", PLAIN)
def _(s, d):
    b = bars(s, d).select(*ID, "open_time", "close_time")
    return b.filter("bar_id % 2 = 0").drop("close_time").unionByName(b.filter("bar_id % 2 = 1"), allowMissingColumns=True).select(*ID, T.micros(F.col("open_time")).alias("open_time"))


@query("so_dedup_id", "SELECT symbol, count(*) AS n FROM trades GROUP BY symbol", "", TRADES)
def _(s, d):
    t = trades(s, d)
    return Q.first_by_id(t.unionByName(t.filter("agg_trade_id % 5 = 0").withColumn("ts_us", F.col("ts_us") + 1))).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("so_replacing", "SELECT symbol, bar_id, close + CASE WHEN bar_id % 3 = 0 THEN 1 ELSE 0 END AS close FROM bars", "close", PLAIN)
def _(s, d):
    b = bars(s, d).withColumn("computed_at", F.lit(1))
    newer = b.filter("bar_id % 3 = 0").withColumn("close", F.col("close") + 1).withColumn("computed_at", F.lit(2))
    return Q.latest(b.unionByName(newer), ["symbol", "threshold", "segment", "bar_id"], "computed_at").select(*ID, "close")


def stored(s, d):
    """A store with an older version of the even bars, and the newer of all."""
    from ..sources import sinks

    store = sinks.BarStore(s, shared(s, "bars"))
    b = bars(s, d)
    store.write(b.filter("bar_id % 2 = 0").withColumn("close", F.col("close") + 5), version=1, token="first")
    store.write(b, version=2, token="second")
    return store


@query("so_retention", "SELECT symbol, bar_id, close_time, close FROM bars WHERE close_time >= 1706745600000000 - 14 * 86400000000", "close", PLAIN)
def _(s, d):
    store = stored(s, d)
    store.compact(now_us=1_706_745_600_000_000, keep_us=14 * 86_400_000_000)
    return store.read().select(*ID, "close_time", "close")


@query("so_invalidate", "SELECT symbol, bar_id, close FROM bars WHERE NOT (symbol = 'click' AND open_time BETWEEN 1705000000000000 AND 1705600000000000) AND symbol <> 'view'", "close", PLAIN)
def _(s, d):
    store = stored(s, d)
    store.invalidate("click", 2, 250, 1_705_000_000_000_000, 1_705_600_000_000_000)
    store.invalidate("view", 2)
    return store.read().select(*ID, "close")


# ---------------------------------------------------------------- scalar functions


@query("fn_fixed_point", "SELECT agg_trade_id, price_fp, price_fp / 1e8 AS price FROM trades", "price", TRADES)
def _(s, d):
    t = trades(s, d).select("agg_trade_id", C.formatted(F.col("price_fp")).alias("_s"))
    return t.select("agg_trade_id", T.fixed(F.col("_s")).alias("price_fp"), (T.fixed(F.col("_s")) / F.lit(1e8)).alias("price"))


@query("fn_date", "SELECT agg_trade_id, ts_us // 1000 AS ms, strftime(make_timestamp(ts_us), '%Y-%m') AS year_month, year(make_timestamp(ts_us)) || '-Q' || quarter(make_timestamp(ts_us)) AS quarter, epoch_us(date_trunc('hour', make_timestamp(ts_us))) AS hour_us FROM trades", "", TRADES)
def _(s, d):
    return trades(s, d).select("agg_trade_id", *C.calendar(F.col("ts_us")))


_LOCAL = ", ".join(f"make_timestamp(ts_us) AT TIME ZONE 'UTC' AT TIME ZONE '{zone}' AS {name}" for name, (zone, _, _) in C.SESSIONS.items())
_OPEN = ", ".join(f"isodow({name}) < 6 AND hour({name}) >= {first} AND hour({name}) < {end} AS {name}" for name, (_, first, end) in C.SESSIONS.items())


@query("fn_sessions", f"SELECT agg_trade_id, {_OPEN} FROM (SELECT agg_trade_id, {_LOCAL} FROM trades)", "", TRADES)
def _(s, d):
    return trades(s, d).select("agg_trade_id", *[c.alias(k) for k, c in C.sessions(F.col("ts_us")).items()])


@query("fn_asset_class", "SELECT symbol, CASE WHEN symbol LIKE '%usd%' THEN 'forex' ELSE 'unknown' END AS asset_class FROM (SELECT DISTINCT symbol FROM trades)", "", TRADES)
def _(s, d):
    return trades(s, d).select("symbol").distinct().select("symbol", C.asset_class(F.col("symbol")).alias("asset_class"))


@query("fn_math", "SELECT agg_trade_id, ln(price_fp / 1e8) AS ln_p, log2(price_fp / 1e8) AS log2_p, sqrt(price_fp / 1e8) AS sqrt_p, 1 / (1 + exp(-(volume_fp / 1e10 - 0.5))) AS sig, tanh(volume_fp / 1e10) AS th, least(greatest(volume_fp / 1e10, 0.2), 0.8) AS clamped FROM trades", "ln_p log2_p sqrt_p sig th clamped", TRADES)
def _(s, d):
    p, v = F.col("price_fp") / F.lit(1e8), F.col("volume_fp") / F.lit(1e10)
    return trades(s, d).select("agg_trade_id", F.log(p).alias("ln_p"), F.log2(p).alias("log2_p"), F.sqrt(p).alias("sqrt_p"), C.logistic(v, 0.5, 1.0).alias("sig"), F.tanh(v).alias("th"), C.clamp(v, 0.2, 0.8).alias("clamped"))


@query("fn_string", "SELECT symbol, split_part('12.39.0', '.', 1) AS major, symbol || '@250' AS key FROM (SELECT DISTINCT symbol FROM trades)", "", TRADES)
def _(s, d):
    return trades(s, d).select("symbol").distinct().select("symbol", C.major(F.lit("12.39.0")).alias("major"), F.concat("symbol", F.lit("@250")).alias("key"))


@query("fn_hash", "SELECT symbol, md5(symbol || ':250') AS cache_key, sha256(symbol) AS sha FROM (SELECT DISTINCT symbol FROM trades)", "", TRADES)
def _(s, d):
    return trades(s, d).select("symbol").distinct().select("symbol", F.md5(F.concat("symbol", F.lit(":250"))).alias("cache_key"), F.sha2("symbol", 256).alias("sha"))


@query("fn_array", "SELECT symbol, bar_id, list_sum(l[1:3])::BIGINT AS head FROM (SELECT symbol, bar_id, list(price_fp ORDER BY rn) AS l FROM a GROUP BY ALL)", "", O.walked())
def _(s, d):
    from .catalog import ids

    lists = ids(s, d).groupBy(*ID).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts_us", "agg_trade_id", "price_fp"))), lambda x: x["price_fp"]).alias("_l"))
    return lists.select(*ID, F.aggregate(F.slice("_l", 1, 3), F.lit(0).cast("long"), lambda a, x: a + x).alias("head"))


@query("fn_conditional", "SELECT agg_trade_id, CASE WHEN volume_fp > 7500000000 THEN 'high' WHEN volume_fp > 2500000000 THEN 'mid' ELSE 'low' END AS size, nullif(volume_fp, 0) AS volume FROM trades", "", TRADES)
def _(s, d):
    return trades(s, d).select("agg_trade_id", F.when(F.col("volume_fp") > 7_500_000_000, "high").when(F.col("volume_fp") > 2_500_000_000, "mid").otherwise("low").alias("size"), F.nullif("volume_fp", F.lit(0).cast("long")).alias("volume"))


@query("fn_json", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# ---------------------------------------------------------------- checks


@query("val_continuity", "SELECT symbol, threshold, segment, bar_id, gap FROM (SELECT *, abs(open - lag(close) OVER w) / lag(close) OVER w AS gap FROM bars WINDOW w AS (PARTITION BY symbol, threshold, segment ORDER BY bar_id)) WHERE gap > threshold / 100000.0 + 0.0005", "gap", PLAIN)
def _(s, d):
    return Q.discontinuities(bars(s, d), 0.0005)


@query("val_junction", "SELECT symbol, threshold, segment, gap, gap <= 0.001 AS ok FROM (SELECT *, abs(o - lag(c) OVER (PARTITION BY symbol, threshold ORDER BY segment)) / lag(c) OVER (PARTITION BY symbol, threshold ORDER BY segment) AS gap FROM (SELECT symbol, threshold, segment, arg_min(open, bar_id) AS o, arg_max(close, bar_id) AS c FROM bars GROUP BY ALL)) WHERE gap IS NOT NULL", "gap", O.bars(segment="week"))
def _(s, d):
    return Q.junctions(bars(s, d, segment="week"))


@query("val_tiered", "SELECT symbol, threshold, CASE WHEN gap < 1e-5 THEN 'precision' WHEN gap < 1e-4 THEN 'noise' WHEN gap < 1e-3 THEN 'market_move' WHEN gap < threshold / 10000.0 * 2 THEN 'microstructure' ELSE 'session_boundary' END AS tier, count(*) AS n, max(gap) AS max_gap, avg(gap) AS avg_gap FROM (SELECT *, abs(open - lag(close) OVER w) / lag(close) OVER w AS gap FROM bars WINDOW w AS (PARTITION BY symbol, threshold, segment ORDER BY bar_id)) WHERE gap IS NOT NULL GROUP BY ALL", "max_gap avg_gap", PLAIN)
def _(s, d):
    return Q.gap_tiers(bars(s, d))


_STALE = "bool_and(vwap BETWEEN low AND high) AS vwap_ok, bool_and(ofi BETWEEN -1 AND 1) AS ofi_ok, bool_and(turnover_imbalance BETWEEN -1 AND 1) AS turnover_ok, bool_and(aggregation_density >= 1) AS density_ok, bool_and(individual_trade_count >= 1) AS counts_ok, bool_and(duration_us >= 0) AS duration_ok, bool_and(volume >= 0) AS volume_ok, bool_or(ofi <> 0) AS not_zero"


@query("val_staleness", f"SELECT *, NOT (vwap_ok AND ofi_ok AND turnover_ok AND density_ok AND counts_ok AND duration_ok AND volume_ok AND not_zero) AS is_stale FROM (SELECT symbol, threshold, {_STALE} FROM bars GROUP BY ALL)", "", PLAIN)
def _(s, d):
    return Q.staleness(bars(s, d))


_TIER1 = "SELECT *, coalesce(corr_sane, true) AND NOT has_nan AND ofi_bounded AND abs(mean_ofi) < 0.3 AND median_aggression < 10 AND min_volume >= 0 AS passed FROM (SELECT *, CASE WHEN n > 50 AND NOT isnan(corr_ofi_return) THEN abs(corr_ofi_return) > 0.05 AND abs(corr_ofi_return) < 0.8 END AS corr_sane FROM (SELECT symbol, threshold, count(*) AS n, bool_or(isnan(ofi) OR isinf(ofi) OR isnan(kyle_lambda_proxy) OR isinf(kyle_lambda_proxy)) AS has_nan, bool_and(ofi BETWEEN -1 AND 1) AS ofi_bounded, avg(ofi) AS mean_ofi, median(aggression_ratio) AS median_aggression, min(volume) AS min_volume, corr(ofi, r) AS corr_ofi_return FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol, threshold, segment ORDER BY bar_id) - 1 AS r FROM bars) GROUP BY ALL))"


@query("val_tier1", _TIER1, "mean_ofi median_aggression min_volume corr_ofi_return", PLAIN)
def _(s, d):
    return Q.plausible(bars(s, d))


_WIDE = ", ".join(f"{f}::DOUBLE AS {f}" for f in B.FEATURES)
_LIMIT = "1.959963984540054 + (1.959963984540054 ** 3 + 1.959963984540054) / (4 * (n - 2)) + (5 * 1.959963984540054 ** 5 + 16 * 1.959963984540054 ** 3 + 3 * 1.959963984540054) / (96 * (n - 2) * (n - 2))"
_TIER2 = f"""long AS (SELECT symbol, threshold, feature, value, ret FROM (SELECT symbol, threshold, ret, {_WIDE} FROM dir WHERE ret IS NOT NULL) UNPIVOT (value FOR feature IN ({', '.join(B.FEATURES)}))),
ranks AS (SELECT symbol, threshold, feature, rank() OVER (PARTITION BY symbol, threshold, feature ORDER BY value) + (count(*) OVER (PARTITION BY symbol, threshold, feature, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol, threshold, feature ORDER BY ret) + (count(*) OVER (PARTITION BY symbol, threshold, feature, ret) - 1) / 2.0 AS b FROM long),
rho AS (SELECT symbol, threshold, feature, count(*) AS n, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS rho FROM ranks GROUP BY ALL HAVING count(*) > 100),
signs AS (SELECT *, coalesce(abs(rho) > 0.02 AND (abs(rho) >= 1 OR abs(rho) * sqrt((n - 2) / (1 - rho * rho)) > {_LIMIT}), false) AS significant FROM rho),
tier1 AS ({_TIER1})"""


@query("val_tier2", "SELECT s.*, count(*) FILTER (significant) OVER (PARTITION BY symbol, threshold) AS n_significant, passed AND count(*) FILTER (significant) OVER (PARTITION BY symbol, threshold) >= 3 AS passed FROM signs s JOIN tier1 USING (symbol, threshold)", "rho", f"{PLAIN}, {_DIR}, {_TIER2}")
def _(s, d):
    return A.second_tier(bars(s, d))


_GAPS = "gaps AS (SELECT *, abs(open - lag(close) OVER w) / lag(close) OVER w AS gap FROM bars WINDOW w AS (PARTITION BY symbol, threshold, segment ORDER BY bar_id)), presets AS (SELECT unnest(['standard', 'paranoid', 'narrow']) AS preset, unnest([0.01::DOUBLE, 0.001::DOUBLE, 0.0002::DOUBLE]) AS tolerance, unnest(['warn', 'error', 'error']) AS mode)"


@query("val_presets", "SELECT preset, symbol, threshold, count(*) AS n_bars, count(*) FILTER (gap < 1e-5) AS precision, count(*) FILTER (gap >= 1e-5 AND gap < 1e-4) AS noise, count(*) FILTER (gap >= 1e-4 AND gap < 1e-3) AS market_move, count(*) FILTER (gap >= 1e-3 AND gap < threshold / 10000.0 * 2) AS microstructure, count(*) FILTER (gap >= 1e-3 AND gap >= threshold / 10000.0 * 2) AS session_boundary, max(gap) AS max_gap, count(*) FILTER (gap > tolerance AND gap >= 1e-5) AS n_over, count(*) FILTER (gap >= 1e-3 AND gap >= threshold / 10000.0 * 2) = 0 AS is_valid, CASE WHEN count(*) FILTER (gap > tolerance AND gap >= 1e-4) > 0 THEN any_value(mode) ELSE 'ok' END AS verdict FROM gaps, presets GROUP BY preset, symbol, threshold", "max_gap", f"{PLAIN}, {_GAPS}")
def _(s, d):
    b, out = bars(s, d), None
    for name, preset in (("standard", "standard"), ("paranoid", "paranoid"), ("narrow", (0.0002, "error"))):
        one = Q.continuity(b, preset).withColumn("preset", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("val_post", "SELECT symbol, threshold, count(*) AS n, min(open_time) AS first, max(close_time) AS last, sum(round(open * 100)::BIGINT + 3 * round(high * 100)::BIGINT + 5 * round(low * 100)::BIGINT + 7 * round(close * 100)::BIGINT)::BIGINT AS checksum FROM bars GROUP BY ALL", "", PLAIN)
def _(s, d):
    return Q.fingerprint(bars(s, d))


@query("val_ohlc", "SELECT count(*) AS bad FROM bars WHERE high < greatest(open, close) OR low > least(open, close)", "", PLAIN)
def _(s, d):
    return Q.bad_ohlc(bars(s, d)).agg(F.count(F.lit(1)).alias("bad"))


@query("val_guards", "SELECT symbol, threshold, segment, bar_id, (high - low) / open AS spread, CASE WHEN close_time NOT BETWEEN 946684800000000 AND 2082758399999999 THEN 'time' WHEN volume < 0 THEN 'volume' WHEN (high - low) / open > 3.0 * threshold / 100000.0 THEN 'range' END AS problem FROM bars", "spread", PLAIN)
def _(s, d):
    return Q.guarded(bars(s, d))


@query("val_gaps", "SELECT symbol, threshold, segment, bar_id, gap_hours, price_gap_bps, CASE WHEN gap_hours >= 2 AND price_gap_bps >= 50 THEN 'both' WHEN gap_hours >= 2 THEN 'time' WHEN price_gap_bps >= 50 THEN 'price' END AS kind FROM (SELECT *, (open_time - lag(close_time) OVER w) / 3.6e9 AS gap_hours, abs(open - lag(close) OVER w) / lag(close) OVER w * 10000 AS price_gap_bps FROM bars WINDOW w AS (PARTITION BY symbol, threshold, segment ORDER BY bar_id)) WHERE gap_hours >= 2 OR price_gap_bps >= 50", "gap_hours price_gap_bps", PLAIN)
def _(s, d):
    return Q.time_gaps(bars(s, d), 2.0, 50.0)


@query("val_id_gaps", "SELECT symbol, threshold, segment, bar_id, missing FROM (SELECT *, first_trade_id - lag(last_trade_id) OVER (PARTITION BY symbol, threshold, segment ORDER BY bar_id) - 1 AS missing FROM bars) WHERE missing <> 0", "", PLAIN)
def _(s, d):
    return Q.id_gaps(bars(s, d))


@query("val_duration", "SELECT symbol, bar_id, duration_us FROM bars WHERE duration_us > 3 * (SELECT median(duration_us) FROM bars)", "", PLAIN)
def _(s, d):
    b = bars(s, d)
    return b.crossJoin(F.broadcast(b.agg(F.median("duration_us").alias("_m")))).filter("duration_us > 3 * _m").select(*ID, "duration_us")  # one row


@query("val_repair", "SELECT symbol, gap_start, gap_end, CASE WHEN gap_end >= 1706700000000000 THEN 'P0' WHEN (1706700000000000 - gap_end) / 3.6e9 < 48 THEN 'P1' ELSE 'P2' END AS priority, unnest(range(gap_start // 86400000000, gap_end // 86400000000 + 1)) AS day FROM (SELECT symbol, lag(close_time) OVER (PARTITION BY symbol ORDER BY bar_id) AS gap_start, open_time AS gap_end FROM bars) WHERE gap_end - gap_start >= 7200000000", "", PLAIN)
def _(s, d):
    gaps = bars(s, d).select("symbol", F.lag("close_time").over(R.series()).alias("gap_start"), F.col("open_time").alias("gap_end")).filter("gap_end - gap_start >= 7200000000")
    return Q.repair_priority(gaps, 1_706_700_000_000_000)


@query("val_recency", "SELECT symbol, threshold, age_minutes, CASE WHEN age_minutes < 30 THEN 900 WHEN age_minutes < 120 THEN 300 WHEN age_minutes < 1440 THEN 120 ELSE 30 END AS poll_seconds FROM (SELECT symbol, threshold, (1706700000000000 - max(close_time)) / 6e7 AS age_minutes FROM bars GROUP BY ALL)", "age_minutes", PLAIN)
def _(s, d):
    return Q.recency(bars(s, d), 1_706_700_000_000_000)


@query("val_csv_profile", "SELECT count(*) AS n, count(DISTINCT symbol) AS symbols, min(ts_us) AS first, max(ts_us) AS last, count(*) FILTER (price_fp <= 0) AS bad_prices FROM trades", "", TRADES)
def _(s, d):
    return trades(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols"), F.min("ts_us").alias("first"), F.max("ts_us").alias("last"), F.count_if(F.col("price_fp") <= 0).alias("bad_prices"))


@query("val_temporal", "SELECT symbol, bar_id FROM (SELECT *, lag(close_time) OVER (PARTITION BY symbol, threshold, segment ORDER BY bar_id) AS before FROM bars) WHERE close_time < open_time OR open_time < before", "", PLAIN)
def _(s, d):
    b = bars(s, d).withColumn("_b", F.lag("close_time").over(Q.order()))
    return b.filter("close_time < open_time or open_time < _b").select(*ID)


# ---------------------------------------------------------------- sources and sinks


_T_COLS = "symbol, agg_trade_id, price_fp, volume_fp, first_trade_id, last_trade_id, ts_us, is_buyer_maker"


@query("src_trades_csv", f"SELECT {_T_COLS} FROM trades", "", TRADES)
def _(s, d):
    path = shared(s, "trades-csv")
    t = trades(s, d)
    t.select("symbol", "agg_trade_id", C.formatted(F.col("price_fp")).alias("p"), C.formatted(F.col("volume_fp")).alias("q"), "first_trade_id", "last_trade_id", "ts_us", F.when(F.col("is_buyer_maker"), "True").otherwise("False").alias("m")).write.partitionBy("symbol").option("header", True).csv(path)
    return T.read_csv(s, path).select(*_T_COLS.split(", "))


@query("src_trades_json", f"SELECT {_T_COLS} FROM trades", "", TRADES)
def _(s, d):
    t = trades(s, d).select("symbol", F.to_json(F.struct(F.col("agg_trade_id").alias("a"), C.formatted(F.col("price_fp")).alias("p"), C.formatted(F.col("volume_fp")).alias("q"), F.col("first_trade_id").alias("f"), F.col("last_trade_id").alias("l"), F.col("ts_us").alias("T"), F.col("is_buyer_maker").alias("m"))).alias("payload"))
    return T.from_json(t, "payload", F.col("symbol")).select(*_T_COLS.split(", "))


@query("src_arrow", "SELECT symbol, agg_trade_id, price_fp, volume_fp, ts_us, false AS is_buyer_maker FROM trades", "", TRADES)
def _(s, d):
    t = trades(s, d).select("symbol", "agg_trade_id", F.col("ts_us").alias("timestamp"), C.formatted(F.col("price_fp")).alias("price"), C.formatted(F.col("volume_fp")).alias("quantity"))
    return T.canonical(t, F.col("symbol")).select("symbol", "agg_trade_id", "price_fp", "volume_fp", "ts_us", "is_buyer_maker")


@query("src_chunks", "SELECT symbol, ts_us - ts_us % 21600000000 AS chunk, count(*) AS n FROM trades GROUP BY ALL", "", TRADES)
def _(s, d):
    return trades(s, d).groupBy("symbol", T.hour_chunk(F.col("ts_us")).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


@query("src_range", "SELECT symbol, count(*) AS n FROM trades WHERE ts_us // 86400000000 > (SELECT max(ts_us) // 86400000000 FROM trades) - 3 GROUP BY symbol", "", TRADES)
def _(s, d):
    return A.last_days(trades(s, d), 3).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("src_recent", "SELECT symbol, max(ts_us // 86400000000) AS day FROM trades GROUP BY symbol", "", TRADES)
def _(s, d):
    return trades(s, d).groupBy("symbol").agg(F.max(F.floor(F.col("ts_us") / 86_400_000_000)).alias("day"))


@query("src_symbol_discovery", "SELECT event_type AS symbol FROM (SELECT event_type, user_id % 3 AS market FROM events) GROUP BY event_type HAVING count(DISTINCT market) = 3")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("symbol"), (F.col("user_id") % 3).alias("market"))
    return e.groupBy("symbol").agg(F.count_distinct("market").alias("_n")).filter("_n = 3").select("symbol")


@query("src_tick_store", "SELECT symbol, count(*) AS n, min(ts_us) AS first, max(ts_us) AS last FROM trades GROUP BY symbol", "", TRADES)
def _(s, d):
    store = T.TickStore(s, shared(s, "ticks"))
    t = trades(s, d)
    store.append(t.filter("agg_trade_id % 2 = 0"))
    store.append(t)
    return store.read(None, 0, 4_000_000_000_000_000).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first"), F.max("ts_us").alias("last"))


#: A table's file, or a file of its folder, below the folder of tables.
_FILE = r"[^/]+\.parquet(/[^/]+)*$"


@query("src_checksum")
def _(s, d):
    found = T.file_digests(s, f"{d}/*.parquet")
    return found.select(F.regexp_extract("path", _FILE, 0).alias("name"), "length", "sha256")


@query("src_ticks_quote", "SELECT symbol, count(*) AS n FROM (SELECT event_type AS symbol FROM events) GROUP BY symbol")
def _(s, d):
    from ..operators.spread import quotes_from_events

    path = shared(s, "quotes")
    quotes_from_events(s, d).select(F.lit("venue").alias("provider"), "symbol", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"), "bid", "ask").write.option("header", True).csv(path)
    return T.read_quotes(s, path).filter("bid > 0 and ask >= bid and ts_us is not null").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def sink(name: str, kind: str):
    @query(name, "SELECT symbol, threshold, segment, bar_id, open, close, volume FROM bars", "open close volume", PLAIN)
    def _(s, d):
        path = shared(s, kind)
        rows = bars(s, d).select(*B.BAR, "open", "close", "volume")
        rows.write.option("header", True).format(kind).save(path)
        return s.read.schema(rows.schema).option("header", True).format(kind).load(path)


sink("snk_parquet", "parquet")
sink("snk_csv", "csv")


@query("snk_arrow", "SELECT symbol, count(*) AS n FROM bars GROUP BY symbol", "", PLAIN)
def _(s, d):
    from ..sources import sinks

    return sinks.arrow_sizes(bars(s, d).select("symbol", "bar_id", "close"))


@query("snk_roundtrip", "SELECT symbol, bar_id, close, CASE WHEN bar_id % 7 = 0 THEN 'volume' WHEN bar_id % 7 = 1 THEN 'prices' WHEN close_time <= open_time THEN 'time' WHEN volume <= 0 THEN 'volume' END AS reason FROM bars", "close", PLAIN)
def _(s, d):
    from ..sources import sinks

    path, b = shared(s, "frame"), bars(s, d)
    spoilt = b.withColumn("volume", F.when(F.col("bar_id") % 7 == 0, 0.0).otherwise(F.col("volume"))).withColumn("high", F.when(F.col("bar_id") % 7 == 1, F.col("low") - 1).otherwise(F.col("high")))
    spoilt.write.parquet(path)
    good, bad = sinks.from_frame(s.read.parquet(path))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).select(*ID, "close", "reason")


@query("snk_store", "SELECT symbol, bar_id, close FROM bars", "close", PLAIN)
def _(s, d):
    store = stored(s, d)
    store.write(bars(s, d).withColumn("close", F.lit(0.0)), version=3, token="second")  # has been written
    store.compact()
    return store.read().select(*ID, "close")


@query("snk_panel", 'SELECT close_time AS ts, symbol, close AS "price.close", ofi AS "feature.ofi" FROM bars', '"price.close" "feature.ofi"', PLAIN)
def _(s, d):
    from ..sources import sinks

    return sinks.panel(bars(s, d), ["ofi"]).select("ts", "symbol", "`price.close`", "`feature.ofi`")


@query("snk_deadletter", "SELECT symbol, bar_id, CASE WHEN bar_id % 5 = 0 THEN 'negative volume' END AS reason FROM bars", "", PLAIN)
def _(s, d):
    from ..sources import sinks
    from ..streaming import live

    folder = shared(s, "dead")
    stream = live.streaming_bars(live._as_stream(s, trades(s, d), folder, 2))
    live.into_store(s, stream.withColumn("volume_fp", F.when(F.col("bar_id") % 5 == 0, -1).otherwise(F.col("volume_fp"))), f"{folder}/store", f"{folder}/state").awaitTermination()
    dead = s.read.option("basePath", f"{folder}/store-dead").parquet(f"{folder}/store-dead")
    return sinks.BarStore(s, f"{folder}/store").read().select(*ID, F.lit(None).cast("string").alias("reason")).unionByName(dead.select(*ID, "reason"))


# ---------------------------------------------------------------- streams, extensions


@query("str_live", "SELECT symbol, bar_id, open_fp, close_fp, volume_fp FROM raw WHERE is_complete", "", O.bars())
def _(s, d):
    from ..streaming import live

    return live.replayed_bars(s, trades(s, d), shared(s, "stream")).select("symbol", "bar_id", "open_fp", "close_fp", "volume_fp")


@query("str_stats", "SELECT symbol, count(*) AS n, min(price_fp) AS lowest, max(price_fp) AS highest FROM trades GROUP BY symbol", "", TRADES)
def _(s, d):
    from ..streaming import live

    return live.replayed_stats(s, trades(s, d), shared(s, "stream"))


@query("udf_provider", f"SELECT symbol, bar_id, close / avg(close) {frame(5)} - 1 AS stretch FROM bars", "stretch", PLAIN)
def _(s, d):
    from .. import plugins

    return plugins.enriched(bars(s, d), [plugins.Provider("stretch", "1.0", ["stretch"], lambda b: b.withColumn("stretch", F.col("close") / F.avg("close").over(R.frame(5)) - 1))]).select(*ID, "stretch")


@query("udf_columns", "SELECT symbol, bar_id, CASE WHEN bar_id % 2 = 0 THEN ofi END AS extra FROM bars", "extra", PLAIN)
def _(s, d):
    from .. import plugins

    b = bars(s, d)
    return plugins.merged(b.filter("bar_id % 2 = 1").select(*ID), b.filter("bar_id % 2 = 0").select(*ID, F.col("ofi").alias("extra"))).select(*ID, "extra")


@query("udf_manifest")
def _(s, d):
    from .. import plugins

    return plugins.manifest(s)


@query("udf_lazy_map", "SELECT symbol, count(*) AS n FROM bars GROUP BY symbol", "", PLAIN)
def _(s, d):
    return trades(s, d).transform(B.range_bars).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


from .catalog import QUERIES, SQL  # noqa: E402

for _alias, _of in (("rb_stream", "str_live"), ("ind_stats", "str_stats")):
    QUERIES[_alias], SQL[_alias] = QUERIES[_of], SQL[_of]


@query("str_state", "SELECT symbol, threshold, bar_id, open_fp, close_fp, volume_fp FROM raw WHERE is_complete", "", O.bars((250, 1000)))
def _(s, d):
    from ..streaming import live

    return live.restarted_bars(s, trades(s, d), shared(s, "stream"), (250, 1000)).select("symbol", "threshold", "bar_id", "open_fp", "close_fp", "volume_fp")


@query("str_backpressure", "SELECT (ts_us - a) // w AS batch, count(*) AS n FROM trades, (SELECT min(ts_us) AS a, greatest(1, (max(ts_us) - min(ts_us)) // 4 + 1) AS w FROM trades) GROUP BY ALL", "", TRADES)
def _(s, d):
    from ..streaming import live

    return live.batch_sizes(s, trades(s, d), shared(s, "stream"), 4)


_WINDOW = "symbol, start_us, start_us + {width} AS end_us, count(*) AS n, sum(volume_fp)::BIGINT AS volume_fp, min(price_fp) AS low_fp, max(price_fp) AS high_fp"
_PASSED = "(SELECT max(ts_us) // 1000 * 1000 - 600000000 FROM trades)"
_SESSIONS = "turned AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w >= 900000000 THEN 1 ELSE 0 END AS turn FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, agg_trade_id)), numbered AS (SELECT *, sum(turn) OVER (PARTITION BY symbol ORDER BY ts_us, agg_trade_id) AS k FROM turned)"
for _kind, _how, _sql in (
    ("tumbling", {}, f"SELECT {_WINDOW.format(width=3_600_000_000)} FROM (SELECT *, ts_us // 3600000000 * 3600000000 AS start_us FROM trades) GROUP BY symbol, start_us"),
    ("sliding", {"slide": "30 minutes"}, f"SELECT {_WINDOW.format(width=3_600_000_000)} FROM (SELECT *, ts_us // 1800000000 * 1800000000 - 1800000000 * unnest([0, 1]) AS start_us FROM trades) GROUP BY symbol, start_us"),
    ("session", {"session": "15 minutes"}, "SELECT symbol, min(ts_us) AS start_us, max(ts_us) + 900000000 AS end_us, count(*) AS n, sum(volume_fp)::BIGINT AS volume_fp, min(price_fp) AS low_fp, max(price_fp) AS high_fp FROM numbered GROUP BY symbol, k"),
):

    @query(f"str_window_{_kind}", f"SELECT * FROM ({_sql}) WHERE end_us <= {_PASSED}", "", f"{TRADES}, {_SESSIONS}")
    def _(s, d, how=_how):
        from ..streaming import live

        return live.replayed_windows(s, trades(s, d), shared(s, "windows"), **how)


@query("rb_checkpoint", """SELECT symbol, threshold, segment, bar_id, last_ts, last_id, done AS next_opens, CASE WHEN done THEN -1 ELSE open_fp END AS open_fp, CASE WHEN done THEN -1 ELSE open_fp + open_fp * threshold // 100000 END AS upper_fp, CASE WHEN done THEN -1 ELSE open_fp - open_fp * threshold // 100000 END AS lower_fp, CASE WHEN done THEN -1 ELSE open_time END AS open_time
FROM (SELECT symbol, threshold, segment, bar_id, arg_min(price_fp, rn) AS open_fp, min(ts_us) AS open_time, bool_or(closes) AS done, max(ts_us) AS last_ts, arg_max(agg_trade_id, rn) AS last_id FROM a GROUP BY ALL) QUALIFY bar_id = max(bar_id) OVER (PARTITION BY symbol, threshold, segment)""", "", O.walked())
def _(s, d):
    from .catalog import ids

    return B.checkpoints(ids(s, d))


@query("str_replay", "SELECT symbol, count(*) AS n FROM (SELECT *, max(ts_us) OVER (PARTITION BY symbol) AS newest FROM trades) WHERE ts_us >= newest - 86400000000 GROUP BY symbol", "", TRADES)
def _(s, d):
    from ..streaming import live

    return live.since(trades(s, d), 24 * 60).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("src_page_id", "SELECT 'btc' AS symbol, 2500 AS n, 0 AS first, 2499 AS last")
def _(s, d):
    from ..sources.paged import PagedTrades

    B.ship(s)
    s.dataSource.register(PagedTrades)
    return s.read.format("trade_pages").option("symbol", "btc").option("toId", 2500).load().groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("agg_trade_id").cast("int").alias("first"), F.max("agg_trade_id").cast("int").alias("last"))


@query("src_page_time", "SELECT 'btc' AS symbol, 2500 AS n, 0 AS first, 2499 AS last, 2500 AS ids")
def _(s, d):
    from ..sources.paged import PagedTrades

    B.ship(s)
    s.dataSource.register(PagedTrades)
    start = 1_704_067_200_000_000
    pages = s.read.format("trade_pages").options(symbol="btc", by="time", fromTime=start, toTime=start + 2500 // 4 * 1_000_000, pageSize=90).load()
    return pages.groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("agg_trade_id").cast("int").alias("first"), F.max("agg_trade_id").cast("int").alias("last"), F.count_distinct("agg_trade_id").cast("int").alias("ids"))


@query("src_parquet_recover")
def _(s, d):
    return T.whole_parquet(s, f"{d}/*.parquet").agg(F.count(F.lit(1)).cast("int").alias("files"), F.count_if("ok").cast("int").alias("whole"))


@query("st_tda")
def _(s, d):
    return A.persistence(bars(s, d))


@query("str_sidecar", "SELECT symbol, bar_id, open, close FROM bars", "open close", PLAIN)
def _(s, d):
    from ..sources import sinks
    from ..streaming import live

    folder = shared(s, "sidecar")
    stream = live.streaming_bars(live._as_stream(s, trades(s, d), folder, 2))
    live.into_store(s, stream, f"{folder}/store", f"{folder}/state").awaitTermination()
    return sinks.BarStore(s, f"{folder}/store").read().select(*ID, "open", "close")


@query("src_ws", "SELECT 'eth' AS symbol, 1500 AS n, 1499 AS last")
def _(s, d):
    from ..sources.paged import PagedTrades

    B.ship(s)
    s.dataSource.register(PagedTrades)
    folder = shared(s, "live")
    stream = s.readStream.format("trade_pages").option("symbol", "eth").option("toId", 1500).option("maxTradesPerTrigger", 500).load()
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return s.read.parquet(f"{folder}/out").groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("agg_trade_id").cast("int").alias("last"))
