"""The queries of the engine by operator, each with SQL that DuckDB runs on the same tables.

Trades are derived from `events` (see sources.trades.from_events), bars from them; doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions import tests as S
from ..operators import bars as B
from ..operators import joins as J
from ..operators import quality as Q
from ..operators.windows import Lookback, bar_windows
from ..sources import trades as T
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PLACES = 6
CARRY = ["volume_fp", "first_trade_id", "last_trade_id", "is_buyer_maker"]
KEYS = "symbol, threshold, segment, bar_id"


def smooth(df: DataFrame) -> DataFrame:
    """Doubles rounded; adding 0 makes one zero of two."""
    return df.select(*[(F.round(F.col(f"`{c}`"), PLACES) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = "", base: str | None = None):
    """Registers a query; `base` holds the common table expressions that `sql` reads."""

    def add(make: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: smooth(make(spark, sf_dir))
        if sql is not None:
            SQL[name] = f"{base}\n{O.rounded(sql, doubles, PLACES)}" if base else O.rounded(sql, doubles, PLACES)
        return make

    return add


def trades(spark: SparkSession, d: str) -> DataFrame:
    return T.from_events(spark, d)


def bars(spark: SparkSession, d: str, thresholds=(250,), segment: str | None = None, **more) -> DataFrame:
    return B.range_bars(trades(spark, d), thresholds, B.calendar_segment(F.col("ts_us"), segment) if segment else None, **more)


def ids(spark: SparkSession, d: str, thresholds=(250,), segment: str | None = None, gate: bool = True) -> DataFrame:
    return B.assigned(trades(spark, d), thresholds, B.calendar_segment(F.col("ts_us"), segment) if segment else None, gate, carry=CARRY)


PLAIN = O.bars()
WALK = O.walked()
TRADES = f"WITH {O.TRADES}"

# ---------------------------------------------------------------- bars

FIELDS = "open_time, close_time, open, high, low, close, volume, individual_trade_count, agg_record_count"


@query("rb_batch", f"SELECT {KEYS}, {FIELDS}, ofi FROM bars", "open high low close volume ofi", PLAIN)
def _(s, d):
    return bars(s, d).select(*KEYS.split(", "), *FIELDS.split(", "), "ofi")


@query("rb_incomplete", f"SELECT {KEYS}, {FIELDS}, is_complete FROM allbars", "open high low close volume", PLAIN)
def _(s, d):
    return bars(s, d, include_incomplete=True).select(*KEYS.split(", "), *FIELDS.split(", "), "is_complete")


@query("rb_multi_threshold", "SELECT symbol, threshold, count(*) AS n_bars, min(open_time) AS first, max(close_time) AS last FROM bars GROUP BY ALL", "", O.bars((250, 500, 1000)))
def _(s, d):
    return bars(s, d, (250, 500, 1000)).groupBy("symbol", "threshold").agg(F.count(F.lit(1)).alias("n_bars"), F.min("open_time").alias("first"), F.max("close_time").alias("last"))


@query("rb_export", "SELECT symbol, threshold, bar_id, individual_trade_count, buy_trade_count, sell_trade_count FROM bars", "", O.bars(by_record=True))
def _(s, d):
    return B.priced(B.aggregated(ids(s, d), by_record=True)).filter("is_complete").select("symbol", "threshold", "bar_id", "individual_trade_count", "buy_trade_count", "sell_trade_count")


for _mode in ("year", "month", "week"):

    @query(f"rb_segment_reset_{_mode}", f"SELECT {KEYS}, {FIELDS}, is_complete FROM allbars", "open high low close volume", O.bars(segment=_mode))
    def _(s, d, mode=_mode):
        return bars(s, d, segment=mode, include_incomplete=True).select(*KEYS.split(", "), *FIELDS.split(", "), "is_complete")


QUERIES["rb_segment_reset"], SQL["rb_segment_reset"] = QUERIES["rb_segment_reset_month"], SQL["rb_segment_reset_month"]

_HOURLY = O.TRADES.replace("epoch_us(ts)::BIGINT AS ts_us", "epoch_us(date_trunc('hour', ts))::BIGINT AS ts_us")


@query("flt_ts_gate", f"SELECT {KEYS}, {FIELDS} FROM bars", "open high low close volume", O.bars(trades=_HOURLY))
def _(s, d):
    hourly = trades(s, d).withColumn("ts_us", F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(3_600_000_000)))
    return B.range_bars(hourly).select(*KEYS.split(", "), *FIELDS.split(", "))


@query("flt_ts_gate_off", f"SELECT {KEYS}, {FIELDS} FROM bars", "open high low close volume", O.bars(trades=_HOURLY, gate=False))
def _(s, d):
    hourly = trades(s, d).withColumn("ts_us", F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(3_600_000_000)))
    return B.range_bars(hourly, gate=False).select(*KEYS.split(", "), *FIELDS.split(", "))


#: Four hours, as the test tables' events know no weekend.
@query("rb_forex_weekend", f"SELECT {KEYS}, {FIELDS} FROM bars", "open high low close volume", O.bars(trades=O.TRADES + ", stepped AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY symbol ORDER BY ts_us, agg_trade_id) >= 14400000000 THEN 1 ELSE 0 END AS step FROM trades), gaps AS (SELECT agg_trade_id AS gid, sum(step) OVER (PARTITION BY symbol ORDER BY ts_us, agg_trade_id)::BIGINT AS gap_segment FROM stepped)", segment="(SELECT gap_segment FROM gaps WHERE gid = agg_trade_id)"))
def _(s, d):
    return B.range_bars(B.with_gap_segment(trades(s, d), 4.0), segment=F.col("gap_segment")).select(*KEYS.split(", "), *FIELDS.split(", "))


_PAUSED = "CASE WHEN ts_us - lag(ts_us) OVER w > 600000000 AND {week} <> lag({week}) OVER w THEN 1 ELSE 0 END".format(week=O.SEGMENTS["week"])


def populated(s: SparkSession, d: str, segment: str | None = None, most_gap_us: int | None = None):
    """A population by weeks of all trades in a tick store that was stopped after two weeks, with what goes on with it."""
    from ..operators.resume import Population
    from .catalog_queries import shared

    folder = shared(s, "population")
    store = T.TickStore(s, f"{folder}/ticks")
    store.append(trades(s, d))
    first, last = s.read.parquet(f"{folder}/ticks").agg(F.min("ts_us"), F.max("ts_us")).first()
    first, end = (0, 0) if first is None else (first, last + 1)
    read = lambda a, b: store.read(None, a, b)
    make = lambda: Population(s, f"{folder}/bars", segment=segment, most_gap_us=most_gap_us)
    make().run(read, first, end, "week", most=2)
    return make(), (read, first, end, "week")


@query("rb_gap_reset", "SELECT symbol, threshold, row_number() OVER (PARTITION BY symbol, threshold ORDER BY segment, bar_id) - 1 AS bar_id, open_time, close_time, open, close, volume FROM bars", "open close volume", O.bars(trades=f"{O.TRADES}, gaps AS (SELECT agg_trade_id AS gid, sum(step) OVER (PARTITION BY symbol ORDER BY ts_us, agg_trade_id)::BIGINT AS paused FROM (SELECT *, {_PAUSED} AS step FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, agg_trade_id)))", segment="(SELECT paused FROM gaps WHERE gid = agg_trade_id)"))
def _(s, d):
    population, rest = populated(s, d, most_gap_us=600_000_000)
    population.run(*rest)
    return population.bars().select("symbol", "threshold", "bar_id", "open_time", "close_time", "open", "close", "volume")


@query("rb_verify_pos", f"SELECT {KEYS}, missing::DOUBLE AS missing, CASE WHEN missing IS NULL THEN 'first' WHEN missing = 0 THEN 'exact' WHEN missing > 0 THEN 'gap' ELSE 'overlap' END AS position FROM (SELECT *, first_trade_id - lag(last_trade_id) OVER (PARTITION BY symbol, threshold, segment ORDER BY bar_id) - 1 AS missing FROM bars)", "", PLAIN)
def _(s, d):
    return B.positions(bars(s, d)).withColumn("missing", F.col("missing").cast("double"))


@query("rb_order_check", "SELECT symbol, agg_trade_id, ts_us, arrival FROM (SELECT *, agg_trade_id * 10 + CASE WHEN agg_trade_id % 7 = 0 THEN 25 ELSE 0 END AS arrival FROM trades) t QUALIFY ts_us < lag(ts_us) OVER (PARTITION BY symbol ORDER BY arrival) OR (ts_us = lag(ts_us) OVER (PARTITION BY symbol ORDER BY arrival) AND agg_trade_id <= lag(agg_trade_id) OVER (PARTITION BY symbol ORDER BY arrival))", "", TRADES)
def _(s, d):
    late = trades(s, d).withColumn("arrival", F.col("agg_trade_id") * 10 + F.when(F.col("agg_trade_id") % 7 == 0, 25).otherwise(0))
    return B.out_of_order(late).select("symbol", "agg_trade_id", "ts_us", "arrival")


@query("rb_count_bounded", f"SELECT {KEYS}, open_time, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, threshold ORDER BY close_time DESC, bar_id DESC) <= 25", "close", PLAIN)
def _(s, d):
    population, rest = populated(s, d)
    return population.last_bars(25, *rest).select(*KEYS.split(", "), "open_time", "close")


_QUOTES = """quotes AS (SELECT event_type AS symbol, event_id AS agg_trade_id, epoch_us(ts)::BIGINT AS ts_us, 1000000 + sum(round(value * 100)::BIGINT - 4963) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS mid, 50 + round(value * 100)::BIGINT % 97 AS half FROM events),
trades AS (SELECT symbol, agg_trade_id, round(((mid - half) / 1e4 + (mid + half) / 1e4) / 2 * 100000000)::BIGINT AS price_fp, 0::BIGINT AS volume_fp, agg_trade_id AS first_trade_id, agg_trade_id AS last_trade_id, ts_us, false AS is_buyer_maker,
  round(((mid + half) / 1e4 - (mid - half) / 1e4) * 100000000)::BIGINT AS spread_fp FROM quotes WHERE mid - half > 0 AND 2 * half <= 0.1 * mid)"""


@query("rb_spread", f"SELECT {KEYS}, arg_min(price_fp, rn) AS open_fp, max(price_fp) AS high_fp, min(price_fp) AS low_fp, arg_max(price_fp, rn) AS close_fp, min(ts_us) AS open_time, max(ts_us) AS close_time, min(spread_fp) AS spread_min_fp, max(spread_fp) AS spread_max_fp, (sum(spread_fp) // count(*))::BIGINT AS spread_avg_fp, count(*) AS tick_count FROM a WHERE is_complete GROUP BY ALL", "", O.walked(trades=_QUOTES))
def _(s, d):
    from ..operators.spread import quotes_from_events, spread_bars

    return spread_bars(quotes_from_events(s, d))


@query("rb_price_hash", "SELECT symbol, string_agg(price_fp, ',' ORDER BY k) FILTER (k <= 8) AS prices, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_us DESC, agg_trade_id DESC) AS k FROM trades) GROUP BY symbol HAVING count(*) >= 8", "", TRADES)
def _(s, d):
    from ..operators.spread import price_hash

    return price_hash(trades(s, d)).select("symbol", F.concat_ws(",", F.col("prices").cast("array<string>")).alias("prices"), "n")


@query("rb_api", f"SELECT {KEYS}, open, close FROM bars", "open close", PLAIN)
def _(s, d):
    from ..api import get_bars

    return get_bars(trades(s, d), None, threshold="standard").select(*KEYS.split(", "), "open", "close")


@query("rb_populate", f"SELECT {KEYS}, {FIELDS}, is_complete FROM allbars", "open high low close volume", PLAIN)
def _(s, d):
    population, rest = populated(s, d)
    population.run(*rest)
    return population.bars(include_incomplete=True).select(*KEYS.split(", "), *FIELDS.split(", "), "is_complete")


@query("rb_precompute", f"SELECT {KEYS}, {FIELDS}, is_complete FROM allbars", "open high low close volume", O.bars(segment="week"))
def _(s, d):
    population, rest = populated(s, d, segment="week")
    population.run(*rest)
    return population.bars(include_incomplete=True).select(*KEYS.split(", "), *FIELDS.split(", "), "is_complete")


# ---------------------------------------------------------------- fields of a bar

_GROUPS = {
    "agg_ohlc": ("open, high, low, close", "open high low close"),
    "agg_time_id": ("open_time, close_time, first_trade_id, last_trade_id, first_agg_trade_id, last_agg_trade_id", ""),
    "agg_volume": ("volume, buy_volume, sell_volume, turnover, buy_turnover, sell_turnover", "volume buy_volume sell_volume turnover buy_turnover sell_turnover"),
    "agg_counts": ("individual_trade_count, agg_record_count, buy_trade_count, sell_trade_count", ""),
    "agg_vwap": ("vwap", "vwap"),
    "agg_source": ("data_source", ""),
    "f_duration": ("duration_us", ""),
    "f_ofi": ("ofi", "ofi"),
    "f_vwap_dev": ("vwap_close_deviation", "vwap_close_deviation"),
    "f_price_impact": ("price_impact", "price_impact"),
    "f_kyle": ("kyle_lambda_proxy", "kyle_lambda_proxy"),
    "f_intensity": ("trade_intensity", "trade_intensity"),
    "f_vol_per_trade": ("volume_per_trade", "volume_per_trade"),
    "f_aggression": ("aggression_ratio", "aggression_ratio"),
    "f_agg_density": ("aggregation_density", "aggregation_density"),
    "f_turn_imb": ("turnover_imbalance", "turnover_imbalance"),
    "prj_output": ("open, high, low, close, volume", "open high low close volume"),
    "snk_backtest": ('close_time AS "Date", open AS "Open", high AS "High", low AS "Low", close AS "Close", volume AS "Volume"', "Open High Low Close Volume"),
}
for _name, (_cols, _doubles) in _GROUPS.items():

    @query(_name, f"SELECT {KEYS}, {_cols} FROM bars", _doubles, PLAIN)
    def _(s, d, cols=_cols):
        return bars(s, d).selectExpr(*KEYS.split(", "), *[c.replace('"', "`") for c in cols.split(", ")])


# ---------------------------------------------------------------- predicates


@query("flt_range", f"SELECT {KEYS}, close_time FROM bars WHERE symbol IN ('click', 'purchase', 'view') AND close_time // 1000 BETWEEN (SELECT min(ts_us) // 1000 + 3600000 FROM trades) AND (SELECT max(ts_us) // 1000 - 3600000 FROM trades)", "", PLAIN)
def _(s, d):
    edge = trades(s, d).agg((F.floor(F.min("ts_us") / 1000) + 3_600_000).alias("_a"), (F.floor(F.max("ts_us") / 1000) - 3_600_000).alias("_b"))
    rows = bars(s, d).filter(F.col("symbol").isin("click", "purchase", "view")).crossJoin(F.broadcast(edge))  # one row
    return rows.filter(F.floor(F.col("close_time") / 1000).between(F.col("_a"), F.col("_b"))).select(*KEYS.split(", "), "close_time")


@query("flt_breach", "SELECT symbol, agg_trade_id, bar_id FROM a WHERE closes", "", WALK)
def _(s, d):
    return ids(s, d).filter("closes").select("symbol", "agg_trade_id", "bar_id")


@query("flt_ts_norm", "SELECT event_id, CASE WHEN raw < 10000000000000 THEN raw * 1000 ELSE raw END AS ts_us FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000 ELSE epoch_us(ts) END::BIGINT AS raw FROM events)")
def _(s, d):
    raw = s.read.parquet(f"{d}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"))
    return raw.select("event_id", T.micros(F.when(F.col("event_id") % 2 == 0, F.floor(F.col("u") / 1000)).otherwise(F.col("u"))).alias("ts_us"))


@query("flt_ts_valid", "SELECT count(*) FILTER (ts_us >= 946684800000000 AND ts_us < 2082758400000000) AS valid, count(*) AS n FROM trades", "", TRADES)
def _(s, d):
    return trades(s, d).agg(F.count_if(T.valid_time(F.col("ts_us"))).alias("valid"), F.count(F.lit(1)).alias("n"))


@query("flt_cascade", f"SELECT {KEYS}, (high - low) / open >= threshold / 10000.0 AND duration_us > 0 AND duration_us <= 100000 AS is_cascade FROM bars", "", PLAIN)
def _(s, d):
    return bars(s, d).select(*KEYS.split(", "), Q.cascades().alias("is_cascade"))


@query("flt_oversized", f"SELECT {KEYS}, (high - low) / open AS spread FROM bars WHERE (high - low) / open > 1.5 * threshold / 100000.0", "spread", PLAIN)
def _(s, d):
    return bars(s, d).filter(Q.oversized(1.5)).select(*KEYS.split(", "), ((F.col("high") - F.col("low")) / F.col("open")).alias("spread"))


@query("flt_registry", "SELECT symbol, threshold, count(*) AS n FROM bars WHERE symbol <> 'search' AND threshold >= CASE WHEN symbol = 'click' THEN 1000 ELSE 250 END GROUP BY ALL", "", O.bars((250, 1000)))
def _(s, d):
    from ..api import Registry

    registry = Registry(s.createDataFrame([("click", 1000), ("view", 250), ("purchase", 250), ("cart", 250), ("signup", 250), ("login", 250), ("logout", 250), ("scroll", 250), ("error", 250), ("add_to_cart", 250)], "symbol string, min_threshold int"), default_threshold=250)
    return registry.allowed(bars(s, d, (250, 1000)), mode="warn").filter("symbol <> 'search'").groupBy("symbol", "threshold").agg(F.count(F.lit(1)).alias("n"))


@query("prj_trade_cols", "SELECT symbol, ts_us, price_fp FROM trades", "", TRADES)
def _(s, d):
    return trades(s, d).select("symbol", "ts_us", "price_fp")


# ---------------------------------------------------------------- before and within a bar

_WITHIN = f"""{WALK}, x AS (SELECT symbol, threshold, segment, bar_id, rn, ts_us, price_fp / 1e8 AS p, volume_fp / 1e8 AS v, is_buyer_maker AS m, last_trade_id - first_trade_id + 1 AS c FROM a),
y AS (SELECT *, p / first_value(p) OVER w AS q, lag(p) OVER w AS p1, lag(ts_us) OVER w AS t1, max(p) OVER (w ROWS UNBOUNDED PRECEDING) AS top, min(p) OVER (w ROWS UNBOUNDED PRECEDING) AS bottom, lag(p, 2) OVER w AS p2 FROM x WINDOW w AS (PARTITION BY symbol, threshold, segment, bar_id ORDER BY rn)),
z AS (SELECT symbol, threshold, segment, bar_id, count(*) AS n, sum(v) FILTER (NOT m) AS bv, sum(v) FILTER (m) AS sv, sum(v) AS tv, sum(c) FILTER (NOT m) AS bc, sum(c) FILTER (m) AS sc, max(ts_us) - min(ts_us) AS dur, max(p) AS hi, min(p) AS lo, arg_min(p, rn) AS op, arg_max(p, rn) AS cl,
  sum(p * v) AS pv, sum(abs(p - p1)) AS path, avg(ts_us - t1) AS gm, stddev_pop(ts_us - t1) AS gs, avg(v) AS vm, stddev_pop(v) AS vs, max(1 - p / top) AS dd, max(1 - bottom / p) AS ru, list(v ORDER BY rn) AS vl, list(CASE WHEN p2 IS NOT NULL THEN (CASE WHEN p1 < p2 THEN 4 ELSE 0 END) + (CASE WHEN p < p1 THEN 2 ELSE 0 END) + (CASE WHEN p < p2 THEN 1 ELSE 0 END) END) AS kinds FROM y GROUP BY ALL)"""
_XB = {
    "xb_count": ("n AS intra_trade_count, CASE WHEN n = 1 OR coalesce(tv, 0) <= 2.3e-16 THEN 0.0 ELSE (coalesce(bv, 0) - coalesce(sv, 0)) / tv END AS intra_ofi, dur::BIGINT AS intra_duration_us, CASE WHEN n = 1 THEN 0.0 WHEN dur > 0 THEN n / (dur / 1e6) ELSE n::DOUBLE END AS intra_intensity", "intra_ofi intra_intensity"),
    "xb_vwap_position": ("CASE WHEN n > 1 THEN CASE WHEN hi - lo > 2.3e-16 THEN least(greatest((pv / tv - lo) / (hi - lo), 0), 1) ELSE 0.5 END END AS intra_vwap_position", "intra_vwap_position"),
    "xb_count_imb": ("CASE WHEN n > 1 THEN (coalesce(bc, 0) - coalesce(sc, 0)) / (coalesce(bc, 0) + coalesce(sc, 0)) END AS intra_count_imbalance", "intra_count_imbalance"),
    "xb_kyle": ("CASE WHEN n > 1 AND abs((coalesce(bv, 0) - coalesce(sv, 0)) / tv) > 2.3e-16 THEN (cl - op) / op / ((coalesce(bv, 0) - coalesce(sv, 0)) / tv) END AS intra_kyle_lambda", "intra_kyle_lambda"),
    "xb_burst": ("CASE WHEN n >= 3 AND gs > 2.3e-16 THEN (gs - gm) / (gs + gm) END AS intra_burstiness", "intra_burstiness"),
    "xb_skew": ("CASE WHEN n >= 3 AND vs > 2.3e-16 THEN list_avg(list_transform(vl, lambda v: (v - vm) ** 3)) / vs ** 3 END AS intra_volume_skew", "intra_volume_skew"),
    "xb_kurt": ("CASE WHEN n >= 3 AND vs > 2.3e-16 THEN list_avg(list_transform(vl, lambda v: (v - vm) ** 4)) / vs ** 4 - 3 END AS intra_volume_kurt", "intra_volume_kurt"),
    "xb_kaufman": ("CASE WHEN n > 1 THEN CASE WHEN path <= 2.3e-16 THEN 1.0 ELSE least(abs(cl - op) / path, 1.0) END END AS intra_kaufman_er", "intra_kaufman_er"),
    "xb_gk": ("CASE WHEN n > 1 THEN sqrt(greatest(0, 0.5 * ln(hi / lo) ** 2 - 0.6137 * ln(cl / op) ** 2)) END AS intra_garman_klass_vol", "intra_garman_klass_vol"),
    "xb_drawdown": ("CASE WHEN n > 1 THEN dd END AS intra_max_drawdown", "intra_max_drawdown"),
    "xb_runup": ("CASE WHEN n > 1 THEN ru END AS intra_max_runup", "intra_max_runup"),
    "xb_pe": ("CASE WHEN n >= 60 THEN least(greatest(list_sum(list_transform(range(8), lambda k: CASE WHEN len(list_filter(kinds, lambda x: x = k)) > 0 THEN -(len(list_filter(kinds, lambda x: x = k)) / (n - 2)) * ln(len(list_filter(kinds, lambda x: x = k)) / (n - 2)) ELSE 0 END)) / ln(6), 0), 1) END AS intra_permutation_entropy", "intra_permutation_entropy"),
    "xb_edge": ("n AS intra_trade_count", ""),
    "xb_bull": (None, "intra_bull_epoch_density, intra_bull_excess_gain, intra_bull_cv"),
    "xb_bear": (None, "intra_bear_epoch_density, intra_bear_excess_gain, intra_bear_cv"),
    "xb_norm": (None, "intra_bull_epoch_density, intra_bear_epoch_density"),
    "xb_hurst": (None, "intra_hurst"),
}
for _name, (_cols, _doubles) in _XB.items():

    @query(_name, f"SELECT symbol, threshold, segment, bar_id, {_cols} FROM z" if _cols else None, _doubles if _cols else "", _WITHIN)
    def _(s, d, cols=_cols, names=_doubles):
        picked = [c.rsplit(" AS ", 1)[-1] for c in cols.split(", ") if " AS intra" in c] if cols else names.split(", ")
        return bar_windows(ids(s, d), lookback=None, hurst=cols is None, entropy=True).select(*KEYS.split(", "), *picked)


_BEFORE = f"""{WALK}, h AS (SELECT *, row_number() OVER (PARTITION BY symbol, threshold ORDER BY ts_us, agg_trade_id) AS seq FROM a),
o AS (SELECT symbol, threshold, segment, bar_id, min(ts_us) AS opened FROM h GROUP BY ALL),
e AS (SELECT o.*, coalesce(max(h.seq), 0) AS upto FROM o LEFT JOIN h ON h.symbol = o.symbol AND h.threshold = o.threshold AND h.ts_us < o.opened GROUP BY ALL),
x AS (SELECT e.symbol, e.threshold, e.segment, e.bar_id, h.seq, h.ts_us, h.price_fp / 1e8 AS p, h.volume_fp / 1e8 AS v, h.is_buyer_maker AS m FROM e LEFT JOIN h ON h.symbol = e.symbol AND h.threshold = e.threshold AND h.seq <= e.upto AND h.seq > e.upto - 50),
y AS (SELECT *, lag(p) OVER w AS p1, lag(ts_us) OVER w AS t1 FROM x WINDOW w AS (PARTITION BY symbol, threshold, segment, bar_id ORDER BY seq)),
z AS (SELECT symbol, threshold, segment, bar_id, count(seq) AS n, coalesce(sum(v) FILTER (NOT m), 0) AS bv, coalesce(sum(v) FILTER (m), 0) AS sv, count(*) FILTER (NOT m) AS bn, max(ts_us) - min(ts_us) AS dur, max(p) AS hi, min(p) AS lo, arg_min(p, seq) AS op, arg_max(p, seq) AS cl, sum(p * v) AS pv,
  sum(abs(p - p1)) AS path, avg(ts_us - t1) AS gm, stddev_pop(ts_us - t1) AS gs, avg(v) AS vm, stddev_pop(v) AS vs, list(v ORDER BY seq) AS vl FROM y GROUP BY ALL)"""
_IB = {
    "ib_window": ("CASE WHEN n > 0 THEN n::DOUBLE END AS lookback_trade_count", ""),
    "ib_count": ("CASE WHEN n > 0 THEN n::DOUBLE END AS lookback_trade_count", ""),
    "ib_ofi": ("CASE WHEN n > 0 THEN (bv - sv) / (bv + sv) END AS lookback_ofi", "lookback_ofi"),
    "ib_count_imb": ("CASE WHEN n > 0 THEN (2 * bn - n) / n END AS lookback_count_imbalance", "lookback_count_imbalance"),
    "ib_duration": ("CASE WHEN n > 0 THEN dur::DOUBLE END AS lookback_duration_us", ""),
    "ib_intensity": ("CASE WHEN n > 0 THEN CASE WHEN dur > 0 THEN n / (dur / 1e6) ELSE n::DOUBLE END END AS lookback_intensity", "lookback_intensity"),
    "ib_vwap_raw": ("CASE WHEN n > 0 THEN pv / (bv + sv) END AS lookback_vwap", "lookback_vwap"),
    "ib_vwap_pos": ("CASE WHEN n > 0 THEN CASE WHEN hi - lo > 2.3e-16 THEN (pv / (bv + sv) - lo) / (hi - lo) ELSE 0.5 END END AS lookback_vwap_position", "lookback_vwap_position"),
    "ib_kyle": ("CASE WHEN n > 0 THEN CASE WHEN n < 2 OR abs((bv - sv) / (bv + sv)) <= 2.3e-16 THEN 0.0 ELSE (cl - op) / op / ((bv - sv) / (bv + sv)) END END AS lookback_kyle_lambda", "lookback_kyle_lambda"),
    "ib_burst": ("CASE WHEN n > 0 THEN CASE WHEN n >= 2 THEN (gs - gm) / greatest(gs + gm, 2.220446049250313e-16) ELSE 0.0 END END AS lookback_burstiness", "lookback_burstiness"),
    "ib_skew": ("CASE WHEN n > 0 THEN CASE WHEN n >= 3 AND vs > 2.3e-16 THEN list_avg(list_transform(vl, lambda v: (v - vm) ** 3)) / vs ** 3 ELSE 0.0 END END AS lookback_volume_skew", "lookback_volume_skew"),
    "ib_kurt": ("CASE WHEN n > 0 THEN CASE WHEN n >= 4 AND vs > 2.3e-16 THEN list_avg(list_transform(vl, lambda v: (v - vm) ** 4)) / vs ** 4 - 3 ELSE 0.0 END END AS lookback_volume_kurt", "lookback_volume_kurt"),
    "ib_range": ("CASE WHEN n > 0 THEN (hi - lo) / op END AS lookback_price_range", "lookback_price_range"),
    "ib_kaufman": ("CASE WHEN n > 0 THEN CASE WHEN n >= 2 AND path > 2.3e-16 THEN abs(cl - op) / path ELSE 0.0 END END AS lookback_kaufman_er", "lookback_kaufman_er"),
    "ib_gk": ("CASE WHEN n > 0 THEN sqrt(greatest(0, 0.5 * ln(hi / lo) ** 2 - 0.3862943611198906 * ln(cl / op) ** 2)) END AS lookback_garman_klass_vol", "lookback_garman_klass_vol"),
}
for _name, (_cols, _doubles) in _IB.items():

    @query(_name, f"SELECT symbol, threshold, segment, bar_id, {_cols} FROM z", _doubles, _BEFORE)
    def _(s, d, name=_cols.rsplit(" AS ", 1)[-1]):
        return bar_windows(ids(s, d), Lookback(count=50), within=False).select(*KEYS.split(", "), F.col(name).cast("double").alias(name))


for _name, _look, _col in (("ib_hurst", Lookback(count=200), "lookback_hurst"), ("ib_entropy", Lookback(count=200), "lookback_permutation_entropy"), ("ib_apen", Lookback(count=600), "lookback_permutation_entropy"), ("ib_tiers", Lookback(bars=3, tier3=False), "lookback_trade_count"), ("ib_window_time", Lookback(count=None, micros=3_600_000_000), "lookback_trade_count")):

    @query(_name)
    def _(s, d, look=_look, col=_col):
        return bar_windows(ids(s, d), look, within=False).select(*KEYS.split(", "), col)


@query("ib_pe_m2")
def _(s, d):
    import numpy as np

    from ..functions.series import permutation_entropy

    entropy = F.udf(lambda x: 1.0 if len(x) < 10 else permutation_entropy(np.array(x), 2) if len(x) < 30 else None, "double")
    b = ids(s, d)
    B.ship(s)
    lists = b.groupBy(*B.BAR).agg(F.sort_array(F.collect_list(F.struct("ts_us", "agg_trade_id", "price_fp"))).alias("_l"))
    return lists.select(*B.BAR, entropy(F.col("_l.price_fp")).alias("entropy_m2"))


from . import catalog_queries  # noqa: E402, F401  the rest registers itself
