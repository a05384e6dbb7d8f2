"""SQL for DuckDB: the trades that are derived from `events`, bars found by joins and a recursive walk, and their features."""

from __future__ import annotations

TRADES = """trades AS (
  SELECT event_type AS symbol, event_id AS agg_trade_id,
         (1000000000000 + sum((round(value * 100)::BIGINT - 4963) * 250000) OVER (PARTITION BY event_type ORDER BY ts, event_id))::BIGINT AS price_fp,
         (round(value * 100)::BIGINT * 1000000)::BIGINT AS volume_fp, (event_id * 3)::BIGINT AS first_trade_id, (event_id * 3 + event_id % 3)::BIGINT AS last_trade_id,
         epoch_us(ts)::BIGINT AS ts_us, event_id % 2 = 0 AS is_buyer_maker FROM events)"""

SEGMENTS = {
    None: "0",
    "month": "epoch_us(date_trunc('month', make_timestamp(ts_us)))",
    "year": "epoch_us(date_trunc('year', make_timestamp(ts_us)))",
    "week": "(ts_us // 86400000000 - (ts_us // 86400000000 + 4) % 7) * 86400000000",
}


def walked(thresholds=(250,), segment: str | None = None, gate: bool = True, trades: str = TRADES) -> str:
    """Common table expressions up to `a`: trades with threshold, segment, bar_id, is_complete, closes."""
    keys = "symbol, threshold, segment"
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE {trades},
k AS (SELECT t.*, ({SEGMENTS.get(segment, segment)})::BIGINT AS segment, h.threshold FROM trades t, (SELECT unnest({list(thresholds)})::INTEGER AS threshold) h),
num AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts_us, agg_trade_id) AS rn, price_fp * threshold // 100000 AS away FROM k),
nb AS (SELECT o.symbol, o.threshold, o.segment, o.rn, min(t.rn) AS nxt FROM num o LEFT JOIN num t ON {same('o', 't')} AND t.rn > o.rn {'AND t.ts_us <> o.ts_us' if gate else ''}
       AND (t.price_fp >= o.price_fp + o.away OR t.price_fp <= o.price_fp - o.away) GROUP BY ALL),
walk AS (SELECT {keys}, 0::BIGINT AS bar_id, rn AS o, nxt AS c FROM nb WHERE rn = 1
         UNION ALL SELECT w.symbol, w.threshold, w.segment, w.bar_id + 1, n.rn, n.nxt FROM walk w JOIN nb n ON {same('w', 'n')} AND n.rn = w.c + 1 WHERE w.c IS NOT NULL),
a AS (SELECT n.*, w.bar_id, w.c IS NOT NULL AS is_complete, coalesce(n.rn = w.c, false) AS closes FROM num n JOIN walk w ON {same('n', 'w')} AND n.rn BETWEEN w.o AND coalesce(w.c, 9000000000))"""


def raw_bars(by_record: bool = False) -> str:
    n = "1" if by_record else "(last_trade_id - first_trade_id + 1)"
    return f"""raw AS (SELECT symbol, threshold, segment, bar_id, arg_min(price_fp, rn) AS open_fp, max(price_fp) AS high_fp, min(price_fp) AS low_fp, arg_max(price_fp, rn) AS close_fp,
  min(ts_us) AS open_time, max(ts_us) AS close_time, arg_min(first_trade_id, rn) AS first_trade_id, arg_max(last_trade_id, rn) AS last_trade_id, arg_min(agg_trade_id, rn) AS first_agg_trade_id, arg_max(agg_trade_id, rn) AS last_agg_trade_id,
  sum(volume_fp)::BIGINT AS volume_fp, coalesce(sum(volume_fp) FILTER (NOT is_buyer_maker), 0)::BIGINT AS buy_volume_fp, coalesce(sum(volume_fp) FILTER (is_buyer_maker), 0)::BIGINT AS sell_volume_fp,
  sum(price_fp::HUGEINT * volume_fp) AS turnover_fp, coalesce(sum(price_fp::HUGEINT * volume_fp) FILTER (NOT is_buyer_maker), 0) AS buy_turnover_fp, coalesce(sum(price_fp::HUGEINT * volume_fp) FILTER (is_buyer_maker), 0) AS sell_turnover_fp,
  sum({n})::BIGINT AS individual_trade_count, count(*) AS agg_record_count, coalesce(sum({n}) FILTER (NOT is_buyer_maker), 0)::BIGINT AS buy_trade_count, coalesce(sum({n}) FILTER (is_buyer_maker), 0)::BIGINT AS sell_trade_count,
  bool_or(closes) AS is_complete FROM a GROUP BY ALL)"""


PRICED = """money AS (SELECT symbol, threshold, segment, bar_id, open_time, close_time, first_trade_id, last_trade_id, first_agg_trade_id, last_agg_trade_id, individual_trade_count, agg_record_count, buy_trade_count, sell_trade_count, is_complete, 'derived' AS data_source,
  open_fp / 1e8 AS open, high_fp / 1e8 AS high, low_fp / 1e8 AS low, close_fp / 1e8 AS close, volume_fp / 1e8 AS volume, buy_volume_fp / 1e8 AS buy_volume, sell_volume_fp / 1e8 AS sell_volume,
  CASE WHEN volume_fp > 0 THEN (turnover_fp // volume_fp)::BIGINT ELSE open_fp END / 1e8 AS vwap, turnover_fp / 1e16 AS turnover, buy_turnover_fp / 1e16 AS buy_turnover, sell_turnover_fp / 1e16 AS sell_turnover FROM raw),
featured AS (SELECT *, close_time - open_time AS duration_us, CASE WHEN buy_volume + sell_volume > 2.220446049250313e-16 THEN (buy_volume - sell_volume) * (1.0::DOUBLE / (buy_volume + sell_volume)) ELSE 0.0 END AS ofi,
  CASE WHEN high - low > 2.220446049250313e-16 THEN (close - vwap) * (1.0::DOUBLE / (high - low)) ELSE 0.0 END AS vwap_close_deviation,
  CASE WHEN volume > 2.220446049250313e-16 THEN abs(close - open) * (1.0::DOUBLE / volume) ELSE 0.0 END AS price_impact,
  CASE WHEN close_time > open_time THEN individual_trade_count * (1.0::DOUBLE / ((close_time - open_time) / 1e6)) ELSE individual_trade_count::DOUBLE END AS trade_intensity,
  CASE WHEN individual_trade_count > 0 THEN volume * (1.0::DOUBLE / individual_trade_count) ELSE 0.0 END AS volume_per_trade,
  CASE WHEN sell_trade_count > 0 THEN least(buy_trade_count * (1.0::DOUBLE / sell_trade_count), 100.0) WHEN buy_trade_count > 0 THEN 100.0 ELSE 1.0 END AS aggression_ratio,
  CASE WHEN agg_record_count > 0 THEN individual_trade_count * (1.0::DOUBLE / agg_record_count) ELSE 1.0 END AS aggregation_density,
  CASE WHEN buy_turnover + sell_turnover > 2.220446049250313e-16 THEN (buy_turnover - sell_turnover) * (1.0::DOUBLE / (buy_turnover + sell_turnover)) ELSE 0.0 END AS turnover_imbalance FROM money),
allbars AS (SELECT *, CASE WHEN abs(ofi) > 2.220446049250313e-16 AND abs(open) > 2.220446049250313e-16 THEN (close - open) * (1.0::DOUBLE / abs(open)) * (1.0::DOUBLE / ofi) ELSE 0.0 END AS kyle_lambda_proxy FROM featured),
bars AS (SELECT * FROM allbars WHERE is_complete)"""


def bars(thresholds=(250,), segment: str | None = None, gate: bool = True, by_record: bool = False, trades: str = TRADES) -> str:
    return f"{walked(thresholds, segment, gate, trades)},\n{raw_bars(by_record)},\n{PRICED}"


def rounded(sql: str, doubles: str, places: int = 6) -> str:
    """The query with its columns of type double rounded; adding 0 makes one zero of two."""
    if not doubles:
        return sql
    parts = ", ".join(f"round({c}, {places}) + 0.0::DOUBLE AS {c}" for c in doubles.split())
    return f"SELECT * REPLACE ({parts}) FROM ({sql})"
