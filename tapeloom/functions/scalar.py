"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exchange sessions: zone, first hour, hour of the end.
SESSIONS = {"sydney": ("Australia/Sydney", 10, 16), "tokyo": ("Asia/Tokyo", 9, 15), "london": ("Europe/London", 8, 17), "new_york": ("America/New_York", 10, 16)}


def formatted(fp: Column) -> Column:
    """Whole 1e-8 units as a decimal string."""
    return (fp.cast("decimal(28,8)") / F.lit(100_000_000).cast("decimal(9,0)")).cast("decimal(28,8)").cast("string")


def calendar(ts: Column) -> list[Column]:
    t = F.timestamp_micros(ts)
    return [F.floor(ts / 1000).alias("ms"), F.date_format(t, "yyyy-MM").alias("year_month"), F.concat(F.year(t), F.lit("-Q"), F.quarter(t)).alias("quarter"), F.unix_micros(F.date_trunc("hour", t)).alias("hour_us")]


def sessions(ts: Column) -> dict[str, Column]:
    """Whether each exchange is open: a weekday of its own zone, within its hours there."""
    out = {}
    for name, (zone, first, end) in SESSIONS.items():
        local = F.from_utc_timestamp(F.timestamp_micros(ts), zone)
        out[name] = (F.weekday(local) < 5) & (F.hour(local) >= first) & (F.hour(local) < end)
    return out


def asset_class(symbol: Column) -> Column:
    s = F.upper(symbol)
    return F.when(s.rlike("(USDT|USDC|BUSD|BTC)$"), "crypto").when(s.rlike("^X(AU|AG|PT|PD)"), "commodity").when(s.rlike("^(EUR|GBP|USD|JPY|AUD|NZD|CAD|CHF){2}"), "forex").otherwise("unknown")


def logistic(x: Column, center: float, scale: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(x - center) * scale))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def major(version: Column) -> Column:
    return F.split(version, "\\.")[0]
