"""Checks of bars and trades: continuity, staleness, plausibility, gaps, duplicates, repair and recency."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import asset_class
from ..functions.tests import correlation
from .bars import BAR, KEYS


def order():
    return Window.partitionBy(*KEYS).orderBy("bar_id")


def gap_share() -> Column:
    """How far a bar's open is from the close before, as a share of it."""
    before = F.lag("close").over(order())
    return F.try_divide(F.abs(F.col("open") - before), before)


def discontinuities(bars: DataFrame, tolerance: float = 0.005) -> DataFrame:
    return bars.withColumn("gap", gap_share()).filter(F.col("gap") > F.col("threshold") / 100_000.0 + tolerance).select(*BAR, "gap")


def gap_tiers(bars: DataFrame, factor: float = 2.0) -> DataFrame:
    """Gaps by tier: under 1e-5, 1e-4 and 1e-3, under a session break, and beyond. A session break is `factor` times
    threshold / 10000, ten times what the bar's own unit would give."""
    gaps = bars.withColumn("gap", gap_share()).filter("gap is not null")
    return gaps.groupBy("symbol", "threshold", _tier(factor).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("max_gap"), F.avg("gap").alias("avg_gap"))


#: Greatest gap and what to do beyond it.
PRESETS = {
    "permissive": (0.05, "warn"), "research": (0.02, "warn"), "standard": (0.01, "warn"), "strict": (0.005, "error"), "paranoid": (0.001, "error"),
    "crypto": (0.02, "warn"), "forex": (0.01, "warn"), "equities": (0.03, "warn"), "skip": (0.0, "skip"), "audit": (0.002, "error"),
}
TIERS = ("precision", "noise", "market_move", "microstructure", "session_boundary")


class ContinuityError(ValueError):
    """Bars with gaps over what the preset allows."""


def continuity(bars: DataFrame, preset: str | tuple[float, str] = "standard", factor: float = 2.0) -> DataFrame:
    """Of each series: n_bars, the gaps of each tier, max_gap, n_over (gaps of 1e-5 and more over the tolerance), is_valid (no
    session boundary) and the verdict: ok, skipped, or warn or error where a gap of 1e-4 or more is over the tolerance. A preset
    by name, "auto" for that of the symbol's kind, or tolerance and mode."""
    if preset == "auto":
        kind = asset_class(F.col("symbol"))
        tolerance, mode = F.when(kind == "crypto", PRESETS["crypto"][0]).when(kind.isin("forex", "commodity"), PRESETS["forex"][0]).otherwise(PRESETS["standard"][0]), "warn"
    else:
        given, mode = PRESETS[preset] if isinstance(preset, str) else preset
        tolerance = F.lit(given)
    if mode not in ("error", "warn", "skip"):
        raise ValueError(f"mode {mode}")
    skip = mode == "skip"
    rows = bars.withColumn("gap", F.lit(None).cast("double") if skip else gap_share()).withColumn("_over", F.col("gap") > tolerance)
    tier = _tier(factor)
    out = rows.groupBy("symbol", "threshold").agg(
        F.count(F.lit(1)).alias("n_bars"), *[F.count_if(tier == t).alias(t) for t in TIERS], F.max("gap").alias("max_gap"),
        F.count_if(F.col("_over") & (F.col("gap") >= 1e-5)).alias("n_over"), F.count_if(F.col("_over") & (F.col("gap") >= 1e-4)).alias("_bad"),
    )
    verdict = F.lit("skipped") if skip else F.when(F.col("_bad") > 0, mode).otherwise("ok")
    return out.withColumn("is_valid", F.col("session_boundary") == 0).withColumn("verdict", verdict).drop("_bad")


def continuous(bars: DataFrame, preset: str | tuple[float, str] = "standard", factor: float = 2.0) -> DataFrame:
    """The bars, once their continuity is checked: an error or a warning names the series with the greatest gap."""
    verdicts = continuity(bars, preset, factor)
    worst = verdicts.filter("verdict in ('warn', 'error')").orderBy(F.desc("max_gap"), "symbol", "threshold").first()
    if worst is not None:
        told = f"{worst.symbol} at {worst.threshold}: {worst.n_over} gaps over the tolerance, the greatest of {worst.max_gap:.4%}"
        if worst.verdict == "error":
            raise ContinuityError(told)
        warnings.warn(told, stacklevel=2)
    return bars


def _tier(factor: float) -> Column:
    return F.when(F.col("gap") < 1e-5, "precision").when(F.col("gap") < 1e-4, "noise").when(F.col("gap") < 1e-3, "market_move").when(F.col("gap") < F.col("threshold") / 10_000.0 * factor, "microstructure").when(F.col("gap").isNotNull(), "session_boundary")


def junctions(bars: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Where one segment's last close meets the next one's first open."""
    edges = bars.groupBy(*KEYS).agg(F.min_by("open", "bar_id").alias("first_open"), F.max_by("close", "bar_id").alias("last_close"))
    w = Window.partitionBy("symbol", "threshold").orderBy("segment")
    before = F.lag("last_close").over(w)
    return edges.withColumn("gap", F.abs(F.col("first_open") - before) / before).filter("gap is not null").select(*KEYS, "gap", (F.col("gap") <= tolerance).alias("ok"))


def staleness(bars: DataFrame) -> DataFrame:
    """Which of the checks on stored features each series passes."""
    checks = {
        "vwap_ok": F.bool_and(F.col("vwap").between(F.col("low"), F.col("high"))), "ofi_ok": F.bool_and(F.col("ofi").between(-1, 1)), "turnover_ok": F.bool_and(F.col("turnover_imbalance").between(-1, 1)),
        "density_ok": F.bool_and(F.col("aggregation_density") >= 1), "counts_ok": F.bool_and(F.col("individual_trade_count") >= 1), "duration_ok": F.bool_and(F.col("duration_us") >= 0), "volume_ok": F.bool_and(F.col("volume") >= 0), "not_zero": F.bool_or(F.col("ofi") != 0),
    }
    out = bars.groupBy("symbol", "threshold").agg(*[c.alias(k) for k, c in checks.items()])
    good = None
    for k in checks:
        good = F.col(k) if good is None else good & F.col(k)
    return out.withColumn("is_stale", ~good)


def plausible(bars: DataFrame) -> DataFrame:
    """First-tier plausibility of the features of each series: no NaN or infinity, bounds, and, where a series has more than 50
    bars, a correlation of order flow and return that is neither absent nor too good."""
    w = order()
    rows = bars.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1)
    c = correlation("ofi", "_r")
    wild = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    out = rows.groupBy("symbol", "threshold").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(wild("ofi") | wild("kyle_lambda_proxy")).alias("has_nan"), F.bool_and(F.col("ofi").between(-1, 1)).alias("ofi_bounded"),
        F.avg("ofi").alias("mean_ofi"), F.median("aggression_ratio").alias("median_aggression"), F.min("volume").alias("min_volume"), c.alias("corr_ofi_return"),
    )
    out = out.withColumn("corr_sane", F.when((F.col("n") > 50) & ~F.isnan("corr_ofi_return"), F.abs("corr_ofi_return").between(0.05, 0.8) & ~F.abs("corr_ofi_return").isin(0.05, 0.8)))
    return out.withColumn("passed", F.coalesce("corr_sane", F.lit(True)) & ~F.col("has_nan") & F.col("ofi_bounded") & (F.abs("mean_ofi") < 0.3) & (F.col("median_aggression") < 10) & (F.col("min_volume") >= 0))


def bad_ohlc(bars: DataFrame) -> DataFrame:
    return bars.filter((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")))


def guarded(bars: DataFrame, times: float = 3.0) -> DataFrame:
    """What keeps each bar out of the store: time scale, volume, range over `times` thresholds; null: nothing."""
    spread = (F.col("high") - F.col("low")) / F.col("open")
    problem = F.when(~F.col("close_time").between(946_684_800_000_000, 2_082_758_399_999_999), "time").when(F.col("volume") < 0, "volume").when(spread > times * F.col("threshold") / 100_000.0, "range")
    return bars.select(*BAR, spread.alias("spread"), problem.alias("problem"))


def fingerprint(bars: DataFrame) -> DataFrame:
    """Row count, edge times and an order-free check sum of each series."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return bars.groupBy("symbol", "threshold").agg(F.count(F.lit(1)).alias("n"), F.min("open_time").alias("first"), F.max("close_time").alias("last"), F.sum(cents("open") + 3 * cents("high") + 5 * cents("low") + 7 * cents("close")).cast("long").alias("checksum"))


def time_gaps(bars: DataFrame, hours: float = 6.0, bps: float = 10.0) -> DataFrame:
    """Bars that follow the one before by `hours` or more, or `bps` or more away in price (basis points)."""
    before, at = F.lag("close").over(order()), F.lag("close_time").over(order())
    rows = bars.withColumn("gap_hours", (F.col("open_time") - at) / 3.6e9).withColumn("price_gap_bps", F.abs(F.col("open") - before) / before * 10_000)
    kind = F.when((F.col("gap_hours") >= hours) & (F.col("price_gap_bps") >= bps), "both").when(F.col("gap_hours") >= hours, "time").when(F.col("price_gap_bps") >= bps, "price")
    return rows.withColumn("kind", kind).filter("kind is not null").select(*BAR, "gap_hours", "price_gap_bps", "kind")


def id_gaps(bars: DataFrame) -> DataFrame:
    """Bars between which individual trades are missing or doubled."""
    return bars.withColumn("missing", F.col("first_trade_id") - F.lag("last_trade_id").over(order()) - 1).filter("missing <> 0").select(*BAR, "missing")


def duplicates(bars: DataFrame, by: list[str]) -> DataFrame:
    return bars.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("open")).alias("opens"), F.sort_array(F.collect_list("close")).alias("closes")).filter("n > 1")


def repair_priority(gaps: DataFrame, now_us: int) -> DataFrame:
    """P0: the series' end is stale (the gap is open); P1: of the last 48 hours; P2: older. Split at days."""
    age = (F.lit(now_us) - F.col("gap_end")) / 3.6e9
    day = F.explode(F.sequence(F.floor(F.col("gap_start") / 86_400_000_000), F.floor(F.col("gap_end") / 86_400_000_000)))
    return gaps.withColumn("priority", F.when(F.col("gap_end") >= now_us, "P0").when(age < 48, "P1").otherwise("P2")).withColumn("day", day)


def recency(bars: DataFrame, now_us: int) -> DataFrame:
    """Age of each series' last bar, and how long to wait before the next look: the older, the sooner."""
    age = (F.lit(now_us) - F.max("close_time")) / 6e7
    out = bars.groupBy("symbol", "threshold").agg(age.alias("age_minutes"))
    return out.withColumn("poll_seconds", F.when(F.col("age_minutes") < 30, 900).when(F.col("age_minutes") < 120, 300).when(F.col("age_minutes") < 1440, 120).otherwise(30))


def cascades() -> Column:
    """Ten thresholds or more in a tenth of a second or less."""
    return ((F.col("high") - F.col("low")) / F.col("open") >= F.col("threshold") / 10_000.0) & (F.col("duration_us") > 0) & (F.col("duration_us") <= 100_000)


def oversized(times: float = 3.0) -> Column:
    return (F.col("high") - F.col("low")) / F.col("open") > times * F.col("threshold") / 100_000.0


# ---------------------------------------------------------------- store semantics


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key: the greatest version."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_by_id(trades: DataFrame) -> DataFrame:
    """One row for each trade id, the earliest."""
    w = Window.partitionBy("symbol", "agg_trade_id").orderBy("ts_us")
    return trades.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def retained(rows: DataFrame, at: str, days: int, now_us: int) -> DataFrame:
    return rows.filter(F.col(at) >= now_us - days * 86_400_000_000)


def last_n(bars: DataFrame, n: int) -> DataFrame:
    """The newest n bars of each series."""
    w = Window.partitionBy("symbol", "threshold").orderBy(F.col("close_time").desc(), F.col("bar_id").desc())
    return bars.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
