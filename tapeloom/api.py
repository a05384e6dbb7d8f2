"""The entry point for bars of symbols, and the registry of symbols that guards it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import bars as B

#: Named thresholds in 1e-5.
PRESETS = {"micro": 10, "tight": 50, "standard": 250, "medium": 250, "wide": 500, "macro": 1000}


@dataclass
class Registry:
    """Symbols that are known, with the least threshold of each and, optionally, from when their data holds."""

    symbols: DataFrame
    default_threshold: int = 1

    def allowed(self, rows: DataFrame, mode: str = "strict") -> DataFrame:
        """Rows of known symbols (strict) or all (warn, off), of thresholds and times that the registry allows."""
        if mode not in ("strict", "warn", "off"):
            raise ValueError(f"mode {mode}")
        if mode == "off":
            return rows
        known = self.symbols.withColumnRenamed("symbol", "_symbol")
        joined = rows.join(known, rows["symbol"] == known["_symbol"], "inner" if mode == "strict" else "left")
        keep = F.col("threshold") >= F.coalesce("min_threshold", F.lit(self.default_threshold))
        if "effective_start_us" in self.symbols.columns:
            keep = keep & (F.col("open_time") >= F.coalesce("effective_start_us", F.lit(0)))
        return joined.filter(keep).select(*rows.columns)


def get_bars(trades: DataFrame, symbol: str | Sequence[str] | None, start_us: int | None = None, end_us: int | None = None, threshold: int | str = 250, segment: str | None = None, include_incomplete: bool = False, features: bool = True) -> DataFrame:
    """Bars of one symbol, of several, or of all (None) between two times, lazily."""
    limit = PRESETS[threshold] if isinstance(threshold, str) else threshold
    rows = trades if symbol is None else trades.filter(F.col("symbol").isin([symbol] if isinstance(symbol, str) else list(symbol)))
    if start_us is not None:
        rows = rows.filter(F.col("ts_us") >= start_us)
    if end_us is not None:
        rows = rows.filter(F.col("ts_us") <= end_us)
    out = B.range_bars(rows, (limit,), B.calendar_segment(F.col("ts_us"), segment) if segment else None, include_incomplete=include_incomplete)
    return out if features else out.select(*B.BAR, "open_time", "close_time", "open", "high", "low", "close", "volume")
