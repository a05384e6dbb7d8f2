"""Features of the trades within each bar and before it: one ordered pass over trades that know their bar.

Partitions sorted by key and time stream through; a bar's features come out when its last trade has passed. What is held is
the open bar and as much history as the window before a bar can need.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import BEFORE, WITHIN, before_bar, within_bar
from .bars import BAR, KEYS, _keys, runs, ship

TRADE = ["ts_us", "price_fp", "volume_fp", "is_buyer_maker", "_n"]


@dataclass(frozen=True)
class Lookback:
    """What the window before a bar holds: trades earlier than its opening time, namely the last `count`, those of the last
    `micros`, or those of the last `bars` bars. The first that is set, from bars to count, holds."""

    count: int | None = 200
    micros: int | None = None
    bars: int | None = None
    tier2: bool = True
    tier3: bool = True

    def start(self, ts: np.ndarray, end: int, opened: int, bar_starts: list[int]) -> int:
        if self.bars is not None:
            return min(bar_starts[-self.bars] if len(bar_starts) >= self.bars else (bar_starts[0] if bar_starts else 0), end)
        if self.micros is not None:
            return int(np.searchsorted(ts[:end], opened - self.micros, "left"))
        return max(0, end - (self.count or 0))


def bar_windows(rows: DataFrame, lookback: Lookback | None = Lookback(), within: bool = True, hurst: bool = True, entropy: bool = True) -> DataFrame:
    """Features of each bar of `rows` (trades with bar_id): lookback_* if `lookback` is set, intra_* if `within`.

    The window before a bar crosses segments, as history outlives a restart of bars; prices and volumes are in units.
    """
    ship(rows.sparkSession)
    schema = {**(BEFORE if lookback else {}), **(WITHIN if within else {})}
    narrow = rows.select(*BAR, "ts_us", "agg_trade_id", "price_fp", "volume_fp", "is_buyer_maker", (F.col("last_trade_id") - F.col("first_trade_id") + 1).alias("_n"))
    ordered = narrow.repartition("symbol", "threshold").sortWithinPartitions(*KEYS, "ts_us", "agg_trade_id")

    def run(batches):
        key, held, starts, begun = None, None, [], None
        out: list[tuple] = []

        def close() -> None:
            """Features of the bar that `begun` describes, whose trades end what is held."""
            if begun is None:
                return
            bar, at, before = begun
            ts, price, volume, maker, n = held
            values = dict(before)
            if within:
                values |= within_bar(ts[at:], price[at:] / 1e8, volume[at:] / 1e8, maker[at:], n[at:], hurst, entropy)
            out.append((bar, values))

        def flushed():
            bars, values = zip(*out)
            out.clear()
            names = [*BAR, *schema]
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64() if t == "double" else pa.int64() for t in schema.values()]]
            data = [[b[i] for b in bars] for i in range(len(BAR))] + [[v[c] for v in values] for c in schema]
            return pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(data, types)], names)

        for batch in batches:
            ids = _keys(batch, BAR)
            trade = _keys(batch, TRADE)
            bounds = runs(*ids)
            for a, b in zip(bounds[:-1], bounds[1:]):
                bar = tuple(x[a].item() if hasattr(x[a], "item") else x[a] for x in ids)
                if begun is None or bar != begun[0]:
                    close()
                    if bar[:2] != key:
                        key, held, starts = bar[:2], [x[:0] for x in trade], []
                    before: dict = {}
                    if lookback:
                        opened = int(trade[0][a])
                        end = int(np.searchsorted(held[0], opened, "left"))
                        first = lookback.start(held[0], end, opened, starts)
                        before = before_bar(*(x[first:end] if i in (0, 3) else x[first:end] / 1e8 for i, x in enumerate(held[:4])), lookback.tier2, lookback.tier3)
                        starts.append(len(held[0]))
                        if lookback.bars is not None:
                            starts = starts[-lookback.bars :]
                        keep = min(first if lookback.bars is None else starts[0], len(held[0]))
                        if keep > 4096 and keep > len(held[0]) // 2:  # earlier trades can't be asked for again
                            held, starts = [x[keep:] for x in held], [s - keep for s in starts]
                    else:
                        held = [x[:0] for x in trade]
                    begun = (bar, len(held[0]), before)
                held = [np.concatenate([h, x[a:b]]) for h, x in zip(held, trade)]
                if len(out) >= 2000:
                    yield flushed()
        close()
        if out:
            yield flushed()

    return ordered.mapInArrow(run, "symbol string, threshold int, segment long, bar_id long, " + ", ".join(f"{k} {t}" for k, t in schema.items()))
