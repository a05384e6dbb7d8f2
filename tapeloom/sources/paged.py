"""Trades from a service that hands out pages by trade id: a Python data source, for batch and for streams.

`fetch` names a function `module:name` of (symbol, from_id, limit) that returns trades as dicts, ascending by id; it is
called on executors, again after failures with growing waits. Batch reads split the id range into as many partitions as
asked; a stream's offset is the next id, so no trade of an edge is lost or doubled.

With the option by=time, `fetch` takes (symbol, from_us, limit) and its pages ascend by time: the next page begins with the time
that the last one ended with, and what came already is passed over, so that trades of one time may lie across an edge.
"""

from __future__ import annotations

import importlib
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "symbol string, agg_trade_id long, price double, volume double, first_trade_id long, last_trade_id long, timestamp long, is_buyer_maker boolean"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def retried(call: Callable, times: int = 5, first_wait: float = 1.0, most: float = 16.0, sleep: Callable[[float], None] = time.sleep):
    """The result of a call that may fail: `times` attempts, with waits that double up to `most` seconds."""
    wait = first_wait
    for attempt in range(times):
        try:
            return call()
        except Exception:
            if attempt == times - 1:
                raise
            sleep(wait)
            wait = min(wait * 2, most)


class Circuit:
    """Stops calls for `rest` seconds once half of the last ten and more have failed; then lets one through to try."""

    def __init__(self, share: float = 0.5, least: int = 10, rest: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.share, self.least, self.rest, self.clock = share, least, rest, clock
        self.calls = self.failed = 0
        self.opened: float | None = None

    @property
    def state(self) -> str:
        return "closed" if self.opened is None else "half-open" if self.clock() - self.opened >= self.rest else "open"

    def __call__(self, call: Callable):
        if self.state == "open":
            raise RuntimeError("the circuit is open")
        trial = self.state == "half-open"
        try:
            out = call()
        except Exception:
            self.calls, self.failed = self.calls + 1, self.failed + 1
            if trial or self.calls >= self.least and self.failed >= self.share * self.calls:
                self.opened = self.clock()
            raise
        if trial:
            self.opened, self.calls, self.failed = None, 0, 0
        else:
            self.calls += 1
        return out


def generated(symbol: str, from_id: int, limit: int) -> list[dict]:
    """A service without network: a deterministic walk, for tests and examples."""
    out = []
    for i in range(from_id, from_id + limit):
        r = random.Random(f"{symbol}:{i}")
        out.append({"symbol": symbol, "agg_trade_id": i, "price": round(100 + 5 * r.random(), 4), "volume": round(r.random(), 4), "first_trade_id": i, "last_trade_id": i, "timestamp": 1_704_067_200_000_000 + i * 1_000_000, "is_buyer_maker": r.random() < 0.5})
    return out


def generated_by_time(symbol: str, from_us: int, limit: int) -> list[dict]:
    """The same service asked by time: four trades a second."""
    first = 1_704_067_200_000_000
    begin = 4 * max(0, -(-(from_us - first) // 1_000_000))
    return [{**t, "timestamp": first + t["agg_trade_id"] // 4 * 1_000_000} for t in generated(symbol, begin, limit)]


@dataclass
class Ids(InputPartition):
    first: int
    end: int


def _pages(options: dict, first: int, end: int) -> Iterator[tuple]:
    module, name = options.get("fetch", "tapeloom.sources.paged:generated").split(":")
    fetch, size = getattr(importlib.import_module(module), name), int(options.get("pageSize", 1000))
    while first < end:
        page = retried(lambda: fetch(options["symbol"], first, min(size, end - first)))
        page = [t for t in page if first <= t["agg_trade_id"] < end]
        if not page:
            return
        for t in page:
            yield tuple(t.get(f) for f in FIELDS)
        first = page[-1]["agg_trade_id"] + 1


def _pages_by_time(options: dict, first: int, end: int) -> Iterator[tuple]:
    module, name = options.get("fetch", "tapeloom.sources.paged:generated_by_time").split(":")
    fetch, size = getattr(importlib.import_module(module), name), int(options.get("pageSize", 1000))
    asked, seen = size, set()
    while first < end:
        page = retried(lambda: fetch(options["symbol"], first, asked))
        for t in page:
            if t["timestamp"] < end and t["agg_trade_id"] not in seen:
                yield tuple(t.get(f) for f in FIELDS)
        if len(page) < asked:
            return
        last = page[-1]["timestamp"]
        seen = {t["agg_trade_id"] for t in page if t["timestamp"] == last} | (seen if last == first else set())
        asked = asked * 2 if last == first else size  # a page of one time only: more of it may follow
        first = last


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        unit = "Time" if self.options.get("by") == "time" else "Id"
        first, end, n = int(self.options.get(f"from{unit}", 0)), int(self.options[f"to{unit}"]), int(self.options.get("partitions", 4))
        step = max(1, -(-(end - first) // n))
        return [Ids(a, min(a + step, end)) for a in range(first, end, step)]

    def read(self, partition: Ids):
        return (_pages_by_time if self.options.get("by") == "time" else _pages)(self.options, partition.first, partition.end)


class PagedStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"id": int(self.options.get("fromId", 0))}

    def read(self, start: dict):
        end = min(start["id"] + int(self.options.get("maxTradesPerTrigger", 10_000)), int(self.options.get("toId", 1 << 62)))
        rows = list(_pages(self.options, start["id"], end))
        return iter(rows), {"id": rows[-1][1] + 1 if rows else start["id"]}

    def readBetweenOffsets(self, start: dict, end: dict):
        return _pages(self.options, start["id"], end["id"])


class PagedTrades(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trade_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return PagedReader(self.options)

    def simpleStreamReader(self, schema):
        return PagedStream(self.options)
