"""Feature providers, added columns, hooks and the manifest of features."""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.series import BEFORE, WITHIN
from .operators.bars import features

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Provider:
    """Columns that a function adds to bars; they are null in series of fewer than min_bars."""

    name: str
    version: str
    columns: list[str]
    enrich: Callable[[DataFrame], DataFrame]
    min_bars: int = 1


def enriched(bars: DataFrame, providers: list[Provider]) -> DataFrame:
    """Bars with the columns of all providers; one that fails or misses its columns is passed over and told."""
    for p in providers:
        try:
            out = p.enrich(bars)
            missing = [c for c in p.columns if c not in out.columns]
            if missing:
                raise ValueError(f"no column {', '.join(missing)}")
            if p.min_bars > 1:
                n = F.count(F.lit(1)).over(Window.partitionBy("symbol", "threshold"))
                out = out.withColumn("_bars", n).withColumns({c: F.when(F.col("_bars") >= p.min_bars, F.col(c)) for c in p.columns}).drop("_bars")
            bars = out
        except Exception:
            log.exception("provider %s", p.name)
            emit("provider_failed", name=p.name)
    return bars


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null there."""
    return old.unionByName(new, allowMissingColumns=True)


_hooks: dict[str, list[Callable]] = defaultdict(list)


def on(event: str, call: Callable) -> None:
    """Calls back at provider_failed (name), bars_stored (path, version), bars_deleted (path, symbol) and chunk_built (path,
    chunk, until). A callback that fails is told and changes nothing."""
    _hooks[event].append(call)


def emit(event: str, **what) -> None:
    for call in _hooks[event]:
        try:
            call(**what)
        except Exception:
            log.exception("hook %s", event)


def manifest(spark: SparkSession) -> DataFrame:
    """name, family and type of every feature."""
    rows = [(k, "bar", "long" if k == "duration_us" else "double") for k in features()] + [(k, "before", t) for k, t in BEFORE.items()] + [(k, "within", t) for k, t in WITHIN.items()]
    return spark.createDataFrame(rows, "name string, family string, type string")
