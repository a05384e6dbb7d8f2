"""Significance and sizing of pattern returns, as aggregate expressions and grouped functions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tstat(col: str = "ret") -> Column:
    """mean / (s / sqrt(n)); null under two values or without spread."""
    n, s = F.count(col), F.stddev_samp(col)
    return F.when((n >= 2) & (s > 0), F.avg(col) / (s / F.sqrt(n)))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's, of the rows in which both are known; null without spread in one of them."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17; the error is under 7.5e-8."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(z))
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    upper = F.exp(-z * z / F.lit(2.0)) * F.lit(0.3989422804014327) * poly
    return F.when(z >= 0, F.lit(1.0) - upper).otherwise(upper)


def robust(rows: DataFrame, by: list[str], period: str, ret: str = "ret", least: int = 100, t: float = 5.0, periods: int = 2) -> DataFrame:
    """Of each group: in how many periods it has `least` returns, and whether all of those are significant with one sign."""
    each = rows.groupBy(*by, period).agg(F.count(ret).alias("n"), tstat(ret).alias("t")).filter((F.col("n") >= least) & F.col("t").isNotNull())
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("periods"), ((F.count(F.lit(1)) >= periods) & F.bool_and(F.abs("t") >= t) & (F.bool_and(F.col("t") > 0) | F.bool_and(F.col("t") < 0))).alias("is_robust"))


def bh_fdr(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg: tests up to the largest rank whose p is at most rank / n * alpha. Tests are few (one row for each
    pattern), so one ordered window is right."""
    n, k = F.count(F.lit(1)).over(Window.partitionBy()), F.row_number().over(Window.orderBy(p))
    ranked = tests.withColumn("_k", k).withColumn("_n", n)
    last = F.max(F.when(F.col(p) <= F.col("_k") / F.col("_n") * alpha, F.col("_k"))).over(Window.partitionBy())
    return ranked.withColumn("significant", F.coalesce(F.col("_k") <= last, F.lit(False))).drop("_k", "_n")


def bonferroni(tests: int, alpha: float = 0.05) -> float:
    return NormalDist().inv_cdf(1 - alpha / (2 * tests))


def sharpe(rows: DataFrame, by: list[str], ret: str = "ret", benchmark: float = 0.0, trials: int = 10, confidence: float = 0.95) -> DataFrame:
    """Sharpe ratio, probabilistic and deflated, and the least track record. Kurtosis isn't excess (normal: 3)."""
    out = rows.groupBy(*by).agg(F.count(ret).alias("n"), (F.avg(ret) / F.stddev_samp(ret)).alias("sr"), F.skewness(ret).alias("skew"), (F.kurtosis(ret) + 3).alias("kurt"))
    penalty = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")
    out = out.filter("n >= 2 and sr is not null").withColumn("_s", F.sqrt(penalty / (F.col("n") - 1)))
    z = NormalDist().inv_cdf(confidence)
    return out.select(
        *by, "n", "sr", normal_cdf((F.col("sr") - benchmark) / F.col("_s")).alias("psr"),
        F.when(F.col("sr") > benchmark, 1 + penalty * F.pow(F.lit(z) / (F.col("sr") - benchmark), F.lit(2))).alias("min_trl"),
        normal_cdf((F.col("sr") - F.lit(math.sqrt(2 * math.log(trials))) * F.col("_s")) / F.col("_s")).alias("dsr"),
    )


def kelly(rows: DataFrame, by: list[str], ret: str = "ret", hurst: float | None = None) -> DataFrame:
    """Kelly fraction mu / s**2, and the effective count n**(2 (1 - H)) under persistence H."""
    n = F.count(ret)
    effective = n.cast("double") if hurst is None else F.pow(n.cast("double"), F.lit(2 * (1 - hurst)))
    return rows.groupBy(*by).agg(n.alias("n"), F.when(F.stddev_samp(ret) > 0, F.avg(ret) / (F.stddev_samp(ret) * F.stddev_samp(ret))).alias("kelly"), effective.alias("n_effective"))


def resampled(rows: DataFrame, by: list[str], ret: str = "ret", times: int = 1000, seed: int = 42) -> DataFrame:
    """Bootstrap interval (95 %) of the mean and sign-flip permutation p-value of each group.

    Resampling needs a group's returns together; the sums of resamples are built from at most `block` returns at a time.
    """
    block = 1 << 14

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[ret].to_numpy())
        rng = np.random.default_rng(seed)
        boot, flip = np.zeros(times), np.zeros(times)
        for at in range(0, len(x), block):
            part = x[at : at + block]
            for k in range(times):
                boot[k] += x[rng.integers(0, len(x), len(part))].sum()
                flip[k] += part @ (rng.integers(0, 2, len(part)) * 2 - 1)
        low, high = np.quantile(boot / len(x), [0.025, 0.975])
        return pd.DataFrame([[*key, len(x), float(low), float(high), float((np.abs(flip) >= abs(x.sum())).mean())]])

    fields = rows.select(*by).schema
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in fields], "n long", "ci_low double", "ci_high double", "p_perm double"])
    return rows.select(*by, ret).filter(F.col(ret).isNotNull()).groupBy(*by).applyInPandas(run, schema)
