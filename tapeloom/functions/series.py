"""Statistics of one stretch of trades, in numpy: price path, order flow, arrival, entropy and persistence."""

from __future__ import annotations

import math

import numpy as np

EPS = 2.220446049250313e-16
#: The Garman-Klass coefficient: 2 ln 2 - 1 before a bar, and 2 - 2 ln 2 as rounded within one.
GK_BEFORE, GK_WITHIN = 0.3862943611198906, 0.6137
LN_6 = math.log(6)

# The tables that results must agree with. Inputs are rounded to the nearest place.
#: Density 0.00 .. 1.00 by 0.01.
DENSITY = np.array([
    0.00669285, 0.00726909, 0.00787748, 0.00852097, 0.00920163,
    0.00992070, 0.01068062, 0.01148386, 0.01233315, 0.01323157,
    0.01418152, 0.01518559, 0.01624660, 0.01736751, 0.01855145,
    0.01980068, 0.02111768, 0.02250503, 0.02396549, 0.02550206,
    0.02711793, 0.02881645, 0.03060120, 0.03247589, 0.03444445,
    0.03651086, 0.03867829, 0.04095020, 0.04333015, 0.04582189,
    0.04842939, 0.05115589, 0.05400481, 0.05697966, 0.06008420,
    0.06332142, 0.06669455, 0.07020703, 0.07386263, 0.07766543,
    0.08161889, 0.08572681, 0.08999323, 0.09442140, 0.09901573,
    0.10378017, 0.10871902, 0.11383679, 0.11913730, 0.12462478,
    0.13030270,
    0.13616428, 0.14221304, 0.14845280, 0.15488763, 0.16152085,
    0.16835600, 0.17539580, 0.18264328, 0.19010081, 0.19777098,
    0.20565666, 0.21376008, 0.22208360, 0.23062885, 0.23939769,
    0.24839228, 0.25760407, 0.26703461, 0.27668572, 0.28655950,
    0.29665838, 0.30698413, 0.31753900, 0.32832457, 0.33934256,
    0.35059484, 0.36208355, 0.37381088, 0.38577921, 0.39799109,
    0.41044938, 0.42315722, 0.43611799, 0.44933528, 0.46281192,
    0.47655109, 0.49055630, 0.50483125, 0.51937889, 0.53420245,
    0.54930542, 0.56469158, 0.58036497, 0.59633001, 0.61259045,
    0.62915049, 0.64601464, 0.66318783, 0.68067547, 0.69848350,
])
#: Hyperbolic tangent of 0.0 .. 5.0 by 0.1.
TANH = np.array([
    0.00000000, 0.09966799, 0.19737532, 0.29131261, 0.38065307,
    0.46211716, 0.53704957, 0.60436778, 0.66403677, 0.71629787,
    0.76159416, 0.80044840, 0.83365461, 0.86177165, 0.88535409,
    0.90514825, 0.92167862, 0.93541078, 0.94681036, 0.95623320,
    0.96402758, 0.97045193, 0.97574126, 0.98010054, 0.98367261,
    0.98661429, 0.98903447, 0.99101876, 0.99265030, 0.99398896,
    0.99509049, 0.99599599, 0.99674205, 0.99736022, 0.99787805,
    0.99831888, 0.99870204, 0.99903370, 0.99932613, 0.99958944,
    0.99982196, 1.00000000, 1.00000000, 1.00000000, 1.00000000,
    1.00000000, 1.00000000, 1.00000000, 1.00000000, 1.00000000, 1.00000000,
])


def _nearest(x: float) -> int:
    return math.floor(x + 0.5)


def density_score(density: float, exact: bool = False) -> float:
    """Score of an epoch density in [0, 1]; `exact` for the logistic curve that the table is named for."""
    d = min(max(density, 0.0), 1.0)
    return 1 / (1 + math.exp(-10 * (d - 0.5))) if exact else float(DENSITY[_nearest(d * 100)])


def tanh_score(x: float, exact: bool = False) -> float:
    return math.tanh(x) if exact else math.copysign(float(TANH[_nearest(min(abs(x), 5.0) * 10)]), x)


def variation_score(cv: float) -> float:
    """Logistic score of a coefficient of variation, about 0.5, to 8 places at steps of 0.1."""
    x = 0.0 if math.isnan(cv) else min(max(cv, 0.0), 5.0)
    return round(1 / (1 + math.exp(-4 * (_nearest(x * 10) / 10 - 0.5))), 8)


def soft_clamp(h: float) -> float:
    return 0.5 + 0.5 * tanh_score((h - 0.5) * 4)


def drawdown(path: np.ndarray) -> float:
    """The largest fall from a peak, as a share of it."""
    return float(np.max(1 - path / np.maximum.accumulate(path), initial=0.0))


def runup(path: np.ndarray) -> float:
    return drawdown(1 / path)


def epochs(path: np.ndarray, hurdle: float) -> tuple[int, float, float]:
    """Of an investor who is long the path: how many epochs, the sum of excess gains, the variation of epoch intervals.

    From the last endorsed crest, a gain is a new high against it and a loss a new low since; an epoch ends when the gain is
    over both the loss and the hurdle, and its high becomes the crest. Gains and losses stand until they change or an epoch
    ends. Intervals count from the start, by population deviation; without epochs the variation is NaN. For a short investor
    take the reciprocal path.
    """
    crest = high = low = path[0]
    gain = loss = total = 0.0
    last, gaps = 0, []
    before = path[0]
    for i, now in enumerate(path[1:].tolist(), 1):
        if now > high:
            gain, high = now / crest - 1, now
        if now < low:
            loss, low = 1 - now / crest, now
        total += gain
        if gain > abs(loss) and gain > hurdle:
            crest, low, gain, loss = high, before, 0.0, 0.0
            gaps.append(i - last)
            last = i
        before = now
    if not gaps:
        return 0, total, math.nan
    g = np.array(gaps, float)
    return len(gaps), total, float(math.sqrt(max((g * g).mean() - g.mean() ** 2, 0.0)) / g.mean())


def burstiness(ts: np.ndarray) -> float | None:
    """(s - m) / (s + m) of the times between trades; None if they are all one."""
    gaps = np.diff(ts).astype(float)
    s, m = float(gaps.std()), float(gaps.mean())
    return None if s <= EPS else (s - m) / (s + m)


def moments(x: np.ndarray) -> tuple[float, float] | None:
    """Population skewness and excess kurtosis; None if constant."""
    d = x - x.mean()
    v = float((d * d).mean())
    if math.sqrt(v) <= EPS:
        return None
    return float((d**3).mean()) / v**1.5, float((d**4).mean()) / v**2 - 3


def efficiency(price: np.ndarray) -> float | None:
    """Kaufman's ratio: net move over the length of the path; None if nothing moved."""
    length = float(np.abs(np.diff(price)).sum())
    return None if length <= EPS else abs(float(price[-1] - price[0])) / length


def garman_klass(price: np.ndarray, coefficient: float) -> float:
    high, low = float(price.max()), float(price.min())
    if low <= 0 or price[0] <= 0 or price[-1] <= 0:
        return 0.0
    return math.sqrt(max(0.0, 0.5 * math.log(high / low) ** 2 - coefficient * math.log(float(price[-1]) / float(price[0])) ** 2))


def permutation_entropy(price: np.ndarray, order: int = 3) -> float:
    """Shannon entropy of the ordinal patterns of `order` (2 or 3) neighbours, as a share of the most it can be; equal
    neighbours count as rising."""
    if order == 2:
        kinds, most = (price[1:] < price[:-1]).astype(int), math.log(2)
    else:
        a, b, c = price[:-2], price[1:-1], price[2:]
        kinds, most = (b < a) * 4 + (c < b) * 2 + (c < a) * 1, LN_6
    share = np.bincount(kinds, minlength=8) / len(kinds)
    share = share[share > 0]
    return min(max(float(-(share * np.log(share)).sum()) / most, 0.0), 1.0)


def _phi(price: np.ndarray, m: int, r: float) -> float:
    n = len(price) - m + 1
    step = 1 if n <= 300 else 2 if n < 500 else 3 if n < 1000 else 4
    windows = np.lib.stride_tricks.sliding_window_view(price, m)[::step]
    near = sum(int((np.abs(windows[i + 1 :] - windows[i]).max(axis=1) <= r).sum()) for i in range(len(windows) - 1))
    count = _nearest(near * step * step)
    if not count:
        return 0.0
    share = count * 2 / (n * (n - 1))
    return -share * math.log(share)


def approximate_entropy(price: np.ndarray, m: int = 2) -> float:
    """Of pattern matches within a fifth of the deviation; long stretches compare every 2nd, 3rd or 4th pattern."""
    r = 0.2 * float(price.std())
    return min(max((_phi(price, m, r) - _phi(price, m + 1, r)) / math.log(len(price)), 0.0), 1.0)


def adaptive_entropy(price: np.ndarray) -> float:
    """Permutation entropy under 500 trades, approximate entropy from there."""
    return permutation_entropy(price) if len(price) < 500 else approximate_entropy(price)


def hurst_rs(price: np.ndarray) -> float:
    """Rescaled range of the whole stretch, on the logarithm of its length."""
    d = price - price.mean()
    s = float(np.sqrt((d * d).mean()))
    c = np.concatenate([[0.0], np.cumsum(d)])
    rs = (float(c.max()) - float(c.min())) / s if s >= EPS else 0.0
    return 0.5 if rs < EPS else math.log2(rs) / math.log2(len(price))


def hurst_dfa(path: np.ndarray) -> float:
    """Detrended fluctuation analysis over scales from a quarter to half of the length, softly clamped; 0.5 with under 2 scales."""
    n = len(path)
    profile = np.cumsum(path - path.mean())
    xs, ys, scale = [], [], max(n // 4, 8)
    while scale <= n // 2:
        pieces = profile[: n // scale * scale].reshape(-1, scale)
        x = np.arange(scale) - (scale - 1) / 2
        y = pieces - pieces.mean(axis=1, keepdims=True)
        rest = (y * y).sum(axis=1) - (y @ x) ** 2 / (x @ x)
        level = float(np.sqrt(np.maximum(rest, 0) / scale).mean())
        if level > EPS:
            xs.append(math.log(scale))
            ys.append(math.log(level))
        scale = math.ceil(scale * 1.5)
    if len(xs) < 2:
        return 0.5
    x, y = np.array(xs) - np.mean(xs), np.array(ys) - np.mean(ys)
    return soft_clamp(float(x @ y) / float(x @ x) if float(x @ x) > EPS else 0.5)


def within_bar(ts: np.ndarray, price: np.ndarray, volume: np.ndarray, maker: np.ndarray, count: np.ndarray, hurst: bool = True, entropy: bool = True) -> dict:
    """The 22 features of a bar's own trades, from the opening to the closing one. One trade has count, flow, duration and
    intensity only."""
    n = len(price)
    out: dict = dict.fromkeys(WITHIN)
    out["intra_trade_count"] = n
    if n == 1:
        return out | {"intra_ofi": 0.0, "intra_duration_us": 0, "intra_intensity": 0.0}
    if price[0] <= 0:
        return out
    path = price / price[0]
    down, up = drawdown(path), runup(path)
    bull, bull_gain, bull_cv = epochs(path, max(down, EPS))
    bear, bear_gain, bear_cv = epochs(1 / path, max(up, EPS))
    buy, sell = float(volume[~maker].sum()), float(volume[maker].sum())
    buys, sells = float(count[~maker].sum()), float(count[maker].sum())
    total, high, low = buy + sell, float(price.max()), float(price.min())
    duration = int(ts[-1] - ts[0])
    imbalance = (buy - sell) / total if total > EPS else 0.0
    vwap = float((price * volume).sum()) / total if total > EPS else float(price[0])
    shape = moments(volume) if n >= 3 else None
    straight = efficiency(price)
    return out | {
        "intra_bull_epoch_density": density_score(bull / n), "intra_bear_epoch_density": density_score(bear / n), "intra_bull_excess_gain": tanh_score(abs(bull_gain) * 5), "intra_bear_excess_gain": tanh_score(abs(bear_gain) * 5),
        "intra_bull_cv": variation_score(bull_cv), "intra_bear_cv": variation_score(bear_cv), "intra_max_drawdown": min(max(down, 0.0), 1.0), "intra_max_runup": min(max(up, 0.0), 1.0),
        "intra_ofi": imbalance, "intra_duration_us": duration, "intra_intensity": n / (duration / 1e6) if duration > 0 else float(n),
        "intra_vwap_position": min(max((vwap - low) / (high - low), 0.0), 1.0) if high - low > EPS else 0.5, "intra_count_imbalance": (buys - sells) / (buys + sells) if buys + sells else 0.0,
        "intra_kyle_lambda": (float(price[-1] - price[0]) / float(price[0])) / imbalance if abs(imbalance) > EPS else None,
        "intra_burstiness": burstiness(ts) if n >= 3 else None, "intra_volume_skew": shape[0] if shape else None, "intra_volume_kurt": shape[1] if shape else None,
        "intra_kaufman_er": 1.0 if straight is None else min(straight, 1.0), "intra_garman_klass_vol": garman_klass(price, GK_WITHIN),
        "intra_hurst": hurst_dfa(path) if hurst and n >= 64 else None, "intra_permutation_entropy": permutation_entropy(price) if entropy and n >= 60 else None,
    }


WITHIN = {
    "intra_bull_epoch_density": "double", "intra_bear_epoch_density": "double", "intra_bull_excess_gain": "double", "intra_bear_excess_gain": "double", "intra_bull_cv": "double", "intra_bear_cv": "double", "intra_max_drawdown": "double", "intra_max_runup": "double",
    "intra_trade_count": "long", "intra_ofi": "double", "intra_duration_us": "long", "intra_intensity": "double", "intra_vwap_position": "double", "intra_count_imbalance": "double", "intra_kyle_lambda": "double",
    "intra_burstiness": "double", "intra_volume_skew": "double", "intra_volume_kurt": "double", "intra_kaufman_er": "double", "intra_garman_klass_vol": "double", "intra_hurst": "double", "intra_permutation_entropy": "double",
}

BEFORE = {
    "lookback_trade_count": "long", "lookback_ofi": "double", "lookback_count_imbalance": "double", "lookback_duration_us": "long", "lookback_intensity": "double", "lookback_vwap": "double", "lookback_vwap_position": "double",
    "lookback_kyle_lambda": "double", "lookback_burstiness": "double", "lookback_volume_skew": "double", "lookback_volume_kurt": "double", "lookback_price_range": "double",
    "lookback_kaufman_er": "double", "lookback_garman_klass_vol": "double", "lookback_hurst": "double", "lookback_permutation_entropy": "double",
}


def before_bar(ts: np.ndarray, price: np.ndarray, volume: np.ndarray, maker: np.ndarray, tier2: bool = True, tier3: bool = True) -> dict:
    """The 16 features of the trades before a bar. Tier 2: flow and shape; tier 3: volatility, entropy and persistence."""
    n = len(price)
    out: dict = dict.fromkeys(BEFORE)
    if not n:
        return out
    buy, sell = float(volume[~maker].sum()), float(volume[maker].sum())
    total, high, low = buy + sell, float(price.max()), float(price.min())
    buys = int((~maker).sum())
    duration = int(ts[-1] - ts[0])
    vwap = float((price * volume).sum()) / total if total > EPS else float(price[0])
    out |= {
        "lookback_trade_count": n, "lookback_ofi": (buy - sell) / total if total > EPS else 0.0, "lookback_count_imbalance": (2 * buys - n) / n, "lookback_duration_us": duration,
        "lookback_intensity": n / (duration / 1e6) if duration > 0 else float(n), "lookback_vwap": vwap, "lookback_vwap_position": (vwap - low) / (high - low) if high - low > EPS else 0.5,
    }
    if tier2:
        move = float(price[-1] - price[0]) / float(price[0]) if abs(float(price[0])) > EPS else 0.0
        part = slice(None, None, 5) if n > 500 else slice(None)
        b, s = float(volume[part][~maker[part]].sum()), float(volume[part][maker[part]].sum())
        lean = (b - s) / (b + s) if b + s > EPS else 0.0
        shape = moments(volume) if n >= 3 else None
        gaps = np.diff(ts).astype(float)
        spread = float(gaps.std()) + float(gaps.mean()) if n >= 2 else 0.0
        out |= {
            "lookback_kyle_lambda": 0.0 if n < 2 or abs(lean) <= EPS else move / lean,
            "lookback_burstiness": (float(gaps.std()) - float(gaps.mean())) / max(spread, EPS) if n >= 2 else 0.0,
            "lookback_volume_skew": shape[0] if shape else 0.0, "lookback_volume_kurt": shape[1] if shape and n >= 4 else 0.0, "lookback_price_range": (high - low) / float(price[0]) if price[0] > EPS else 0.0,
        }
    if tier3:
        straight = efficiency(price) if n >= 2 else None
        entropy = adaptive_entropy(price) if n >= 60 else None
        hurst = None
        if n >= 64:  # what looks random isn't tested for persistence
            hurst = 0.5 if entropy is not None and entropy > 0.75 else soft_clamp(hurst_rs(price))
        out |= {"lookback_kaufman_er": straight or 0.0, "lookback_garman_klass_vol": garman_klass(price, GK_BEFORE), "lookback_hurst": hurst, "lookback_permutation_entropy": entropy}
    return out
