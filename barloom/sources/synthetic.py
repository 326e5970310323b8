"""Made price series for tests and studies, the same for the same seed."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from barloom.sources.bars import numbered


def regime_walk(n: int = 2500, seed: int = 42, start: float = 100.0, share: float = 0.45, drift: float = 0.0009) -> pd.DataFrame:
    """Daily bars in stretches of two kinds: trends that drift one way, and ranges whose price is pulled to where they began.

    What is drawn, and in which order, is part of the definition: kind, length and side of each stretch and one normal a close,
    stretch by stretch, then a half range a bar and a volume a bar.
    """
    rng, parts, made = np.random.default_rng(seed), [np.array([start])], 1
    while made < n:
        rises = rng.choice(["trend", "range"], p=[share, 1 - share]) == "trend"
        length, side, origin = int(rng.integers(60, 180)), rng.choice([-1, 1]), parts[-1][-1]
        noise = rng.normal(0, 0.010 if rises else 0.006, min(length, n - made))
        if rises:
            part = origin * np.cumprod(1 + side * drift + noise)
        else:  # a pull of 2 % of the way back, and a move in proportion to the price
            part = np.fromiter(accumulate(noise, lambda price, z: 0.98 * price + 0.02 * origin + price * z, initial=origin), float)[1:]
        parts.append(part)
        made += len(part)
    close = np.concatenate(parts)
    reach = 0.0015 + np.abs(rng.normal(0, 0.004, len(close)))
    opened = np.append(close[0], close[:-1])
    bars = {"open": opened, "high": np.maximum(opened, close + close * reach), "low": np.minimum(opened, close - close * reach), "close": close}
    return pd.DataFrame({"ts": pd.bdate_range("2015-01-01", periods=len(close)), **bars, "volume": rng.integers(1_000_000, 5_000_000, len(close)).astype(float)})


def synthetic_bars(spark: SparkSession, seeds: list[int], n: int = 2500) -> DataFrame:
    """Bars of one asset for each seed; every series is made in a task."""

    def make(d: pd.DataFrame) -> pd.DataFrame:
        made = regime_walk(n, int(d["seed"].iloc[0]))
        made.insert(0, "asset", f"seed-{d['seed'].iloc[0]}")
        return made

    schema = "asset string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    return numbered(spark.createDataFrame([(s,) for s in seeds], "seed long").groupBy("seed").applyInPandas(make, schema))


def _bars(close: np.ndarray, spread: np.ndarray, rng: np.random.Generator) -> pd.DataFrame:
    """Bars around a path: opens with a gap, ranges of the spread beyond open and close."""
    open_ = np.concatenate((close[:1], close[:-1] * np.exp(0.3 * spread[1:] * rng.standard_normal(len(close) - 1))))
    top, low = np.maximum(open_, close), np.minimum(open_, close)
    high, low = top * np.exp(np.abs(rng.standard_normal(len(close))) * spread / 2), low * np.exp(-np.abs(rng.standard_normal(len(close))) * spread / 2)
    return pd.DataFrame({"ts": pd.bdate_range("2000-01-03", periods=len(close)), "open": open_, "high": high, "low": low, "close": close, "volume": rng.integers(1_000_000, 5_000_000, len(close)).astype(float)})


def _clustered(n: int, vol: float, z: np.ndarray) -> np.ndarray:
    """Deviations that follow the squares of the shocks, with mean square vol ** 2."""
    out, now = np.empty(n), vol * vol
    for t in range(n):
        out[t] = now**0.5
        now = 0.02 * vol * vol + 0.93 * now + 0.05 * now * z[t] ** 2
    return out


def random_walk(n: int = 3000, seed: int = 0, vol: float = 0.01) -> pd.DataFrame:
    """No edge: any Sharpe ratio found here is luck."""
    rng = np.random.default_rng(seed)
    z = rng.standard_normal(n)
    sd = _clustered(n, vol, z)
    return _bars(100 * np.exp(np.cumsum(sd * z)), sd, rng)


def trending(n: int = 3000, seed: int = 0, ic: float = 0.03, halflife: int = 60, vol: float = 0.01, fast: float = 0.0, lags: int = 5) -> pd.DataFrame:
    """A move has correlation ic with the recursive mean of the moves before it, and ``fast`` (negative: reversal) with the sum of the last few."""
    rng = np.random.default_rng(seed)
    z, a = rng.standard_normal(n), 1 - 0.5 ** (1 / halflife)
    u, mean, unit = np.zeros(n), 0.0, (a / (2 - a)) ** 0.5
    for t in range(n):
        u[t] = ic / (1 - ic * ic) ** 0.5 * mean / unit + fast * u[max(0, t - lags) : t].sum() / lags**0.5 + z[t]
        mean += a * (u[t] - mean)
    sd = _clustered(n, vol, z)
    return _bars(100 * np.exp(np.cumsum(sd * u)), sd, rng)


def autoregressive(n: int = 3000, seed: int = 0, phi: float = 0.2, vol: float = 0.01) -> pd.DataFrame:
    """Each move is phi times the last one and a shock, with deviation vol."""
    rng = np.random.default_rng(seed)
    z, u = rng.standard_normal(n) * (1 - phi * phi) ** 0.5, np.zeros(n)
    for t in range(n):
        u[t] = (phi * u[t - 1] if t else 0.0) + z[t]
    return _bars(100 * np.exp(np.cumsum(vol * u)), np.full(n, vol), rng)


def switching(n: int = 3000, seed: int = 0, stay: float = 120.0, drift: float = 0.06, pull: float = 0.02, vol: float = 0.01) -> pd.DataFrame:
    """Trends of a drawn side and stretches pulled back to where they began, each of a geometric length; column ``trend`` tells."""
    rng = np.random.default_rng(seed)
    z, change, first = rng.standard_normal(n), rng.random(n) < 1 / stay, int(rng.integers(2))
    state = (first + np.cumsum(change)) % 2 == 1
    level, anchor, way, path = 0.0, 0.0, 1.0, np.empty(n)
    for t in range(n):
        if t == 0 or change[t]:
            anchor, way = level, rng.choice([-1.0, 1.0])
        level += vol * ((drift * way if state[t] else -pull * (level - anchor) / vol) + z[t])
        path[t] = level
    return _bars(100 * np.exp(path), np.full(n, vol), rng).assign(trend=state)


def planted(n: int = 3000, seed: int = 0, span: int = 20, side: int = 1, edge: float = 0.1, vol: float = 0.01) -> pd.DataFrame:
    """The next move drifts with ``side`` times the stance of the last break of a channel of ``span`` bars, as long as the span."""
    rng = np.random.default_rng(seed)
    close, high, low = np.full(n, 100.0), np.full(n, 100.2), np.full(n, 99.8)
    at, way = -1, 0
    for t in range(1, n):
        stance = way if at >= 0 and t - 1 - at < span else 0
        close[t] = close[t - 1] * (1 + side * stance * edge * vol + rng.normal(0, vol))
        high[t] = max(close[t - 1], close[t]) * (1 + abs(rng.normal(0, 0.003)))
        low[t] = min(close[t - 1], close[t]) * (1 - abs(rng.normal(0, 0.003)))
        if t >= span:
            up, down = high[t] >= high[t - span : t].max(), low[t] <= low[t - span : t].min()
            if up != down:
                at, way = t, 1 if up else -1
    open_ = np.concatenate((close[:1], close[:-1]))
    return pd.DataFrame({"ts": pd.bdate_range("2000-01-03", periods=n), "open": open_, "high": high, "low": low, "close": close, "volume": 0.0})


def planted_switch(n: int = 3000, seed: int = 0, stretch: int = 500, edge: float = 0.1, vol: float = 0.01, experts: tuple[tuple[int, int], tuple[int, int]] = ((40, 1), (20, -1))) -> pd.DataFrame:
    """As ``planted``, by two experts (span, side) in turn, each for ``stretch`` bars; column ``expert`` tells which."""
    rng = np.random.default_rng(seed)
    z, up_by, down_by = rng.normal(0, vol, n), np.abs(rng.normal(0, 0.003, n)), np.abs(rng.normal(0, 0.003, n))
    who = np.arange(n) // stretch % 2
    close, high, low = np.full(n, 100.0), np.full(n, 100.2), np.full(n, 99.8)
    broke = {span: (-1, 0) for span, _ in experts}  # bar and way of the last break of each channel
    for t in range(1, n):
        span, side = experts[who[t]]
        at, way = broke[span]
        drift = side * way * edge * vol if 0 <= at and t - 1 - at < span else 0.0
        close[t] = close[t - 1] * (1 + drift + z[t])
        top, bottom = max(close[t - 1], close[t]), min(close[t - 1], close[t])
        high[t], low[t] = top * (1 + up_by[t]), bottom * (1 - down_by[t])
        for length in broke:
            if t >= length:
                up, down = high[t] >= high[t - length : t].max(), low[t] <= low[t - length : t].min()
                if up != down:
                    broke[length] = (t, 1 if up else -1)
    out = pd.DataFrame({"ts": pd.bdate_range("2000-01-03", periods=n), "open": np.append(close[0], close[:-1]), "high": high, "low": low, "close": close, "volume": 0.0})
    return out.assign(expert=who)


def _decayed(shocks: np.ndarray, halflife: float) -> np.ndarray:
    """What is left of all shocks, each halved every ``halflife`` bars."""
    keep = 0.5 ** (1 / halflife)
    return np.fromiter(accumulate(shocks, lambda level, z: keep * level + z), float)


def spread(n: int = 3000, seed: int = 0, kind: str = "calendar", halflife: float = 10.0, vol: float = 0.07, jumps: float = 4.0, every: int = 21, gap: float = 0.02, tick: float = 0.01) -> pd.DataFrame:
    """A listed spread in points, through 0: a mean, deviations from it that halve in ``halflife`` bars, jumps a year, contracts that change.

    The mean of a "calendar" spread has a season of a year and wanders; that of a "trending" one drifts in episodes, either way.
    Every ``every`` bars the contract rolls (column roll), and the listed price moves by the gap between the two. Columns mean and
    latent (without the contracts' gaps) tell the truth.
    """
    rng, t = np.random.default_rng(seed), np.arange(n)
    if kind == "calendar":
        mean = 0.4 + 0.5 * np.sin(2 * np.pi * (t / 252 + rng.random())) + _decayed(rng.normal(0, 0.01, n), 500)
    elif kind == "trending":
        lengths = rng.geometric(np.tile([1 / 120, 1 / 60], n)[:n])
        episode = np.repeat(np.arange(n), lengths)[:n]
        way = np.where(np.arange(n) % 2 == 0, rng.choice([-1.0, 1.0], n), 0.0)  # a drift, then none
        mean = 0.3 + _decayed(0.012 * way[episode], 400)
    else:
        raise ValueError(f"no kind {kind}")
    shocks = rng.normal(0, vol, n) + (rng.random(n) < jumps / 252) * rng.choice([-1.0, 1.0], n) * 3 * vol
    latent = mean + _decayed(shocks, halflife)
    contract = (t + 1) // every
    listed = latent + rng.normal(0, gap, n // every + 2)[contract]
    whole = lambda x: np.round(x / tick) * tick
    close = whole(listed)
    opened = whole(np.append(close[0], close[:-1] + 0.3 * vol * rng.standard_normal(n - 1)))
    high = whole(np.maximum(opened, close) + np.abs(rng.normal(0, vol / 2, n)))
    low = whole(np.minimum(opened, close) - np.abs(rng.normal(0, vol / 2, n)))
    out = pd.DataFrame({"ts": pd.bdate_range("2000-01-03", periods=n), "open": opened, "high": high, "low": low, "close": close, "volume": 0.0})
    return out.assign(roll=(np.diff(contract, prepend=0) > 0).astype(float), mean=mean, latent=latent)


def trending_spread(n: int = 3000, seed: int = 0) -> pd.DataFrame:
    return spread(n, seed, "trending", halflife=8.0, jumps=2.0)


SUITE = {"random_walk": random_walk, "trending": trending, "autoregressive": autoregressive, "switching": switching, "planted": planted, "planted_switch": planted_switch, "calendar_spread": spread, "trending_spread": trending_spread}


def suite(spark: SparkSession, names: tuple[str, ...] = tuple(SUITE), seeds: tuple[int, ...] = (0,), n: int = 3000) -> DataFrame:
    """Bars of an asset for each name and seed, each made in a task."""

    def make(d: pd.DataFrame) -> pd.DataFrame:
        name, seed = d["name"].iloc[0], int(d["seed"].iloc[0])
        made = SUITE[name](n, seed)[["ts", "open", "high", "low", "close", "volume"]]
        made.insert(0, "asset", f"{name}-{seed}")
        return made

    schema = "asset string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    return numbered(spark.createDataFrame([(x, s) for x in names for s in seeds], "name string, seed long").groupBy("name", "seed").applyInPandas(make, schema))
