"""One continuous series from listed spreads that expire: what holding the front one and rolling it earns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRICES = ["open", "high", "low", "close"]
SCHEMA = "root string, ts timestamp_ntz, open double, high double, low double, close double, held string, roll double"


def stretches(traded: np.ndarray, last_day: np.ndarray, roll_days: int) -> list[tuple[int, int, int, int]]:
    """(contract, first bar, last bar, bar of entry or -1) of each holding, from the first bar on which anything traded.

    ``traded`` (bars, contracts) and ``last_day``, a contract's last trading bar (inf: unknown). A contract is left at the close
    of the first bar with ``roll_days`` or fewer bars to go on which the next one trades and it does too, or has expired, or was
    never entered; one that has expired while the next does not trade is left for nothing, until the next one trades. A contract
    that was rolled into is entered on the bar of the roll, before its first bar; else it is entered at its first close.
    """
    n, m = traded.shape
    if not traded.any():
        return []
    t0 = int(np.argmax(traded.any(axis=1)))
    far = np.flatnonzero(traded[t0] & (last_day - t0 > roll_days))
    j, begin, entry, out = int(far[0] if len(far) else np.argmax(traded[t0])), t0, -1, []
    while begin < n:
        if entry < 0:
            on = np.flatnonzero(traded[begin:, j])
            entry = begin + int(on[0]) if len(on) else n
        if j + 1 == m:
            out.append((j, begin, n - 1, entry))
            break
        bar = np.arange(begin, n)
        gone = last_day[j] <= bar
        following = traded[begin:, j + 1]
        leaves = (last_day[j] - bar <= roll_days) & np.where(following, traded[begin:, j] | gone | (bar < entry), gone)
        if not leaves.any():
            out.append((j, begin, n - 1, entry))
            break
        end = begin + int(np.argmax(leaves))
        out.append((j, begin, end, entry))
        entry = end if following[end - begin] else -1
        j, begin = j + 1, end + 1
    return out


def continuous(quotes: pd.DataFrame, expiries: dict[str, pd.Timestamp], order: list[str], roll_days: int = 10, size: float = 1.0, start: float = 0.0, roll_cost: float = 0.0) -> pd.DataFrame:
    """ts, open, high, low, close, held, roll of one root: ``start`` plus ``size`` times the moves of what is held.

    Within a holding the series is the contract's prices, shifted; a negative size is short, with high and low exchanged. Bars on
    which it does not trade are flat. ``roll`` is 1 on the bar at whose close the contract changes; ``roll_cost`` (points, of a
    fixed side) is taken off there.
    """
    dates = np.sort(quotes["ts"].unique())
    place, column = {c: k for k, c in enumerate(order)}, {c: np.full((len(dates), len(order)), np.nan) for c in PRICES}
    at = (np.searchsorted(dates, quotes["ts"].to_numpy()), quotes["contract"].map(place).to_numpy())
    for c in PRICES:
        column[c][at] = quotes[c].to_numpy(float)
    o, h, low, c = (column[k] for k in PRICES)
    dead = np.isnan(c) | ((o == 0) & (h == 0) & (low == 0) & (c == 0))
    o = np.where(np.isnan(o), c, o)
    h, low = np.fmax(np.fmax(h, o), c), np.fmin(np.fmin(low, o), c)
    last_day = np.array([np.searchsorted(dates, np.datetime64(expiries[k])) if pd.notna(expiries.get(k)) else np.inf for k in order], float)
    out, held, roll, level = np.full((len(dates), 4), np.nan), np.full(len(dates), None, object), np.zeros(len(dates)), float(start)
    parts = stretches(~dead, last_day, roll_days)
    for k, (j, a, z, entry) in enumerate(parts):
        bars = np.arange(a, z + 1)
        live = ~dead[bars, j] & (bars > entry)
        moved = [level + size * (x[bars, j] - c[entry, j]) if entry < len(dates) else np.full(len(bars), level) for x in (o, h, low, c)]
        if size < 0:
            moved[1], moved[2] = moved[2], moved[1]
        closes = pd.Series(np.where(live, moved[3], np.nan)).ffill().fillna(level).to_numpy()
        carried = np.append(level, closes[:-1])
        for q in range(4):
            out[bars, q] = np.where(live, moved[q], carried)
        held[bars], level = order[j], float(closes[-1])
        if k + 1 < len(parts):
            roll[z] = 1.0
            if entry <= z and parts[k + 1][3] == z:
                level -= roll_cost * abs(size)
    first = parts[0][1] if parts else len(dates)
    made = pd.DataFrame({"ts": dates, **dict(zip(PRICES, out.T, strict=True)), "held": held, "roll": roll})
    return made.iloc[first:].reset_index(drop=True)


def rolled_spreads(quotes: DataFrame, contracts: DataFrame, roll_days: int = 10, size: float = 1.0, start: float = 0.0, roll_cost: float = 0.0) -> DataFrame:
    """root, ts, OHLC, held, roll of each root's listed spreads.

    quotes: root, contract, ts, open, high, low, close; a bar of zeros or without a close did not trade. contracts: root, contract,
    rank (order of expiry), expiry (last trading day of the front leg; where it is null, the last bar that traded, unless that is
    within ``roll_days`` of the end of the root's bars). A root is a group: its spreads by its days.
    """
    row = quotes.select("root", "contract", F.col("ts").cast("timestamp_ntz").alias("ts"), *PRICES).withColumns({"rank": F.lit(None).cast("long"), "expiry": F.lit(None).cast("timestamp_ntz")})
    listed = contracts.select("root", "contract", F.col("rank").cast("long").alias("rank"), F.col("expiry").cast("timestamp_ntz").alias("expiry"))
    both = row.unionByName(listed, allowMissingColumns=True)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        names = d[d["rank"].notna()].sort_values("rank")
        own = d[d["rank"].isna() & d["contract"].isin(names["contract"])].drop_duplicates(["contract", "ts"], keep="last")
        if not len(own):
            return pd.DataFrame(columns=[x.split()[0] for x in SCHEMA.split(", ")])
        ends = dict(zip(names["contract"], names["expiry"], strict=True))
        dates = np.sort(own["ts"].unique())
        live = own[own["close"].notna() & ~(own[PRICES] == 0).all(axis=1)].groupby("contract")["ts"].max()
        edge = dates[max(0, len(dates) - 1 - roll_days)]
        for k, e in ends.items():
            if pd.isna(e) and k in live and live[k] < edge:
                ends[k] = live[k]
        got = continuous(own, ends, names["contract"].tolist(), roll_days, size, start, roll_cost)
        got.insert(0, "root", d["root"].iloc[0])
        return got

    return both.groupBy("root").applyInPandas(run, SCHEMA)
