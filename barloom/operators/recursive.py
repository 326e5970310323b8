"""Operators whose value depends on their own last value: one ordered pass over each asset's bars.

An asset's bars are one Arrow group, bounded by the length of its history; the
passes run on numpy columns, in parallel over assets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import simulation


def recursive_means(bars: DataFrame, span: int, adx_span: int) -> DataFrame:
    """asset, bar_idx, ema (alpha 2 / (span + 1)), adx (Wilder, alpha 1 / adx_span).

    A mean is seeded by its first value, the outer one of the adx by the first index, at bar adx_span - 1.
    """

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("bar_idx")
        f = simulation.Formed(d, True)
        ema = f.middle("keltner", span).to_numpy()
        return pd.DataFrame({"asset": d["asset"], "bar_idx": d["bar_idx"], "ema": ema, "adx": f.adx(adx_span).to_numpy()})

    out = bars.select("asset", "bar_idx", "high", "low", "close").groupBy("asset").applyInPandas(run, "asset string, bar_idx long, ema double, adx double")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("ema", "adx")})


def keltner(bars: DataFrame, n: int, k: float, atr_n: int) -> DataFrame:
    """asset, bar_idx, upper, lower, middle: a recursive mean of closes and k average true ranges around it."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("bar_idx")
        f = simulation.Formed(d, True)
        parts = {"upper": f.edge("keltner", n, k, atr_n, 1), "lower": f.edge("keltner", n, k, atr_n, -1), "middle": f.middle("keltner", n)}
        return pd.DataFrame({"asset": d["asset"], "bar_idx": d["bar_idx"], **{c: x.to_numpy() for c, x in parts.items()}})

    out = bars.select("asset", "bar_idx", "high", "low", "close").groupBy("asset").applyInPandas(run, "asset string, bar_idx long, upper double, lower double, middle double")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("upper", "lower", "middle")})


def buffered_levels(rows: DataFrame, band: float, sides: str = "both") -> DataFrame:
    """asset, bar_idx, level: a level that follows ``target`` only as far as it must to stay within ``band`` of it.

    A missing target holds the level and shows 0. With one side allowed, a target of the other puts the level flat at once.
    """

    barred = {"both": 0, "long_only": -1, "short_only": 1}[sides]

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("bar_idx")
        out, level = np.empty(len(d)), 0.0
        for i, p in enumerate(d["target"].to_numpy(float)):
            if np.isnan(p):
                out[i] = 0.0
                continue
            level = 0.0 if p * barred > 0 else min(max(level, p - band), p + band)
            level = 0.0 if level * barred > 0 else level
            out[i] = level
        return pd.DataFrame({"asset": d["asset"], "bar_idx": d["bar_idx"], "level": out})

    return rows.select("asset", "bar_idx", "target").groupBy("asset").applyInPandas(run, "asset string, bar_idx long, level double")
