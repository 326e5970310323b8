"""Features and position of the trend forecaster as window expressions; each bar reads a fixed number of bars before it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.sources.bars import by_bar

#: Bars of the deviation and of the ranks, scales of the kernels, clips, prior, precisions, full size.
SIGMA_BARS, RANK_BARS, FAST, SLOW, KERNEL_CLIP, BAND_CLIP, TARGET_CLIP = 60, 250, (4, 8), (16, 32, 64, 128), 2.5, 2.0, 4.0
PRIOR, STIFF_SLOW, STIFF_FAST, FULL_SHARPE, BUFFER = 0.02, 1000.0, 2500.0, 0.4, 0.1


def sigma(change: Column, n: int = SIGMA_BARS) -> Column:
    """Deviation of the changes of close, null where it is 0."""
    return ind.full(F.nullif(F.stddev_samp(change).over(ind.back(n)), F.lit(0.0)), change, n)


def kernel(change: Column, deviation: Column, scale: int) -> Column:
    """Changes of the last 3 scales weighted (k + 1) exp(-2 k / scale) to unit norm, in deviations, clipped."""
    import math

    weights = [(k + 1) * math.exp(-2 * k / scale) for k in range(3 * scale + 1)]
    norm = math.sqrt(sum(w * w for w in weights))
    held = F.collect_list(change).over(ind.back(len(weights)))
    late_first = F.array(*(F.lit(w) for w in reversed(weights)))
    total = F.aggregate(F.zip_with(held, late_first, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return ind.full(ind.clip(total / norm / deviation, -KERNEL_CLIP, KERNEL_CLIP), change, len(weights))


def centred_rank(x: Column, n: int = RANK_BARS) -> Column:
    """Rank among the last n values from -1 to 1, ties counting half."""
    held = F.collect_list(x).over(ind.back(n))
    less, same = F.size(F.filter(held, lambda v: v < x)), F.size(F.filter(held, lambda v: v == x))
    return ind.full(2 * (less + 0.5 * same) / n - 1, x, n)


def bands(bars: DataFrame) -> DataFrame:
    """The bars with ch, sigma, slow, fast (mean kernels of each speed) and y, the move that a forecast is of.

    A bar's y is the move from the next open to the one after in deviations: it is known two bars later.
    """
    rows = bars.withColumn("ch", F.col("close") - ind.lag(F.col("close")))
    rows = rows.withColumn("sigma", sigma(F.col("ch")))
    rows = rows.withColumns({f"k{n}": kernel(F.col("ch"), F.col("sigma"), n) for n in (*SLOW, *FAST)})
    mean = lambda scales: ind.clip(reduce(lambda a, b: a + b, (F.col(f"k{n}") for n in scales)) / len(scales), -BAND_CLIP, BAND_CLIP)
    ahead = lambda n: F.lead("open", n).over(by_bar())
    return rows.withColumns({"slow": mean(SLOW), "fast": mean(FAST), "y": ind.clip((ahead(2) - ahead(1)) / F.col("sigma"), -TARGET_CLIP, TARGET_CLIP)}).drop(*(f"k{n}" for n in (*SLOW, *FAST)))


def context(bars: DataFrame) -> DataFrame:
    """The bars with context: the mean rank of six measures of how much a market trends, from -1 to 1."""
    lags = range(1, 11)
    rows = bars.withColumns({"_ch": F.col("close") - ind.lag(F.col("close")), "_tr": ind.true_range()} | {f"_m{q}": F.col("close") - ind.lag(F.col("close"), q) for q in lags})
    rows = rows.withColumns({
        "_r0": ind.efficiency_ratio(20, F.col("_ch")), "_r1": F.abs(ind.trend_correlation(20)), "_r2": 100 - ind.choppiness(14, F.col("_tr")),
        "_r3": ind.variance_ratio(60, 5, F.col("_ch"), F.col("_m5")), "_r4": 100 - ind.market_meanness(100, F.col("_ch")), "_r5": ind.hurst(100, [F.col(f"_m{q}") for q in lags]),
    })
    ranked = rows.withColumns({f"_q{k}": centred_rank(F.col(f"_r{k}")) for k in range(6)})
    mean = reduce(lambda a, b: a + b, (F.col(f"_q{k}") for k in range(6))) / 6
    return ranked.withColumn("context", mean).drop("_ch", "_tr", *(f"_m{q}" for q in lags), *(f"_r{k}" for k in range(6)), *(f"_q{k}" for k in range(6)))


def spec(direction: str, with_context: bool = False) -> tuple[list[str], list[float], list[float]]:
    """Features, prior and precision of a direction's forecaster; infinite precision keeps a coefficient at its prior."""
    names = ["slow", "fast"] + (["slow_context", "fast_context"] if with_context else [])
    fixed, more = float("inf"), 2 if with_context else 0
    prior = [0.0 if direction == "countertrend" else PRIOR, 0.0] + [0.0] * more
    stiff = {
        "trend": [fixed, fixed, STIFF_FAST, fixed], "countertrend": [fixed, STIFF_FAST, fixed, STIFF_FAST], "learned": [STIFF_SLOW, STIFF_FAST, STIFF_FAST, STIFF_FAST],
    }[direction][: 2 + more]
    return names, prior, stiff


def features(rows: DataFrame, names: list[str]) -> DataFrame:
    """asset, bar_idx, features (an array in the order of the names), y of rows of ``bands`` (and ``context``)."""
    held = {"slow": F.col("slow"), "fast": F.col("fast")}
    if "context" in rows.columns:
        held |= {"slow_context": F.col("slow") * F.col("context"), "fast_context": F.col("fast") * F.col("context")}
    return rows.select("asset", "bar_idx", F.array(*(held[x] for x in names)).alias("features"), "y")


def position(forecast: Column, per_year: float = 252.0) -> Column:
    """Target of a forecast in full sizes: 1 where it implies a yearly Sharpe of FULL_SHARPE."""
    return ind.clip(forecast * per_year**0.5 / FULL_SHARPE, -1, 1)
