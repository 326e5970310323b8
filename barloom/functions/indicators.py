"""Indicators as window expressions over a bar table; null until a window is full.

All share the (asset, ts) partitioning, so any set of them costs one sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.sources.bars import by_bar


def back(n: int):
    return by_bar().rowsBetween(-(n - 1), 0)


def full(value: Column, of: Column, n: int) -> Column:
    """``value`` where the window holds ``n`` values of ``of``."""
    return F.when(F.count(of).over(back(n)) == n, value)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def lag(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_bar())


def true_range() -> Column:
    before = lag(F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def sma(x: Column, n: int) -> Column:
    return full(F.avg(x).over(back(n)), x, n)


def donchian(n: int) -> tuple[Column, Column, Column]:
    high, low = full(F.max(F.col("high")).over(back(n)), F.col("high"), n), full(F.min(F.col("low")).over(back(n)), F.col("low"), n)
    return high, low, (high + low) / 2


def bollinger(n: int, k: float) -> tuple[Column, Column, Column]:
    middle, width = sma(F.col("close"), n), k * F.stddev_pop(F.col("close")).over(back(n))
    return middle + width, middle - width, middle


def efficiency_ratio(n: int, change: Column) -> Column:
    """Net over gross movement; ``change`` is a column close - previous close."""
    gross = full(F.sum(F.abs(change)).over(back(n)), change, n)
    return clip(F.try_divide(F.abs(F.col("close") - lag(F.col("close"), n)), F.nullif(gross, F.lit(0.0))), 0, 1)


def trend_correlation(n: int) -> Column:
    """Correlation of close and time; 0 for a flat window."""
    x, y = F.col("bar_idx").cast("double"), F.col("close")
    spread = F.stddev_pop(x).over(back(n)) * F.stddev_pop(y).over(back(n))
    r = F.try_divide(F.covar_pop(y, x).over(back(n)), F.nullif(spread, F.lit(0.0)))
    return full(clip(F.coalesce(r, F.lit(0.0)), -1, 1), F.col("close"), n)


def choppiness(n: int, tr: Column) -> Column:
    span = F.max(F.col("high")).over(back(n)) - F.min(F.col("low")).over(back(n))
    ratio = F.try_divide(F.sum(tr).over(back(n)), F.nullif(span, F.lit(0.0)))
    return full(clip(100 * F.log10(ratio) / F.log10(F.lit(float(n))), 0, 100), tr, n)


def variance_ratio(n: int, q: int, change: Column, wide: Column) -> Column:
    """Variance of q-bar changes over q times that of one-bar changes; ``wide`` is close - close q bars before."""
    one = F.nullif(F.var_samp(change).over(back(n)) * q, F.lit(0.0))
    return full(clip(F.try_divide(F.var_samp(wide).over(back(n)), one), 0, 5), wide, n)


def hurst(n: int, moves: list[Column]) -> Column:
    """Half the slope of log variance on log lag, lags 1 to len(moves); ``moves`` are close - close q bars before."""
    import math

    x = [math.log(q) for q in range(1, len(moves) + 1)]
    mean = sum(x) / len(x)
    spread = sum((v - mean) ** 2 for v in x)
    logs = [F.ln(F.nullif(F.var_pop(m).over(back(n)), F.lit(0.0))) for m in moves]
    slope = reduce(lambda a, b: a + b, (F.lit((v - mean) / spread) * y for v, y in zip(x, logs, strict=True)))
    return full(slope / 2, moves[-1], n)


def percentile_rank(x: Column, n: int) -> Column:
    """Share of the window below the last value, ties counted by their mean rank."""
    held = F.collect_list(x).over(back(n))
    less, same = F.size(F.filter(held, lambda v: v < x)), F.size(F.filter(held, lambda v: v == x))
    return full((less + (same + 1) / 2) / n, x, n)


def market_meanness(n: int, change: Column) -> Column:
    """Percent of the changes in a window that are further from its median than the change before them, on the same side."""
    held = F.collect_list(change).over(back(n))
    ordered = F.array_sort(held)
    middle = (F.get(ordered, F.lit((n - 1) // 2)) + F.get(ordered, F.lit(n // 2))) / 2
    near = lambda m: F.aggregate(
        F.sequence(F.lit(1), F.lit(n - 1)),
        F.lit(0),
        lambda a, i: a
        + F.when(
            ((F.get(held, i) > m) & (F.get(held, i) > F.get(held, i - 1))) | ((F.get(held, i) < m) & (F.get(held, i) < F.get(held, i - 1))), 1
        ).otherwise(0),
    )
    count = F.get(F.transform(F.array(middle), near), F.lit(0))
    return full(100 * count / F.lit(n - 1), change, n)


def break_signal(high: Column, low: Column) -> Column:
    """1 or -1 where the bar reaches an edge of the last bar's channel, and only one; else null."""
    up, down = F.col("high") >= lag(high), F.col("low") <= lag(low)
    return F.when(up & ~down, F.lit(1)).when(down & ~up, F.lit(-1))


def stance_loss(held: Column, stance_: Column, move: Column, cost: Column, formed: Column) -> Column:
    """Half of one less the payoff: the move (in ranges) of the stance held, less the cost of the sides traded, halved and clipped.

    0.5 before the channel is formed or where the range is not known.
    """
    payoff = clip((held * move - cost * F.abs(stance_ - held)) / 2, -1, 1)
    return F.when(formed, F.coalesce(0.5 * (1 - payoff), F.lit(0.5))).otherwise(F.lit(0.5))


def stance(signal: Column, span: int) -> Column:
    """The last break of the past ``span`` bars, 0 without one."""
    return F.coalesce(F.last(signal, ignorenulls=True).over(back(span)), F.lit(0))
