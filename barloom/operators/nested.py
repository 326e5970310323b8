"""Selection of templates as it could be made at the time: records up to each boundary, the portfolios picked from them.

A boundary is the start of a tested window. What lies before it is a prefix of an asset's windows, so every record is a running
aggregate over windows, met by its window's number; no bar or window is joined with the boundaries after it. Of the bars only
sums a window reach the running aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import metrics, portfolio
from barloom.operators.book import candidates

#: What a candidate must show, and bars and windows of history before the first selection.
LEAST_SHARPE, LEAST_WINDOWS, LEAST_TRADES, HISTORY_WINDOWS, HISTORY_BARS = 0.2, 4, 20, 4, 60
KEYS = ["asset", "template"]


def _before() -> Window:
    return Window.partitionBy(*KEYS).orderBy("window_id").rowsBetween(Window.unboundedPreceding, -1)


def causal_records(wins: DataFrame, rets: DataFrame, per_year: float = 252.0) -> DataFrame:
    """asset, template, window_id and the record of the windows before it: what was known when that window began.

    wins and rets as of ``search.walked`` with a template. n_windows, n_live, n_trades, pct_profitable, wfe, oos_sharpe, oos_total,
    oos_max_dd, n_bars, pardo_pass; a template's first window has no record.
    """
    ret = F.col("ret")
    curve = metrics.curve(rets.withColumn("_k", F.struct(*KEYS)).withColumnRenamed("bar_idx", "ts"), "_k")
    per = curve.groupBy("_k", "window_id").agg(
        F.count("ret").alias("_n"), F.sum(ret).alias("_s"), F.sum(ret * ret).alias("_q"), F.max_by("equity", "ts").alias("_e"), F.min("drawdown").alias("_d")
    )
    years = lambda p: F.when(F.col(f"{p}_years") > 0, F.col(f"{p}_years")).otherwise(F.col(f"{p}_n_bars") / per_year)
    live = F.col("trial_id").isNotNull()
    rows = wins.join(per.select("_k.*", "window_id", "_n", "_s", "_q", "_e", "_d"), [*KEYS, "window_id"], "left").withColumns({
        "_live": live.cast("long"), "_won": F.coalesce((F.col("oos_total_return") > 0).cast("long"), F.lit(0).cast("long")),
        "_i": F.when(live, F.col("is_total_return") / years("is")), "_o": F.when(live, F.col("oos_total_return") / years("oos")),
    })
    w = _before()
    total = lambda c: F.sum(c).over(w)
    known = rows.select(
        *KEYS, "window_id", F.count(F.lit(1)).over(w).alias("n_windows"), total("_live").alias("n_live"), F.coalesce(total("oos_n_trades"), F.lit(0)).cast("long").alias("n_trades"),
        (total("_won") / F.nullif(F.count(F.lit(1)).over(w), F.lit(0))).alias("pct_profitable"), F.avg("_i").over(w).alias("_i"), F.avg("_o").over(w).alias("_o"),
        total("_n").alias("n_bars"), total("_s").alias("_s"), total("_q").alias("_q"), (F.last("_e", True).over(w) - 1).alias("oos_total"), F.min("_d").over(w).alias("oos_max_dd"),
    ).filter("n_windows > 0")
    mean = F.col("_s") / F.col("n_bars")
    var = (F.col("_q") - F.col("n_bars") * mean * mean) / F.nullif(F.col("n_bars") - 1, F.lit(0))
    wfe = F.when(F.col("_i") > 0, F.least(F.greatest(F.col("_o") / F.col("_i"), F.lit(-10.0)), F.lit(10.0)))
    told = known.withColumns({"wfe": wfe, "oos_sharpe": F.when(var > 0, mean / F.sqrt(var) * F.sqrt(F.lit(per_year))).otherwise(F.lit(0.0))}).drop("_i", "_o", "_s", "_q")
    passed = (F.col("n_live") >= 3) & (F.col("oos_total") > 0) & (F.col("pct_profitable") >= 0.5) & F.coalesce(F.col("wfe") >= 0.5, F.lit(False))
    return told.withColumn("pardo_pass", passed)


def _told(past: DataFrame, group: list[str], per_year: float) -> DataFrame:
    """Correlation, covariance, mean and Sharpe of pairs from their sums, with the groups they belong to."""
    n = F.col("n")
    vx, vy, cxy = (F.col(p) - F.col(q) * F.col(s) / n for p, q, s in (("sxx", "sx", "sx"), ("syy", "sy", "sy"), ("sxy", "sx", "sy")))
    return past.select(
        *group, "a", "b", F.when((vx > 0) & (vy > 0), cxy / F.sqrt(vx * vy)).alias("corr"), F.try_divide(cxy, n - 1).alias("cov"), (F.col("sx") / n).alias("mean"),
        F.when(vx > 0, F.col("sx") / n / F.sqrt(vx / (n - 1)) * per_year**0.5).otherwise(F.lit(0.0)).alias("sharpe"),
    )


def _picker(group: list[str], kind: str, most: int, ceiling: float, method: str, weighting: str):
    """Kernel that picks from the pairs of one group, and its schema."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        taken = portfolio.picked(d, -np.inf, most, ceiling, method)
        weight = np.full(len(taken), 1 / max(len(taken), 1))
        if weighting == "hrp" and taken:
            weight = portfolio.hrp(portfolio._matrices(d[d["a"].isin(taken) & d["b"].isin(taken)], taken, "cov"))
        out = pd.DataFrame({"template": taken, "weight": weight, "rank": np.arange(len(taken))})
        for c in group:
            out[c] = d[c].iloc[0]
        return out

    return run, f"{kind}, template string, weight double, rank int"


def _pair_sums(rets: DataFrame, names: DataFrame) -> DataFrame:
    """asset, a <= b, window_id and the sums of the returns of each pair of templates; only ``names`` (asset, template) are paired."""
    put = rets.join(names, KEYS, "left_semi")
    a, b = (put.select("asset", "bar_idx", *(["window_id"] if x == "a" else []), F.col("template").alias(x), F.col("ret").alias(v)) for x, v in (("a", "x"), ("b", "y")))
    x, y = F.col("x"), F.col("y")
    return a.join(b, ["asset", "bar_idx"]).filter("a <= b").groupBy("asset", "a", "b", "window_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")
    )


SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def nested_portfolio(wins: DataFrame, rets: DataFrame, history_windows: int = HISTORY_WINDOWS, history_bars: int = HISTORY_BARS, least_sharpe: float = LEAST_SHARPE, least_trades: int = 0, least_windows: int = 0, pardo: bool = False, least_wfe: float | None = None, most: int = 8, ceiling: float = 0.6, method: str = "greedy", weighting: str = "equal", per_year: float = 252.0) -> DataFrame:
    """asset, window_id, template, weight, rank: what is held over each window, picked from the windows that ended before it.

    A boundary counts from ``history_windows`` windows and ``history_bars`` bars on. Filter, subset and weights are those of the
    static portfolio, every number of them as of the boundary.
    """
    known = causal_records(wins, rets, per_year).filter((F.col("n_windows") >= history_windows) & (F.col("n_bars") >= history_bars))
    allowed = candidates(known, least_sharpe, least_windows, least_trades, pardo, least_wfe).select(*KEYS, "window_id")
    sums = _pair_sums(rets, allowed.select(*KEYS).distinct())
    # pairs of candidates by windows, no bars: a window in which a pair has no bars of its own still has its history
    grid = sums.select("asset", "a", "b").distinct().join(wins.select("asset", "window_id").distinct(), "asset").join(sums, ["asset", "a", "b", "window_id"], "left")
    before = Window.partitionBy("asset", "a", "b").orderBy("window_id").rowsBetween(Window.unboundedPreceding, -1)
    past = grid.select("asset", "a", "b", "window_id", *(F.sum(c).over(before).alias(c) for c in SUMS)).filter("n IS NOT NULL")
    for x in "ab":
        past = past.join(allowed.withColumnRenamed("template", x), ["asset", x, "window_id"], "left_semi")
    group = ["asset", "window_id"]
    run, schema = _picker(group, "asset string, window_id long", most, ceiling, method, weighting)
    return _told(past, group, per_year).groupBy(*group).applyInPandas(run, schema)


def static_portfolio(summary: DataFrame, rets: DataFrame, least_sharpe: float = LEAST_SHARPE, least_windows: int = LEAST_WINDOWS, least_trades: int = LEAST_TRADES, pardo: bool = False, least_wfe: float | None = None, most: int = 8, ceiling: float = 0.6, method: str = "greedy", weighting: str = "equal", per_year: float = 252.0) -> DataFrame:
    """asset, template, weight, rank: picked once from the whole history, so what it earned in it is a biased record."""
    allowed = candidates(summary, least_sharpe, least_windows, least_trades, pardo, least_wfe).select(*KEYS)
    sums = _pair_sums(rets, allowed).groupBy("asset", "a", "b").agg(*(F.sum(c).alias(c) for c in SUMS))
    run, schema = _picker(["asset"], "asset string", most, ceiling, method, weighting)
    return _told(sums, ["asset"], per_year).groupBy("asset").applyInPandas(run, schema)


def portfolio_returns(rets: DataFrame, held: DataFrame, first_window: int | None = None) -> DataFrame:
    """asset, bar_idx, window_id, ret of what is held (asset, template, weight, and window_id if it changes), closed after a ruin.

    Windows without holdings earn 0; those before ``first_window``, the first that could hold anything, are left out.
    """
    on = [*KEYS, *(["window_id"] if "window_id" in held.columns else [])]
    every = rets.select("asset", "window_id", "bar_idx").distinct()
    earned = rets.join(held.select(*on, "weight"), on).groupBy("asset", "bar_idx").agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))
    every = every if first_window is None else every.filter(F.col("window_id") >= first_window)
    series = every.join(earned, ["asset", "bar_idx"], "left").select("asset", "window_id", F.col("bar_idx").alias("ts"), F.coalesce("ret", F.lit(0.0)).alias("ret"))
    return metrics.closed_after_ruin(series).withColumnRenamed("ts", "bar_idx").select("asset", "bar_idx", "window_id", "ret")


def both_portfolios(summary: DataFrame, wins: DataFrame, rets: DataFrame, history_windows: int = HISTORY_WINDOWS, **how) -> tuple[DataFrame, DataFrame]:
    """Holdings and returns of both portfolios: (target, asset, window_id, template, weight, rank), (target, asset, bar_idx, window_id, ret)."""
    static = static_portfolio(summary, rets, **how)
    nested = nested_portfolio(wins, rets, history_windows, **how)
    name = lambda d, target: d.withColumn("target", F.lit(target))
    held = name(static.withColumn("window_id", F.lit(None).cast("long")), "static").unionByName(name(nested, "nested"))
    earned = name(portfolio_returns(rets, static), "static").unionByName(name(portfolio_returns(rets, nested, history_windows), "nested"))
    return held, earned


def best_template(summary: DataFrame) -> DataFrame:
    """asset, template with the largest Sharpe of its tests (ties: the first by name)."""
    best: Column = F.min(F.struct((-F.col("oos_sharpe")).alias("s"), F.col("template")))
    return summary.groupBy("asset").agg(best["template"].alias("template"))


