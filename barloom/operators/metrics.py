"""Performance of return series: (series keys, ts, ret). ``additive`` series sum, others compound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def returns(bars: DataFrame) -> DataFrame:
    """asset, ts, bar_idx, ret from closes; the first bar of an asset has none."""
    by = Window.partitionBy("asset").orderBy("ts")
    ret = F.try_divide(F.col("close"), F.nullif(F.lag("close").over(by), F.lit(0.0))) - 1
    return bars.select("asset", "ts", "bar_idx", ret.alias("ret")).filter("ret IS NOT NULL")


YEAR_DAYS = 365.25


def per_year(bars: DataFrame, key: str = "asset") -> DataFrame:
    """key, per_year, years: bars in a year, the median of the full calendar years inside the span, else of the span.

    Years count per 365.25 days; fewer than two full years with bars leave the span to decide.
    """
    day = F.col("ts").cast("timestamp")
    spans = bars.groupBy(key).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("n"))
    counts = bars.groupBy(key, F.year("ts").alias("y")).agg(F.count(F.lit(1)).alias("n_y")).join(spans.select(key, "first", "last"), key)
    inside = counts.filter((F.col("y") > F.year("first")) & (F.col("y") < F.year("last")))
    days = F.dayofyear(F.make_date("y", F.lit(12), F.lit(31)))
    full = inside.groupBy(key).agg(F.median(F.col("n_y") * YEAR_DAYS / days).alias("x"), F.count(F.lit(1)).alias("years"))
    span = (F.col("last").cast("double") - F.col("first").cast("double")) / 86400 / YEAR_DAYS
    raw = F.when(F.col("years") >= 2, F.col("x")).otherwise((F.col("n") - 1) / F.nullif(span, F.lit(0.0)))
    return spans.join(full, key, "left").select(key, F.greatest(F.lit(1.0), F.rint(raw)).cast("long").alias("per_year"), F.coalesce("years", F.lit(0).cast("long")).alias("years"))


def sharpe(ret: Column, per_year: float) -> Column:
    """Annualised mean over deviation; 0 for fewer than two values or no spread."""
    spread = F.stddev_samp(ret)
    return F.when((F.count(ret) < 2) | (spread == 0), F.lit(0.0)).otherwise(F.avg(ret) / spread * F.sqrt(F.lit(float(per_year))))


def curve(rets: DataFrame, key: str = "asset", additive: bool = False) -> DataFrame:
    """Adds equity (from 1) and drawdown. A compounded curve stays where it first reaches 0 or less."""
    by = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    raw = 1 + F.sum("ret").over(by) if additive else F.product(1 + F.col("ret")).over(by)
    eq = rets.withColumn("_e", raw)
    dead = F.first(F.when(F.col("_e") <= 0, F.col("_e")), ignorenulls=True).over(by)
    eq = eq.withColumn("equity", F.col("_e") if additive else F.coalesce(dead, F.col("_e"))).drop("_e")
    return eq.withColumn("drawdown", F.col("equity") / F.greatest(F.max("equity").over(by), F.lit(1.0)) - 1)


def record(rets: DataFrame, per_year_: float, key: str = "asset", additive: bool = False) -> DataFrame:
    """key, n_bars, total_return, max_dd, sharpe, years, cagr of return series; years are calendar time, one step more than the span."""
    c = curve(rets, key, additive)
    seconds = F.col("ts").cast("timestamp").cast("double")
    got = c.groupBy(key).agg(
        F.count("ret").alias("n_bars"), F.max_by("equity", "ts").alias("_last"), F.min("drawdown").alias("max_dd"), sharpe(F.col("ret"), per_year_).alias("sharpe"), ((F.max(seconds) - F.min(seconds)) / 86400 / YEAR_DAYS).alias("_span")
    )
    years = F.col("_span") * F.col("n_bars") / F.nullif(F.col("n_bars") - 1, F.lit(0))
    cagr = F.when(F.col("_last") > 0, F.pow("_last", 1 / F.nullif(F.col("years"), F.lit(0.0))) - 1).otherwise(F.lit(-1.0))
    return got.withColumn("years", years).select(key, "n_bars", (F.col("_last") - 1).alias("total_return"), "max_dd", "sharpe", "years", cagr.alias("cagr"))


def correlation(a: str, b: str) -> Column:
    """Pearson's, null where a series is flat (the built-in raises there)."""
    return F.try_divide(F.covar_samp(a, b), F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))


def moments(rets: DataFrame, key: str | list[str] = "asset") -> DataFrame:
    """n, Sharpe a bar, biased skewness and kurtosis (3 for a normal)."""
    return rets.groupBy(*([key] if isinstance(key, str) else key)).agg(
        F.count("ret").alias("n"),
        (F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0))).alias("sharpe_bar"),
        F.skewness("ret").alias("skew"),
        (F.kurtosis("ret") + 3).alias("kurt"),
    )


def sharpe_z(benchmark: float = 0.0) -> Column:
    """Argument of the normal distribution in the probabilistic Sharpe ratio, from ``moments``."""
    s = F.col("sharpe_bar")
    return (s - benchmark) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("skew") * s + (F.col("kurt") - 1) / 4 * s * s)


def block_stats(rets: DataFrame, blocks: int, key: str | list[str] = "asset", order: str = "ts") -> DataFrame:
    """Count, sum and sum of squares for each of ``blocks`` equal stretches: mergeable statistics for cross-validation."""
    keys = [key] if isinstance(key, str) else key
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    put = rets.withColumn("block", F.floor(nth * blocks / n).cast("int"))
    return put.groupBy(*keys, "block").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("s2"))


def correlations(rets: DataFrame, key: str = "asset") -> DataFrame:
    """a < b, n, corr, cov of each pair of series on shared stamps. Stamps meet on their key; series are few."""
    a, b = (rets.select("ts", F.col(key).alias(x), F.col("ret").alias(f"r{x}")) for x in "ab")
    return a.join(b, "ts").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), correlation("ra", "rb").alias("corr"), F.covar_samp("ra", "rb").alias("cov"))


def against(rets: DataFrame, benchmark: str, key: str = "asset") -> DataFrame:
    """Beta and correlation of each series with one of them, whose missing stamps count 0."""
    base = rets.filter(F.col(key) == benchmark).select("ts", F.col("ret").alias("base"))
    both = rets.filter(F.col(key) != benchmark).join(base, "ts", "left").withColumn("base", F.coalesce("base", F.lit(0.0)))
    return both.groupBy(key).agg(F.try_divide(F.covar_samp("ret", "base"), F.nullif(F.var_samp("base"), F.lit(0.0))).alias("beta"), correlation("ret", "base").alias("corr"))


def aligned(rets: DataFrame, key: str = "asset") -> DataFrame:
    """The rows at stamps that every series has, missing returns as 0."""
    n = rets.select(key).distinct().agg(F.count(F.lit(1)).alias("_n"))
    shared = rets.groupBy("ts").agg(F.count_distinct(key).alias("_c")).join(F.broadcast(n), F.col("_c") == F.col("_n")).select("ts")
    return rets.join(shared, "ts", "left_semi").withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def added(*parts: DataFrame) -> DataFrame:
    """ts, ret: returns of several blocks added stamp by stamp; a block without a stamp counts 0 there."""
    from functools import reduce

    return reduce(DataFrame.unionByName, (p.select("ts", "ret") for p in parts)).groupBy("ts").agg(F.sum("ret").alias("ret"))


def verified(stored: DataFrame, again: DataFrame, keys: tuple[str, ...] = ("ts",), tolerance: float = 1e-12) -> DataFrame:
    """One row: n, missing, worst, ok; whether returns made again are the stored ones, to ``tolerance``."""
    both = stored.join(again.withColumnRenamed("ret", "_again"), list(keys), "full_outer")
    off = F.max(F.abs(F.col("ret") - F.col("_again")))
    got = both.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("ret").isNull() | F.col("_again").isNull()).cast("long")).alias("missing"), F.coalesce(off, F.lit(0.0)).alias("worst"))
    return got.withColumn("ok", (F.coalesce("missing", F.lit(0)) == 0) & (F.col("worst") <= tolerance))


def closed_after_ruin(rets: DataFrame, key: str = "asset") -> DataFrame:
    """The returns with every one after a curve first reaches 0 or less set to 0: the account is closed."""
    by = Window.partitionBy(key).orderBy("ts")
    marked = rets.withColumn("_d", (F.product(1 + F.col("ret")).over(by.rowsBetween(Window.unboundedPreceding, 0)) <= 0).cast("int"))
    before = F.coalesce(F.max("_d").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("ret", F.when(before == 1, F.lit(0.0)).otherwise(F.col("ret"))).drop("_d")


def benchmark_returns(bars: DataFrame, point_value: float = 1.0, equity: float = 100_000.0, margin: float = 0.0) -> DataFrame:
    """asset, ts, kind, ret: holding the asset, or for one with a margin or with prices at 0 or below one unit on the equity."""
    by = Window.partitionBy("asset").orderBy("ts")
    low = F.min("low").over(Window.partitionBy("asset"))
    held = F.lit(not margin > 0) & (low > 0)
    step = F.col("close") - F.lag("close").over(by)
    ret = F.when(held, step / F.nullif(F.lag("close").over(by), F.lit(0.0))).otherwise(step * point_value / equity)
    return bars.select("asset", "ts", F.when(held, "buy_and_hold").otherwise("one_unit").alias("kind"), ret.alias("ret")).filter("ret IS NOT NULL")


def exposures(bars: DataFrame, trades: DataFrame, curve_: DataFrame, keys: tuple[str, ...] = ("asset", "trial_id"), point_value: float = 1.0, margin: float = 0.0, per_year_: float = 252.0) -> DataFrame:
    """keys, n_bars, held_bars, gross, net, turnover: exposure and change of position over equity, of whole series.

    trades (keys, entry_idx, exit_idx, side, units) cover [entry, exit); curve_ (keys, bar_idx, equity). Units come from their
    changes at the ends of trades, summed in order: no bar is joined with the trades that cover it.
    """
    k = list(keys)
    ends = trades.select(*k, F.col("entry_idx").alias("bar_idx"), (F.col("side") * F.col("units")).alias("d")).unionByName(
        trades.select(*k, F.col("exit_idx").alias("bar_idx"), (-F.col("side") * F.col("units")).alias("d"))
    )
    steps = ends.groupBy(*k, "bar_idx").agg(F.sum("d").alias("d"))
    rows = curve_.select(*k, "bar_idx", "equity").join(bars.select("asset", "bar_idx", "close"), ["asset", "bar_idx"]).join(steps, [*k, "bar_idx"], "left")
    by = Window.partitionBy(*k).orderBy("bar_idx")
    d = F.coalesce("d", F.lit(0.0))
    units = F.round(F.sum(d).over(by.rowsBetween(Window.unboundedPreceding, 0)), 9)
    basis = F.lit(float(margin)) if margin > 0 else F.abs("close") * point_value
    rows = rows.withColumns({"u": units, "moved": F.abs(d) * basis, "one": basis})
    over = lambda c: F.when(F.col("equity") > 0, c / F.col("equity")).otherwise(F.lit(0.0))
    return rows.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_bars"), F.sum((F.col("u") != 0).cast("long")).alias("held_bars"), F.avg(over(F.abs(F.col("u") * F.col("one")))).alias("gross"),
        F.avg(over(F.col("u") * F.col("one"))).alias("net"), (F.avg(over(F.col("moved"))) * per_year_).alias("turnover"),
    )


def breakeven(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, breakeven: the cost at which a return (cost, ret) first falls to 0, between its neighbours; 0 if it starts there, infinite if never."""
    by = Window.partitionBy(*keys).orderBy("cost")
    x0, y0 = F.lag("cost").over(by), F.lag("ret").over(by)
    cross = F.when(F.col("ret") <= 0, F.coalesce(x0 + F.try_divide((F.col("cost") - x0) * y0, y0 - F.col("ret")), F.lit(0.0)))
    marked = rows.withColumn("_x", F.struct(F.col("cost"), cross.alias("at")))
    first = F.min(F.when(F.col("ret") <= 0, F.col("_x")))
    return marked.groupBy(*keys).agg(F.coalesce(first["at"], F.lit(float("inf"))).alias("breakeven"))
