"""How much of a family's results is luck, its finalists, and comparisons of learners on the same bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import backtest, metrics, nested, portfolio, simulation
from barloom.operators.runs import Run

PARTS = 16


def ranked(summary: DataFrame, shown: int = 60, finalists: int = 3) -> DataFrame:
    """The summaries with their rank in the asset by Sharpe of the tests, and whether they are shown and finalists."""
    rank = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc_nulls_last("oos_sharpe"), "template"))
    return summary.withColumn("rank", rank).withColumns({"shown": F.col("rank") <= shown, "finalist": F.col("rank") <= finalists})


def trial_returns(run: Run) -> DataFrame:
    """asset, template, trial_id, bar_idx, ret of every trial over all bars, added up on the starting capital."""
    fixed = simulation.Account(**{**run.account.__dict__, "fixed": True, "whole_units": False})
    rows = simulation.simulated(run.bars, run.plans.drop("coord", "template"), "bars", fixed, run.warm).select("asset", "trial_id", "bar_idx", "ret")
    return rows.join(F.broadcast(run.plans.select("trial_id", "template")), "trial_id")


def family_diagnostics(run: Run, replicates: int = 500, trials: DataFrame | None = None) -> DataFrame:
    """One row an asset: what the whole search over templates and parameters could have found without skill.

    best, n_templates, n_trials, pbo_trials over every trial, pbo_templates over the tested curves, reality_check_p, the best
    curve's Sharpe, its deflated Sharpe with all templates as trials (dsr_raw) and with clusters of alike ones (dsr), n_eff, and
    the years that its Sharpe needs and has.
    """
    year = run.account.per_year
    rets = run.returns.select("asset", "template", F.col("bar_idx").alias("ts"), "ret")
    trials = trial_returns(run) if trials is None else trials
    pbo = lambda rows, keys, order, name: backtest.overfit_summary(
        backtest.overfit_probability(metrics.block_stats(rows, PARTS, keys, order), PARTS, keys[-1], "asset"), year, "asset"
    ).select("asset", F.col("pbo").alias(name))
    moments = metrics.moments(rets, ["asset", "template"])
    raw = backtest.deflated_sharpe(moments, year, "template", "asset")
    counts = run.plans.agg(F.count_distinct("template").alias("n_templates"), F.count(F.lit(1)).alias("n_trials"))
    clusters = portfolio.effective_trials(rets, "template", "asset").groupBy("asset").agg(F.first("n_eff").alias("n_eff"), F.first("var_sharpe").alias("var_sharpe"))
    sizes = sorted({r["n_eff"] for r in clusters.select("n_eff").distinct().collect()})  # numbers of clusters, at most as many as assets
    top = F.lit(0.0)
    for n in sizes:
        top = F.when(F.col("n_eff") == n, F.lit(backtest.expected_max_sharpe(n))).otherwise(top)
    best = raw.join(moments.withColumnRenamed("template", "best").select("asset", "best", "sharpe_bar", "skew", "kurt"), ["asset", "best"]).join(clusters, "asset")
    s, star = F.col("sharpe_bar"), F.sqrt("var_sharpe") * top
    spread = F.sqrt(F.greatest(1 - F.col("skew") * s + (F.col("kurt") - 1) / 4 * s * s, F.lit(1e-12)))
    dsr = backtest.normal_cdf((s - star) * F.sqrt(F.greatest(F.col("n") - 1, F.lit(1)).cast("double")) / spread)
    told = best.select(
        "asset", "best", "sharpe_annual", "psr", F.col("dsr").alias("dsr_raw"), dsr.alias("dsr"), "n_eff", (F.col("n") / year).alias("years"),
        backtest.min_backtest_years(F.col("n_eff"), F.col("sharpe_annual"), year).alias("min_years"),
    )
    luck = backtest.reality_check(rets, replicates, key="template", family="asset").select("asset", F.col("p_value").alias("reality_check_p"))
    parts = [pbo(trials, ["asset", "trial_id"], "bar_idx", "pbo_trials"), pbo(rets, ["asset", "template"], "ts", "pbo_templates"), luck]
    for p in parts:
        told = told.join(p, "asset")
    return told.join(F.broadcast(counts))  # one row


def finalist_paths(run: Run, n_groups: int = 6, n_test: int = 2, embargo: int = 10, finalists: int = 3, trials: DataFrame | None = None) -> DataFrame:
    """asset, template, rank, n_paths, sharpe_mean, sharpe_sd, sharpe_min, prob_negative: what purged paths say of each asset's best templates."""
    top = ranked(run.summary, finalists=finalists).filter("finalist").select("asset", "template", "rank")
    trials = trial_returns(run) if trials is None else trials
    rows = trials.join(F.broadcast(top), ["asset", "template"], "left_semi")
    name = F.concat_ws("|", "asset", "template")
    rets = rows.select(name.alias("slot"), F.concat_ws("|", "asset", "trial_id").alias("trial"), F.col("bar_idx").alias("ts"), "ret")
    paths = backtest.purged_paths(rets, n_groups, n_test, embargo, "trial", family="slot").withColumn("sharpe", F.col("sharpe") * run.account.per_year**0.5)
    told = paths.groupBy("slot").agg(
        F.count(F.lit(1)).alias("n_paths"), F.avg("sharpe").alias("sharpe_mean"), F.stddev_samp("sharpe").alias("sharpe_sd"), F.min("sharpe").alias("sharpe_min"), F.avg((F.col("sharpe") < 0).cast("double")).alias("prob_negative")
    )
    return top.withColumn("slot", name).join(told, "slot").drop("slot")


def verdict_inputs(run: Run, diagnostics: DataFrame, finalists: DataFrame) -> DataFrame:
    """asset and the columns that ``book.verdict`` judges."""
    rets = run.portfolios.filter("target = 'nested'").select("asset", "ret")
    nested_ = rets.groupBy("asset").agg(metrics.sharpe(F.col("ret"), run.account.per_year).alias("nested_sharpe"))
    slots = run.holdings.filter("target = 'static'").groupBy("asset").agg(F.count(F.lit(1)).alias("n_slots"))
    weak = finalists.groupBy("asset").agg(F.sum((F.col("prob_negative") > 0.5).cast("long")).alias("weak_slots"))
    rows = diagnostics.join(nested_, "asset", "left").join(slots, "asset", "left").join(weak, "asset", "left")
    zero = F.lit(0).cast("long")
    return rows.select("asset", F.coalesce("n_slots", zero).alias("n_slots"), F.coalesce("nested_sharpe", F.lit(0.0)).alias("nested_sharpe"), F.col("pbo_trials").alias("pbo"), "reality_check_p", "dsr", "years", "min_years", F.coalesce("weak_slots", zero).alias("weak_slots"))


def committee_returns(bars: DataFrame, positions: DataFrame, cost: float = 0.0005, first: int = 0) -> DataFrame:
    """asset, bar_idx, ret of holding a position (asset, bar_idx, level within 1) read at a close over the next bar, less the cost of its changes."""
    by = Window.partitionBy("asset").orderBy("bar_idx")
    level = F.least(F.greatest(F.coalesce(F.nanvl("level", F.lit(0.0)), F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    rows = bars.select("asset", "bar_idx", "close").join(positions.select("asset", "bar_idx", level.alias("level")), ["asset", "bar_idx"])
    before, close = F.lag("level").over(by), F.lag("close").over(by)
    ret = F.coalesce(before * (F.col("close") / F.nullif(close, F.lit(0.0)) - 1) - cost * F.abs(F.col("level") - before), F.lit(0.0))
    return rows.select("asset", "bar_idx", ret.alias("ret")).filter(F.col("bar_idx") >= first)


def direction_flips(levels: DataFrame, first: int = 0) -> DataFrame:
    """asset, flips: share of bars on which the sign of a direction (asset, bar_idx, level) changes, from bar ``first`` on."""
    by = Window.partitionBy("asset").orderBy("bar_idx")
    sign = levels.filter(F.col("bar_idx") >= first).select("asset", "bar_idx", F.signum("level").alias("s"))
    turned = F.when(F.lag("s").over(by).isNotNull(), (F.col("s") != F.lag("s").over(by)).cast("double"))
    return sign.withColumn("_t", turned).groupBy("asset").agg(F.avg("_t").alias("flips"))


def paired_sharpe(a: DataFrame, b: DataFrame, key: str = "asset", order: str = "bar_idx") -> DataFrame:
    """key, n, sharpe_a, sharpe_b (a bar), t: whether a's Sharpe is larger than b's on the same bars.

    Both are scaled to unit deviation first: a smaller position is not a worse one. A series without spread gives 0.
    """
    both = a.select(key, order, F.col("ret").alias("x")).join(b.select(key, order, F.col("ret").alias("y")), [key, order])
    told = both.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.covar_pop("x", "y").alias("c"))
    ratio = lambda m, s: F.when(F.col(s) > 0, F.col(m) / F.col(s)).otherwise(F.lit(0.0))
    gap = ratio("mx", "sx") - ratio("my", "sy")
    spread = F.sqrt(F.greatest(2 - 2 * F.try_divide(F.col("c"), F.col("sx") * F.col("sy")), F.lit(0.0)))
    t = F.when((F.col("sx") > 0) & (F.col("sy") > 0) & (spread > 1e-12), gap / spread * F.sqrt("n")).otherwise(F.lit(0.0))
    return told.select(key, "n", ratio("mx", "sx").alias("sharpe_a"), ratio("my", "sy").alias("sharpe_b"), t.alias("t"))


def candidate_table(run: Run) -> DataFrame:
    """The ranked summaries with whether each passes the static filter and what of each portfolio it holds."""
    held = run.holdings.groupBy(*nested.KEYS).agg(
        F.max(F.when(F.col("target") == "static", F.col("weight"))).alias("static_weight"), F.count_distinct(F.when(F.col("target") == "nested", F.col("window_id"))).alias("nested_windows")
    )
    passed = nested.candidates(run.summary, nested.LEAST_SHARPE, nested.LEAST_WINDOWS, nested.LEAST_TRADES).select(*nested.KEYS, F.lit(True).alias("qualifies"))
    rows = ranked(run.summary).join(passed, nested.KEYS, "left").join(held, nested.KEYS, "left")
    return rows.withColumns({"qualifies": F.coalesce("qualifies", F.lit(False)), "nested_windows": F.coalesce("nested_windows", F.lit(0).cast("long"))})
