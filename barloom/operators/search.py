"""Templates, parameter lattices, walk-forward windows and plateau selection as tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import metrics, simulation
from barloom.sources import stored

#: The switches of the default family and their short names.
SWITCHES = {
    "direction": ("trend", "countertrend"),
    "channel": ("donchian", "keltner", "bollinger"),
    "entry": ("stop", "close_confirm", "pullback", "stance"),
    "exit": ("channel", "atr_trail", "target_stop", "time_stop"),
    "regime_filter": ("none", "trend_only", "range_only"),
    "regime_indicator": ("er", "adx", "cti"),
}


def templates(spark: SparkSession, switches: dict[str, tuple[str, ...]] = SWITCHES) -> DataFrame:
    """All combinations, with switches that have no effect put to one value, once each."""
    rows = reduce(lambda d, kv: d.withColumn(kv[0], F.explode(F.array(*map(F.lit, kv[1])))), switches.items(), spark.range(1).drop("id"))
    rows = rows.withColumn("regime_indicator", F.when(F.col("regime_filter") == "none", F.lit("er")).otherwise(F.col("regime_indicator")))
    rows = rows.withColumn("exit", F.when(F.col("entry") == "stance", F.lit("channel")).otherwise(F.col("exit")))
    return rows.dropDuplicates(list(switches)).withColumn("template_id", F.concat_ws("|", *switches))


def lattice(spark: SparkSession, grid: dict[str, list[float]]) -> DataFrame:
    """trial_id, params, coord of each point of a parameter grid."""
    rows = spark.range(1).select(F.array().cast("array<int>").alias("coord"), F.expr("map()").cast("map<string,double>").alias("params"))
    for name, values in grid.items():
        rows = rows.select("*", F.posexplode(F.array(*map(F.lit, map(float, values)))).alias("i", "v")).select(
            F.concat("coord", F.array(F.col("i").cast("int"))).alias("coord"), F.map_concat("params", F.create_map(F.lit(name), "v")).alias("params")
        )
    sizes = [len(v) for v in grid.values()]
    weights = [reduce(lambda a, b: a * b, sizes[k + 1 :], 1) for k in range(len(sizes))]
    return rows.withColumn("trial_id", sum((F.get("coord", F.lit(k)) * w for k, w in enumerate(weights)), F.lit(0)).cast("int"))


def windows(bars: DataFrame, train: int, test: int, embargo: int = 0, anchored: bool = False, least_test: int = 20) -> DataFrame:
    """asset, window_id, train_start, train_end, test_start, test_end (ends open) of the tests of ``least_test`` bars or more.

    ``embargo`` bars lie between training and test; an anchored training starts at the first bar.
    """
    room = train + embargo + min(least_test, test)
    n = bars.groupBy("asset").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= room)
    last = F.floor((F.col("n") - room) / test).cast("long")
    rows = n.select("asset", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("window_id"))
    start = F.col("window_id") * test
    tested = start + train + embargo
    return rows.select(
        "asset", "window_id", (F.lit(0).cast("long") if anchored else start).alias("train_start"), (start + train).alias("train_end"),
        tested.alias("test_start"), F.least(tested + test, F.col("n")).alias("test_end"),
    )


def _settled(alpha: Column) -> Column:
    """Bars until a recursive mean has forgotten its first value to 1e-4."""
    return F.ceil(F.log(F.lit(1e-4)) / F.log1p(-alpha))


def warmup(plans: DataFrame) -> Column:
    """Bars before the first on which a plan can trade with values that a full history would show."""
    p = lambda name: F.col(name) if name in plans.columns else F.lit(simulation.PLAN[name])
    keltner, channel = p("channel") == "keltner", p("exit") == "channel"
    own = F.lit(0)
    for name, (n, _) in simulation.REGIMES.items():
        own = F.when(p("regime_indicator") == name, F.lit(n)).otherwise(own)
    length = F.when(p("regime_n") > 0, p("regime_n")).otherwise(own)
    alpha = lambda n: 2.0 / (n + 1)
    regime = F.when(p("regime_indicator") == "adx", length + 2 * _settled(1.0 / length)).otherwise(length + 10)
    parts = [
        p("n_entry"), p("atr_n"), F.when(keltner, _settled(alpha(p("n_entry")))), F.when(channel, p("n_exit")),
        F.when(channel & keltner, _settled(alpha(p("n_exit")))), F.when(p("regime_filter") != "none", regime),
        F.when(p("vol_filter"), p("vol_lookback") + p("atr_n")), F.when(p("vol_target") > 0, p("vol_target_n") + 1), F.when(p("bias_filter") == "sma", p("bias_n")),
    ]
    return (F.greatest(*(x.cast("long") for x in parts)) + 5).cast("long")


def soft_cap(x: Column, cap: float = 10.0) -> Column:
    """``x``, growing only with its logarithm beyond ``cap``."""
    return F.when(x > cap, cap + F.log1p(F.least(x, F.lit(1e6)) - cap)).otherwise(x)


def score(metric: str, least_trades: int = 5) -> Column:
    """Objective of a trial's totals; null with fewer trades."""
    value = {
        "sharpe": F.col("sharpe"),
        "return_over_dd": soft_cap(F.col("total_return") / F.greatest(F.abs("max_dd"), F.when(F.col("max_dd") == 0, F.lit(1e-6)).otherwise(F.lit(0.0)))),
        "profit_factor": soft_cap(F.when(F.col("loss") > 0, F.col("gain") / F.col("loss")).when(F.col("gain") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))),
    }[metric]
    return F.when(F.col("n_trades") >= least_trades, value)


def optimized(bars: DataFrame, plans: DataFrame, spans: DataFrame, dims: int, metric: str = "sharpe", selection: str = "plateau", least_trades: int = 5, account: simulation.Account = simulation.Account()) -> DataFrame:
    """asset, window_id and totals of the trial picked for each training span (asset, window_id, start, stop), and template where plans have it.

    plans: trial_id, coord (a point of a lattice) and plan columns. A span is scored from the bar on which every trial is warm;
    one that ends before has no row, nor has one in which no trial traded enough.
    """
    warm = plans.agg(F.max(warmup(plans)).alias("w")).first()["w"] or 0
    usable = spans.withColumn("start", F.greatest(F.col("start"), F.lit(warm))).filter(F.col("stop") - 1 > warm)
    totals = simulation.windowed(bars, usable, plans.drop("coord", "template"), warm, "totals", account).withColumn("score", score(metric, least_trades))
    keys = ["asset", "window_id", *(["template"] if "template" in plans.columns else [])]
    scored = totals.join(F.broadcast(plans.select("trial_id", "coord", *keys[2:])), "trial_id")
    if selection == "best":
        best = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("score"), "trial_id")
        return scored.withColumn("_n", F.row_number().over(best)).filter("_n = 1 AND score IS NOT NULL").drop("_n", "coord")
    return plateau(scored, keys, dims).filter("picked").drop("picked", "smooth", "coord")


def _values(totals: pd.DataFrame, metric: str, least_trades: int) -> np.ndarray:
    """``score`` of a local frame of totals; NaN where it is null."""
    capped = lambda x: np.where(x > 10.0, 10.0 + np.log1p(np.minimum(x, 1e6) - 10.0), x)
    with np.errstate(divide="ignore", invalid="ignore"):
        if metric == "sharpe":
            value = totals["sharpe"].to_numpy(float)
        elif metric == "return_over_dd":
            drop = totals["max_dd"].abs().to_numpy(float)
            value = capped(totals["total_return"].to_numpy(float) / np.where(drop == 0, 1e-6, drop))
        else:
            gain, loss = totals["gain"].to_numpy(float), totals["loss"].to_numpy(float)
            value = capped(np.where(loss > 0, gain / np.where(loss > 0, loss, 1), np.where(gain > 0, np.inf, 0.0)))
    return np.where(totals["n_trades"].to_numpy(int) >= least_trades, value, np.nan)


def pick(scores: np.ndarray, coords: np.ndarray, ids: np.ndarray, selection: str = "plateau") -> int | None:
    """Place of the trial that ``plateau`` or "best" picks from the scores of one lattice; None if no trial has a score."""
    known = np.flatnonzero(~np.isnan(scores))
    if not len(known):
        return None
    value = scores.copy()
    if selection == "plateau":
        grid = np.full(coords.max(axis=0) + 3, np.nan)  # a border of missing cells
        grid[tuple((coords + 1).T)] = scores
        total, count = np.zeros(len(scores)), np.zeros(len(scores))
        for shift in np.ndindex(*(3,) * coords.shape[1]):
            near = grid[tuple((coords + np.array(shift)).T)]
            total, count = total + np.nan_to_num(near), count + ~np.isnan(near)
        missing = 0.5 * (np.minimum(3, coords.max(axis=0) + 1).prod() - count)
        value = np.where(np.isnan(scores), np.nan, (total + missing * np.nanmedian(scores)) / (count + missing))
    return int(min(known, key=lambda k: (-value[k], -scores[k], ids[k])))


def _carried(bars: DataFrame, plans: DataFrame, wins: DataFrame, warm: int, metric: str, selection: str, least_trades: int, account: simulation.Account) -> DataFrame:
    """asset, template, window_id, trial_id, capital of an account in whole units: a window's sizes, and so its pick, follow from what the last one left.

    Only the windows of one asset and template follow each other; those pairs are the groups. The plan table goes to every
    task: it is a lattice of each template.
    """
    local = plans.withColumn("template", F.col("template") if "template" in plans.columns else F.lit("")).toPandas().sort_values("trial_id")
    names = sorted(local["template"].unique())
    spread = lambda d: d.withColumn("template", F.explode(F.array(*map(F.lit, names))))
    left = spread(bars.select("asset", *simulation._bar_columns(bars)))
    right = spread(wins.select(F.col("asset").alias("_a"), "window_id", "train_start", "train_end", "test_start", "test_end")).withColumnRenamed("template", "_t")

    def run(key: tuple, b: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        b, own = b.sort_values("bar_idx").reset_index(drop=True), local[local["template"] == key[1]]
        ids, coords, capital, rows = own["trial_id"].to_numpy(int), np.array(own["coord"].tolist()), account.equity, []

        def totals(p: pd.DataFrame, start: int, stop: int) -> pd.DataFrame:
            low = max(0, start - warm)
            got = simulation.simulate(b.iloc[low:stop].reset_index(drop=True), p.assign(capital=capital), account, start - low)
            return simulation._totals(got, account, start - low, p["trial_id"].to_numpy(int))

        for x in w.sort_values("window_id").to_dict("records"):
            place = None
            if capital > 0 and x["train_end"] - 1 > warm:
                trained = totals(own, max(x["train_start"], warm), x["train_end"])
                place = pick(_values(trained, metric, least_trades), coords, ids, selection)
            rows.append((x["window_id"], None if place is None else int(ids[place]), capital))
            if place is not None:
                capital = float(totals(own.iloc[[place]], x["test_start"], x["test_end"])["final"].iloc[0])
        out = pd.DataFrame(rows, columns=["window_id", "trial_id", "capital"]).astype({"trial_id": "Int32"})
        return out.assign(asset=key[0], template=key[1])

    kernel, schema = simulation._arrow("asset string, template string, window_id long, trial_id int, capital double", run)
    return left.groupBy("asset", "template").cogroup(right.groupBy("_a", "_t")).applyInArrow(kernel, schema)


def _elapsed(wins: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """asset, window_id, is_years, oos_years: calendar time of the spans, one step more than from their first bar to their last."""
    if "ts" not in bars.columns:
        return wins.select("asset", "window_id").withColumns({"is_years": F.lit(None).cast("double"), "oos_years": F.lit(None).cast("double")}).distinct()
    ends = {"is": ("train_start", "train_end"), "oos": ("test_start", "test_end")}
    marks = [F.struct(F.lit(p).alias("part"), x.alias("bar_idx")) for p, (a, b) in ends.items() for x in (F.col(a), F.col(b) - 1)]
    edges = wins.select("asset", "window_id", F.explode(F.array(*marks)).alias("_m")).select("asset", "window_id", "_m.part", "_m.bar_idx")
    second = F.col("ts").cast("timestamp").cast("double")
    met = edges.join(bars.select("asset", "bar_idx", second.alias("_s")), ["asset", "bar_idx"])
    span = (F.max("_s") - F.min("_s")) / 86400 / metrics.YEAR_DAYS
    n = F.max("bar_idx") - F.min("bar_idx") + 1
    per = met.groupBy("asset", "window_id", "part").agg((span * n / F.nullif(n - 1, F.lit(0))).alias("years"))
    of = lambda p: F.max(F.when(F.col("part") == p, F.col("years"))).alias(f"{p}_years")
    return per.groupBy("asset", "window_id").agg(of("is"), of("oos"))


def walked(bars: DataFrame, plans: DataFrame, dims: int, train: int = 500, test: int = 125, embargo: int = 0, anchored: bool = False, metric: str = "sharpe", selection: str = "plateau", least_trades: int = 5, account: simulation.Account = simulation.Account(), least_test: int = 20) -> tuple[DataFrame, DataFrame]:
    """Parameters picked on each training span and traded on the test after it, as one account: (windows, returns of every tested bar).

    Windows: asset, template (where plans have it), window_id, bounds, trial_id (null where nothing was picked), initial_equity,
    ruined, and totals of training (is_) and test (oos_). An account at or below 0 is closed: later windows are flat and keep
    what was left. Sizes are shares of the capital, so without whole units no return depends on it: windows are picked and
    traded in parallel, and the account is their running product. With whole units an asset's windows follow each other.
    Returns: asset, template, window_id, bar_idx, ret, 0 in windows without a pick and after a ruin.
    """
    wins = windows(bars, train, test, embargo, anchored, least_test)
    warm = plans.agg(F.max(warmup(plans)).alias("w")).first()["w"] or 0
    own = ["template"] if "template" in plans.columns else []
    keys = ["asset", *own, "window_id"]
    spans = lambda d, a, b: d.select("asset", "window_id", F.col(a).alias("start"), F.col(b).alias("stop"))
    trained = wins.withColumn("train_start", F.greatest("train_start", F.least(F.lit(warm), F.col("train_end") - 2)))
    params = F.broadcast(plans.drop("coord", "template"))
    every = wins.join(F.broadcast(plans.select("template").distinct())) if own else wins
    traded = lambda chosen, where, output: simulation.windowed(bars, where, chosen.join(params, "trial_id"), warm, output, account)
    if account.whole_units:
        made = _carried(bars, plans, wins, warm, metric, selection, least_trades, account)
        made = stored.kept(made if own else made.drop("template"))
        chosen = made.filter("trial_id IS NOT NULL")
        named = plans.select("trial_id", *own)
        inside = traded(chosen.drop("template"), spans(trained, "train_start", "train_end"), "totals").join(F.broadcast(named), "trial_id")
        held = made.select(*keys, F.col("capital").alias("initial_equity"))
        chosen = chosen.select(*keys, "trial_id", "capital")
    else:
        inside = stored.kept(optimized(bars, plans, spans(wins, "train_start", "train_end"), dims, metric, selection, least_trades, account))
        chosen, held = inside.select(*keys, "trial_id"), None
    tests = spans(wins, "test_start", "test_end")
    outside = traded(chosen.drop("template"), tests, "totals").join(F.broadcast(plans.select("trial_id", *own)), "trial_id")
    fields = ("total_return", "sharpe", "max_dd", "n_trades", "n_bars", "held", "gross", "net")
    side = lambda d, p: d.select(*keys, *([F.col("trial_id")] if p == "is_" else []), *(F.col(c).alias(p + c) for c in (fields if p == "oos_" else fields[:5])))
    table = every.join(side(inside, "is_"), keys, "left").join(side(outside, "oos_"), keys, "left").join(_elapsed(trained, bars, keys), ["asset", "window_id"], "left")
    by = Window.partitionBy("asset", *own).orderBy("window_id")
    if account.fixed:
        table = table.withColumns({"initial_equity": F.lit(float(account.equity)), "ruined": F.lit(False)})
    elif held is not None:
        table = table.join(held, keys, "left").withColumn("ruined", F.col("initial_equity") <= 0)
    else:
        grown = account.equity * F.product(1 + F.coalesce("oos_total_return", F.lit(0.0))).over(by.rowsBetween(Window.unboundedPreceding, -1))
        table = table.withColumn("_e", F.coalesce(grown, F.lit(float(account.equity))))
        left = F.first(F.when(F.col("_e") <= 0, F.col("_e")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
        table = table.withColumn("initial_equity", F.coalesce(left, F.col("_e"))).withColumn("ruined", left.isNotNull()).drop("_e")
    told = [c for c in table.columns if c.startswith(("is_", "oos_")) and not c.endswith("_years")] + ["trial_id"]
    table = stored.kept(table.select(*(F.when(~F.col("ruined"), F.col(c)).alias(c) if c in told else F.col(c) for c in table.columns)))
    rets = traded(chosen.drop("template"), tests, "bars").join(F.broadcast(plans.select("trial_id", *own)), "trial_id").select(*keys, "bar_idx", "ret")
    bars_ = table.select(*keys, "ruined", F.explode(F.sequence("test_start", F.col("test_end") - 1)).alias("bar_idx"))
    ret = F.when(F.col("ruined"), F.lit(0.0)).otherwise(F.coalesce("ret", F.lit(0.0)))
    return table, bars_.join(rets, [*keys, "bar_idx"], "left").select(*keys, "bar_idx", ret.alias("ret"))


def walk_forward(bars: DataFrame, plans: DataFrame, dims: int, train: int = 500, test: int = 125, output: str = "windows", **how) -> DataFrame:
    """One of the tables of ``walked``: "windows" or "bars"."""
    return walked(bars, plans, dims, train, test, **how)[output == "bars"]


def summary(wins: DataFrame, rets: DataFrame, per_year: float = 252.0) -> DataFrame:
    """One row an asset (and template): the record of its tested windows, with Pardo's efficiency and criteria.

    Efficiency is the mean annual return of tests over that of trainings, null without a profit in training, within +-10; years
    are calendar time where windows have it, else bars over ``per_year``. A window without a pick made no money and counts, in
    the exposures too, which are over all tested bars.
    """
    own = ["asset", *(["template"] if "template" in wins.columns else [])]
    live = F.col("trial_id").isNotNull()
    by = Window.partitionBy(*own).orderBy("window_id")
    before = F.last("trial_id", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = wins.withColumn("changed", F.when(live & before.isNotNull(), (F.col("trial_id") != before).cast("double")))
    years = lambda p: F.when(F.col(f"{p}_years") > 0, F.col(f"{p}_years")).otherwise(F.col(f"{p}_n_bars") / per_year)
    annual = lambda p: F.col(f"{p}_total_return") / years(p)
    over = lambda c: F.coalesce(F.sum(F.col(f"oos_{c}") * (F.col("oos_n_bars") if c != "held" else 1)), F.lit(0.0))
    per = rows.groupBy(*own).agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum(live.cast("long")).alias("n_live"), F.avg("is_sharpe").alias("is_sharpe"),
        F.avg(annual("is")).alias("_i"), F.avg(annual("oos")).alias("_o"), F.coalesce(F.sum("oos_n_trades"), F.lit(0)).alias("n_trades"),
        (F.sum(F.coalesce((F.col("oos_total_return") > 0).cast("long"), F.lit(0))) / F.count(F.lit(1))).alias("pct_profitable"),
        F.coalesce(F.avg("changed"), F.lit(0.0)).alias("change_rate"), over("held").alias("_h"), over("gross").alias("_g"), over("net").alias("_n"),
        F.sum("oos_years").alias("years"), F.max(F.col("ruined").cast("int")).cast("boolean").alias("ruined"),
    )
    series = rets.withColumn("_k", F.struct(*own)).withColumnRenamed("bar_idx", "ts")
    ends = metrics.curve(series, "_k").groupBy("_k").agg(
        metrics.sharpe(F.col("ret"), per_year).alias("oos_sharpe"), (F.max_by("equity", "ts") - 1).alias("oos_total"), F.min("drawdown").alias("oos_max_dd"), F.count(F.lit(1)).alias("n_bars")
    )
    wfe = F.when(F.col("_i") > 0, F.least(F.greatest(F.col("_o") / F.col("_i"), F.lit(-10.0)), F.lit(10.0)))
    out = per.join(ends.select("_k.*", "oos_sharpe", "oos_total", "oos_max_dd", "n_bars"), own).withColumn("wfe", wfe)
    end = 1 + F.col("oos_total")
    out = out.withColumns({
        "oos_cagr": F.when(end > 0, F.pow(end, 1 / F.coalesce(F.nullif(F.col("years"), F.lit(0.0)), F.col("n_bars") / per_year)) - 1).otherwise(F.lit(-1.0)),
        "oos_is_sharpe_ratio": F.when(F.col("is_sharpe") > 0, F.col("oos_sharpe") / F.col("is_sharpe")),
        "oos_exposure": F.col("_h") / F.col("n_bars"), "oos_notional": F.col("_g") / F.col("n_bars"), "oos_net_exposure": F.col("_n") / F.col("n_bars"),
    })
    passed = (F.col("n_live") >= 3) & (F.col("oos_total") > 0) & (F.col("pct_profitable") >= 0.5) & F.coalesce(F.col("wfe") >= 0.5, F.lit(False))
    return out.withColumn("pardo_pass", passed).drop("_i", "_o", "_h", "_g", "_n", "years")


def in_windows(rows: DataFrame, train: int, test: int) -> DataFrame:
    """Each bar once for every window it trains and the one it tests: window_id and part, by arithmetic, without a range join."""
    i = F.col("bar_idx")
    tested = F.when(i >= train, F.floor((i - train) / test)).cast("long")
    low = F.greatest(F.lit(0).cast("long"), F.floor((i - train) / test).cast("long") + 1)
    trained = F.sequence(low, F.floor(i / test).cast("long"))
    both = F.concat(
        F.transform(trained, lambda w: F.struct(w.alias("window_id"), F.lit("train").alias("part"))),
        F.when(tested.isNotNull(), F.array(F.struct(tested.alias("window_id"), F.lit("test").alias("part")))).otherwise(F.array().cast("array<struct<window_id:bigint,part:string>>")),
    )
    return rows.withColumn("_w", F.explode(both)).select(*rows.columns, "_w.window_id", "_w.part")


def plateau(scores: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """Mean of each score and its lattice neighbours (|difference| <= 1 in each dimension), and the best point of each group.

    Each point is sent to its at most 3 ** dims neighbour cells within the lattice, so points meet by equality and a dimension of
    one value costs nothing. A neighbour that is missing, beyond
    the lattice's edge or without a score, counts as the group's median at half weight; points without a score get none.
    """
    last = F.array(*(F.max(F.get("coord", F.lit(k))) for k in range(dims)))
    mid = scores.groupBy(*keys).agg(F.median("score").alias("_mid"), last.alias("_last"))
    room = reduce(lambda a, b: a * b, (F.least(F.lit(3), F.get("_last", F.lit(k)) + 1) for k in range(dims)), F.lit(1))
    mid = mid.withColumn("_room", room.cast("double"))
    cells = scores.filter("score IS NOT NULL").join(mid.select(*keys, "_last"), keys).select(*keys, "_last", F.col("score").alias("_s"), F.col("coord").alias("_c"))
    for k in range(dims):
        own = F.get("_c", F.lit(k))
        near = F.sequence(F.greatest(own - 1, F.lit(0)), F.least(own + 1, F.get("_last", F.lit(k))))
        cells = cells.withColumn("_d", F.explode(near)).withColumn("_c", F.array(*(F.col("_d") if i == k else F.get("_c", F.lit(i)) for i in range(dims))))
    near = cells.groupBy(*keys, F.col("_c").alias("coord")).agg(F.sum("_s").alias("_t"), F.count(F.lit(1)).alias("_n"))
    missing = 0.5 * (F.col("_room") - F.col("_n"))
    smooth = F.when(F.col("score").isNotNull(), (F.col("_t") + missing * F.col("_mid")) / (F.col("_n") + missing))
    rows = scores.join(near, [*keys, "coord"], "left").join(mid, keys).withColumn("smooth", smooth)
    best = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("smooth"), F.desc_nulls_last("score"), "trial_id")
    picked = (F.row_number().over(best) == 1) & F.col("smooth").isNotNull()
    return rows.withColumn("picked", picked).select(*scores.columns, "smooth", "picked")


def matrix(bars: DataFrame, plans: DataFrame, dims: int, trains: tuple[int, ...] = (250, 375, 500, 750), tests: tuple[int, ...] = (63, 125, 250), **how) -> DataFrame:
    """train, test and the summary of each asset for every pair of lengths that fits the longest series."""
    longest = bars.groupBy("asset").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    cells = [(a, b) for a in trains for b in tests if a + b < longest]
    each = [summary(*walked(bars, plans, dims, a, b, **how)).withColumns({"train": F.lit(a), "test": F.lit(b)}) for a, b in cells]  # a dozen cells at most
    return reduce(DataFrame.unionByName, each) if each else summary(*walked(bars.limit(0), plans, dims)).withColumns({"train": F.lit(0), "test": F.lit(0)})


def cost_sweep(bars: DataFrame, plans: DataFrame, dims: int, train: int = 500, test: int = 125, costs: tuple[float, ...] = (0.0, 2.0, 5.0, 10.0, 20.0), account: simulation.Account = simulation.Account(), **how) -> DataFrame:
    """asset, cost and the summary of a whole walk-forward at every cost, parameters picked anew under each.

    ``costs`` are basis points a side; for an account with costs a unit they multiply its costs and roll costs instead.
    """
    priced = account.cost_per_unit > 0 or account.roll_cost > 0
    at = lambda c: replace(account, cost_per_unit=account.cost_per_unit * c, roll_cost=account.roll_cost * c) if priced else replace(account, cost_rate=c / 1e4)
    runs = [summary(*walked(bars, plans, dims, train, test, account=at(c), **how)).withColumn("cost", F.lit(float(c))) for c in costs]  # a handful
    return reduce(DataFrame.unionByName, runs)


def cost_totals(bars: DataFrame, plans: DataFrame, costs: tuple[float, ...] = (0.0, 2.0, 5.0, 10.0, 20.0), account: simulation.Account = simulation.Account()) -> DataFrame:
    """asset, trial_id, cost (basis points a side) and totals of every plan at every cost."""
    runs = [simulation.simulated(bars, plans, "totals", replace(account, cost_rate=c / 1e4)).withColumn("cost", F.lit(float(c))) for c in costs]
    return reduce(DataFrame.unionByName, runs)
