"""Selection as of each boundary, stored runs and their replay."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import nested, runs, search, simulation
from barloom.plans import research
from barloom.sources.synthetic import synthetic_bars

SELECT = {"least_sharpe": -5.0, "least_trades": 0, "least_windows": 0, "most": 2, "ceiling": 0.95}


def templates(spark):
    """Three templates with a small lattice each."""
    points = search.lattice(spark, {"n_entry": [20, 40], "stop_mult": [2.0, 3.0]})
    p = F.col("params")
    base = points.select("trial_id", "coord", p["n_entry"].cast("int").alias("n_entry"), p["stop_mult"].alias("stop_mult"))
    kinds = [("break", "trend", "channel"), ("trail", "trend", "atr_trail"), ("fade", "countertrend", "time_stop")]
    parts = [base.withColumns({"template": F.lit(n), "direction": F.lit(d), "exit": F.lit(e), "trial_id": F.col("trial_id") + 10 * k}) for k, (n, d, e) in enumerate(kinds)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("runs") / "one")
    bars = synthetic_bars(spark, [3, 5], 700)
    return runs.researched(folder, bars, templates(spark), 2, 160, 50, simulation.Account(equity=200_000.0, whole_units=True), SELECT, least_trades=1)


def test_records_know_only_windows_that_ended(run):
    wins, rets = run.windows.toPandas(), run.returns.toPandas()
    got = nested.causal_records(run.windows, run.returns).toPandas().set_index(["asset", "template", "window_id"])
    assert len(got) == len(wins) - wins.groupby(["asset", "template"]).ngroups
    for key, w in wins.groupby(["asset", "template"]):
        w = w.sort_values("window_id")
        own = rets[(rets.asset == key[0]) & (rets.template == key[1])].sort_values("bar_idx")
        for j in w.window_id[1:]:
            r, past, x = got.loc[(*key, j)], w[w.window_id < j], own[own.window_id < j].ret.to_numpy()
            live = past[past.trial_id.notna()]
            curve = np.cumprod(1 + x)
            assert r.n_windows == len(past) and r.n_live == len(live) and r.n_bars == len(x) and r.n_trades == live.oos_n_trades.sum()
            assert r.oos_total == pytest.approx(curve[-1] - 1) and r.oos_max_dd == pytest.approx((curve / np.maximum(1, np.maximum.accumulate(curve)) - 1).min())
            assert r.oos_sharpe == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(252) if x.std() > 0 else 0.0)
            i, o = (live.is_total_return / live.is_years).mean(), (live.oos_total_return / live.oos_years).mean()
            assert (pd.isna(r.wfe) if not i > 0 else r.wfe == pytest.approx(np.clip(o / i, -10, 10)))
            assert r.pct_profitable == pytest.approx((past.oos_total_return > 0).mean())


def picked_by_hand(rets, names, most, ceiling):
    """Templates of a table of returns (a column each) by greedy choice."""
    sharpe = lambda x: x.mean() / x.std(ddof=1) if x.std(ddof=1) > 0 else 0.0
    ranked = sorted(names, key=lambda c: -sharpe(rets[c]))
    corr, taken = rets[names].corr(), ranked[:1]
    while taken and len(taken) < most:
        best, level = None, sharpe(rets[taken].mean(axis=1))
        for c in ranked:
            if c not in taken and all(abs(corr.loc[c, t]) <= ceiling for t in taken) and sharpe(rets[[*taken, c]].mean(axis=1)) > level:
                best, level = c, sharpe(rets[[*taken, c]].mean(axis=1))
        if best is None:
            break
        taken.append(best)
    return taken


def test_nested_portfolio_sees_no_later_bar(run):
    rets = run.returns.toPandas()
    held = run.holdings.filter("target = 'nested'").toPandas()
    assert set(held.window_id) == set(range(4, int(rets.window_id.max()) + 1)) and len(held) > 10
    for (asset, j), part in held.groupby(["asset", "window_id"]):
        own = rets[(rets.asset == asset) & (rets.window_id < j)].pivot(index="bar_idx", columns="template", values="ret")
        want = picked_by_hand(own, list(own.columns), 2, 0.95)
        assert part.sort_values("rank").template.tolist() == want and part.weight.tolist() == [1 / len(want)] * len(want)
    earned = run.portfolios.filter("target = 'nested'").toPandas().set_index(["asset", "bar_idx"]).ret
    both = rets.merge(held, on=["asset", "template", "window_id"]).assign(x=lambda d: d.ret * d.weight).groupby(["asset", "bar_idx"]).x.sum()
    assert np.allclose(earned.sort_index(), both.sort_index())
    # returns after a boundary have no part in its choice
    later = run.returns.withColumn("ret", F.when(F.col("window_id") >= 6, -F.col("ret") * 3).otherwise(F.col("ret")))
    again = nested.nested_portfolio(run.windows, later, **SELECT).filter("window_id <= 6").toPandas()
    key = ["asset", "window_id", "template"]
    assert again.sort_values(key)[key].values.tolist() == held[held.window_id <= 6].sort_values(key)[key].values.tolist()


def test_filters_apply_as_of_the_boundary(run):
    known = nested.causal_records(run.windows, run.returns).toPandas()
    least = int(known.n_trades.median())
    got = nested.nested_portfolio(run.windows, run.returns, least_sharpe=-5.0, least_trades=least, most=3, ceiling=1.0, weighting="hrp").toPandas()
    ok = known[(known.n_trades >= least) & (known.n_windows >= 4)].set_index(["asset", "window_id", "template"]).index
    assert len(got) and all(k in ok for k in got.set_index(["asset", "window_id", "template"]).index)
    assert np.allclose(got.groupby(["asset", "window_id"]).weight.sum(), 1.0)
    assert nested.nested_portfolio(run.windows, run.returns, least_sharpe=99.0).count() == 0


@pytest.mark.parametrize("target", runs.TARGETS)
def test_replay_is_what_was_stored(spark, run, target):
    got = runs.verification(runs.load_run(spark, run.folder), target).first()
    assert got["ok"] and got["missing"] == 0 and got["worst"] <= 1e-12 and got["n"] > 200 and got["n_windows"] > 5 and got["n_windows_off"] == 0
    trades = runs.replayed(run, runs.needed(run, target), "all_trades").toPandas()
    ended = trades[trades.closed]
    assert len(ended) > 10 and set(trades.reason[~trades.closed]) <= {"open_at_window_end"} and (trades.units % 1 == 0).all()
    spans = run.windows.toPandas().drop_duplicates(["asset", "window_id"]).set_index(["asset", "window_id"])
    bounds = spans.loc[list(zip(trades.asset, trades.window_id, strict=True))]
    assert (trades.entry_idx.to_numpy() >= bounds.test_start.to_numpy()).all() and (ended.exit_idx.to_numpy() < spans.loc[list(zip(ended.asset, ended.window_id, strict=True))].test_end.to_numpy()).all()


def test_replay_tells_a_changed_store(spark, run):
    changed = runs.load_run(spark, run.folder)
    changed.tables["portfolios"] = run.portfolios.withColumn("ret", F.col("ret") + F.when(F.col("bar_idx") == 400, 1e-9).otherwise(0.0))
    assert not runs.verification(changed, "nested").first()["ok"]
    changed.tables["windows"] = run.windows.withColumn("oos_n_trades", F.col("oos_n_trades") + (F.col("window_id") == 5).cast("long"))
    assert runs.verification(changed, "best").first()["n_windows_off"] > 0
    lives = runs.order_lives(run, "nested").toPandas()
    assert len(lives) > 50 and lives.groupby("asset").first_bar.apply(lambda s: s.is_monotonic_increasing).all()
    other = runs.needed(run, "best", "fade").toPandas()
    assert set(other.template) == {"fade"} and runs.verification(run, "best", "fade").first()["ok"]
    with pytest.raises(ValueError, match="no target"):
        runs.needed(run, "other")


def test_runs_of_another_version_are_refused(spark, run, tmp_path):
    old = spark.createDataFrame([(0, 1, "{}", "{}", 0, 0)], runs.MANIFEST)
    old.write.parquet(str(tmp_path / "old" / "manifest"))
    with pytest.raises(ValueError, match="schema version"):
        runs.load_run(spark, str(tmp_path / "old"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        runs.researched(run.folder, run.bars, run.plans, 2)


def test_signals_are_the_walk_forward_window(spark, run):
    """A slot fitted where a window's training ended stands where that window's test stands."""
    from barloom.operators import signals

    wins = run.windows.filter("trial_id IS NOT NULL AND NOT ruined AND window_id = 6").toPandas()
    slots = spark.createDataFrame([(r.asset, r.template, 0.5, int(r.trial_id), int(r.train_end) - 1) for r in wins.itertuples()], "asset string, template string, weight double, trial_id int, fitted_idx long")
    account = simulation.Account(equity=200_000.0)
    seen = run.bars.filter("bar_idx < 500")
    states = signals.slot_states(seen, run.plans, slots, run.warm, 100_000.0, account).toPandas()
    orders = signals.slot_orders(seen, run.plans, slots, run.warm, 100_000.0, account).toPandas()
    plans = run.plans.toPandas().set_index("trial_id", drop=False)
    assert len(states) == len(wins) > 3 and (states.weight == 0.5).all()
    for r in wins.itertuples():
        local = seen.filter(F.col("asset") == r.asset).orderBy("bar_idx").toPandas()
        low = r.train_end - run.warm
        plan = plans.loc[[r.trial_id]].assign(capital=50_000.0)
        got = states[(states.asset == r.asset) & (states.template == r.template)].iloc[0]
        want = simulation._run_group("states", local.iloc[low:].reset_index(drop=True), plan.reset_index(drop=True), account, run.warm).iloc[0]
        assert got.position == want.position and got.equity == want.equity and (got.stop == want.stop or pd.isna(want.stop))
        own = orders[(orders.asset == r.asset) & (orders.template == r.template)][["kind", "side", "level", "shares"]].sort_values(["kind", "side"]).reset_index(drop=True)
        want = simulation._run_group("next_orders", local.iloc[low:].reset_index(drop=True), plan.reset_index(drop=True), account, run.warm)[["kind", "side", "level", "shares"]]
        pd.testing.assert_frame_equal(own, want.sort_values(["kind", "side"]).reset_index(drop=True), check_dtype=False)
    book = signals.slot_book(seen, signals.slot_states(seen, run.plans, slots, run.warm, 100_000.0, account), spark.createDataFrame([("seed-3", 7.0), ("other", 3.0)], "asset string, held double"), 1.0, 100_000.0, None, account).toPandas()
    live = states[states.position != 0].assign(x=lambda d: d.position * d.units).groupby("asset").x.sum()
    assert set(book.asset) >= {"seed-3", "other"} and all(book[book.asset == a].target.iloc[0] == pytest.approx(x) for a, x in live.items())


def test_fits_are_held_for_a_test_window(spark, run):
    from barloom.operators import signals

    fits = signals.refitted(run.bars, run.plans, 2, 160, least_trades=1).toPandas()
    spans = spark.createDataFrame([(a, 0, 540, 700) for a in ("seed-3", "seed-5")], "asset string, window_id long, start long, stop long")
    want = search.optimized(run.bars, run.plans, spans, 2, least_trades=1).toPandas()
    key = lambda d: sorted(d[["asset", "template", "trial_id"]].itertuples(index=False, name=None))
    assert key(fits) == key(want) and (fits.fitted_idx == 699).all()
    slots = spark.createDataFrame([("seed-3", "break", 0.4, 0, 670), ("seed-3", "fade", 0.3, 21, 640), ("seed-5", "trail", 0.3, None, None)], "asset string, template string, weight double, trial_id int, fitted_idx long")
    marked = {(r["asset"], r["template"]): (r["bars_since"], r["due"]) for r in signals.due(run.bars, slots, 50).collect()}
    assert marked == {("seed-3", "break"): (29, False), ("seed-3", "fade"): (59, True), ("seed-5", "trail"): (700, True)}
    now = {(r["asset"], r["template"]): r for r in signals.kept_or_refitted(run.bars, run.plans, slots, 2, 160, 50, least_trades=1).collect()}
    assert now["seed-3", "break"]["trial_id"] == 0 and now["seed-3", "break"]["fitted_idx"] == 670
    again = fits.set_index(["asset", "template"]).trial_id
    assert now["seed-3", "fade"]["trial_id"] == again["seed-3", "fade"] and now["seed-5", "trail"]["fitted_idx"] == 699 and now["seed-5", "trail"]["weight"] == 0.3
    with pytest.raises(ValueError, match="are needed"):
        signals.refitted(run.bars, run.plans, 2, 800)


def test_filters_that_bar_an_entry(spark):
    rows = synthetic_bars(spark, [3], 300)
    plans = spark.createDataFrame(
        [(0, "none", False, 0.35), (1, "trend_only", False, 0.0), (2, "trend_only", False, 2.0), (3, "range_only", False, 0.0), (4, "range_only", False, 2.0), (5, "none", True, 0.35)],
        "trial_id int, regime_filter string, vol_filter boolean, regime_threshold double",
    ).withColumns({"vol_low": F.lit(1.5), "vol_high": F.lit(2.0), "vol_lookback": F.lit(100)})
    got = {(r["trial_id"], r["reason"]): r for r in simulation.simulated(rows, plans, "blocked").collect()}
    assert set(got) == {(2, "regime"), (3, "regime"), (5, "volatility")} and got[2, "regime"]["low"] == 2.0 and 0 <= got[2, "regime"]["value"] <= 1 and got[5, "volatility"]["high"] == 2.0
    short = simulation.simulated(rows.filter("bar_idx < 30"), plans, "blocked").collect()
    assert {(r["trial_id"], r["reason"]) for r in short} == {(k, "not_formed") for k in range(6)}


def test_orders_of_a_held_level(spark):
    from barloom.operators import signals

    rows = [("up", 0.5, 0.2, 1000.0, 10.0, 0.01), ("same", 0.5, 0.5, 1000.0, 10.0, 0.01), ("none", None, 0.5, 1000.0, 10.0, 0.01), ("flip", -0.25, 0.25, 1000.0, 10.0, 0.01)]
    levels = spark.createDataFrame(rows, "asset string, target double, held double, equity double, close double, vol double")
    got = {r["asset"]: (r["side"], r["shares"]) for r in signals.stance_orders(levels, leverage=2.0).collect()}
    assert got == {"up": (1, pytest.approx(60.0)), "flip": (-1, pytest.approx(100.0))}
    whole = {r["asset"]: r["shares"] for r in signals.stance_orders(levels, simulation.Account(whole_units=True, margin=150.0, per_year=100.0), 0.2).collect()}
    full = min(1000 * 0.02 / 0.01, 2 * 1000 / 150)
    assert whole == {"up": math.floor(0.5 * full) - math.floor(0.2 * full), "flip": 2 * math.floor(0.25 * full)}


def test_family_diagnostics(spark, run):
    from barloom.operators import backtest, book, diagnostics

    trials = diagnostics.trial_returns(run).persist()
    got = {r["asset"]: r for r in diagnostics.family_diagnostics(run, 100, trials).collect()}
    rets = run.returns.toPandas()
    for asset, r in got.items():
        wide = rets[rets.asset == asset].pivot(index="bar_idx", columns="template", values="ret").sort_index()
        sharpe = wide.mean() / wide.std(ddof=1)
        assert r["best"] == sharpe.idxmax() and r["sharpe_annual"] == pytest.approx(sharpe.max() * 252**0.5) and (r["n_templates"], r["n_trials"]) == (3, 12)
        assert 1 <= r["n_eff"] <= 3 and 0 <= r["dsr_raw"] <= 1 and 0 <= r["dsr"] <= 1 and 0 <= r["pbo_trials"] <= 1 and 0 <= r["reality_check_p"] <= 1 and r["years"] == pytest.approx(len(wide) / 252)
    one = run.returns.filter("asset = 'seed-3'").select(F.col("template").alias("asset"), F.col("bar_idx").alias("ts"), "ret")
    assert backtest.reality_check(one, 100).first()["p_value"] == got["seed-3"]["reality_check_p"]
    paths = diagnostics.finalist_paths(run, trials=trials, finalists=2)
    told = paths.toPandas()
    assert len(told) == 4 and (told.n_paths == 5).all() and set(told["rank"]) == {1, 2} and ((told.prob_negative >= 0) & (told.prob_negative <= 1)).all()
    name = told[(told.asset == "seed-3") & (told["rank"] == 1)].template.iloc[0]
    alone = trials.filter((F.col("asset") == "seed-3") & (F.col("template") == name)).select(F.col("trial_id").cast("string").alias("asset"), F.col("bar_idx").alias("ts"), "ret")
    own = backtest.purged_paths(alone, 6, 2, 10).toPandas().sharpe * 252**0.5
    assert told[(told.asset == "seed-3") & (told["rank"] == 1)].sharpe_mean.iloc[0] == pytest.approx(own.mean())
    judged = book.verdict(diagnostics.verdict_inputs(run, diagnostics.family_diagnostics(run, 50, trials), paths)).collect()
    assert len(judged) == 2 and all(r["level"] in ("good", "warning", "critical") for r in judged)
    table = diagnostics.candidate_table(run).toPandas()
    assert len(table) == 6 and sorted(table[table.asset == "seed-5"]["rank"]) == [1, 2, 3] and table.nested_windows.sum() == run.holdings.filter("target = 'nested'").count()


def test_comparisons_of_learners(spark):
    from barloom.operators import backtest, diagnostics

    rng = np.random.default_rng(4)
    close, level = 100 * np.cumprod(1 + rng.normal(0, 0.01, 200)), np.clip(rng.normal(0, 0.8, 200), -1.2, 1.2)
    bars = spark.createDataFrame([("x", i, float(c)) for i, c in enumerate(close)], "asset string, bar_idx long, close double")
    table = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(level)], "asset string, bar_idx long, level double")
    pos = np.clip(level, -1, 1)
    want = np.append(0.0, pos[:-1] * (close[1:] / close[:-1] - 1) - 0.0005 * np.abs(np.diff(pos)))
    got = diagnostics.committee_returns(bars, table, first=20).orderBy("bar_idx").toPandas()
    assert np.allclose(got.ret, want[20:])
    sign = np.sign(level[30:])
    assert diagnostics.direction_flips(table, 30).first()["flips"] == pytest.approx(np.mean(sign[1:] != sign[:-1]))
    x, y = rng.normal(0.1, 1, 300), rng.normal(0, 2, 300)
    frames = [spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(z)] + [("flat", i, 0.0) for i in range(9)], "asset string, bar_idx long, ret double") for z in (x, y)]
    told = {r["asset"]: r for r in diagnostics.paired_sharpe(*frames).collect()}
    d = x / x.std() - y / y.std()
    assert told["k"]["t"] == pytest.approx(d.mean() / d.std() * math.sqrt(300)) and told["flat"]["t"] == 0.0 and told["k"]["sharpe_b"] == pytest.approx(y.mean() / y.std())
    z = [-40.0, -9.0, -7.2, -7.0, -1.96, -0.3, 0.0, 1e-9, 0.7, 2.5, 6.9, 8.0, 39.0]
    cdf = spark.createDataFrame([(v,) for v in z] + [(None,), (math.nan,)], "z double").select("z", backtest.normal_cdf(F.col("z")).alias("p")).collect()
    for r in cdf[:-2]:
        want = 0.5 * math.erfc(-r["z"] / math.sqrt(2))
        assert abs(r["p"] - want) < 1e-14 and r["p"] == pytest.approx(want, rel=1e-7, abs=1e-300)
    assert [r["p"] for r in cdf[-2:]] == [None, None]
