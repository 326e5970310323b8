"""Simulation, walk-forward and the tests of luck against known numbers and plain loops."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, book, calendar, metrics, portfolio, recursive, search, simulation, stance
from barloom.plans import research
from barloom.sources import bars as src
from barloom.sources import synthetic
from barloom.sources.synthetic import regime_walk, synthetic_bars

K = 30


def quiet(n=40, **bars):
    """Bars of close 99.9 in a channel of 98.8 to 101 (set by bar 12); ``bars`` b31=(open, high, low, close) replace some."""
    rows = [(99.9, 100.9, 98.9, 99.9)] * n
    rows[12] = (99.9, 101.0, 98.8, 99.9)
    for name, row in bars.items():
        rows[int(name[1:])] = row
    return pd.DataFrame(rows, columns=["open", "high", "low", "close"])


def run(bars, log=False, first=K, account=simulation.Account(cost_rate=0.0), **plan):
    plan = {"n_entry": 28, "n_exit": 10, "atr_n": 10} | plan
    return simulation.simulate(bars, pd.DataFrame([plan]), account, first, log)


def trade(bars, **plan):
    t = run(bars, **plan).trades.iloc[0]
    return t.side, t.entry_price, t.exit_price, simulation.REASONS[int(t.reason)], int(t.entry_idx), int(t.exit_idx)


@pytest.mark.parametrize(
    ("plan", "final", "trades", "total"),
    [
        ({}, 96199.21803455162, 20, 87169986.55665812),
        ({"direction": "countertrend", "channel": "bollinger"}, 100562.92699953135, 44, 91280866.8013434),
        ({"entry": "pullback", "exit": "atr_trail", "regime_filter": "trend_only"}, 97139.7079619701, 12, 88500537.77155879),
    ],
)
def test_known_results(plan, final, trades, total):
    got = simulation.simulate(regime_walk(900, 13), pd.DataFrame([{"direction": "trend"} | plan]), first=100)
    assert got.equity[-1, 0] == pytest.approx(final, rel=1e-13) and len(got.trades) == trades and got.equity.sum() == pytest.approx(total, rel=1e-13)


def test_lanes_do_not_depend_on_each_other():
    bars = regime_walk(400, 5)
    many = pd.DataFrame([dict(direction=d, channel=c, entry=e, exit=x) for d in ("trend", "countertrend") for c in ("donchian", "keltner", "bollinger") for e in ("stop", "close_confirm", "pullback") for x in ("channel", "atr_trail", "target_stop", "time_stop")])
    whole = simulation.simulate(bars, many, first=60)
    for k in range(0, len(many), 7):
        assert np.array_equal(simulation.simulate(bars, many.iloc[[k]], first=60).equity[:, 0], whole.equity[:, k])


def test_entry_bar_stop_and_gaps():
    held = {"exit": "time_stop", "max_hold": 99}
    assert trade(quiet(b31=(100.0, 102.0, 90.0, 95.0)), **held) == (1, 101.0, pytest.approx(95.0, abs=0.1), "stop_same_bar", 31, 31)
    # the opposite channel is nearer than the stop
    assert trade(quiet(b31=(100.0, 102.0, 90.0, 95.0))) == (1, 101.0, 98.9, "channel", 31, 31)
    # an open beyond the edge fills there, an open through the stop leaves there
    assert trade(quiet(b31=(103.0, 104.0, 102.0, 103.0), b32=(90.0, 91.0, 89.0, 90.0)), **held) == (1, 103.0, 90.0, "stop", 31, 32)
    # a target inside the bar of a stop entry comes after the fill; the stop goes first where both are reached
    assert trade(quiet(b31=(100.0, 110.0, 100.0, 108.0)), exit="target_stop", target_mult=1.0)[3:] == ("target", 31, 31)
    assert trade(quiet(b31=(100.0, 110.0, 90.0, 108.0)), exit="target_stop", target_mult=1.0, stop_mult=1.0)[3] == "stop_same_bar"
    # a fade's limit entry waits with its target
    assert trade(quiet(b31=(100.0, 102.0, 100.0, 100.5), b32=(100.5, 100.6, 90.0, 95.0)), direction="countertrend", exit="target_stop", target_mult=1.0)[3:] == ("target", 31, 32)


def test_time_exit_and_confirming_entry():
    rise = quiet(b31=(100.0, 102.0, 100.0, 101.5), b32=(101.4, 101.6, 101.2, 101.5), **{f"b{i}": (101.5, 101.6, 101.4, 101.5) for i in range(33, 40)})
    assert trade(rise, entry="close_confirm", exit="time_stop", max_hold=3) == (1, 101.4, 101.5, "time", 32, 35)
    # a pullback rests below the edge and lapses
    log = run(rise, True, entry="pullback", pullback_bars=2).orders
    kinds = [simulation.KINDS[int(k)] for k in log.kind]
    assert "pullback_submit" in kinds and kinds.count("pullback_working") >= 2 and "pullback_expire" in kinds and "entry_fill" not in kinds


def test_sides_size_rolls_and_ruin():
    up, held = quiet(b31=(100.0, 102.0, 100.0, 101.5)), {"exit": "time_stop", "max_hold": 99}
    assert len(run(up, sides="short_only").trades) == 0 and (run(up, sides="short_only").position == 0).all()
    got = run(up, **held)
    assert got.position[0] == 1 and got.units[0] == pytest.approx(1000 / (3 * 2.0), rel=0.05)
    assert run(up, account=simulation.Account(cost_rate=0.0, whole_units=True), **held).units[0] == math.floor(got.units[0])
    assert run(up, account=simulation.Account(cost_rate=0.0), leverage=0.1, **held).units[0] == pytest.approx(0.1 * 100_000 / 101)
    rolled = run(up.assign(roll=[0.0] * 35 + [1.0] + [0.0] * 4), account=simulation.Account(cost_rate=0.0, roll_cost=2.0), **held)
    assert rolled.equity[-1, 0] == pytest.approx(got.equity[-1, 0] - 2 * got.units[0])
    crash = quiet(b31=(100.0, 102.0, 100.0, 101.5), b32=(1.0, 1.0, 1.0, 1.0))
    dead = run(crash, leverage=50.0, risk=1.0, **held)
    assert dead.equity[-1, 0] < 0 and (dead.equity[32:, 0] == dead.equity[-1, 0]).all() and dead.returns(simulation.Account())[33:].sum() == 0
    fixed = simulation.Account(cost_rate=0.0, fixed=True)
    assert run(crash, leverage=50.0, risk=1.0, account=fixed, **held).returns(fixed)[32, 0] < -1


def test_simulated_tables_agree(spark):
    bars = synthetic_bars(spark, [1, 2], 300)
    assert [r["close"] for r in bars.filter("asset = 'seed-2'").orderBy("ts").collect()][:300] == regime_walk(300, 2)["close"].tolist()[:300]
    plans = research.plans(spark, research.SHOWN | {"channel": ("donchian",)})
    totals = {(r["asset"], r["trial_id"]): r for r in simulation.simulated(bars, plans).collect()}
    trades, rows, orders = (simulation.simulated(bars, plans, x).toPandas() for x in ("trades", "bars", "orders"))
    assert len(totals) == 2 * 24 and len(rows) == len(totals) * bars.count() // 2
    for (asset, k), r in list(totals.items())[::5]:
        t, b = trades[(trades.asset == asset) & (trades.trial_id == k)], rows[(rows.asset == asset) & (rows.trial_id == k)]
        assert r["n_trades"] == len(t) == b.exited.sum() and r["final"] == pytest.approx(100_000 * (1 + b.ret).prod()) and b.pnl.sum() == pytest.approx(t.pnl.sum())
        assert (orders[(orders.asset == asset) & (orders.trial_id == k)].kind == "exit_fill").sum() == len(t)


def test_walk_forward_equals_single_windows(spark):
    bars = synthetic_bars(spark, [3], 420)
    points = research.lattice_plans(spark)
    local, plans = bars.orderBy("ts").toPandas(), points.toPandas()
    warm = points.agg(F.max(search.warmup(points))).first()[0]
    assert warm == 85
    got = {r["window_id"]: r for r in search.walk_forward(bars, points, 3, 200, 60, least_trades=2).collect()}
    rets = search.walk_forward(bars, points, 3, 200, 60, "bars", least_trades=2).toPandas()
    for w in range(4):
        a, z = max(60 * w, warm), 60 * w + 200
        run = simulation.simulate(local.iloc[a - warm : z].reset_index(drop=True), plans, first=warm)
        r = run.returns(simulation.Account())[warm:]
        n = np.array([(run.trades.lane == k).sum() for k in range(len(plans))])
        score = np.where(n >= 2, r.mean(axis=0) / r.std(axis=0, ddof=1) * math.sqrt(252), np.nan)
        grid = {tuple(c): s for c, s in zip(plans.coord, score)}
        mid, best = np.nanmedian(score), None
        for k, c in enumerate(plans.coord):
            near = [grid.get((c[0] + x, c[1] + y, c[2] + z), np.nan) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
            held = [v for v in near if not np.isnan(v)]
            miss = 0.5 * (3 * 3 * 2 - len(held))
            if not np.isnan(score[k]):
                smooth = (round((sum(held) + miss * mid) / (len(held) + miss), 9), score[k])
                best = max(best or (smooth, -1), (smooth, k), key=lambda x: x[0])
        assert got[w]["trial_id"] == plans.trial_id[best[1]]
        test = simulation.simulate(local.iloc[z - warm : min(z + 60, 420)].reset_index(drop=True), plans.iloc[[best[1]]], first=warm)
        assert got[w]["oos_total_return"] == pytest.approx(test.equity[-1, 0] / 100_000 - 1)
        own = rets[rets.window_id == w].sort_values("bar_idx").ret.to_numpy()
        assert np.allclose(own, test.returns(simulation.Account())[warm:, 0])
    told = search.summary(search.walk_forward(bars, points, 3, 200, 60, least_trades=2), rets_frame(spark, rets)).first()
    assert told["n_windows"] == len(got) and told["oos_total"] == pytest.approx((1 + rets.ret).prod() - 1)


def test_one_account_over_the_windows(spark):
    """In whole units every window is picked and sized on what the last one left; otherwise the account is a running product."""
    bars, points = synthetic_bars(spark, [3, 4], 420), research.lattice_plans(spark)
    warm, plans = 85, points.toPandas().sort_values("trial_id").reset_index(drop=True)
    how = {"least_trades": 2, "least_test": 20}
    account = simulation.Account(equity=60_000.0, whole_units=True, cost_per_unit=0.01)
    wins, rets = search.walked(bars, points, 3, 200, 60, account=account, **how)
    got = {(r["asset"], r["window_id"]): r for r in wins.collect()}
    split = 0
    for asset in sorted({a for a, _ in got}):
        local, capital = bars.filter(F.col("asset") == asset).orderBy("ts").toPandas(), account.equity
        for w in range(4):
            r, a, z = got[asset, w], max(60 * w, warm), 60 * w + 200
            run = simulation.simulate(local.iloc[a - warm : z].reset_index(drop=True), plans.assign(capital=capital), account, first=warm)
            totals = simulation._totals(run, account, warm, plans.trial_id.to_numpy())
            place = search.pick(search._values(totals, "sharpe", 2), np.array(plans.coord.tolist()), plans.trial_id.to_numpy())
            assert r["initial_equity"] == pytest.approx(capital) and (r["trial_id"] == plans.trial_id[place] if place is not None else r["trial_id"] is None)
            if place is None:
                continue
            test = simulation.simulate(local.iloc[z - warm : min(z + 60, 420)].reset_index(drop=True), plans.iloc[[place]].assign(capital=capital), account, first=warm)
            assert (test.trades.units % 1 == 0).all() and r["oos_total_return"] == pytest.approx(test.equity[-1, 0] / capital - 1)
            fresh = simulation.simulate(local.iloc[z - warm : min(z + 60, 420)].reset_index(drop=True), plans.iloc[[place]], account, first=warm)
            split += int(len(fresh.trades) > 0 and not np.array_equal(fresh.trades.units, test.trades.units))
            capital = float(test.equity[-1, 0])
    assert split > 0  # counts follow the compounded account
    whole = {k: v for k, v in got.items()}
    parts, _ = search.walked(bars, points, 3, 200, 60, **how)
    serial = search._carried(bars, points, search.windows(bars, 200, 60), warm, "sharpe", "plateau", 2, simulation.Account()).collect()
    both = {(r["asset"], r["window_id"]): r for r in parts.collect()}
    assert len(serial) == len(both) == len(whole) and all(both[r["asset"], r["window_id"]]["trial_id"] == r["trial_id"] for r in serial)
    assert all(both[r["asset"], r["window_id"]]["initial_equity"] == pytest.approx(r["capital"]) for r in serial)
    named = points.withColumn("template", F.lit("one")).unionByName(points.withColumns({"template": F.lit("two"), "trial_id": F.col("trial_id") + 100}))
    by = {(r["template"], r["asset"], r["window_id"]): r for r in search.walked(bars, named, 3, 200, 60, **how)[0].collect()}
    assert len(by) == 2 * len(both)
    for (a, w), r in both.items():
        assert by["one", a, w]["trial_id"] == r["trial_id"] and by["two", a, w]["trial_id"] == (None if r["trial_id"] is None else r["trial_id"] + 100)
        assert by["one", a, w]["oos_sharpe"] == pytest.approx(r["oos_sharpe"]) and by["two", a, w]["initial_equity"] == pytest.approx(r["initial_equity"])


@pytest.mark.parametrize("whole", [False, True])
def test_a_ruined_account_is_not_funded_again(spark, whole):
    rows = synthetic_bars(spark, [3], 420).orderBy("ts").toPandas()
    fall = rows.index >= 290  # a gap through the account in the second test
    for c in ("open", "high", "low", "close"):
        rows.loc[fall, c] = rows.loc[fall, c] * 0.01
    bars = spark.createDataFrame(rows)
    points = research.lattice_plans(spark).withColumns({"sides": F.lit("long_only"), "leverage": F.lit(20.0), "risk": F.lit(5.0), "exit": F.lit("atr_trail")})
    wins, rets = search.walked(bars, points, 3, 200, 60, least_trades=0, account=simulation.Account(equity=1e7, cost_rate=0.0, whole_units=whole))
    got = wins.orderBy("window_id").collect()
    dead = [r["ruined"] for r in got]
    assert dead == sorted(dead) and any(dead) and not all(dead)
    first = dead.index(True)
    assert got[first - 1]["oos_total_return"] <= -1 and all(r["trial_id"] is None and r["oos_n_bars"] is None and r["initial_equity"] == got[first]["initial_equity"] <= 0 for r in got[first:])
    assert rets.filter(F.col("window_id") >= first).agg(F.sum(F.abs("ret"))).first()[0] == 0.0
    told = search.summary(wins, rets).first()
    assert told["ruined"] and told["oos_cagr"] == -1.0 and told["n_windows"] == len(got) and 0 < told["oos_exposure"] <= 1


def rets_frame(spark, rets):
    return spark.createDataFrame(rets[["asset", "window_id", "bar_idx", "ret"]])


def test_scores(spark):
    rows = [("a", 0.5, -0.1, 10, 30.0, 10.0, 1.0), ("b", 0.5, 0.0, 10, 30.0, 0.0, 1.0), ("c", 0.5, -0.1, 2, 1.0, 1.0, 1.0), ("d", 9.0, -0.1, 9, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, total_return double, max_dd double, n_trades int, gain double, loss double, sharpe double")
    got = {r["k"]: r for r in df.select("k", *(search.score(m).alias(m) for m in ("sharpe", "return_over_dd", "profit_factor"))).collect()}
    assert got["a"]["return_over_dd"] == pytest.approx(5) and got["a"]["profit_factor"] == 3 and got["c"]["sharpe"] is None
    assert got["b"]["return_over_dd"] == pytest.approx(10 + math.log1p(0.5 / 1e-6 - 10)) and got["b"]["profit_factor"] == pytest.approx(10 + math.log1p(1e6 - 10))
    assert got["d"]["return_over_dd"] == pytest.approx(10 + math.log1p(80)) and got["d"]["profit_factor"] == 0


def test_carried_trades_bar_training(spark):
    rng = np.random.default_rng(2)
    rets = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(rng.normal(size=80))] + [("y", i, float(v)) for i, v in enumerate(rng.normal(size=80))], "trial string, ts long, ret double")
    trades = spark.createDataFrame([("x", 5, 37), ("x", 50, 55), ("y", 30, 30)], "trial string, entry_idx long, exit_idx long")
    ends = spark.createDataFrame([("x", g, 10 * g + 13) for g in range(8)] + [("y", g, 10 * g + 13) for g in range(8)], "trial string, block int, from_idx long")
    got = {(r["trial"], r["block"]): r["until"] for r in backtest.carried_until(trades, ends).collect()}
    assert got == {("x", 0): 37, ("x", 1): 37, ("x", 2): 37, ("x", 4): 55}
    local = rets.toPandas()
    series = {k: d.sort_values("ts").ret.to_numpy() for k, d in local.groupby("trial")}
    spans = {"x": [(5, 37), (50, 55)], "y": [(30, 30)]}
    paths = {r["path"]: r for r in backtest.purged_paths(rets, 8, 2, 3, "trial", purge=2, trades=trades).collect()}
    out: dict[int, list] = {}
    seen = [0] * 8
    masks = sorted((1 << a) + (1 << b) for a in range(8) for b in range(a))
    for mask in masks:
        groups = [g for g in range(8) if mask >> g & 1]
        best = None
        for k in ("x", "y"):
            keep = np.ones(80, bool)
            for g in groups:
                lo, hi = 10 * g, 10 * g + 10
                keep[max(0, lo - 2) : hi + 3] = False
                held = [t for t in spans[k] if t[0] < hi + 3]
                if held and held[-1][1] >= hi + 3:
                    keep[hi + 3 : held[-1][1] + 1] = False
            x = series[k][keep]
            s = x.mean() / x.std(ddof=1)
            if best is None or s > best[0]:
                best = (s, k)
        for g in groups:
            out.setdefault(seen[g], []).append(series[best[1]][10 * g : 10 * g + 10])
            seen[g] += 1
    for p, parts in out.items():
        x = np.concatenate(parts)
        assert paths[p]["n"] == len(x) and paths[p]["sharpe"] == pytest.approx(x.mean() / x.std(ddof=1))


def test_luck(spark):
    rng = np.random.default_rng(7)
    rows = [(f"s{k}", i, float(v)) for k in range(6) for i, v in enumerate(rng.normal(0, 1, 400))] + [("good", i, float(v)) for i, v in enumerate(rng.normal(0.3, 1, 400))]
    rets = spark.createDataFrame(rows, "asset string, ts long, ret double")
    noise = rets.filter("asset <> 'good'")
    a, b = backtest.reality_check(rets, 200).first(), backtest.reality_check(noise, 200).first()
    assert a["best"] == "good" and a["p_value"] == 0 and b["p_value"] > 0.03
    assert backtest.reality_check(rets, 200).first() == a
    p = {r["asset"]: r["p"] for r in backtest.bootstrap_p(rets, 200).collect()}
    assert p["good"] == 0 and sum(p.values()) / 7 > 0.2
    told = backtest.deflated_sharpe(metrics.moments(rets), 252.0).first()
    assert told["best"] == "good" and told["n_trials"] == 7 and told["psr"] > told["dsr"] > 0.5
    got = [r[0] for r in spark.createDataFrame([(-1.96,), (0.0,), (1.0,), (None,)], "z double").select(backtest.normal_cdf(F.col("z"))).collect()]
    assert got[:3] == pytest.approx([0.024997895, 0.5, 0.841344746]) and got[3] is None
    assert backtest.expected_max_sharpe(1) == 0 and 1.5 < backtest.expected_max_sharpe(10) < 1.6


def test_bands_hold_on_missing_targets_and_one_side(spark):
    rows = spark.createDataFrame([("a", 0, 0.8), ("a", 1, None), ("a", 2, 0.5), ("a", 3, -0.4), ("a", 4, 0.1)], "asset string, bar_idx long, target double")
    ask = lambda s: [round(r["level"], 9) for r in recursive.buffered_levels(rows, 0.3, s).orderBy("bar_idx").collect()]
    assert ask("both") == [0.5, 0.0, 0.5, -0.1, -0.1] and ask("long_only") == [0.5, 0.0, 0.5, 0.0, 0.0] and ask("short_only") == [0.0, 0.0, 0.0, -0.1, 0.0]


def stamps(spark, by_asset):
    return spark.createDataFrame([(a, t.to_pydatetime()) for a, ts in by_asset.items() for t in ts], "asset string, ts timestamp_ntz")


def test_sessions_of_kinds_of_calendars(spark):
    days = pd.bdate_range("2021-01-04", "2022-12-30")
    hours = lambda first, n, d: pd.DatetimeIndex([x + pd.Timedelta(hours=first + k) for x in d for k in range(n)])
    all_day = pd.date_range("2021-01-01", "2022-12-31", freq="h")
    rng = np.random.default_rng(1)
    ticks = pd.DatetimeIndex(sorted(d + pd.Timedelta(seconds=int(s)) for d in days[:200] for s in rng.integers(14 * 3600, 21 * 3600, 20)))
    bars = stamps(spark, {"equity": hours(14, 7, days), "future": hours(23, 23, days), "crypto": all_day, "daily": days, "ticks": ticks.unique(), "two": days[:2]})
    got = {r["asset"]: r for r in calendar.annualization(bars).collect()}
    assert "two" not in got and (got["daily"]["sessions_per_year"], got["daily"]["cut"]) == (None, 0) and got["daily"]["per_year"] in (260, 261)
    assert got["crypto"]["cut"] == 0 and got["crypto"]["sessions_per_year"] in (365, 366) and 8700 < got["crypto"]["per_year"] < 8800
    assert not 14 * 60 <= got["equity"]["cut"] <= 20 * 60 and got["equity"]["sessions_per_year"] in (260, 261)
    # a session of 23 hours from 23:00 on breaks after its bar of 21:00
    assert got["future"]["cut"] == 22 * 60 and got["future"]["sessions_per_year"] in (260, 261)
    odd = {r["asset"]: r["irregular"] for r in calendar.irregular(bars.filter("asset <> 'two'")).collect()}
    assert odd == {"equity": False, "future": False, "crypto": False, "daily": False, "ticks": True}
    assert calendar.best_cut(np.array([5, 5, 9, 9, 5, 5]), np.zeros(6, int), 240) == 1200
    assert {r["asset"]: r["intraday"] for r in src.intraday(bars).collect()} == {"equity": True, "future": True, "crypto": True, "daily": False, "ticks": True, "two": False}


def test_loading_of_numeric_dates_and_rolls(spark, tmp_path):
    def load(text):
        (tmp_path / "x.csv").write_text(text)
        return [(str(r["ts"]), r["close"], r["roll"] if "roll" in r else None) for r in src.csv_bars(spark, str(tmp_path / "x.csv"), "x").orderBy("ts").collect()]

    head = "stamp,Open,High,Low,Close\n"
    assert [x[0][:10] for x in load(head + "13.01.2023,1,1,1,1\n14.01.2023,1,1,1,2\n")] == ["2023-01-13", "2023-01-14"]
    assert [x[0][:10] for x in load(head + "01/13/2023,1,1,1,1\n02/01/2023,1,1,1,2\n")] == ["2023-01-13", "2023-02-01"]
    # all fields fit both: a day of bars, not months of jumps
    assert [x[0] for x in load(head + "02.01.2023 10:00,1,1,1,1\n02.01.2023 11:00,1,1,1,2\n03.01.2023 10:00,1,1,1,3\n")] == ["2023-01-02 10:00:00", "2023-01-02 11:00:00", "2023-01-03 10:00:00"]
    assert [x[0] for x in load(head + "2023-01-02 10:00:00.250,1,1,1,1\n2023-01-02T10:00:01+01:00,1,1,1,2\n")] == ["2023-01-02 09:00:01", "2023-01-02 10:00:00.250000"]
    rolled = load("stamp,Open,High,Low,Close,Roll\n2023-01-02,1,1,1,1,no\n2023-01-03,,1,1,1,TRUE\n2023-01-04,1,1,1,1,1\n2023-01-04,1,1,1,2,\n2023-01-05,0,0,0,0,y\n")
    assert rolled == [("2023-01-02 00:00:00", 1.0, 1.0), ("2023-01-04 00:00:00", 2.0, 2.0)]
    with pytest.raises(Exception, match="not a roll flag"):
        load("stamp,Open,High,Low,Close,Roll\n2023-01-02,1,1,1,1,maybe\n")
    bars = spark.createDataFrame([("a", 1.0, 2.0, -1.0, 1.0)], "asset string, open double, high double, low double, close double")
    assert src.checked(bars, margin=10.0).count() == 1
    for why, how in (("margin", {}), ("basis points", {"margin": 1.0, "cost_bps": 5.0}), ("roll", {"margin": 1.0, "roll_cost": 1.0}), ("needed", {"margin": 1.0, "least": 5}), ("point_value", {"point_value": 0.0})):
        with pytest.raises(ValueError, match=why):
            src.checked(bars, **how)


def test_next_orders_are_what_the_next_bar_works(spark):
    """Orders after the first k bars are those that the log has on bar k of a longer run."""
    bars = synthetic_bars(spark, [4], 260)
    plans = research.plans(spark)
    log = simulation.simulated(bars, plans, "orders").filter("bar_idx = 200").toPandas()
    got = simulation.simulated(bars.filter("bar_idx < 200"), plans, "next_orders").toPandas()
    states = {r["trial_id"]: r for r in simulation.simulated(bars.filter("bar_idx < 200"), plans, "states").collect()}
    assert len(states) == 72 and len(got)
    for k in range(72):
        own, now = got[got.trial_id == k], log[log.trial_id == k]
        work = now[now.kind.isin(["stop_working", "target_working"])] if states[k]["position"] else now[now.kind.isin(["entry_working", "pullback_working"])]
        levels = own[~own.kind.isin(["market_on_open", "exit_on_open"])].level
        known = work.level if not states[k]["position"] else now[now.seq < now[now.kind == "entry_fill"].seq.min()].level if (now.kind == "entry_fill").any() else work.level
        assert sorted(levels) == pytest.approx(sorted(known))
        assert (own.shares >= 0).all()


def test_books_and_verdicts(spark):
    table = spark.createDataFrame([("a", 1.0, 9, 50, -0.2, True, 0.7), ("b", 1.0, 2, 50, -0.2, True, 0.7), ("c", -1.0, 9, 50, -0.2, True, 0.7), ("d", 1.0, 9, 50, -1.0, True, 0.7), ("e", 1.0, 9, 50, None, False, None)], "k string, oos_sharpe double, n_live int, n_trades int, oos_max_dd double, pardo_pass boolean, wfe double")
    names = lambda d: sorted(r["k"] for r in d.collect())
    assert names(book.candidates(table)) == ["a", "e"] and names(book.candidates(table, pardo=True)) == ["a"] == names(book.candidates(table, least_wfe=0.5))
    diag = spark.createDataFrame([(1, 3, 0.8, 0.1, 0.01, 0.99, 10.0, 5.0, 0), (2, 3, 0.3, 0.4, 0.01, 0.99, 10.0, 5.0, 0), (3, 0, -0.1, 0.6, 0.3, 0.5, 1.0, 5.0, 2)], "k int, n_slots int, nested_sharpe double, pbo double, reality_check_p double, dsr double, years double, min_years double, weak_slots int")
    got = {r["k"]: (r["level"], len(r["reasons"])) for r in book.verdict(diag).collect()}
    assert got == {1: ("good", 0), 2: ("warning", 2), 3: ("critical", 7)}
    legs = spark.createDataFrame([("x", 1, 1, 10.0, 100.0, 1.0, 0.0, 90.0), ("x", 2, -1, 4.0, 100.0, 1.0, 0.0, None), ("y", 3, 1, 2.0, 50.0, 10.0, 300.0, 45.0)], "asset string, slot int, side int, shares double, price double, point_value double, margin double, stop double")
    free = {r["asset"]: r for r in book.book_targets(legs, 1000.0).collect()}
    assert (free["x"]["shares"], free["x"]["notional"], free["x"]["open_risk"], free["y"]["notional"], free["y"]["scale"]) == (6.0, 600.0, 100.0, 600.0, 1.0)
    tight = {r["asset"]: r for r in book.book_targets(legs, 1000.0, 1.0).collect()}
    assert tight["x"]["scale"] == pytest.approx(0.5) and tight["y"]["shares"] == pytest.approx(1.0)
    trades = spark.createDataFrame([("a", 1.0, 3.0, 2.0, 10.0), ("b", 3.0, 1.0, -2.0, None), ("c", 1.0, 1.0, 0.0, 5.0)], "asset string, held double, target double, order double, price double")
    assert [(r["action"], r["order_notional"]) for r in book.order_actions(trades).orderBy("asset").collect()] == [("BUY", 20.0), ("SELL", None), ("hold", 0.0)]
    orders = spark.createDataFrame([("A", "stop", -1, 95.0, 10.0, 100.0), ("A", "market_on_open", 1, None, 5.0, 100.0), ("B", "stop", 1, 1.0, 1.0, 1.0)], "asset string, kind string, side int, level double, shares double, close double")
    futures = spark.createDataFrame([("A", "R", 4000.0, 1000.0, 2.0, 0.25)], "asset string, root string, price double, value double, ratio double, tick double")
    told = {r["kind"]: r for r in portfolio.translated_orders(orders, futures).collect()}
    assert told["stop"]["fut_level"] == 3900.0 and told["stop"]["contracts"] == 2 and told["market_on_open"]["fut_level"] is None and told["market_on_open"]["contracts_raw"] == pytest.approx(1.0)


def test_orders_collapse(spark):
    rows = [("a", i, "stop_working", -1, "hard", 99.0 if i < 4 else 98.0, 1.0) for i in (1, 2, 3, 4, 6)] + [("a", 6, "exit_fill", -1, "stop", 98.0, 1.0)]
    got = book.collapsed(spark.createDataFrame(rows, "asset string, bar_idx long, kind string, side int, detail_text string, level double, qty double"), "asset").collect()
    assert sorted((r["first_bar"], r["last_bar"], r["n_bars"], r["level"], r["kind"]) for r in got) == [(1, 3, 3, 99.0, "stop_working"), (4, 4, 1, 98.0, "stop_working"), (6, 6, 1, 98.0, "exit_fill"), (6, 6, 1, 98.0, "stop_working")]


def test_held_levels_by_hand():
    bars = pd.DataFrame({"open": [10.0, 10, 11, 12, 12, 12], "close": [10.0, 11, 12, 12, 12, 12], "high": [11.0, 12, 13, 13, 13, 13], "low": [9.0, 9, 10, 11, 11, 11]})
    bars = pd.concat([bars.iloc[[0]]] * 20 + [bars.iloc[1:]], ignore_index=True)
    level = np.full(len(bars), np.nan)
    level[19:] = [0.5, 0.5, 1.0, -0.5, np.nan, np.nan][: len(bars) - 19]
    account = simulation.Account(equity=1000.0, cost_rate=0.0, cost_per_unit=0.1, fixed=True)
    equity, trades, held, units = stance.hold(bars, level, account, leverage=100.0)
    atr = [2.0, 2.1, 2.1]
    a, b, c = (1000 * 0.01 / (3 * x) * y for x, y in zip(atr, (0.5, 1.0, 0.5), strict=True))
    assert [(t[0], t[1], t[2], t[8]) for t in trades] == [(20, 22, 1, "stance"), (22, 23, 1, "stance")] and held == -0.5 and units == pytest.approx(-c)
    assert trades[0][5] == pytest.approx(a) and trades[0][6] == pytest.approx(a * 2 - 0.1 * a) and trades[1][5] == pytest.approx(b)
    assert trades[1][7] == pytest.approx(0.1 * (b - a) + 0.1 * b) and equity[-1] == pytest.approx(1000 + sum(t[6] for t in trades) - 0.1 * c)


def test_made_series(spark):
    for make in synthetic.SUITE.values():
        d = make(800, 3)
        assert len(d) == 800 and (d.high >= d[["open", "close"]].max(axis=1)).all() and (d.low <= d[["open", "close"]].min(axis=1)).all() and make(800, 3).close.equals(d.close)
    r = np.log(synthetic.autoregressive(4000, 1, 0.3).close).diff().dropna()
    assert r.autocorr(1) == pytest.approx(0.3, abs=0.05) and r.std() == pytest.approx(0.01, rel=0.05)
    assert abs(np.log(synthetic.random_walk(4000, 1).close).diff().autocorr(1)) < 0.05
    edge = synthetic.planted(4000, 2, 20, 1, 0.5)
    up = (edge.high >= edge.high.rolling(20).max().shift(1)) & ~(edge.low <= edge.low.rolling(20).min().shift(1))
    assert edge.close.pct_change().shift(-1)[up].mean() > 0.002
    bars = synthetic.suite(spark, ("planted", "switching"), (1, 2), 120)
    assert bars.count() == 480 and [r["close"] for r in bars.filter("asset = 'planted-2'").orderBy("ts").collect()] == synthetic.planted(120, 2).close.tolist()


def test_made_spreads_and_switching_experts(spark):
    for kind in ("calendar", "trending"):
        s = synthetic.spread(6000, 3, kind)
        assert (s.close.min() < 0 or kind == "trending") and (s.high >= s[["open", "close"]].max(axis=1)).all() and (s.low <= s[["open", "close"]].min(axis=1)).all()
        assert s.roll.sum() == 6000 // 21 and s.roll[20] == 1.0 and s.roll[:20].sum() == 0
        away = (s.latent - s["mean"]).to_numpy()
        assert np.corrcoef(away[1:], away[:-1])[0, 1] == pytest.approx(0.5 ** (1 / 10), abs=0.02)
        assert np.corrcoef(-away[:-1], np.diff(s.latent))[0, 1] > 0.1  # the edge: deviations fade
        same = (s.roll == 0).to_numpy()[1:]
        assert np.abs(np.diff(s.close) - np.diff(s.latent))[same].max() <= 0.0101 and (np.diff(s.close) - np.diff(s.latent))[~same].std() > 0.02
    assert synthetic.spread(50, 1).equals(synthetic.spread(50, 1)) and not synthetic.spread(50, 1).close.equals(synthetic.spread(50, 2).close)
    with pytest.raises(ValueError, match="no kind"):
        synthetic.spread(50, 1, "other")
    edge = synthetic.planted_switch(6000, 2, 1000, 0.6)
    nxt = edge.close.pct_change().shift(-1)
    for who, span, side in ((0, 40, 1), (1, 20, -1)):
        up = (edge.high >= edge.high.rolling(span).max().shift(1)) & ~(edge.low <= edge.low.rolling(span).min().shift(1)) & (edge.expert.shift(-1) == who)
        assert side * nxt[up].mean() > 0.002
    bars = synthetic.suite(spark, ("calendar_spread", "trending_spread", "planted_switch"), (1,), 120)
    assert bars.count() == 360


def test_series_operations(spark):
    rets = spark.createDataFrame([("a", 1, 0.1), ("a", 2, -1.5), ("a", 3, 0.2), ("b", 2, 0.3), ("b", 3, None)], "asset string, ts long, ret double")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(metrics.closed_after_ruin(rets.filter("ret IS NOT NULL")).select("asset", "ts", "ret")) == [("a", 1, 0.1), ("a", 2, -1.5), ("a", 3, 0.0), ("b", 2, 0.3)]
    assert rows(metrics.aligned(rets).select("asset", "ts", "ret")) == [("a", 2, -1.5), ("a", 3, 0.2), ("b", 2, 0.3), ("b", 3, 0.0)]
    one, two = rets.filter("asset = 'a'").select("ts", "ret"), rets.filter("asset = 'a' AND ts < 3").select("ts", "ret")
    assert metrics.verified(one, one).first()["ok"] and metrics.verified(one, two).first()["missing"] == 1 and not metrics.verified(one, two).first()["ok"]
    cost = spark.createDataFrame([("x", 0.0, 0.3), ("x", 5.0, 0.1), ("x", 10.0, -0.1), ("y", 0.0, -0.1), ("z", 0.0, 0.2), ("z", 5.0, 0.1),
        ("flat", 0.0, 0.1), ("flat", 5.0, -0.1), ("flat", 10.0, -0.1), ("flat", 20.0, -0.1), ("lost", 0.0, -1.0), ("lost", 5.0, -1.0)], "k string, cost double, ret double")
    assert {r["k"]: r["breakeven"] for r in metrics.breakeven(cost, "k").collect()} == {"x": 7.5, "y": 0.0, "z": math.inf, "flat": 2.5, "lost": 0.0}
    bars = spark.createDataFrame([("a", i, 10.0 + i) for i in range(4)], "asset string, bar_idx long, close double")
    trades = spark.createDataFrame([("a", 0, 1, 3, 1, 2.0)], "asset string, trial_id int, entry_idx long, exit_idx long, side int, units double")
    curve = spark.createDataFrame([("a", 0, i, 100.0) for i in range(4)], "asset string, trial_id int, bar_idx long, equity double")
    e = metrics.exposures(bars, trades, curve, per_year_=1.0).first()
    assert (e["n_bars"], e["held_bars"]) == (4, 2) and e["gross"] == pytest.approx((22 + 24) / 400) and e["turnover"] == pytest.approx((22 + 26) / 400)
