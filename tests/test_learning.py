"""Learners, selection and contracts against plain loops over small fixtures."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import learners, portfolio


def one_window(loss, keep, share, slow):
    """Weights and trade weight after all rounds of ``loss``, one number at a time."""
    n, rungs = loss.shape[1], len(keep)
    w, d = [[1 / n] * n for _ in keep], [[0.0] * n for _ in keep]
    gap, z, v, lag, mine, cash = [0.0] * rungs, [float(n)] * rungs, [1 / rungs] * rungs, [0.0] * rungs, 0.0, 0.0
    for row in loss.tolist():
        felt = []
        for k in range(rungs):
            h = sum(a * b for a, b in zip(w[k], row))
            felt.append(h)
            best = min(row)
            if gap[k] > 0:
                eta = math.log(n) / gap[k]
                low = min(a + b for a, b in zip(d[k], row))
                best = low - math.log(sum(math.exp(-eta * (a + b - low)) for a, b in zip(d[k], row)) / z[k]) / eta
            gap[k] = keep[k] * gap[k] + max(h - best, 0.0)
            d[k] = [keep[k] * a + b for a, b in zip(d[k], row)]
            d[k] = [a - min(d[k]) for a in d[k]]
            if gap[k] <= 0:
                w[k] = [1 / n] * n
                continue
            eta = math.log(n) / gap[k]
            raw = [math.exp(-eta * a) for a in d[k]]
            z[k] = sum(raw)
            w[k] = [a / z[k] for a in raw]
            if share[k] > 0:
                w[k] = [(1 - share[k]) * a + share[k] / n for a in w[k]]
                d[k] = [-math.log(a) / eta for a in w[k]]
                d[k] = [a - min(d[k]) for a in d[k]]
                z[k] = sum(math.exp(-eta * a) for a in d[k])
        mine, cash = slow * mine + sum(a * b for a, b in zip(v, felt)), slow * cash + 0.5
        lag = [slow * a + b for a, b in zip(lag, felt)]
        odds = [math.exp(min(lag) - a) for a in lag]
        v = [a / sum(odds) for a in odds]
    return [sum(v[k] * w[k][e] for k in range(rungs)) for e in range(n)], 1 / (1 + math.exp(mine - cash))


@pytest.mark.parametrize("sharing", [True, False])
def test_committee(sharing):
    rng = np.random.default_rng(3)
    loss = rng.random((60, 4))
    loss[:5] = 0.5
    keep, share, slow = learners.rungs(25, (5, 10), sharing)
    weights, trade = learners.committee(loss, 25, keep, share, slow)
    for t in (0, 3, 7, 24, 25, 40, 59):
        w, u = one_window(loss[max(0, t - 24) : t + 1], keep, share, slow)
        assert np.allclose(weights[t], w, atol=1e-10) and abs(trade[t] - u) < 1e-10


def test_ridge():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(50, 2)), rng.normal(size=50)
    x[9, 0] = np.nan
    got = learners.ridge(x, y, 20, 0.9, np.array([0.1, -0.2]), np.array([2.0, 3.0]))
    assert np.allclose(got[:2], [0.1, -0.2])
    for t in (5, 12, 30, 49):
        a, b = np.diag([2.0, 3.0]), np.array([0.2, -0.6])
        for s in range(max(0, t - 21), t - 1):
            if s != 9:
                a, b = a + 0.9 ** (t - 2 - s) * np.outer(x[s], x[s]), b + 0.9 ** (t - 2 - s) * x[s] * y[s]
        assert np.allclose(got[t], np.linalg.solve(a, b))


def test_hrp_and_clusters():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(800, 3))
    x = np.repeat(base, 5, axis=1) + 0.1 * rng.normal(size=(800, 15))
    assert len(set(portfolio.clusters(np.corrcoef(x.T)))) == 3
    two = np.cov(np.stack([rng.normal(size=500), 3 * rng.normal(size=500)]))
    w = portfolio.hrp(two)
    assert w.sum() == pytest.approx(1) and w[0] / w[1] == pytest.approx(two[1, 1] / two[0, 0])
    assert portfolio.hrp(np.diag([1.0, 0.0, 1.0]))[1] == 0 and np.allclose(portfolio.hrp(np.zeros((2, 2))), 0.5)


def test_nested_selection(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(0.05, 1, 200)
    series = {"a": a, "b": a + 0.1 * rng.normal(size=200), "c": rng.normal(0.1, 1, 200), "d": np.zeros(200)}
    rows = [(k, i, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "asset string, ts long, bar_idx long, ret double")
    picked = portfolio.nested_selection(df, 50, 0.0, 252.0, history=60).collect()
    for block in range(5):
        past = {k: x[: block * 50] for k, x in series.items()}
        want: list[str] = []
        if block in (2, 3):
            ratio = {k: x.mean() / x.std(ddof=1) if x.std() > 0 else 0.0 for k, x in past.items()}
            mix = lambda names: (m := np.mean([past[k] for k in names], axis=0)).mean() / m.std(ddof=1) if np.std([past[k] for k in names]) > 0 else 0.0
            names = sorted((k for k in ratio if ratio[k] >= 0), key=lambda k: (-ratio[k], k))
            want = names[:1]
            while True:
                free = [k for k in names if k not in want and past[k].std() > 0 and all(abs(np.corrcoef(past[k], past[t])[0, 1]) <= 0.6 for t in want)]
                best = max(free, key=lambda k: mix([*want, k]), default=None)
                if best is None or mix([*want, best]) <= mix(want):
                    break
                want.append(best)
        assert sorted(r["series"] for r in picked if r["block_id"] == block) == sorted(want)
    assert portfolio.nested_selection(df.filter("false"), 50, 0.0, 252.0).count() == 0


def test_weights_and_trials_of_tables(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 4)) * [1, 2, 3, 4]
    x[:, 1] = 2 * x[:, 0] + 0.01 * rng.normal(size=300)
    df = spark.createDataFrame([(f"s{k}", i, float(x[i, k])) for k in range(4) for i in range(300)], "asset string, ts long, ret double")
    got = {r["series"]: r["weight"] for r in portfolio.hrp_weights(df).collect()}
    assert np.allclose([got[f"s{k}"] for k in range(4)], portfolio.hrp(np.cov(x.T)))
    rows = portfolio.effective_trials(df).collect()
    label = {r["series"]: r["cluster"] for r in rows}
    assert label["s0"] == label["s1"] and {r["n_eff"] for r in rows} == {len(set(label.values()))}
    assert portfolio.hrp_weights(df.filter("false")).count() == 0


def test_contracts(spark):
    cases = [(2.49, 2.0, 2), (2.59, 2.0, 2), (2.61, 2.0, 3), (-0.5, 0.0, -1), (1.2, -1.0, 1), (0.0, 3.0, 0), (None, 3.0, 0), (float("nan"), 1.0, 0)]
    df = spark.createDataFrame(cases, "target double, held double, want long")
    assert df.filter(~portfolio.whole_contracts(F.col("target"), F.col("held")).eqNullSafe(F.col("want"))).count() == 0
    level = df.limit(1).select(portfolio.future_level(F.lit(102.0), F.lit(100.0), F.lit(4000.0), F.lit(2.0), 0.25).alias("x")).first()["x"]
    assert level == 4040.0


def test_ladders_and_the_split_learner():
    assert [len(learners.ladder(x)) for x in learners.LADDERS] == [8, 16, 8, 16, 8, 18]
    assert [e.label for e in learners.ladder("hedge_split", "countertrend")][:3] == ["fade_5_h1", "fade_5_h3", "fade_10_h1"] and learners.ladder("hedge_wide", "trend")[-1].label == "follow_kel80x2"
    assert learners.learner_of("hedge_long")[0] == 750 and {e.span for e in learners.ladder("hedge_split", "trend")} == {20, 40, 80}
    rng = np.random.default_rng(9)
    loss = rng.random((80, 5))
    weights, trade = learners.split_committee(loss, 2, False)
    own = [learners.committee(loss[:, p], *_learner(x))[0] for p, x in ((slice(0, 2), learners.FOLLOW_LEARNER), (slice(2, 5), learners.FADE_LEARNER))]
    top = np.full((80, 2), 0.5)
    for t in range(1, 80):
        top[t] = [own[0][t - 1] @ loss[t, :2], own[1][t - 1] @ loss[t, 2:]]
    u, want = learners.committee(top, *_learner(learners.TOP_LEARNER))
    assert np.allclose(weights, np.concatenate([u[:, :1] * own[0], u[:, 1:] * own[1]], axis=1)) and np.allclose(trade, want) and np.allclose(weights.sum(1), 1)


def _learner(of):
    keep, share, slow = learners.rungs(of[0], of[1], False)
    return of[0], keep, share, slow


def test_ridge_with_fixed_coefficients():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    prior, stiff = np.array([0.3, 0.1, -0.2]), np.array([np.inf, 2.0, np.inf])
    got = learners.ridge(x, y, 25, 0.95, prior, stiff)
    alone = learners.ridge(x[:, 1:2], y - 0.3 * x[:, 0] + 0.2 * x[:, 2], 25, 0.95, prior[1:2], stiff[1:2])
    assert np.allclose(got[:, 0], 0.3) and np.allclose(got[:, 2], -0.2) and np.allclose(got[:, 1], alone[:, 0])


def test_experts_of_a_split_ladder(spark):
    """Stances and losses of every expert against one bar at a time."""
    from barloom.plans.learning import ATR, COST, experts
    from barloom.sources.synthetic import synthetic_bars

    bars, every = synthetic_bars(spark, [6], 160), learners.ladder("hedge_split")
    d = bars.orderBy("ts").toPandas()
    rows = experts(bars, every, "long_only").orderBy("bar_idx").collect()
    h, low, c = (d[x].to_numpy() for x in ("high", "low", "close"))
    before = np.concatenate(([np.nan], c[:-1]))
    tr = np.fmax(h - low, np.fmax(abs(h - before), abs(low - before)))
    atr = np.array([tr[t - ATR + 1 : t + 1].mean() if t >= ATR - 1 else np.nan for t in range(len(c))])
    for k, e in enumerate(every):
        last, side, held = -1, 0, np.zeros(len(c))
        edge = lambda t, s, e=e: ((h[t - e.n + 1 : t + 1].max() if s > 0 else low[t - e.n + 1 : t + 1].min()) if e.kind == "donchian" else c[t - e.n + 1 : t + 1].mean() + s * e.k * atr[t]) if t >= e.n - 1 else np.nan
        for t in range(1, len(c)):
            up, down = h[t] >= edge(t - 1, 1), low[t] <= edge(t - 1, -1)
            if up != down:
                last, side = t, e.side if up else -e.side
            held[t] = side if last >= 0 and t - last < e.span and side > 0 else 0
            formed = not np.isnan(edge(t, 1))
            pay = (held[t - 1] * (c[t] - c[t - 1]) - c[t] * COST * abs(held[t] - held[t - 1])) / atr[t - 1] / 2
            want = 0.5 * (1 - min(1, max(-1, pay))) if formed and not np.isnan(pay) else 0.5
            assert rows[t]["stances"][k] == held[t] and rows[t]["losses"][k] == pytest.approx(want)


def test_chunks_equal_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = spark.createDataFrame([("a", i, rng.choice([-1.0, 0.0, 1.0], 3).tolist(), rng.random(3).tolist(), rng.normal(size=2).tolist(), float(rng.normal())) for i in range(230)], "asset string, bar_idx long, stances array<double>, losses array<double>, features array<double>, y double")
    ask = lambda: [
        [tuple(np.round(r["weights"], 12)) + (round(r["position"], 12),) for r in learners.hedge(rows, 40, (5, 10)).orderBy("bar_idx").collect()],
        [round(r["forecast"], 10) for r in learners.ridge_forecasts(rows, 30, 20).orderBy("bar_idx").collect()],
    ]
    whole = ask()
    monkeypatch.setattr(learners, "CHUNK", 64)
    assert ask() == whole and len(whole[0]) == len(whole[1]) == 230


def test_flat_windows_have_no_correlation(spark):
    from barloom.functions import indicators as ind

    bars = spark.createDataFrame([("a", i, i, 5.0 if i < 12 else float(i)) for i in range(24)], "asset string, ts long, bar_idx long, close double")
    got = [r["c"] for r in bars.select("bar_idx", ind.trend_correlation(8).alias("c")).orderBy("bar_idx").collect()]
    assert got[:7] == [None] * 7 and got[7:12] == [0.0] * 5 and got[-1] == pytest.approx(1)


def test_static_selection(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(0.1, 1, 300)
    series = {"a": a, "a2": a + 0.05 * rng.normal(size=300), "b": rng.normal(0.12, 1, 300), "c": rng.normal(-0.3, 1, 300), "flat": np.zeros(300)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "asset string, ts long, ret double")
    got = {r["series"]: r["weight"] for r in portfolio.static_selection(df, 0.1, 252.0).collect()}
    assert len(got) == 2 and "b" in got and len({"a", "a2"} & set(got)) == 1 and set(got.values()) == {0.5}
    two = {r["series"] for r in portfolio.static_selection(df, 0.1, 252.0, most=2, method="cluster").collect()}
    assert "b" in two and len(two) == 2
    weighed = {r["series"]: r["weight"] for r in portfolio.static_selection(df, 0.1, 252.0, weighting="hrp").collect()}
    assert sum(weighed.values()) == pytest.approx(1) and set(weighed) == set(got)


@pytest.mark.parametrize(
    ("sharing", "final", "trades", "total"), [(True, 97517.19454785736, 15, 89244596.95579053), (False, 99813.97830555258, 13, 90173843.35899201)]
)
def test_known_results_of_a_learned_channel(spark, sharing, final, trades, total):
    """Published results of the ladder's averaged channel and learned direction as orders."""
    import pandas as pd

    from barloom.operators import ladders, simulation
    from barloom.sources.synthetic import regime_walk

    local = regime_walk(900, 13)
    local = local.assign(asset="x", bar_idx=range(900), ts=pd.date_range("2001-01-01", periods=900))
    bars = ladders.with_ladder(spark.createDataFrame(local), sharing=sharing)
    plan = spark.createDataFrame([(0, "learned", "ladder", "target_stop")], "trial_id int, direction string, channel string, exit string")
    got = simulation.simulated(bars, plan, "bars", first=100).toPandas().sort_values("bar_idx")
    assert got.equity.iloc[-1] == pytest.approx(final, rel=1e-11) and got.equity.sum() + 100 * 100_000 == pytest.approx(total, rel=1e-11)
    assert simulation.simulated(bars, plan, "totals", first=100).first()["n_trades"] == trades


def test_ladder_columns(spark):
    from barloom.operators import ladders, learners
    from barloom.sources.synthetic import synthetic_bars

    bars = synthetic_bars(spark, [6], 520)
    d = bars.orderBy("ts").toPandas()
    for name, mode in (("hedge", "trend"), ("hedge_wide", "learned")):
        rows = ladders.committee(bars, name, mode).orderBy("bar_idx").toPandas()
        got = ladders.with_ladder(bars, name, mode).orderBy("bar_idx").toPandas()
        told = ladders.told(ladders.committee(bars, name, mode), name, mode).orderBy("bar_idx").toPandas()
        ladder, warm = learners.ladder(name, mode), ladders.warmup(name, mode)
        w, losses = np.array(rows.weights.tolist()), np.nan_to_num(np.array(rows.losses.tolist(), float), nan=0.5)
        assert got[["upper", "lower_x", "learned"]][:warm].isna().all().all() and got[["upper", "lower", "upper_x", "mid_x", "learned"]][warm:].notna().all().all()
        tr = np.fmax(d.high - d.low, np.fmax((d.high - d.close.shift()).abs(), (d.low - d.close.shift()).abs()))
        tr[0] = np.nan
        for column, scale in (("upper", 1), ("upper_x", 0.5)):
            want = np.zeros(len(d))
            for k, e in enumerate(ladder):
                n = int(e.n * scale)
                high = d.high.rolling(n).max() if e.kind == "donchian" else d.close.rolling(n).mean() + e.k * tr.rolling(20).mean()
                want += w[:, k] * high.to_numpy()
            np.testing.assert_allclose(got[column][warm:], want[warm:], rtol=1e-9)
        side = w @ np.array([e.side for e in ladder])
        want = np.where(side < 0, -1, 1) * rows.position.abs() if name == "hedge_wide" else np.ones(len(d))
        np.testing.assert_allclose(got.learned[warm:], want[warm:], rtol=1e-9, atol=1e-12)
        played = np.append(0.5, (w[:-1] * losses[1:]).sum(axis=1))
        np.testing.assert_allclose(told.surprise, np.maximum(played - losses.min(axis=1), 0), atol=1e-12)
        assert set(told.expert_weights[warm]) == {e.label for e in ladder} and np.allclose(told.net, np.clip(side, -1, 1))
    assert ladders.warmup("hedge") == 410 and ladders.warmup("hedge_long") == 750 + 320 and ladders.warmup("hedge_split") == 500 + 160 + 1 + 120
