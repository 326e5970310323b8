"""Families of templates and their lattices."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import families, search, simulation
from barloom.sources.synthetic import synthetic_bars


@pytest.mark.parametrize(("family", "n"), [("quick", 72), ("default", 768), ("online", 27), ("online_long", 27), ("online_forecast", 3), ("full", 32_400)])
def test_sizes_and_names(spark, family, n):
    rows = families.templates(spark, family).select("template", "number").collect()
    assert len(rows) == n == len({r["template"] for r in rows}) == len({r["number"] for r in rows})


def test_names_and_refusals(spark):
    names = {r["template"] for r in families.templates(spark, "full").collect()}
    assert {"TR-don-stop-chan-noreg-noV-noB", "LN-hdw-pb-time-hurst:range-V-B-S", "CT-kel-cls-tgt-adx:trend-noV-B-L"} <= names
    stance = [r for r in families.templates(spark, "online").collect() if r["entry"] == "stance"]
    assert len(stance) == 3 and {r["exit"] for r in stance} == {"channel"}
    assert families.templates(spark, "quick", most=5).count() == 5
    assert [r["template"] for r in families.templates(spark, "quick", most=1).collect()] == ["TR-don-stop-chan-noreg-noV-noB"]
    for wrong in ({"channel": ("donchian",), "entry": ("stance",)}, {"channel": ("forecast",), "entry": ("stop",)}, {"channel": ("hedge",), "entry": ("stance",), "vol_filter": (True,)}):
        with pytest.raises(ValueError, match="stance"):
            families.templates(spark, "quick", **wrong)


@pytest.mark.parametrize("wide", [False, True])
def test_lattices(spark, wide):
    rows = families.templates(spark, "default", channel=("donchian", "keltner", "hedge"), entry=("stop", "pullback"), bias_filter=("none",), regime=(("er", "none"), ("adx", "trend_only"))).withColumn("n", families.n_points(wide))
    sizes = {r["template"]: r for r in rows.collect()}
    keep = rows.filter("n < 500")
    got = families.lattices(keep, wide).toPandas()
    assert got.trial_id.tolist() != [] and sorted(got.trial_id) == list(range(len(got)))
    for name, part in got.groupby("template"):
        r = sizes[name]
        coords = np.array(part.coord.tolist())
        assert len(part) == r["n"] == len({tuple(c) for c in coords}) and coords.shape[1] == 9
        varied = [p for k, p in enumerate(families.PARAMETERS) if coords[:, k].max() > 0]
        online = r["channel"] == "hedge"
        want = [] if online else ["n_entry"]
        want += {"channel": [] if online else ["n_exit"], "atr_trail": ["trail_mult"], "target_stop": ["stop_mult", "target_mult"], "time_stop": ["max_hold"]}[r["exit"]]
        want += ["channel_k"] if r["channel"] == "keltner" else []
        want += ["stop_mult"] if wide and not online and r["exit"] != "target_stop" else []
        want += ["pullback_mult"] if r["entry"] == "pullback" else []
        want += ["regime_threshold"] if r["regime_filter"] != "none" else []
        assert set(varied) == set(want)
        for k, p in enumerate(families.PARAMETERS):
            if p in varied:
                by = part.assign(_c=coords[:, k]).groupby("_c")[p].unique()
                assert all(len(v) == 1 for v in by) and [v[0] for v in by] == sorted(v[0] for v in by)
            elif p != "regime_threshold":
                assert (part[p] == simulation.PLAN[p]).all()
    if not wide:
        assert set(got.n_entry) == {20, 40, 60, simulation.PLAN["n_entry"]} and sizes["TR-kel-stop-tgt-adx:trend-noV-noB"]["n"] == 3 * 2 * 2 * 2 * 3


def test_a_family_walks_forward_as_its_templates_alone(spark):
    bars = synthetic_bars(spark, [3], 420)
    rows = families.templates(spark, "quick", direction=("trend",), entry=("stop",), exit=("atr_trail", "channel"), vol_filter=(False,), regime=(("er", "none"), ("er", "trend_only")))
    plans = families.lattices(rows)
    how = {"least_trades": 1, "train": 200, "test": 60}
    both = {(r["template"], r["window_id"]): r for r in search.walked(bars, plans, 9, **how)[0].collect()}
    assert len({t for t, _ in both}) == 4
    for name in sorted({t for t, _ in both}):
        alone = search.walked(bars, plans.filter(F.col("template") == name).drop("template"), 9, **how)[0].collect()
        for r in alone:
            got = both[name, r["window_id"]]
            # the longest warm-up is that of all the lattices, so spans may begin later with more templates
            assert got["test_start"] == r["test_start"] and (got["trial_id"] is None) == (r["trial_id"] is None)
    assert any(r["trial_id"] is not None for r in both.values())


def test_plateau_of_lattices_with_flat_dimensions(spark):
    rng = np.random.default_rng(1)
    points = list(itertools.product(range(3), [0], range(4), [0]))
    rows = [("g", k, list(c), float(v) if v > -1.0 else None) for k, (c, v) in enumerate(zip(points, rng.normal(size=len(points)), strict=True))]
    scores = spark.createDataFrame(rows, "g string, trial_id int, coord array<int>, score double")
    flat = search.plateau(scores, ["g"], 4)
    thin = search.plateau(scores.withColumn("coord", F.array(F.get("coord", F.lit(0)), F.get("coord", F.lit(2)))), ["g"], 2)
    own = lambda d: [(r["trial_id"], r["smooth"] and round(r["smooth"], 12), r["picked"]) for r in d.orderBy("trial_id").collect()]
    assert own(flat) == own(thin)
    coords = np.array([r[2] for r in rows])
    value = np.array([np.nan if r[3] is None else r[3] for r in rows])
    assert [r["trial_id"] for r in flat.filter("picked").collect()] == [search.pick(value, coords, np.arange(len(rows)))]
