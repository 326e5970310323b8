"""Slots over a stream against the batch simulation of the same bars."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import search, simulation
from barloom.plans import research
from barloom.sources.synthetic import synthetic_bars
from barloom.streaming.slots import OUTPUTS, Slots, streamed_slots

KINDS = ["asset", "trial_id"]


def ordered(frame):
    frame = frame.astype({c: "float64" for c in frame.columns if frame[c].dtype.kind in "if"})
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def equal(got, want):
    pd.testing.assert_frame_equal(ordered(got[want.columns]), ordered(want), check_dtype=False, check_exact=True)


def local(bars, asset):
    return bars.filter(F.col("asset") == asset).orderBy("ts").toPandas()


@pytest.mark.parametrize("output", OUTPUTS)
def test_one_bar_at_a_time_is_the_batch(spark, output):
    """Every cut of the bars gives the same rows, to the bit."""
    b = local(synthetic_bars(spark, [3], 260), "seed-3").assign(roll=lambda d: (d.index % 40 == 0).astype(float))
    plans = research.plans(spark).toPandas().sort_values("trial_id").iloc[::5].reset_index(drop=True)
    account = simulation.Account(roll_cost=0.5, whole_units=True)
    want = simulation._run_group(output, b, plans, account, 60)
    for cuts in ([1, 2, 3, 50, 61, 62, 150, 259], list(range(200, 260))):
        slots, parts = Slots(plans, account, 60), []
        for part in np.split(np.arange(260), cuts):
            parts.append(slots.update(b.iloc[part], part, output))
        if output in ("states", "next_orders"):
            equal(parts[-1], want)
        else:
            equal(pd.concat(parts, ignore_index=True), want)


@pytest.fixture
def feed(spark, tmp_path):
    """Bars of two assets that arrive in files; a late bar and a repeated one among them."""
    bars = synthetic_bars(spark, [3, 4], 300).withColumn("ts", F.col("ts").cast("timestamp")).select("asset", "ts", "bar_idx", "open", "high", "low", "close")
    rows = bars.orderBy("asset", "bar_idx").toPandas()

    def add(low, high):
        part = rows[(rows.bar_idx >= low) & (rows.bar_idx < high)]
        odd = rows[(rows.bar_idx == low - 1)].assign(close=-1.0)  # late: this bar is known already
        table = spark.createDataFrame(pd.concat([part, odd]), bars.schema).drop("bar_idx")
        table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(**how):
        stream = spark.readStream.schema(bars.drop("bar_idx").schema).parquet(str(tmp_path / "in"))
        query = streamed_slots(stream, **how).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
        return spark.read.parquet(str(tmp_path / "out")).toPandas()

    return bars, add, run


def test_a_stream_with_restarts_is_the_batch(spark, feed):
    bars, add, run = feed
    plans = research.plans(spark).toPandas().sort_values("trial_id").iloc[::9].reset_index(drop=True)
    for low, high in ((0, 1), (1, 120), (120, 121), (121, 300)):  # each run goes on from the checkpoint
        add(low, high)
        got = run(plans=plans, output="trades", first=50)
    equal(got, simulation.simulated(bars, spark.createDataFrame(plans), "trades", first=50).toPandas())
    assert len(got) > 50 and set(got.asset) == {"seed-3", "seed-4"}


def test_new_plans_start_flat_on_the_next_bar(spark, feed):
    bars, add, run = feed
    points = research.lattice_plans(spark)
    warm = points.agg(F.max(search.warmup(points))).first()[0]
    plans = points.drop("coord").toPandas().sort_values("trial_id").reset_index(drop=True)
    old, new = plans.iloc[[0, 4]], plans.iloc[[7, 11, 13]]
    add(0, 180)
    run(plans=old, output="trades", first=warm, version="a")
    add(180, 300)
    got = run(plans=new, output="trades", warm=warm, version="b")
    spans = spark.createDataFrame([(a, 0, 180, 300) for a in ("seed-3", "seed-4")], "asset string, window_id long, start long, stop long")
    want = simulation.windowed(bars, spans, spark.createDataFrame(new), warm, "trades").drop("window_id").toPandas()
    equal(got[got.trial_id.isin(new.trial_id)], want)
    before = simulation.simulated(bars.filter("bar_idx < 180"), spark.createDataFrame(old), "trades", first=warm).toPandas()
    equal(got[got.trial_id.isin(old.trial_id)], before)
    assert len(want) > 3 and len(before) > 3


def test_what_a_stream_cannot_return(spark, feed):
    with pytest.raises(ValueError, match="no output"):
        streamed_slots(feed[0], pd.DataFrame({"trial_id": [0]}), output="totals")
