"""What the stamps of bars say: sessions, bars and sessions a year, regular or not."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import metrics

#: Minutes between the cuts that are tried, and bars to a session above which bars are intraday.
WIDTHS, INTRADAY = (15, 30, 60, 120, 240), 1.5
DAY = 1440


def _steps(bars: DataFrame) -> DataFrame:
    """asset, a, b: minutes of each bar's stamp and of the one before it, with the asset's usual step and cut width."""
    minute = F.unix_micros(F.col("ts").cast("timestamp")) / 6e7
    by = Window.partitionBy("asset").orderBy("ts")
    rows = bars.select("asset", minute.alias("b"), F.lag(minute).over(by).alias("a")).filter("a IS NOT NULL")
    usual = rows.filter("b > a").groupBy("asset").agg(F.median(F.col("b") - F.col("a")).alias("spacing"))
    width = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS):
        width = F.when(F.col("spacing") <= w, F.lit(w)).otherwise(width)
    return rows.join(usual.withColumn("width", width.cast("long")), "asset")


def cut_counts(bars: DataFrame) -> DataFrame:
    """asset, cut (minute of the day), sessions, sliced: sessions that a cut makes, and steps of continuous trading that it slices.

    A step meets only the cuts that lie in it, so a bar is not repeated for all of them.
    """
    s = _steps(bars)
    count = F.lit(DAY) / F.col("width")
    low, high = F.floor(F.col("a") / F.col("width")).cast("long") + 1, F.floor(F.col("b") / F.col("width")).cast("long")
    met = s.filter(low <= high).select(
        "asset", "width", ((F.col("b") - F.col("a")) <= 1.5 * F.col("spacing")).cast("long").alias("trading"), F.explode(F.sequence(low, F.least(high, low + count.cast("long") - 1))).alias("m")
    )
    cut = F.pmod(F.col("m") * F.col("width"), F.lit(DAY)).cast("long")
    found = met.groupBy("asset", cut.alias("cut")).agg(F.count(F.lit(1)).alias("n"), F.sum("trading").alias("sliced"))
    every = s.select("asset", "width").distinct().select("asset", F.explode(F.sequence(F.lit(0).cast("long"), DAY - F.col("width"), F.col("width"))).alias("cut"))
    zero = F.lit(0).cast("long")
    return every.join(found, ["asset", "cut"], "left").select("asset", "cut", (F.coalesce("n", zero) + 1).alias("sessions"), F.coalesce("sliced", zero).alias("sliced"))


def best_cut(sessions: np.ndarray, sliced: np.ndarray, width: int) -> int:
    """The middle of the longest stretch (around midnight too) of cuts with nearly the fewest sessions.

    Counts within 1 % (or one) of the least are alike. Where a cut hardly slices trading, only such cuts count; where all cuts
    are alike the day is cut at midnight.
    """
    near = lambda n: max(1, int(0.01 * n))
    good = sessions <= sessions.min() + near(int(sessions.min()))
    least = sliced[good].min()
    if least <= near(int(np.median(sliced[good]))):
        good &= sliced <= least + near(int(least))
    if good.all():
        return 0
    n = len(good)
    ends = np.flatnonzero(~good)
    gaps = np.diff(np.append(ends, ends[0] + n)) - 1
    k = int(np.argmax(gaps))
    return int((ends[k] + 1 + (gaps[k] - 1) // 2) % n * width)


def session_cuts(bars: DataFrame) -> DataFrame:
    """asset, cut: the minute of the day that sessions are cut at, from the at most 96 counts of each asset."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("cut")
        width = int(DAY // len(d))
        return pd.DataFrame({"asset": [d["asset"].iloc[0]], "cut": [best_cut(d["sessions"].to_numpy(), d["sliced"].to_numpy(), width)]})

    return cut_counts(bars).groupBy("asset").applyInPandas(run, "asset string, cut long")


def sessions(bars: DataFrame, cuts: DataFrame) -> DataFrame:
    """The bars with the date of their session."""
    day = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 6e7 - F.col("cut")) / DAY).cast("int")
    return bars.join(F.broadcast(cuts), "asset").withColumn("session", F.date_from_unix_date(day)).drop("cut")


def annualization(bars: DataFrame) -> DataFrame:
    """asset, per_year, sessions_per_year (null for daily and longer bars), cut of assets with three bars or more over some time."""
    n = bars.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).filter("n >= 3 AND last > first")
    own = bars.join(n.select("asset"), "asset", "left_semi")
    cuts = session_cuts(own)
    days = sessions(own, cuts).select("asset", F.col("session").alias("ts")).distinct()
    counts = days.groupBy("asset").agg(F.count(F.lit(1)).alias("n_sessions"))
    per_day = metrics.per_year(days).select("asset", F.col("per_year").alias("_s"))
    every = n.select("asset", "n").join(metrics.per_year(own).select("asset", "per_year"), "asset").join(cuts, "asset").join(counts, "asset").join(per_day, "asset")
    intraday = (F.col("n") / F.col("n_sessions") > INTRADAY) & (F.col("n_sessions") >= 3)
    return every.select("asset", "per_year", F.when(intraday, F.col("_s")).alias("sessions_per_year"), F.when(intraday, F.col("cut")).otherwise(F.lit(0).cast("long")).alias("cut"))


def irregular(bars: DataFrame) -> DataFrame:
    """asset, irregular: whether intraday bars are cut by activity: under half of their steps are the usual one, to a second."""
    s = _steps(bars).withColumn("step", (F.col("b") - F.col("a")) * 60).filter("step > 0")
    usual = F.abs(F.col("step") - F.col("spacing") * 60) <= 1
    return s.groupBy("asset").agg(((F.first("spacing") < DAY) & (F.avg(usual.cast("double")) < 0.5)).alias("irregular"))


def session_sums(rets: DataFrame, key: str = "asset", additive: bool = False) -> DataFrame:
    """key, ts (the session), n, ret of rows (key, ts, session, ret): returns of a session added up, or compounded."""
    whole = F.sum("ret") if additive else F.product(1 + F.col("ret")) - 1
    return rets.groupBy(key, F.col("session").alias("ts")).agg(F.count("ret").alias("n"), whole.alias("ret"))


def observed(rets: DataFrame, rate: DataFrame, key: str = "asset", additive: bool = False) -> DataFrame:
    """key, ts, ret, per_year: returns as statistics take them, by session where bars are intraday, else as they are.

    rets (key, asset, ts, ret); rate is ``annualization`` of the bars. Sharpe ratios, moments and clusters of trials on what this
    gives are those of sessions, however many bars a session has.
    """
    tagged = rets.join(F.broadcast(rate), "asset")  # a row an asset
    day = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 6e7 - F.col("cut")) / DAY).cast("int")
    tagged = tagged.withColumn("session", F.date_from_unix_date(day).cast("timestamp"))
    fine = F.col("sessions_per_year").isNotNull()
    put = tagged.select(key, F.when(fine, F.col("session")).otherwise(F.col("ts").cast("timestamp")).alias("ts"), "ret", F.coalesce("sessions_per_year", "per_year").alias("per_year"))
    whole = F.sum("ret") if additive else F.product(1 + F.col("ret")) - 1
    return put.groupBy(key, "ts").agg(whole.alias("ret"), F.first("per_year").alias("per_year"))


def snapped_groups(rows: DataFrame, n_groups: int, key: str = "asset") -> DataFrame:
    """key, g, lo, hi: ``n_groups`` equal stretches of rows (key, ts, session), their inner bounds moved to the nearest start of a session.

    A bound between two starts goes to the nearer, the earlier on ties. Where that would empty a group, or there is one session,
    the series keeps the even bounds.
    """
    by = Window.partitionBy(key).orderBy("ts")
    nth = rows.select(key, "session", (F.row_number().over(by) - 1).cast("long").alias("at"))
    starts = nth.groupBy(key, "session").agg(F.min("at").alias("at"))
    n = nth.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    even = n.select(key, "n", F.explode(F.sequence(F.lit(0), F.lit(n_groups))).alias("g")).withColumn("even", F.floor(F.col("g") * F.col("n") / n_groups).cast("long"))
    # starts and bounds in one order: the last start before a bound, the first at or after it
    both = starts.select(key, "at", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("g")).unionByName(even.select(key, F.col("even").alias("at"), F.lit(0).alias("kind"), "g"))
    order = Window.partitionBy(key).orderBy("at", "kind")
    start = F.when(F.col("kind") == 1, F.col("at"))
    met = both.withColumns({
        "left": F.last(start, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "right": F.first(start, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
    }).filter("kind = 0")
    last = Window.partitionBy(key)
    near = F.when(F.col("right").isNull() | (F.col("at") - F.col("left") <= F.col("right") - F.col("at")), F.col("left")).otherwise(F.col("right"))
    inner = (F.col("g") > 0) & (F.col("g") < n_groups)
    snapped = met.withColumn("snap", F.when(inner, F.coalesce(near, F.col("at"))).otherwise(F.col("at")))
    step = snapped.withColumn("_d", F.col("snap") - F.lag("snap").over(last.orderBy("g")))
    counted = step.join(starts.groupBy(key).agg(F.count(F.lit(1)).alias("_s")), key)
    fine = (F.min("_d").over(last) > 0) & (F.col("_s") >= 2)
    bound = counted.select(key, "g", F.when(fine, F.col("snap")).otherwise(F.col("at")).alias("lo"))
    return bound.withColumn("hi", F.lead("lo").over(last.orderBy("g"))).filter(F.col("g") < n_groups)


#: Length of each interval in minutes; months are whole ones.
INTERVALS = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "60m": 60, "1h": 60, "90m": 90, "1d": DAY, "1wk": 7 * DAY, "1mo": 30 * DAY}
#: Close of the session and the exchange's zone where no venue is given; minutes that its last print may take.
CLOSE, GRACE = ("16:00", "America/New_York"), 15


def final_at(ts: Column, interval: str, close: Column | None = None, zone: Column | None = None, grace: int = GRACE) -> Column:
    """When the bar stamped ``ts`` is final, in UTC without a zone.

    An intraday stamp is UTC and its bar is final an interval later. A longer bar is stamped with its first date and final when
    the session of its last day has closed on its exchange, whatever daylight saving says, plus the grace.
    """
    if interval not in INTERVALS:
        raise ValueError(f"unknown interval {interval!r}")
    minutes = INTERVALS[interval]
    stamp = ts.cast("timestamp_ntz")
    if minutes < DAY:
        return stamp + F.make_dt_interval(mins=F.lit(minutes))
    first = stamp.cast("date")
    last = F.last_day(first) if interval == "1mo" else F.date_add(first, minutes // DAY - 1)
    close, zone = F.lit(CLOSE[0]) if close is None else close, F.lit(CLOSE[1]) if zone is None else zone
    local = F.concat(last.cast("string"), F.lit(" "), close, F.lit(":00")).cast("timestamp_ntz")
    return F.convert_timezone(zone, F.lit("UTC"), local) + F.make_dt_interval(mins=F.lit(grace))


def closed_bars(bars: DataFrame, interval: str, now: str, venues: DataFrame | None = None, grace: int = GRACE) -> DataFrame:
    """The bars that are final at ``now`` (UTC). venues: asset, close ("16:00"), zone; an asset without one has New York's."""
    columns = bars.columns
    rows = bars
    if venues is not None:
        rows = bars.join(F.broadcast(venues.select("asset", F.col("close").alias("_close"), F.col("zone").alias("_zone"))), "asset", "left")  # a row an asset
        close, zone = F.coalesce("_close", F.lit(CLOSE[0])), F.coalesce("_zone", F.lit(CLOSE[1]))
    else:
        close, zone = None, None
    return rows.filter(final_at(F.col("ts"), interval, close, zone, grace) <= F.lit(now).cast("timestamp_ntz")).select(*columns)


def refits(bars: DataFrame, fits: DataFrame, test_bars: int) -> DataFrame:
    """asset, slot, fitted_on, bars_since, due: bars after each slot's last fit, and whether a test window of them has passed.

    fits: asset, slot, fitted_on (null: never fitted, due at once). Fits take their place among the bars by order, so no bar meets
    the fits after it.
    """
    stamp = lambda c: F.col(c).cast("timestamp_ntz")
    total = bars.groupBy("asset").agg(F.count(F.lit(1)).alias("_n"))
    rows = bars.select("asset", stamp("ts").alias("ts"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("slot")).unionByName(
        fits.filter("fitted_on IS NOT NULL").select("asset", stamp("fitted_on").alias("ts"), F.lit(1).alias("kind"), F.col("slot").cast("string").alias("slot"))
    )
    before = F.sum(1 - F.col("kind")).over(Window.partitionBy("asset").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("_b", before).filter("kind = 1").select("asset", "slot", "_b")
    got = fits.withColumn("slot", F.col("slot").cast("string")).join(placed, ["asset", "slot"], "left").join(total, "asset", "left")
    since = F.coalesce("_n", F.lit(0)) - F.coalesce("_b", F.lit(0))
    return got.select("asset", "slot", "fitted_on", since.cast("long").alias("bars_since"), (F.col("fitted_on").isNull() | (since >= test_bars)).alias("due"))
