"""Ladders of experts as plans: each expert's stance and loss, and the committee's channel, direction and size as columns of the bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.operators import learners
from barloom.sources import stored

#: Bars of the range that moves are measured in, and the cost of a side.
ATR, COST = 20, 0.0005
#: How much shorter the channel of exits is, and the ladders whose entries the committee's position sizes.
EXIT_SCALE, SIZED = 0.5, ("hedge_wide", "hedge_wide_slow", "hedge_split")


def band(e: learners.Expert, atr: Column, scale: float = 1.0) -> tuple[Column, Column]:
    """High and low edge of an expert's channel at ``scale`` times its length."""
    n = e.n if scale == 1.0 else max(2, math.floor(e.n * scale + 0.5))
    if e.kind == "donchian":
        return ind.donchian(n)[:2]
    middle, width = ind.sma(F.col("close"), n), e.k * atr
    return middle + width, middle - width


def experts(bars: DataFrame, ladder: list[learners.Expert] | None = None, sides: str = "both", cost: float = COST, atr: int = ATR) -> DataFrame:
    """asset, bar_idx, stances, losses: the side of each expert's last channel break, and its loss on this bar's move.

    A break stays the stance for the expert's span; a stance on a side that ``sides`` bars is flat.
    """
    ladder = ladder or [learners.Expert("donchian", n) for n in learners.RUNGS]
    which = range(len(ladder))
    rows = bars.withColumn("_tr", ind.true_range()).withColumn("_a", ind.sma(F.col("_tr"), atr))
    edges = {}
    for k, e in enumerate(ladder):
        high, low = band(e, F.col("_a"))
        edges |= {f"_h{k}": high, f"_b{k}": low}
    rows = rows.withColumns(edges)
    rows = rows.withColumns({f"_g{k}": e.side * ind.break_signal(F.col(f"_h{k}"), F.col(f"_b{k}")).cast("double") for k, e in enumerate(ladder)})
    barred = {"both": F.lit(0.0), "long_only": F.lit(-1.0), "short_only": F.lit(1.0)}[sides]
    last = lambda k, e: F.coalesce(F.last(f"_g{k}", ignorenulls=True).over(ind.back(e.span)), F.lit(0.0))
    rows = rows.withColumns({f"_s{k}": F.when(last(k, e) * barred > 0, F.lit(0.0)).otherwise(last(k, e)) for k, e in enumerate(ladder)})
    rows = rows.withColumn("_a", F.nullif(ind.lag(F.col("_a")), F.lit(0.0)))
    move, paid = (F.col("close") - ind.lag(F.col("close"))) / F.col("_a"), F.abs(F.col("close")) * cost / F.col("_a")
    rows = rows.withColumns({"_z": move, "_c": paid} | {f"_p{k}": ind.lag(F.col(f"_s{k}")) for k in which})
    loss = lambda k: ind.stance_loss(F.col(f"_p{k}"), F.col(f"_s{k}"), F.col("_z"), F.col("_c"), F.col(f"_h{k}").isNotNull())
    return rows.select("asset", "bar_idx", F.array(*(f"_s{k}" for k in which)).alias("stances"), F.array(*(loss(k) for k in which)).alias("losses"))


def warmup(name: str, mode: str = "learned", atr: int = ATR) -> int:
    """Bars before the first on which a ladder says what the whole history would make it say."""
    formed = lambda e: e.n - 1 if e.kind == "donchian" else max(e.n - 1, atr)
    lead = lambda ladder: max(max(e.span + formed(e) + 1 for e in ladder), atr + 1)
    if name != "hedge_split":
        return learners.learner_of(name)[0] + lead(learners.ladder(name, mode))
    own = [learner[0] + lead(learners.ladder(name, way)) for learner, way in ((learners.FOLLOW_LEARNER, "trend"), (learners.FADE_LEARNER, "countertrend"))]
    return max(own) + 1 + learners.TOP_LEARNER[0]


def committee(bars: DataFrame, name: str = "hedge", mode: str = "learned", sides: str = "both", sharing: bool = True, cost: float = COST, atr: int = ATR) -> DataFrame:
    """asset, bar_idx, weights, trade, position of a ladder's learner, with its experts' stances and losses."""
    rows = stored.kept(experts(bars, learners.ladder(name, mode), sides if name in SIZED else "both", cost, atr))
    memory, lifetimes = learners.learner_of(name)
    followers = None
    if name == "hedge_split":
        memory, lifetimes = {"trend": learners.FOLLOW_LEARNER, "countertrend": learners.FADE_LEARNER, "learned": (memory, lifetimes)}[mode]
        followers = len(learners.ladder(name, "trend")) if mode == "learned" else None
    return learners.hedge(rows, memory, lifetimes, sharing, followers).join(rows, ["asset", "bar_idx"])


def net_side(ladder: list[learners.Expert]) -> Column:
    """Weight of the following experts less that of the fading ones."""
    side = sum((F.get("weights", F.lit(k)) * float(e.side) for k, e in enumerate(ladder)), F.lit(0.0))
    return F.least(F.greatest(side, F.lit(-1.0)), F.lit(1.0))


def told(rows: DataFrame, name: str = "hedge", mode: str = "learned") -> DataFrame:
    """The committee row by row: net side weight, weight of each expert by label, surprise (loss of the weights of the bar before less the best expert's)."""
    ladder = learners.ladder(name, mode)
    before = F.lag("weights").over(Window.partitionBy("asset").orderBy("bar_idx"))
    loss = F.transform("losses", lambda x: F.coalesce(F.nanvl(x, F.lit(0.5)), F.lit(0.5)))
    played = F.aggregate(F.zip_with(before, loss, lambda w, x: w * x), F.lit(0.0), lambda a, x: a + x)
    surprise = F.greatest(F.coalesce(played, F.lit(0.5)) - F.array_min(loss), F.lit(0.0))
    named = F.map_from_arrays(F.array(*(F.lit(e.label) for e in ladder)), F.col("weights"))
    return rows.select("asset", "bar_idx", net_side(ladder).alias("net"), named.alias("expert_weights"), surprise.alias("surprise"), "trade", "position")


def with_ladder(bars: DataFrame, name: str = "hedge", mode: str = "learned", sides: str = "both", sharing: bool = True, cost: float = COST, atr: int = ATR) -> DataFrame:
    """The bars with what a plan of channel "ladder" and direction "learned" reads, null until the learner has formed.

    upper, lower, upper_x, lower_x, mid_x: the experts' channels (shorter ones for exits) averaged by their weights. learned: which
    way breaks are taken and how large. On a sized ladder that is the committee's position, on others the net weight of
    following over fading, and 1 for a ladder of one side.
    """
    ladder = learners.ladder(name, mode)
    rows = committee(bars, name, mode, sides, sharing, cost, atr)
    state = rows.select("asset", "bar_idx", "weights", "position", net_side(ladder).alias("net"))
    b = bars.withColumn("_tr", ind.true_range()).withColumn("_a", ind.sma(F.col("_tr"), atr))
    edges = {}
    for part, scale in (("", 1.0), ("_x", EXIT_SCALE)):
        for k, e in enumerate(ladder):
            high, low = band(e, F.col("_a"), scale)
            edges |= {f"_h{part}{k}": high, f"_l{part}{k}": low}
    b = b.withColumns(edges).join(state, ["asset", "bar_idx"], "left")
    formed = F.col("bar_idx") >= warmup(name, mode, atr)
    mean = lambda side, part: F.when(formed, sum((F.get("weights", F.lit(k)) * F.col(f"_{side}{part}{k}") for k in range(len(ladder))), F.lit(0.0)))
    size = F.abs("position")
    if mode == "learned":
        way = F.when(F.col("net") < 0, -size).otherwise(size) if name in SIZED else F.col("net")
    else:
        way = (1.0 if mode == "trend" else -1.0) * (size if name in SIZED else F.lit(1.0))
    out = b.withColumns({"upper": mean("h", ""), "lower": mean("l", ""), "upper_x": mean("h", "_x"), "lower_x": mean("l", "_x"), "learned": F.when(formed, way)})
    return out.withColumn("mid_x", (F.col("upper_x") + F.col("lower_x")) / 2).select(*bars.columns, "upper", "lower", "upper_x", "lower_x", "mid_x", "learned")
