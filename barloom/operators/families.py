"""Families of templates and the parameter lattice of each, as tables.

A template is a choice of switches; those without effect are put to one value, so that every structure occurs once. Its lattice
varies the parameters that its switches read. Both grow with the switches, not with any data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import simulation

#: The switches.
DIRECTIONS, FITTED, LADDERS = ("trend", "countertrend", "learned"), ("donchian", "keltner", "bollinger"), ("hedge", "hedge_wide")
ENTRIES, EXITS = ("stop", "close_confirm", "pullback"), ("channel", "atr_trail", "target_stop", "time_stop")
FILTERS, BIASES, SIDES = ("trend_only", "range_only"), ("none", "sma"), ("both", "long_only", "short_only")
_PLAIN = (("er", "none"),)
#: Switches of each family; regimes are pairs of indicator and filter.
FAMILIES: dict[str, dict[str, tuple]] = {
    "quick": {
        "direction": DIRECTIONS[:2], "channel": ("donchian",), "entry": ("stop", "pullback"), "exit": EXITS[:3],
        "regime": (("er", "none"), ("er", "trend_only"), ("er", "range_only")), "vol_filter": (False, True), "bias_filter": ("none",), "sides": ("both",),
    },
    "default": {
        "direction": DIRECTIONS[:2], "channel": ("donchian", "keltner"), "entry": ENTRIES, "exit": EXITS,
        "regime": (("er", "none"), ("er", "trend_only"), ("er", "range_only"), ("adx", "trend_only"), ("cti", "trend_only"), ("chop", "range_only"), ("vr", "trend_only"), ("vr", "range_only")),
        "vol_filter": (False,), "bias_filter": BIASES, "sides": ("both",),
    },
    "online": {"direction": DIRECTIONS, "channel": ("hedge_split",), "entry": ("stop", "close_confirm", "stance"), "exit": EXITS, "regime": _PLAIN, "vol_filter": (False,), "bias_filter": ("none",), "sides": ("both",)},
    "online_long": {"direction": DIRECTIONS, "channel": ("hedge_long",), "entry": ("stop", "close_confirm", "stance"), "exit": EXITS, "regime": _PLAIN, "vol_filter": (False,), "bias_filter": ("none",), "sides": ("both",)},
    "online_forecast": {"direction": DIRECTIONS, "channel": ("forecast",), "entry": ("stance",), "exit": ("channel",), "regime": _PLAIN, "vol_filter": (False,), "bias_filter": ("none",), "sides": ("both",)},
    "full": {
        "direction": DIRECTIONS, "channel": FITTED + LADDERS, "entry": ENTRIES, "exit": EXITS, "regime": _PLAIN + tuple((i, f) for i in simulation.REGIMES for f in FILTERS),
        "vol_filter": (False, True), "bias_filter": BIASES, "sides": SIDES,
    },
}
#: Abbreviations in names.
SHORT = {
    "trend": "TR", "countertrend": "CT", "learned": "LN", "donchian": "don", "keltner": "kel", "bollinger": "bol", "hedge": "hdg", "hedge_wide": "hdw", "hedge_slow": "hds",
    "hedge_wide_slow": "hws", "hedge_split": "hsp", "hedge_long": "hlg", "forecast": "fc", "forecast_ctx": "fcx", "stop": "stop", "close_confirm": "cls", "pullback": "pb",
    "stance": "stance", "channel": "chan", "atr_trail": "trail", "target_stop": "tgt", "time_stop": "time", "trend_only": "trend", "range_only": "range", "long_only": "L", "short_only": "S",
}
#: Values of each parameter, and those that a wide lattice adds.
GRIDS: dict[str, tuple[tuple[float, ...], tuple[float, ...]]] = {
    "n_entry": ((20, 40, 60), (10, 30, 70, 90, 120, 160, 250)), "n_exit": ((10, 20), (5, 15, 30, 50, 80, 120)), "trail_mult": ((2.5, 3.5), (1.5, 2.0, 3.0, 4.5, 6.0, 7.5, 9.0)),
    "stop_mult": ((2.0, 3.0), (1.5, 2.5, 4.0, 5.0, 6.0, 8.0)), "target_mult": ((3.0, 4.0), (2.0, 5.0, 6.0, 8.0, 10.0, 12.0)), "max_hold": ((10, 20), (5, 15, 30, 40, 60, 80, 120)),
    "channel_k": ((1.5, 2.5), (1.0, 2.0, 3.0)), "pullback_mult": ((0.4, 0.7), (0.25, 0.5, 0.75, 1.0)),
}
#: Hard stops of exits that have another rule, in a wide lattice; thresholds of each regime indicator.
HARD_STOPS = (3.0, 4.5, 6.0, 9.0)
THRESHOLDS = {"er": (0.25, 0.35, 0.45), "adx": (20.0, 25.0, 30.0), "cti": (0.4, 0.5, 0.6), "chop": (38.2, 50.0, 61.8), "vr": (0.9, 1.0, 1.1), "mmi": (20.0, 25.0, 30.0), "hurst": (0.45, 0.5, 0.55)}
COLUMNS = ("direction", "channel", "entry", "exit", "regime_indicator", "regime_filter", "vol_filter", "bias_filter", "sides")
PARAMETERS = (*GRIDS, "regime_threshold")


def template_name() -> Column:
    """The name of a template from its switches; one that takes both sides has no mark for them."""
    short = F.create_map(*(x for k, v in SHORT.items() for x in (F.lit(k), F.lit(v))))
    of = lambda c: F.try_element_at(short, F.col(c))
    regime = F.when(F.col("regime_filter") == "none", F.lit("noreg")).otherwise(F.concat("regime_indicator", F.lit(":"), of("regime_filter")))
    marks = (F.when(F.col("vol_filter"), F.lit("V")).otherwise(F.lit("noV")), F.when(F.col("bias_filter") == "sma", F.lit("B")).otherwise(F.lit("noB")))
    side = F.when(F.col("sides") != "both", of("sides"))
    return F.concat_ws("-", of("direction"), of("channel"), of("entry"), of("exit"), regime, *marks, side)


def templates(spark: SparkSession, family: str = "quick", most: int | None = None, **switches: tuple) -> DataFrame:
    """template, number and the switches of a family, each of whose lists may be given instead; ``most`` takes the first so many."""
    lists = FAMILIES[family] | switches
    rows, number, size = spark.range(1), F.lit(0).cast("long"), 1
    for name, values in lists.items():
        if name == "regime":
            one = F.array(*(F.struct(F.lit(i).alias("regime_indicator"), F.lit(f).alias("regime_filter")) for i, f in values))
        else:
            one = F.array(*map(F.lit, values))
        rows = rows.select("*", F.posexplode(one).alias(f"_{name}", name))
    for name, values in reversed(lists.items()):
        number, size = number + F.col(f"_{name}") * size, size * len(values)
    rows = rows.select(number.alias("number"), *(c for c in lists if c != "regime"), "regime.*")
    # switches without effect: an indicator without a filter, the exit of a stance, which its learner decides
    rows = rows.withColumns({
        "regime_indicator": F.when(F.col("regime_filter") == "none", F.lit("er")).otherwise(F.col("regime_indicator")),
        "exit": F.when(F.col("entry") == "stance", F.lit("channel")).otherwise(F.col("exit")),
    })
    once = rows.groupBy(*COLUMNS).agg(F.min("number").alias("number"))
    refused = F.col("channel").isin("forecast", "forecast_ctx") & (F.col("entry") != "stance") | (
        (F.col("entry") == "stance") & (F.col("channel").isin(*FITTED) | (F.col("regime_filter") != "none") | F.col("vol_filter") | (F.col("bias_filter") != "none"))
    )
    bad = once.filter(refused).select(template_name().alias("t")).first()
    if bad:
        raise ValueError(f"{bad['t']}: a stance holds a committee or a forecast and has no filter, and a forecast is held by nothing else")
    named = once.select(template_name().alias("template"), "number", *COLUMNS)
    return named if most is None else named.orderBy("number").limit(most)


def values_of(wide: bool = False) -> dict[str, Column]:
    """For each parameter the values that a template's lattice gives it: null where it does not vary."""
    def listed(name: str) -> Column:
        usual, more = GRIDS[name]
        return F.array(*(F.lit(float(v)) for v in (sorted({*usual, *more}) if wide else usual)))

    col = F.col
    forecast, online = col("channel").isin("forecast", "forecast_ctx"), col("channel").startswith("hedge")
    exit_is = lambda name: col("exit") == name
    stops = F.when(exit_is("target_stop"), listed("stop_mult"))
    if wide:
        stops = stops.when(~online, F.array(*map(F.lit, HARD_STOPS)))
    threshold = F.lit(None).cast("array<double>")
    for name, values in THRESHOLDS.items():
        threshold = F.when(col("regime_indicator") == name, F.array(*map(F.lit, values))).otherwise(threshold)
    when = {
        "n_entry": F.when(~online, listed("n_entry")), "n_exit": F.when(exit_is("channel") & ~online, listed("n_exit")), "trail_mult": F.when(exit_is("atr_trail"), listed("trail_mult")),
        "stop_mult": stops, "target_mult": F.when(exit_is("target_stop"), listed("target_mult")), "max_hold": F.when(exit_is("time_stop"), listed("max_hold")),
        "channel_k": F.when(col("channel").isin("keltner", "bollinger"), listed("channel_k")), "pullback_mult": F.when(col("entry") == "pullback", listed("pullback_mult")),
        "regime_threshold": F.when(col("regime_filter") != "none", threshold),
    }
    return {name: F.when(~forecast, x) for name, x in when.items()}


def n_points(wide: bool = False) -> Column:
    """Points of a template's lattice."""
    return reduce(lambda a, b: a * b, (F.coalesce(F.size(v), F.lit(1)) for v in (F.when(x.isNotNull(), x) for x in values_of(wide).values())), F.lit(1)).cast("long")


def lattices(rows: DataFrame, wide: bool = False) -> DataFrame:
    """template, trial_id, coord and plan columns of every point of every template's lattice.

    A parameter that does not vary has the plan's value and coordinate 0. trial_id numbers points by template, then coordinates.
    """
    order = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # templates of a family, not data
    put = rows.withColumn("_base", F.coalesce(F.sum(n_points(wide)).over(order), F.lit(0)))
    index = F.lit(0).cast("long")
    for name, values in values_of(wide).items():
        plain = F.array(F.lit(float(simulation.PLAN[name])) if name != "regime_threshold" else F.lit(float("nan")))
        put = put.withColumn(f"_v_{name}", F.coalesce(values, plain)).select("*", F.posexplode(f"_v_{name}").alias(f"_c_{name}", name))
        index = index * F.size(f"_v_{name}") + F.col(f"_c_{name}")
    channel = F.when(F.col("channel").startswith("hedge"), F.lit("ladder")).otherwise(F.col("channel"))
    whole = ("n_entry", "n_exit", "max_hold")
    return put.select(
        "template", (F.col("_base") + index).cast("int").alias("trial_id"), F.array(*(F.col(f"_c_{n}") for n in PARAMETERS)).alias("coord"),
        "direction", channel.alias("channel"), *COLUMNS[2:], *(F.col(n).cast("int").alias(n) if n in whole else F.col(n) for n in PARAMETERS),
    )


def slots(bars: DataFrame, rows: DataFrame) -> DataFrame:
    """asset, n_bars, template, number and switches of every asset with every template."""
    n = bars.groupBy("asset").agg(F.count(F.lit(1)).alias("n_bars"))
    return n.join(F.broadcast(rows))  # a family's templates, bounded by its switches
