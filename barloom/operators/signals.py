"""What to do before the next bar: fits when they are due, the state of every slot, its orders, its filters, and the book.

A slot is an asset and a template with a share of the account. Its parameters hold for one test window after the bar they were
fitted on, and it trades from the bar after that one, flat, as the walk-forward that measured it did.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import book, search, simulation
from barloom.sources import stored

KEYS = ["asset", "template"]


def refitted(bars: DataFrame, plans: DataFrame, dims: int, train: int, anchored: bool = False, account: simulation.Account = simulation.Account(), **how) -> DataFrame:
    """asset, template, trial_id, fitted_idx, score: parameters picked on the last ``train`` bars, as a walk-forward window picks them.

    A pair without a pick has no row; an asset with fewer bars is an error.
    """
    n = bars.groupBy("asset").agg((F.max("bar_idx") + 1).alias("n"))
    short = n.filter(F.col("n") < train).first()
    if short:
        raise ValueError(f"{short['asset']}: {train} bars are needed for a fit, there are {short['n']}")
    first = F.lit(0).cast("long") if anchored else F.col("n") - train
    spans = n.select("asset", F.lit(0).cast("long").alias("window_id"), first.alias("start"), F.col("n").alias("stop"))
    got = search.optimized(bars, plans, spans, dims, account=account, **how)
    return got.join(F.broadcast(n), "asset").select(*KEYS, "trial_id", (F.col("n") - 1).alias("fitted_idx"), "score")


def due(bars: DataFrame, slots: DataFrame, test_bars: int) -> DataFrame:
    """The slots (asset, template, ..., fitted_idx, null if never) with bars_since and due: a test window has passed since the fit."""
    n = bars.groupBy("asset").agg(F.max("bar_idx").alias("_last"))
    since = F.col("_last") - F.coalesce("fitted_idx", F.lit(-1))
    rows = slots.join(F.broadcast(n), "asset").withColumns({"bars_since": since.cast("long"), "due": F.col("fitted_idx").isNull() | (since >= test_bars)})
    return rows.drop("_last")


def kept_or_refitted(bars: DataFrame, plans: DataFrame, slots: DataFrame, dims: int, train: int, test_bars: int, **how) -> DataFrame:
    """The slots (asset, template, weight, trial_id, fitted_idx), fitted again where due: what was fitted for a template without a pick is dropped."""
    marked = stored.kept(due(bars, slots, test_bars))
    again = marked.filter("due").select(*KEYS, "weight")
    own = plans.join(again.select("template").distinct(), "template", "left_semi")
    fits = refitted(bars.join(again.select("asset").distinct(), "asset", "left_semi"), own, dims, train, **how) if again.first() else None
    old = marked.filter("NOT due").select(*KEYS, "weight", "trial_id", "fitted_idx")
    return old if fits is None else old.unionByName(again.join(fits, KEYS).select(*KEYS, "weight", "trial_id", "fitted_idx"))


def _spanned(bars: DataFrame, plans: DataFrame, slots: DataFrame, warm: int, equity: float, output: str, account: simulation.Account) -> DataFrame:
    """``output`` of each slot over the bars since its fit; slots of an asset that were fitted on one bar share a span."""
    n = bars.groupBy("asset").agg((F.max("bar_idx") + 1).alias("n"))
    named = slots.join(F.broadcast(n), "asset").withColumn("window_id", F.col("fitted_idx"))
    spans = named.select("asset", "window_id", (F.col("fitted_idx") + 1).alias("start"), F.col("n").alias("stop")).distinct()
    chosen = named.select("asset", "window_id", "trial_id", (F.col("weight") * equity).alias("capital")).join(F.broadcast(plans.drop("coord", "template", "capital")), "trial_id")
    rows = simulation.windowed(bars, spans, chosen, warm, output, account)
    return rows.join(named.select(*KEYS, "trial_id", "window_id", "weight"), ["asset", "trial_id", "window_id"]).drop("window_id")


def slot_states(bars: DataFrame, plans: DataFrame, slots: DataFrame, warm: int, equity: float = 100_000.0, account: simulation.Account = simulation.Account()) -> DataFrame:
    """Position, stop, target, equity of each slot (asset, template, trial_id, fitted_idx, weight) after the last bar."""
    return _spanned(bars, plans, slots, warm, equity, "states", account)


def slot_orders(bars: DataFrame, plans: DataFrame, slots: DataFrame, warm: int, equity: float = 100_000.0, account: simulation.Account = simulation.Account()) -> DataFrame:
    """The orders of each slot for the next bar."""
    return _spanned(bars, plans, slots, warm, equity, "next_orders", account)


def slot_filters(bars: DataFrame, plans: DataFrame, slots: DataFrame, warm: int, account: simulation.Account = simulation.Account()) -> DataFrame:
    """Why a slot may not enter on the next bar: one row a filter that bars it, with the value it read and its bounds."""
    return _spanned(bars, plans, slots, warm, account.equity, "blocked", account)


def slot_book(bars: DataFrame, states: DataFrame, holdings: DataFrame, lot: float = 1.0, equity: float = 100_000.0, most_gross: float | None = None, account: simulation.Account = simulation.Account()) -> DataFrame:
    """The trades that take what is held (asset, held) to what the slots hold together, at the last close."""
    price = bars.groupBy("asset").agg(F.max_by("close", "bar_idx").alias("price"))
    legs = states.filter("position <> 0").join(F.broadcast(price), "asset").select(
        "asset", F.col("template").alias("slot"), F.col("position").alias("side"), F.col("units").alias("shares"), "price", F.lit(account.point_value).alias("point_value"), F.lit(account.margin).alias("margin"), "stop"
    )
    targets = book.book_targets(legs, equity, most_gross).select("asset", F.col("shares").alias("target"))
    return book.order_actions(book.trade_list(targets, holdings, lot).join(F.broadcast(price), "asset", "left"))


def stance_orders(levels: DataFrame, account: simulation.Account = simulation.Account(), vol_target: float = 0.0, leverage: float = 2.0) -> DataFrame:
    """asset, side, shares, level, held: the order at the next open that takes a held level to the target read at the last close.

    levels: asset, target and held level (-1 to 1, null: not formed), equity, close, and vol (a bar's deviation, of returns, or
    of points where a unit has a margin) for a volatility target. A full level is the equity times the aimed share of volatility,
    or the leverage; without a change or a formed target there is no order.
    """
    one = F.lit(account.margin) if account.margin > 0 else F.abs("close") * account.point_value
    cap = leverage * F.col("equity") / F.nullif(one, F.lit(0.0))
    aim = vol_target / account.per_year**0.5
    per_vol = F.col("equity") * aim / F.nullif(F.col("vol") * account.point_value * (F.lit(1.0) if account.margin > 0 else F.abs("close")), F.lit(0.0))
    full = F.least(per_vol, cap) if vol_target > 0 else cap
    sized = lambda level: F.floor(F.abs(level) * full) * F.signum(level) if account.whole_units else level * full
    held = F.coalesce("held", F.lit(0.0))
    rows = levels.withColumn("_d", sized(F.col("target")) - sized(held)).filter(F.col("target").isNotNull() & (F.col("target") != held) & (F.col("_d") != 0))
    return rows.select("asset", F.signum("_d").cast("int").alias("side"), F.abs("_d").alias("shares"), F.col("target").alias("level"), held.alias("held"))
