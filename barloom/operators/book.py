"""Trades, holdings and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spells(stances: DataFrame) -> DataFrame:
    """Runs of one non-zero stance: asset, side, first and one past the last bar, bars held (gaps and islands)."""
    by = Window.partitionBy("asset").orderBy("bar_idx")
    changed = (F.col("stance") != F.coalesce(F.lag("stance").over(by), F.lit(0))).cast("int")
    runs = stances.withColumn("run", F.sum(changed).over(by)).filter("stance <> 0")
    return runs.groupBy("asset", "run").agg(
        F.min("stance").alias("side"), F.min("bar_idx").alias("entry"), (F.max("bar_idx") + 1).alias("exit"), F.count(F.lit(1)).alias("held")
    )


def exposure(trades: DataFrame) -> DataFrame:
    """asset, bar_idx, units: signed units at each bar that trades [entry, exit) cover, from changes at their ends."""
    ends = trades.select("asset", F.col("entry").alias("bar_idx"), F.col("side").alias("d")).unionByName(
        trades.select("asset", F.col("exit").alias("bar_idx"), (-F.col("side")).alias("d"))
    )
    steps = ends.groupBy("asset", "bar_idx").agg(F.sum("d").alias("d"))
    by = Window.partitionBy("asset").orderBy("bar_idx")
    level = steps.select("asset", "bar_idx", F.sum("d").over(by).alias("units"), F.lead("bar_idx").over(by).alias("until"))
    return level.filter("units <> 0 AND until IS NOT NULL").select("asset", F.explode(F.sequence("bar_idx", F.col("until") - 1)).alias("bar_idx"), "units")


def trade_list(targets: DataFrame, holdings: DataFrame, lot: float) -> DataFrame:
    """asset, held, target, order: the change to the target in whole lots towards 0; assets of either side."""
    both = targets.join(holdings, "asset", "full_outer").select(
        "asset", F.coalesce("held", F.lit(0.0)).alias("held"), F.coalesce("target", F.lit(0.0)).alias("target")
    )
    gap = F.col("target") - F.col("held")
    return both.withColumn("order", F.signum(gap) * F.floor(F.abs(gap) / lot) * lot)


def moved_rolls(bars: DataFrame) -> DataFrame:
    """Roll flags of dropped bars (kept = false) on the last kept bar before or at them, summed: asset, bar_idx, roll."""
    by = Window.partitionBy("asset").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    onto = F.last(F.when(F.col("kept"), F.col("bar_idx")), ignorenulls=True).over(by)
    return bars.withColumn("onto", onto).filter("onto IS NOT NULL").groupBy("asset", F.col("onto").alias("bar_idx")).agg(F.sum("roll").alias("roll"))


#: Order kinds that rest over bars.
WORKING = ("entry_working", "pullback_working", "stop_working", "target_working")


def collapsed(events: DataFrame, *keys: str) -> DataFrame:
    """The order log as lives of orders: an order of one level over consecutive bars is one row (first_bar, last_bar, n_bars).

    Fills, submissions and the like keep a row each. ``keys`` name whose orders they are.
    """
    same = [*keys, "kind", "side", "detail_text", "level"]
    working = F.col("kind").isin(*WORKING)
    own = Window.partitionBy(*same).orderBy("bar_idx")
    held = events.filter(working).withColumn("_r", F.col("bar_idx") - F.row_number().over(own))
    runs = held.groupBy(*same, "_r").agg(F.min("bar_idx").alias("first_bar"), F.max("bar_idx").alias("last_bar"), F.count(F.lit(1)).alias("n_bars"), F.min_by("qty", "bar_idx").alias("qty")).drop("_r")
    single = events.filter(~working).select(*same, F.col("bar_idx").alias("first_bar"), F.col("bar_idx").alias("last_bar"), F.lit(1).cast("long").alias("n_bars"), "qty")
    return runs.unionByName(single)


def book_targets(legs: DataFrame, equity: float, max_gross: float | None = None) -> DataFrame:
    """asset, shares (signed), price, notional, share of the account, open risk of a book of legs.

    legs (asset, slot, side, shares, price, point_value, margin, stop): a unit counts its margin where it has one, else its
    notional. Beyond ``max_gross`` of the equity all legs shrink alike; price is that of the asset's last slot.
    """
    basis = F.when(F.col("margin") > 0, F.col("margin")).otherwise(F.col("point_value") * F.abs("price"))
    rows = legs.withColumn("basis", basis)
    gross = rows.agg(F.coalesce(F.sum(F.col("shares") * F.col("basis")), F.lit(0.0)).alias("gross"))
    limit = F.lit(None).cast("double") if max_gross is None else F.lit(float(max_gross * equity))
    scaled = rows.crossJoin(F.broadcast(gross.select(F.when((limit > 0) & (F.col("gross") > limit), limit / F.col("gross")).otherwise(F.lit(1.0)).alias("scale"))))  # one row
    signed, risk = F.col("shares") * F.col("side") * F.col("scale"), F.col("shares") * F.col("scale") * F.abs(F.col("price") - F.col("stop")) * F.col("point_value")
    per = scaled.groupBy("asset").agg(
        F.sum(signed).alias("shares"), F.max_by("price", "slot").alias("price"), F.max_by("basis", "slot").alias("basis"), F.coalesce(F.sum(risk), F.lit(0.0)).alias("open_risk"), F.first("scale").alias("scale")
    )
    notional = F.col("shares") * F.col("basis")
    return per.select("asset", "shares", "price", notional.alias("notional"), (notional / equity).alias("pct_of_account"), "open_risk", "scale")


def order_actions(trades: DataFrame) -> DataFrame:
    """What a trade list (asset, held, target, order, price) says to do, with the order's notional where a price is known."""
    action = F.when(F.col("order") > 0, "BUY").when(F.col("order") < 0, "SELL").otherwise("hold")
    return trades.withColumns({"action": action, "order_notional": F.abs("order") * F.abs("price")})


def candidates(table: DataFrame, least_sharpe: float = 0.0, least_windows: int = 4, least_trades: int = 20, pardo: bool = False, least_wfe: float | None = None) -> DataFrame:
    """Rows of walk-forward summaries that may be held: enough windows and trades, Sharpe, and an account that was never closed."""
    rows = table.filter((F.col("oos_sharpe") >= least_sharpe) & (F.col("n_live") >= least_windows) & (F.col("n_trades") >= least_trades) & (F.coalesce("oos_max_dd", F.lit(0.0)) > -1))
    if pardo:
        rows = rows.filter("pardo_pass")
    return rows if least_wfe is None else rows.filter(F.col("wfe") >= least_wfe)


#: Rules of a verdict in order: level, condition, code. A critical one outweighs all warnings.
VERDICT = (
    ("critical", "n_slots = 0", "empty_book"),
    ("critical", "nested_sharpe <= 0", "nested_loses"),
    ("warning", "nested_sharpe > 0 AND nested_sharpe < 0.5", "nested_below_half"),
    ("critical", "pbo >= 0.5", "pbo_from_half"),
    ("warning", "pbo >= 0.35 AND pbo < 0.5", "pbo_raised"),
    ("critical", "reality_check_p > 0.15", "search_luck"),
    ("warning", "reality_check_p > 0.05 AND reality_check_p <= 0.15", "search_unclear"),
    ("warning", "dsr < 0.95", "dsr_below_95"),
    ("warning", "years < min_years", "short_record"),
    ("warning", "weak_slots > 0", "weak_paths"),
)


def verdict(diagnostics: DataFrame) -> DataFrame:
    """The diagnostics with level (good, warning, critical) and reasons, the codes of the rules that hold."""
    told = F.array_compact(F.array(*(F.when(F.expr(c), F.struct(F.lit(level).alias("level"), F.lit(why).alias("why"))) for level, c, why in VERDICT)))
    rows = diagnostics.withColumn("_t", told)
    level = F.when(F.exists("_t", lambda x: x["level"] == "critical"), "critical").when(F.size("_t") > 0, "warning").otherwise("good")
    return rows.withColumns({"level": level, "reasons": F.transform("_t", lambda x: x["why"])}).drop("_t")
