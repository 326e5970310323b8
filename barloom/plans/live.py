"""Queries of streams, stored runs, records as of a boundary, masks, sessions, closed bars and rolled series; importing registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.operators import backtest, book, calendar, diagnostics, families, ladders, metrics, nested, runs, search, signals, simulation
from barloom.plans import research
from barloom.plans.queries import BARS, ORACLE_SQL, RETS, SPELLS, STANCE, _stances, query, r
from barloom.sources import bars as src
from barloom.sources import spreads, stored
from barloom.streaming.slots import streamed_slots


def fed(bars: DataFrame, parts: int = 3) -> DataFrame:
    """The bars as a stream: written in order of their numbers, a file set at a time."""
    folder, spark = stored.shared_folder(bars.sparkSession), bars.sparkSession
    last = bars.agg(F.max("bar_idx").alias("n")).first()["n"] or 0
    rows = bars.withColumn("ts", F.col("ts").cast("timestamp")).select("asset", "ts", "open", "high", "low", "close", "bar_idx")
    for k in range(parts):  # a few appends, so that files arrive as bars do
        low, high = last * k // parts, last * (k + 1) // parts
        rows.filter((F.col("bar_idx") > (low if k else -1)) & (F.col("bar_idx") <= high)).drop("bar_idx").write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.drop("bar_idx").schema).parquet(folder)


def drained(stream: DataFrame) -> DataFrame:
    """What a stream returns until its input is used up."""
    folder, spark = stored.shared_folder(stream.sparkSession), stream.sparkSession
    out = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append")
    run = out.trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("streamed_trades", ORACLE_SQL["breakout_trades"])
def streamed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batch gives, in micro-batches with a state between them."""
    rows = drained(streamed_slots(fed(src.order_bars(spark, sf_dir)), research._exits(spark).toPandas(), output="trades"))
    return rows.select("asset", "trial_id", "entry_idx", "exit_idx", "side", "entry_price", "exit_price", "units", "pnl")


def _templates(spark: SparkSession) -> DataFrame:
    """Three templates with a small lattice each."""
    points = search.lattice(spark, {"n_entry": [20, 40], "stop_mult": [2.0, 3.0]})
    p = F.col("params")
    base = points.select("trial_id", "coord", p["n_entry"].cast("int").alias("n_entry"), p["stop_mult"].alias("stop_mult"))
    kinds = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("template"), F.lit(d).alias("direction"), F.lit(e).alias("exit")) for k, (n, d, e) in enumerate((("break", "trend", "channel"), ("trail", "trend", "atr_trail"), ("fade", "countertrend", "time_stop")))))
    rows = base.withColumn("_k", F.explode(kinds)).select("*", "_k.*").drop("_k")
    return rows.withColumn("trial_id", (F.col("trial_id") + 10 * F.col("k")).cast("int")).drop("k")


def _run(spark: SparkSession, sf_dir: str) -> runs.Run:
    bars = src.order_bars(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return runs.researched(stored.shared_folder(spark), bars, _templates(spark), 2, 150, 50, select={"least_sharpe": -5.0, "least_trades": 0, "least_windows": 0, "most": 2, "ceiling": 0.9}, least_trades=1)


@query("run_verification")
def run_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)
    best, static, held = (runs.verification(run, t) for t in runs.TARGETS)
    return best.unionByName(static).unionByName(held)


@query("run_holdings")
def run_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).holdings


@query("run_order_lives")
def run_order_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.order_lives(_run(spark, sf_dir), "nested").drop("rank")


@query("run_diagnostics")
def run_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)
    trials = stored.kept(diagnostics.trial_returns(run))
    told = diagnostics.family_diagnostics(run, 100, trials)
    return book.verdict(diagnostics.verdict_inputs(run, told, diagnostics.finalist_paths(run, trials=trials)))


@query("run_signals")
def run_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next orders of the templates that the static portfolio holds, fitted on the last window."""
    run = _run(spark, sf_dir)
    held = run.holdings.filter("target = 'static'").select("asset", "template", "weight")
    slots = stored.kept(held.join(signals.refitted(run.bars, run.plans, 2, 150, least_trades=1), ["asset", "template"]))
    return signals.slot_orders(run.bars, run.plans, slots, run.warm)


@query("filters_on_last_bar")
def filters_on_last_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = families.templates(spark, "quick").select(F.col("number").cast("int").alias("trial_id"), *families.COLUMNS)
    return simulation.simulated(src.order_bars(spark, sf_dir), plans, "blocked")


@query("committee_comparison")
def committee_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed share against discounting on the plain ladder: flips of the direction and the paired Sharpe."""
    bars = src.order_bars(spark, sf_dir)
    one, two = (stored.kept(ladders.committee(bars, sharing=s)) for s in (True, False))
    made = [diagnostics.committee_returns(bars, d.select("asset", "bar_idx", F.col("position").alias("level")), first=300) for d in (one, two)]
    flips = diagnostics.direction_flips(ladders.told(one).select("asset", "bar_idx", F.col("net").alias("level")), 300)
    return diagnostics.paired_sharpe(*made).join(flips, "asset")


@query(
    "paired_sharpe",
    f"""WITH {STANCE}, p AS (SELECT asset, bar_idx, close, stance, lag(stance) OVER w AS s1, lag(close) OVER w AS c1, avg(stance) OVER (PARTITION BY asset ORDER BY bar_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM st WINDOW w AS (PARTITION BY asset ORDER BY bar_idx)),
q AS (SELECT *, lag(m) OVER (PARTITION BY asset ORDER BY bar_idx) AS m1 FROM p),
x AS (SELECT asset, bar_idx, coalesce(s1 * (close / c1 - 1) - 0.0005 * abs(stance - s1), 0) AS a, coalesce(m1 * (close / c1 - 1) - 0.0005 * abs(m - m1), 0) AS b FROM q),
k AS (SELECT asset, count(*) AS n, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS r FROM x GROUP BY asset)
SELECT asset, n, {r("ma / sa", "sharpe_a")}, {r("mb / sb", "sharpe_b")}, {r("(ma / sa - mb / sb) / sqrt(2 - 2 * r) * sqrt(n)", "t")} FROM k""",
)
def paired_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stances(spark, sf_dir)
    levels = s.select("asset", "bar_idx", F.col("stance").cast("double").alias("level")), s.select("asset", "bar_idx", F.avg("stance").over(ind.back(10)).alias("level"))
    return diagnostics.paired_sharpe(*(diagnostics.committee_returns(s, x) for x in levels))


#: Windows of 50 bars from bar 150 on as if each series were a template; their totals come from its returns over a thousand.
WINS = (
    RETS
    + """,
x AS (SELECT asset, bar_idx, ret / 1000 AS ret, CASE WHEN bar_idx >= 150 THEN (bar_idx - 150) // 50 END AS w FROM rets),
t AS (SELECT asset, w, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q, count(*) FILTER (ret > 0.0002) AS trades FROM x WHERE w IS NOT NULL GROUP BY 1, 2),
l AS (SELECT *, w % 7 <> 3 AS live, n > 48 AS full FROM t)"""
)


def _wins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = metrics.returns(src.order_bars(spark, sf_dir)).withColumn("ret", F.col("ret") / 1000).filter("bar_idx >= 150")
    rets = x.select("asset", F.col("asset").alias("template"), F.floor((F.col("bar_idx") - 150) / 50).cast("long").alias("window_id"), "bar_idx", "ret")
    t = rets.groupBy("asset", "template", "window_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("s"), F.sum((F.col("ret") > 0.0002).cast("long")).alias("trades"))
    live = F.col("window_id") % 7 != 3
    on = lambda c: F.when(live, c)
    wins = t.select(
        "asset", "template", "window_id", on(F.lit(1)).alias("trial_id"), on(F.abs("s") + 0.001).alias("is_total_return"), on(F.col("n")).alias("is_n_bars"), on(F.col("s")).alias("oos_total_return"),
        on(F.col("n")).alias("oos_n_bars"), on(F.col("trades")).alias("oos_n_trades"), F.lit(None).cast("double").alias("is_years"), F.lit(None).cast("double").alias("oos_years"),
    )
    return wins, rets


@query(
    "causal_records",
    f"""WITH {WINS},
c AS (SELECT asset, w, bar_idx, product(1 + ret) OVER p AS e FROM x WHERE w IS NOT NULL WINDOW p AS (PARTITION BY asset ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)),
d AS (SELECT asset, w, bar_idx, e, e / greatest(max(e) OVER (PARTITION BY asset ORDER BY bar_idx ROWS UNBOUNDED PRECEDING), 1) - 1 AS dd FROM c),
k AS (SELECT asset, w, arg_max(e, bar_idx) AS e, min(dd) AS dd FROM d GROUP BY 1, 2),
j AS (SELECT l.*, k.e, k.dd, CASE WHEN live THEN (abs(s) + 0.001) / (n / 252.0) END AS i, CASE WHEN live THEN s / (n / 252.0) END AS o FROM l JOIN k USING (asset, w)),
g AS (SELECT asset, w, count(*) OVER b AS n_windows, count(*) FILTER (live) OVER b AS n_live, coalesce(sum(CASE WHEN live THEN trades END) OVER b, 0) AS n_trades,
  (count(*) FILTER (live AND s > 0) OVER b) / nullif(count(*) OVER b, 0) AS pct, avg(i) OVER b AS i, avg(o) OVER b AS o, sum(n) OVER b AS n_bars, sum(s) OVER b AS s, sum(q) OVER b AS q,
  last_value(e) OVER b - 1 AS total, min(dd) OVER b AS dd FROM j WINDOW b AS (PARTITION BY asset ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, CASE WHEN i > 0 THEN least(greatest(o / i, -10), 10) END AS wfe FROM g WHERE n_windows > 0)
SELECT asset, asset AS template, w AS window_id, n_windows, n_live, CAST(n_trades AS BIGINT) AS n_trades, {r("pct", "pct_profitable")}, CAST(n_bars AS BIGINT) AS n_bars, {r("total", "oos_total")}, {r("dd", "oos_max_dd")},
  {r("wfe", "wfe")}, {r("s / n_bars / sqrt((q - s * s / n_bars) / (n_bars - 1)) * sqrt(252)", "oos_sharpe")},
  n_live >= 3 AND total > 0 AND pct >= 0.5 AND coalesce(wfe >= 0.5, false) AS pardo_pass FROM z""",
)
def causal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.causal_records(*_wins(spark, sf_dir))


@query("ladder_views")
def ladder_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = ladders.told(ladders.committee(src.order_bars(spark, sf_dir)))
    return told.select("asset", "bar_idx", "net", "surprise", "trade", "position")


@query("ladder_trades")
def ladder_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = spark.createDataFrame([(k, "learned", "ladder", e) for k, e in enumerate(("channel", "atr_trail", "target_stop", "time_stop"))], "trial_id int, direction string, channel string, exit string")
    return simulation.simulated(ladders.with_ladder(src.order_bars(spark, sf_dir)), plan, "trades", first=100)


@query(
    "overfit_regression",
    f"""WITH {RETS}, q AS (SELECT asset, ret, ((row_number() OVER (PARTITION BY asset ORDER BY ts) - 1) * 8) // count(*) OVER (PARTITION BY asset) AS block FROM rets),
bs AS (SELECT asset, block, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS s2 FROM q GROUP BY 1, 2),
masks AS (SELECT m FROM range(0, 256) t(m) WHERE bit_count(m) = 4),
x AS (SELECT m, asset, sum(n) FILTER (i) AS n1, sum(s) FILTER (i) AS s1, sum(s2) FILTER (i) AS t1, sum(n) FILTER (NOT i) AS n0, sum(s) FILTER (NOT i) AS s0, sum(s2) FILTER (NOT i) AS t0
  FROM (SELECT *, (m >> CAST(block AS INT)) & 1 = 1 AS i FROM bs, masks) GROUP BY 1, 2),
y AS (SELECT m, asset, (s1 / n1) / sqrt((t1 - s1 * s1 / n1) / (n1 - 1)) AS inside, (s0 / n0) / sqrt((t0 - s0 * s0 / n0) / (n0 - 1)) AS outside FROM x),
wn AS (SELECT m, max(inside) AS inside, arg_max(outside, inside) AS level FROM y GROUP BY m),
k AS (SELECT m, any_value(wn.inside) * sqrt(252) AS inside, any_value(level) * sqrt(252) AS outside, (sum(CAST(outside < level AS DOUBLE)) + 0.5 * sum(CAST(outside = level AS DOUBLE)) + 0.5) / (count(*) + 1) AS share
  FROM y JOIN wn USING (m) GROUP BY m)
SELECT count(*) AS n_splits, {r("avg(CAST(share <= 0.5 AS DOUBLE))", "pbo")}, {r("avg(ln(share / (1 - share)))", "mean_logit")}, {r("avg(CAST(outside < 0 AS DOUBLE))", "prob_loss")},
  {r("regr_slope(outside, inside)", "slope")}, {r("regr_intercept(outside, inside)", "intercept")} FROM k""",
)
def overfit_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = metrics.block_stats(metrics.returns(src.order_bars(spark, sf_dir)), 8)
    return backtest.overfit_summary(backtest.overfit_probability(stats, 8, "asset"))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the stances as one plan: entered, exited and what a spell that ends made, with the return while held."""
    s = _stances(spark, sf_dir)
    spells = book.spells(s)
    ends = spells.select("asset", F.col("entry").alias("bar_idx"), F.lit(True).alias("entered"), F.lit(False).alias("exited"), F.lit(0.0).alias("pnl"))
    closes = s.select("asset", "bar_idx", "close")
    at = lambda c: closes.select("asset", F.col("bar_idx").alias(c), F.col("close").alias(f"_{c}"))
    made = spells.join(at("entry"), ["asset", "entry"]).join(at("exit"), ["asset", "exit"])
    gone = made.select("asset", F.col("exit").alias("bar_idx"), F.lit(False).alias("entered"), F.lit(True).alias("exited"), (F.col("side") * (F.col("_exit") - F.col("_entry"))).alias("pnl"))
    both = ends.unionByName(gone).groupBy("asset", "bar_idx").agg(F.bool_or("entered").alias("entered"), F.bool_or("exited").alias("exited"), F.sum("pnl").alias("pnl"))
    ret = F.coalesce(ind.lag(F.col("stance")) * (F.col("close") - ind.lag(F.col("close"))) / 1e6, F.lit(0.0))
    rows = s.select("asset", "bar_idx", ret.alias("ret")).join(both, ["asset", "bar_idx"], "left")
    return rows.select("asset", "bar_idx", "ret", F.coalesce("entered", F.lit(False)).alias("entered"), F.coalesce("exited", F.lit(False)).alias("exited"), F.coalesce("pnl", F.lit(0.0)).alias("pnl"))


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.order_bars(spark, sf_dir).select("asset", "bar_idx", (F.col("bar_idx") % 60 >= 12).alias("inside"))


TRADES = (
    SPELLS
    + """,
tr AS (SELECT sp.asset, entry AS entry_idx, exit AS exit_idx, side * (z.close - a.close) AS pnl FROM sp JOIN b a ON a.asset = sp.asset AND a.bar_idx = entry JOIN b z ON z.asset = sp.asset AND z.bar_idx = exit)"""
)


@query("paired_trades", f"WITH {TRADES} SELECT asset, entry_idx, exit_idx, {r('pnl', 'pnl')} FROM tr")
def paired_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.paired_trades(_flags(spark, sf_dir), "asset")


@query("trades_inside", f"WITH {TRADES} SELECT asset, entry_idx, exit_idx, {r('pnl', 'pnl')} FROM tr WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.asset = tr.asset AND b.bar_idx BETWEEN entry_idx AND exit_idx AND b.bar_idx % 60 < 12)")
def trades_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.trades_inside(backtest.paired_trades(_flags(spark, sf_dir), "asset"), _mask(spark, sf_dir), "asset")


@query(
    "masked_totals",
    f"""WITH {TRADES},
w AS (SELECT asset, bar_idx, coalesce(lag(stance) OVER p * (close - lag(close) OVER p) / 1e6, 0) AS ret, bar_idx % 60 >= 12 AS inside FROM st WINDOW p AS (PARTITION BY asset ORDER BY bar_idx)),
e AS (SELECT *, 1 + sum(CASE WHEN inside THEN ret ELSE 0 END) OVER (PARTITION BY asset ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS e FROM w),
d AS (SELECT *, e - greatest(max(e) OVER (PARTITION BY asset ORDER BY bar_idx ROWS UNBOUNDED PRECEDING), 1) AS dd FROM e),
n AS (SELECT asset, count(*) AS n FROM sp WHERE entry % 60 >= 12 GROUP BY asset),
k AS (SELECT asset, sum(greatest(pnl, 0)) AS gain, sum(greatest(-pnl, 0)) AS loss FROM tr WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.asset = tr.asset AND b.bar_idx BETWEEN entry_idx AND exit_idx AND b.bar_idx % 60 < 12) GROUP BY asset)
SELECT d.asset, coalesce(any_value(n), 0) AS n_trades, {r("avg(ret) FILTER (inside) / stddev_samp(ret) FILTER (inside) * sqrt(252)", "sharpe")}, {r("arg_max(e, bar_idx) - 1", "total_return")}, {r("min(dd)", "max_dd")},
  {r("coalesce(any_value(gain), 0)", "gain")}, {r("coalesce(any_value(loss), 0)", "loss")} FROM d LEFT JOIN n USING (asset) LEFT JOIN k USING (asset) GROUP BY d.asset""",
)
def masked_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.masked_totals(_flags(spark, sf_dir), _mask(spark, sf_dir), ("asset",))


HOURS = """e AS (SELECT event_type AS asset, date_trunc('hour', ts) AS ts, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2),
h AS (SELECT asset, ts, CAST(ts - INTERVAL 390 MINUTE AS DATE) AS session, close / 1e6 AS ret, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS i FROM e)"""


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = src.event_bars(spark, sf_dir, "hour")
    return b.select("asset", "ts", (F.col("ts") - F.expr("INTERVAL 390 MINUTES")).cast("date").alias("session"), (F.col("close") / 1e6).alias("ret"))


@query("compounded_sessions", f"WITH {HOURS} SELECT asset, CAST(session AS TIMESTAMP) AS ts, count(*) AS n, {r('product(1 + ret) - 1', 'ret', 8)} FROM h GROUP BY 1, 2", digits=8)
def compounded_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.session_sums(_hours(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "snapped_groups",
    f"""WITH {HOURS}, s AS (SELECT asset, min(i) AS x FROM h GROUP BY asset, session), n AS (SELECT asset, count(*) AS n FROM h GROUP BY asset),
v AS (SELECT asset, g, (g * n) // 8 AS even FROM n, range(0, 9) t(g)),
m AS (SELECT v.asset, g, even, max(x) FILTER (x < even) AS l, min(x) FILTER (x >= even) AS r FROM v JOIN s USING (asset) GROUP BY 1, 2, 3),
p AS (SELECT asset, g, even, CASE WHEN g IN (0, 8) THEN even WHEN r IS NULL OR even - l <= r - even THEN coalesce(l, even) ELSE r END AS snap FROM m),
f AS (SELECT asset, min(snap - before) > 0 AND any_value(k) >= 2 AS fine FROM (SELECT *, lag(snap) OVER (PARTITION BY asset ORDER BY g) AS before FROM p) JOIN (SELECT asset, count(*) AS k FROM s GROUP BY 1) USING (asset) GROUP BY asset),
o AS (SELECT asset, g, CASE WHEN fine THEN snap ELSE even END AS lo FROM p JOIN f USING (asset)),
q AS (SELECT asset, g, lo, lead(lo) OVER (PARTITION BY asset ORDER BY g) AS hi FROM o)
SELECT asset, CAST(g AS INT) AS g, lo, hi FROM q WHERE g < 8""",
)
def snapped_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.snapped_groups(_hours(spark, sf_dir), 8)


#: New York is five hours behind in winter, four (until 2006) from the first Sunday of April to the last of October.
_SUMMER = "ts >= make_date(year(ts), 4, 1) + CAST((7 - dayofweek(make_date(year(ts), 4, 1))) % 7 AS INT) AND ts < make_date(year(ts), 10, 31) - CAST(dayofweek(make_date(year(ts), 10, 31)) AS INT)"


@query(
    "closed_bars",
    f"""WITH {BARS}, k AS (SELECT asset, ts, bar_idx, CAST(ts AS TIMESTAMP) + (CASE WHEN {_SUMMER} THEN INTERVAL 1215 MINUTE ELSE INTERVAL 1275 MINUTE END) AS final_at FROM b)
SELECT asset, bar_idx, final_at FROM k WHERE final_at <= TIMESTAMP '1997-07-15 20:15:00'""",
)
def closed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar.closed_bars(src.order_bars(spark, sf_dir), "1d", "1997-07-15 20:15:00")
    return rows.select("asset", "bar_idx", calendar.final_at(F.col("ts"), "1d").alias("final_at"))


@query(
    "refits",
    f"""WITH {BARS}, f AS (SELECT asset, CAST(bar_idx // 100 AS VARCHAR) AS slot, CASE WHEN bar_idx % 300 <> 0 THEN CAST(ts AS TIMESTAMP) + INTERVAL 7 HOUR END AS fitted_on FROM b WHERE bar_idx % 100 = 0),
n AS (SELECT asset, count(*) AS n FROM b GROUP BY asset)
SELECT asset, slot, fitted_on, (SELECT count(*) FROM b WHERE b.asset = f.asset AND (fitted_on IS NULL OR CAST(b.ts AS TIMESTAMP) > fitted_on)) AS bars_since,
  fitted_on IS NULL OR (SELECT count(*) FROM b WHERE b.asset = f.asset AND CAST(b.ts AS TIMESTAMP) > fitted_on) >= 500 AS due FROM f""",
)
def refits(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = src.order_bars(spark, sf_dir)
    fitted = F.when(F.col("bar_idx") % 300 != 0, F.col("ts").cast("timestamp_ntz") + F.expr("INTERVAL 7 HOURS"))
    fits = b.filter("bar_idx % 100 = 0").select("asset", F.floor(F.col("bar_idx") / 100).cast("string").alias("slot"), fitted.alias("fitted_on"))
    return calendar.refits(b, fits, 500)


_RATE = "r AS (SELECT o_orderstatus AS currency, CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) / 1e5 AS close FROM orders WHERE day(o_orderdate) % 3 = 1 GROUP BY 1, 2)"
_CURRENCY = "CASE asset WHEN '1-URGENT' THEN 'F' WHEN '2-HIGH' THEN 'O' WHEN '3-MEDIUM' THEN 'P' ELSE 'USD' END"


def _restated(spark: SparkSession, sf_dir: str, each_bar: bool) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("day(o_orderdate) % 3 = 1")
    rates = o.groupBy(F.col("o_orderstatus").alias("currency"), F.col("o_orderdate").cast("date").alias("ts")).agg((F.avg("o_totalprice") / 1e5).alias("close"))
    rates = rates.unionByName(rates.groupBy("currency").agg(F.lit("1900-01-01").cast("date").alias("ts"), F.lit(1.0).alias("close")).select("currency", "ts", "close"))
    b = src.order_bars(spark, sf_dir)
    names = b.select("asset").distinct().withColumn("currency", F.expr(_CURRENCY))
    return src.restated(b, names, rates, each_bar=each_bar).select("asset", "bar_idx", "open", "close")


@query("restated_last", f"WITH {BARS}, {_RATE}, l AS (SELECT currency, arg_max(close, ts) AS x FROM r GROUP BY 1) SELECT asset, bar_idx, {r('open * coalesce(x, 1)', 'open')}, {r('close * coalesce(x, 1)', 'close')} FROM (SELECT *, {_CURRENCY} AS currency FROM b) LEFT JOIN l USING (currency)")
def restated_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restated(spark, sf_dir, False)


@query("restated_each_bar", f"WITH {BARS}, {_RATE}, c AS (SELECT *, {_CURRENCY} AS currency FROM b) SELECT asset, bar_idx, {r('c.open * coalesce(r.close, 1)', 'open')}, {r('c.close * coalesce(r.close, 1)', 'close')} FROM c ASOF LEFT JOIN r ON c.currency = r.currency AND c.ts >= r.ts")
def restated_each_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restated(spark, sf_dir, True)


@query("rolled_spreads")
def rolled_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by return flag as listed contracts: a line number is one that trades for its share of the days."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = (F.col("l_extendedprice") / F.col("l_quantity")).cast("double")
    key = F.struct("l_orderkey", "l_linenumber", price)
    q = li.groupBy(F.col("l_returnflag").alias("root"), F.concat(F.lit("line"), "l_linenumber").alias("contract"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close")
    )
    span = q.groupBy("root").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    ranked = q.select("root", "contract").distinct().withColumns({"rank": F.row_number().over(Window.partitionBy("root").orderBy("contract")), "n": F.count(F.lit(1)).over(Window.partitionBy("root"))})
    days = F.floor(F.datediff("z", "a") * F.col("rank") / F.col("n")).cast("int")
    listed = ranked.join(span, "root").select("root", "contract", "rank", F.date_add(F.col("a").cast("date"), days).cast("timestamp_ntz").alias("expiry"))
    alive = q.join(listed.select("root", "contract", "expiry"), ["root", "contract"]).filter("ts <= expiry").drop("expiry")
    return spreads.rolled_spreads(alive, listed)


def _family_sql(family: str, spec: dict[str, tuple]) -> str:
    """Templates of a family with the points of their lattices."""
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()
    parts = [f"(VALUES {', '.join(f'({text(a)}, {text(b)})' for a, b in v)}) t{k}(ri, rf)" if n == "regime" else f"(VALUES {', '.join(f'({text(x)})' for x in v)}) t{k}({n})" for k, (n, v) in enumerate(spec.items())]
    return f"""SELECT DISTINCT '{family}' AS family, direction, channel, entry, CASE WHEN entry = 'stance' THEN 'channel' ELSE exit END AS exit, CASE WHEN rf = 'none' THEN 'er' ELSE ri END AS ri, rf, vol_filter, bias_filter, sides
  FROM {', '.join(parts)}"""


def _points_sql(wide: bool) -> str:
    n = {k: len({*a, *b}) if wide else len(a) for k, (a, b) in families.GRIDS.items()}
    stop = f"CASE WHEN exit = 'target_stop' THEN {n['stop_mult']} {f'WHEN NOT online THEN {len(families.HARD_STOPS)}' if wide else ''} ELSE 1 END"
    return f"""CASE WHEN channel = 'forecast' THEN 1 ELSE CASE WHEN online THEN 1 ELSE {n['n_entry']} END * CASE exit WHEN 'channel' THEN CASE WHEN online THEN 1 ELSE {n['n_exit']} END WHEN 'atr_trail' THEN {n['trail_mult']}
  WHEN 'target_stop' THEN {n['target_mult']} ELSE {n['max_hold']} END * {stop} * CASE WHEN channel IN ('keltner', 'bollinger') THEN {n['channel_k']} ELSE 1 END
  * CASE WHEN entry = 'pullback' THEN {n['pullback_mult']} ELSE 1 END * CASE WHEN rf <> 'none' THEN 3 ELSE 1 END END"""


_NAMES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in families.SHORT.items()) + "}"


@query(
    "family_slots",
    f"""WITH {BARS}, n AS (SELECT asset, count(*) AS n_bars FROM b GROUP BY asset), t AS ({' UNION ALL '.join(_family_sql(k, v) for k, v in families.FAMILIES.items())}),
m AS (SELECT *, starts_with(channel, 'hedge') AS online, {_NAMES} AS m FROM t)
SELECT asset, n_bars, family, concat_ws('-', m[direction], m[channel], m[entry], m[exit], CASE WHEN rf = 'none' THEN 'noreg' ELSE ri || ':' || m[rf] END, CASE WHEN vol_filter THEN 'V' ELSE 'noV' END,
  CASE WHEN bias_filter = 'sma' THEN 'B' ELSE 'noB' END, CASE WHEN sides <> 'both' THEN m[sides] END) AS template, CAST({_points_sql(False)} AS BIGINT) AS n_points, CAST({_points_sql(True)} AS BIGINT) AS n_points_wide FROM n, m""",
)
def family_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = [families.templates(spark, f).select(F.lit(f).alias("family"), "template", families.n_points().alias("n_points"), families.n_points(True).alias("n_points_wide")) for f in families.FAMILIES]
    rows = every[0]
    for more in every[1:]:
        rows = rows.unionByName(more)
    return families.slots(src.order_bars(spark, sf_dir), rows).select("asset", "n_bars", "family", "template", "n_points", "n_points_wide")


@query("family_walk_forward")
def family_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward of a family's trend templates, each over its own lattice."""
    rows = families.templates(spark, "quick", direction=("trend",), regime=(("er", "none"),), vol_filter=(False,))
    return search.summary(*search.walked(src.order_bars(spark, sf_dir), families.lattices(rows), len(families.PARAMETERS), 300, 100, least_trades=2))


#: Series as templates of one asset on shared stamps, in windows of 50 bars.
_SLOTS = (
    RETS
    + """,
g AS (SELECT asset AS template, dense_rank() OVER (ORDER BY ts) - 1 AS d, ret / 1000 AS ret FROM rets),
y AS (SELECT *, d // 50 AS w FROM g)"""
)


def _slot_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rets = metrics.returns(src.order_bars(spark, sf_dir))
    stamps = src.numbered(rets.select("ts").distinct().withColumn("asset", F.lit("ALL"))).select("ts", "bar_idx")
    rows = rets.select("ts", F.col("asset").alias("template"), (F.col("ret") / 1000).alias("ret")).join(stamps, "ts")
    rows = rows.select(F.lit("ALL").alias("asset"), "template", F.floor(F.col("bar_idx") / 50).cast("long").alias("window_id"), "bar_idx", "ret")
    per = rows.groupBy("asset", "template", "window_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("s"))
    null = F.lit(None).cast("double")
    return per.select(
        "asset", "template", "window_id", F.lit(1).alias("trial_id"), F.col("s").alias("is_total_return"), F.col("n").alias("is_n_bars"), F.col("s").alias("oos_total_return"), F.col("n").alias("oos_n_bars"),
        F.col("n").alias("oos_n_trades"), null.alias("is_years"), null.alias("oos_years"),
    ), rows


_NESTED = f"""WITH {_SLOTS},
s AS (SELECT p.template AS a, q.template AS b, p.w, count(*) AS n, sum(p.ret) AS sx, sum(q.ret) AS sy, sum(p.ret * p.ret) AS sxx, sum(q.ret * q.ret) AS syy, sum(p.ret * q.ret) AS sxy
  FROM y p JOIN y q ON p.d = q.d AND p.template <= q.template GROUP BY 1, 2, 3),
ws AS (SELECT DISTINCT w FROM y), ab AS (SELECT DISTINCT a, b FROM s),
h AS (SELECT ab.a, ab.b, ws.w, {", ".join(f"sum({c}) OVER k AS {c}" for c in nested.SUMS)}, count(s.n) OVER k AS seen FROM ab CROSS JOIN ws LEFT JOIN s ON s.a = ab.a AND s.b = ab.b AND s.w = ws.w
  WINDOW k AS (PARTITION BY ab.a, ab.b ORDER BY ws.w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT a, b, w, seen, n, (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) AS corr, (sxy - sx * sy / n) / (n - 1) AS cov, sx / n AS mean FROM h WHERE n > 1),
o AS (SELECT a AS template, w, mean, cov, mean / sqrt(cov) * sqrt(252) AS sharpe FROM t WHERE a = b AND seen >= 4 AND n >= 60 AND mean / sqrt(cov) * sqrt(252) >= 0.2),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY sharpe DESC, template) AS k FROM o) WHERE k = 1),
c AS (SELECT f.w, o.template, o.sharpe, (f.mean + o.mean) / 2 / sqrt((f.cov + o.cov + 2 * t.cov) / 4) AS mix, f.mean / sqrt(f.cov) AS alone FROM f JOIN o ON o.w = f.w AND o.template <> f.template
  JOIN t ON t.w = f.w AND t.a = least(f.template, o.template) AND t.b = greatest(f.template, o.template) WHERE abs(t.corr) <= 0.6),
e AS (SELECT w, template FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY mix DESC, sharpe DESC, template) AS k FROM c WHERE mix > alone) WHERE k = 1),
held AS (SELECT 'ALL' AS asset, w AS window_id, template, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.w = f.w) THEN 0.5 ELSE 1.0 END AS weight, 0 AS rank FROM f UNION ALL SELECT 'ALL', w, template, 0.5, 1 FROM e)"""


def _nested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    wins, rets = _slot_table(spark, sf_dir)
    return nested.nested_portfolio(wins, rets, least_trades=0, most=2), rets


@query("nested_holdings", f"{_NESTED} SELECT asset, window_id, template, weight, rank FROM held")
def nested_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir)[0]


@query(
    "nested_portfolio_returns",
    f"""{_NESTED}, z AS (SELECT DISTINCT d, w FROM y WHERE w >= 4), m AS (SELECT y.d, sum(ret * weight) AS ret FROM y JOIN held ON held.window_id = y.w AND held.template = y.template GROUP BY 1)
SELECT 'ALL' AS asset, z.d AS bar_idx, z.w AS window_id, {r("coalesce(m.ret, 0)", "ret", 8)} FROM z LEFT JOIN m USING (d)""",
    digits=8,
)
def nested_portfolio_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, rets = _nested(spark, sf_dir)
    return nested.portfolio_returns(rets, held, 4)
