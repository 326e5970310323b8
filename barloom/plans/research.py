"""Queries of simulated plans, walk-forward selection and the tests of luck; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import backtest, metrics, search, simulation
from barloom.plans.queries import BARS, RETS, query, r
from barloom.sources import bars as src

SHOWN = {"direction": ("trend", "countertrend"), "channel": ("donchian", "keltner", "bollinger"), "entry": ("stop", "close_confirm", "pullback"), "exit": ("channel", "atr_trail", "target_stop", "time_stop")}


def plans(spark: SparkSession, switches: dict[str, tuple[str, ...]] = SHOWN) -> DataFrame:
    """trial_id and the switches of every combination."""
    rows = spark.range(1)
    for k, (name, values) in enumerate(switches.items()):
        rows = rows.select("*", F.posexplode(F.array(*map(F.lit, values))).alias(f"_p{k}", name))
    number, size = F.lit(0), 1
    for k, values in reversed(list(enumerate(switches.values()))):
        number, size = number + F.col(f"_p{k}") * size, size * len(values)
    return rows.select(number.cast("int").alias("trial_id"), *switches)


def _few(spark: SparkSession) -> DataFrame:
    return plans(spark, SHOWN | {"direction": ("trend",), "channel": ("donchian",)})


@query("backtest")
def run_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.simulated(src.order_bars(spark, sf_dir), plans(spark))


@query("simulated_trades")
def simulated_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.simulated(src.order_bars(spark, sf_dir), plans(spark), "trades")


@query("simulated_orders")
def simulated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.simulated(src.order_bars(spark, sf_dir), _few(spark), "orders")


def _trial_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive returns of the few plans: those on fixed capital do not depend on what came before."""
    return simulation.simulated(src.order_bars(spark, sf_dir), _few(spark), "bars", simulation.Account(fixed=True))


@query("trial_overfit")
def trial_overfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = metrics.block_stats(_trial_returns(spark, sf_dir), 16, ["asset", "trial_id"], "bar_idx")
    splits = backtest.overfit_probability(stats, 16, "trial_id", "asset")
    return splits.groupBy("asset").agg(F.count(F.lit(1)).alias("n_splits"), F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.avg("logit").alias("mean_logit"))


@query("trial_paths")
def trial_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, account = src.order_bars(spark, sf_dir), simulation.Account(fixed=True)
    name = F.concat_ws("|", "asset", "trial_id")
    rets = simulation.simulated(bars, _few(spark), "bars", account).select(name.alias("trial"), F.col("bar_idx").alias("ts"), "ret")
    trades = simulation.simulated(bars, _few(spark), "trades", account).select(name.alias("trial"), "entry_idx", "exit_idx")
    return backtest.purged_paths(rets, key="trial", trades=trades)


@query("trial_deflated")
def trial_deflated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.deflated_sharpe(metrics.moments(_trial_returns(spark, sf_dir), ["asset", "trial_id"]), 252.0, "trial_id", "asset")


@query("trial_reality_check")
def trial_reality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = _trial_returns(spark, sf_dir).select("asset", F.col("trial_id").cast("string").alias("trial"), F.col("bar_idx").alias("ts"), "ret")
    return backtest.reality_check(rets, 200, key="trial", family="asset")


_CDF = "0.5 + {z} / 3000 * list_sum(list_transform(range(0, 1001), lambda i: (CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow({z} * i / 1000, 2) / 2) / sqrt(2 * pi())))"


@query(
    "deflated_sharpe",
    f"""WITH {RETS}, m AS (SELECT asset, avg(ret) AS mu, stddev_pop(ret) AS sd, stddev_samp(ret) AS ss, count(*) AS n FROM rets GROUP BY asset),
k AS (SELECT asset, any_value(n) AS n, any_value(mu / ss) AS s, avg(pow((ret - mu) / sd, 3)) AS g3, avg(pow((ret - mu) / sd, 4)) AS g4 FROM rets JOIN m USING (asset) GROUP BY asset),
v AS (SELECT var_samp(s) AS v, count(*) AS n_trials FROM k), top1 AS (SELECT * FROM k ORDER BY s DESC, asset LIMIT 1),
z AS (SELECT *, sqrt(v) * {backtest.expected_max_sharpe(5)!r} AS star, sqrt(n - 1) / sqrt(1 - g3 * s + (g4 - 1) / 4 * s * s) AS per FROM top1, v),
w AS (SELECT *, s * per AS z0, (s - star) * per AS z1 FROM z)
SELECT asset AS best, n_trials, n, {r("s * sqrt(252)", "sharpe_annual")}, {r("star * sqrt(252)", "star_annual")}, {r(_CDF.format(z="z0"), "psr")}, {r(_CDF.format(z="z1"), "dsr")},
  {r("2 * ln(n_trials) / (s * s) / 252", "min_years")} FROM w""",
)
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.deflated_sharpe(metrics.moments(metrics.returns(src.order_bars(spark, sf_dir))), 252.0)


def lattice_plans(spark: SparkSession) -> DataFrame:
    points = search.lattice(spark, {"n_entry": [20, 40, 80], "stop_mult": [2.0, 3.0, 4.0], "n_exit": [10, 20]})
    p = F.col("params")
    return points.select("trial_id", "coord", p["n_entry"].cast("int").alias("n_entry"), p["stop_mult"].alias("stop_mult"), p["n_exit"].cast("int").alias("n_exit"))


@query("walk_forward")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.walk_forward(src.order_bars(spark, sf_dir), lattice_plans(spark), 3, 150, 50)


@query("walk_forward_summary")
def walk_forward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, points = src.order_bars(spark, sf_dir), lattice_plans(spark)
    return search.summary(*search.walked(bars, points, 3, 150, 50))


@query(
    "warmups",
    """WITH p AS (SELECT p_partkey AS trial_id, 10 + p_partkey % 70 AS n_entry, 10 + p_partkey % 13 AS n_exit, CASE p_partkey % 3 WHEN 0 THEN 'donchian' WHEN 1 THEN 'keltner' ELSE 'bollinger' END AS channel,
  CASE p_partkey % 2 WHEN 0 THEN 'channel' ELSE 'time_stop' END AS exit, CASE p_partkey % 5 WHEN 0 THEN 'none' ELSE 'trend_only' END AS f, CASE p_partkey % 4 WHEN 0 THEN 'adx' ELSE 'er' END AS g FROM part)
SELECT trial_id, CAST(5 + greatest(n_entry, 20, CASE WHEN channel = 'keltner' THEN ceil(ln(1e-4) / ln(1 - 2.0::DOUBLE / (n_entry + 1))) END, CASE WHEN exit = 'channel' THEN n_exit END,
  CASE WHEN exit = 'channel' AND channel = 'keltner' THEN ceil(ln(1e-4) / ln(1 - 2.0::DOUBLE / (n_exit + 1))) END,
  CASE WHEN f <> 'none' THEN CASE WHEN g = 'adx' THEN 14 + 2 * ceil(ln(1e-4) / ln(1 - 1.0::DOUBLE / 14)) ELSE 30 END END) AS BIGINT) AS bars FROM p""",
)
def warmups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda n, *names: F.get(F.array(*map(F.lit, names)), (k % n).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("trial_id"), (10 + k % 70).alias("n_entry"), (10 + k % 13).alias("n_exit"), pick(3, "donchian", "keltner", "bollinger").alias("channel"), pick(2, "channel", "time_stop").alias("exit"),
        F.when(k % 5 == 0, "none").otherwise("trend_only").alias("regime_filter"), F.when(k % 4 == 0, "adx").otherwise("er").alias("regime_indicator"),
    )
    return rows.select("trial_id", search.warmup(rows).alias("bars"))


@query(
    "keltner",
    f"""WITH RECURSIVE {BARS}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER p), abs(low - lag(close) OVER p)) AS tr FROM b WINDOW p AS (PARTITION BY asset ORDER BY ts)),
v AS MATERIALIZED (SELECT asset, bar_idx, close, CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END AS atr FROM t WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
e AS (SELECT asset, bar_idx, close AS m, atr FROM v WHERE bar_idx = 0 UNION ALL SELECT v.asset, v.bar_idx, e.m + (v.close - e.m) * 2 / 21, v.atr FROM e JOIN v ON v.asset = e.asset AND v.bar_idx = e.bar_idx + 1)
SELECT asset, bar_idx, {r("CASE WHEN bar_idx >= 19 THEN m + 2 * atr END", "upper")}, {r("CASE WHEN bar_idx >= 19 THEN m - 2 * atr END", "lower")}, {r("CASE WHEN bar_idx >= 19 THEN m END", "middle")} FROM e""",
)
def keltner(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.operators import recursive

    return recursive.keltner(src.order_bars(spark, sf_dir), 20, 2.0, 14)


#: Steps of one bar of a plan that follows breaks of a 40-bar channel, as columns added one layer after another; an exit comes first,
#: then an entry, then the entry bar's own stop and target. x is the plan's exit.
_STEP = (
    {"ok": "up IS NOT NULL AND lo IS NOT NULL AND atr > 0 AND NOT dead", "held": "side <> 0 AND NOT dead"},
    {"a": "CASE WHEN coalesce(ok, false) THEN atr ELSE last END", "late": "held AND x = 'time_stop' AND i - since >= 20", "opp": "CASE WHEN side > 0 THEN lx ELSE ux END"},
    {"lev1": "CASE WHEN x = 'atr_trail' AND side * ((ext - side * 3 * a) - stop) > 0 THEN ext - side * 3 * a ELSE stop END"},
    {"lev": "CASE WHEN x = 'channel' AND side * (opp - lev1) > 0 THEN opp ELSE lev1 END", "rest": "held AND NOT late", "aims": "held AND x = 'target_stop'"},
    {"gapped": "rest AND side * (o - lev) <= 0"},
    {"gained": "aims AND NOT gapped AND side * (o - goal) >= 0"},
    {"struck": "rest AND NOT gapped AND NOT gained AND CASE WHEN side > 0 THEN l <= lev ELSE h >= lev END"},
    {"reached": "aims AND NOT gapped AND NOT gained AND NOT struck AND CASE WHEN side > 0 THEN h >= goal ELSE l <= goal END"},
    {"left1": "late OR gapped OR gained OR struck OR reached", "at1": "CASE WHEN struck THEN lev WHEN reached THEN goal ELSE o END"},
    {"made1": "CASE WHEN left1 THEN side * units * (at1 - entry) - 0.0005 * units * abs(at1) ELSE 0 END"},
    {
        "cash1": "cash + made1", "side1": "CASE WHEN left1 THEN 0 ELSE side END",
        "ext1": "CASE WHEN held AND NOT left1 AND x = 'atr_trail' THEN CASE WHEN side > 0 THEN greatest(ext, h) ELSE least(ext, l) END ELSE ext END",
    },
    {"fresh": "coalesce(ok, false) AND NOT left1 AND side1 = 0 AND i >= first"},
    {"turn": "CASE WHEN fresh AND h >= up AND NOT (o <= lo AND o < up AND l <= lo) THEN 1 WHEN fresh AND l <= lo THEN -1 ELSE 0 END"},
    {"at2": "CASE turn WHEN 1 THEN greatest(o, up) WHEN -1 THEN least(o, lo) END"},
    {"qty": "CASE WHEN turn <> 0 THEN least(cash1 * 0.01 / (m * a), 2 * cash1 / abs(at2)) ELSE 0 END"},
    {"opens": "turn <> 0 AND qty > 0"},
    {
        "fee": "CASE WHEN opens THEN 0.0005 * qty * abs(at2) ELSE paid END", "side2": "CASE WHEN opens THEN turn ELSE side1 END", "units2": "CASE WHEN opens THEN qty ELSE units END",
        "entry2": "CASE WHEN opens THEN at2 ELSE entry END", "stop2": "CASE WHEN opens THEN at2 - turn * m * a ELSE stop END", "goal2": "CASE WHEN opens THEN at2 + turn * 4 * a ELSE goal END",
        "since2": "CASE WHEN opens THEN i ELSE since END", "cash2": "cash1 - CASE WHEN opens THEN 0.0005 * qty * abs(at2) ELSE 0 END",
    },
    {"opp2": "CASE WHEN side2 > 0 THEN lx ELSE ux END"},
    {"lev2": "CASE WHEN x = 'channel' AND side2 * (opp2 - stop2) > 0 THEN opp2 ELSE stop2 END"},
    {"thru": "opens AND side2 * (at2 - lev2) <= 0"},
    {"struck2": "opens AND NOT thru AND CASE WHEN side2 > 0 THEN l <= lev2 ELSE h >= lev2 END"},
    {"reached2": "opens AND x = 'target_stop' AND NOT thru AND NOT struck2 AND CASE WHEN side2 > 0 THEN h >= goal2 ELSE l <= goal2 END"},
    {"left2": "thru OR struck2 OR reached2", "at3": "CASE WHEN struck2 THEN lev2 WHEN reached2 THEN goal2 ELSE at2 END"},
    {"made2": "CASE WHEN left2 THEN side2 * units2 * (at3 - entry2) - 0.0005 * units2 * abs(at3) ELSE 0 END"},
    {
        "cash3": "cash2 + made2", "side3": "CASE WHEN left2 THEN 0 ELSE side2 END",
        "ext3": "CASE WHEN opens THEN CASE WHEN x = 'atr_trail' AND NOT left2 THEN CASE WHEN side2 > 0 THEN greatest(at2, h) ELSE least(at2, l) END ELSE at2 END ELSE ext1 END",
    },
    {"worth": "cash3 + CASE WHEN side3 <> 0 THEN side3 * units2 * (c - entry2) ELSE 0 END"},
    {"die": "NOT dead AND worth <= 0"},
    {"made3": "CASE WHEN die AND side3 <> 0 THEN side3 * units2 * (c - entry2) - 0.0005 * units2 * abs(c) ELSE 0 END"},
)
_STATE = (
    ("cash", "cash3 + made3"), ("side", "CASE WHEN die THEN 0 ELSE side3 END"), ("units", "units2"), ("paid", "fee"), ("entry", "entry2"), ("stop", "stop2"), ("goal", "goal2"), ("ext", "ext3"), ("last", "a"),
    ("since", "since2"), ("dead", "dead OR die"), ("equity", "CASE WHEN die THEN cash3 + made3 ELSE worth END"), ("ended", "left1 OR left2 OR (die AND side3 <> 0)"), ("t_entry", "CASE WHEN left1 THEN since ELSE since2 END"),
    ("t_side", "CASE WHEN left1 THEN side ELSE side2 END"), ("t_from", "CASE WHEN left1 THEN entry ELSE entry2 END"), ("t_to", "CASE WHEN left1 THEN at1 WHEN left2 THEN at3 ELSE c END"),
    ("w_fresh", "fresh"), ("w_rest", "rest"), ("w_aims", "aims"), ("w_late", "late"), ("w_up", "up"), ("w_lo", "lo"), ("w_lev", "lev"), ("w_lev1", "lev1"), ("w_goal", "goal"), ("w_side", "side"), ("w_units", "units"), ("w_open", "o"),
    ("w_opens", "opens"), ("w_at", "at2"), ("w_qty", "qty"), ("w_turn", "turn"), ("w_stop2", "stop2"), ("w_lev2", "lev2"), ("w_goal2", "goal2"), ("w_left1", "left1"), ("w_left2", "left2"), ("w_target1", "gained OR reached"), ("w_target2", "reached2"),
    ("w_trails", "x = 'atr_trail' AND lev1 <> stop"), ("w_opp", "x = 'channel' AND lev <> lev1"), ("w_opp2", "x = 'channel' AND lev2 <> stop2"), ("w_die", "die AND side3 <> 0"), ("w_made1", "made1 - paid"), ("w_made2", "made2 - fee"),
    ("t_units", "CASE WHEN left1 THEN units ELSE units2 END"), ("t_pnl", "CASE WHEN left1 THEN made1 - paid WHEN left2 THEN made2 - fee ELSE made3 - fee END"),
)


#: Bars, range and channels of the bar before each bar, for the lengths that lanes use.
_SPANS = (10, 20, 40, 80)
_SEEN = f"""{BARS},
t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER p), abs(low - lag(close) OVER p)) AS tr FROM b WINDOW p AS (PARTITION BY asset ORDER BY ts)),
w AS (SELECT *, {", ".join(f"CASE WHEN bar_idx >= {n - 1} THEN max(high) OVER w{n} END AS u{n}, CASE WHEN bar_idx >= {n - 1} THEN min(low) OVER w{n} END AS l{n}" for n in _SPANS)}, CASE WHEN bar_idx >= 19 THEN avg(tr) OVER w20 END AS atr0 FROM t
  WINDOW {", ".join(f"w{n} AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in _SPANS)}),
v AS MATERIALIZED (SELECT asset, bar_idx, open AS o, high AS h, low AS l, close AS c, lag(atr0) OVER p AS atr, {", ".join(f"lag({s}{n}) OVER p AS {s}{n}" for n in _SPANS for s in "ul")} FROM w WINDOW p AS (PARTITION BY asset ORDER BY ts))"""
_OF = lambda side, column: "CASE e." + column + "".join(f" WHEN {n} THEN v.{side}{n}" for n in _SPANS) + " END"


def _loop_sql(name: str, lanes: str) -> str:
    """A recursive table of every bar of lanes (asset, lane, trial_id, x, n, nx, m, low, first, stop), which start flat at ``low`` and trade from ``first`` on."""
    names, keys = [n for n, _ in _STATE], ("asset", "lane", "trial_id", "x", "n", "nx", "m", "first", "stop_at")
    step = f"""(SELECT {", ".join(f"e.{k}" for k in keys)}, v.bar_idx AS i, o, h, l, c, {_OF("u", "n")} AS up, {_OF("l", "n")} AS lo, atr, {_OF("u", "nx")} AS ux, {_OF("l", "nx")} AS lx, {", ".join(f"e.{n}" for n in names[:11])}
    FROM {name} e JOIN v ON v.asset = e.asset AND v.bar_idx = e.i + 1 AND e.i + 1 < e.stop_at)"""
    for layer in _STEP:
        step = f"(SELECT *, {', '.join(f'{expr} AS {column}' for column, expr in layer.items())} FROM {step})"
    zero = {"cash": "100000.0::DOUBLE", "equity": "100000.0::DOUBLE", "since": "-1::BIGINT", "dead": "false", "ended": "false", "w_turn": "0", "w_side": "0", **{f"w_{k}": "false" for k in ("fresh", "rest", "aims", "late", "opens", "left1", "left2", "target1", "target2", "trails", "opp", "opp2", "die")}, "t_entry": "0::BIGINT", "side": "0", "t_side": "0"}
    return f"""{name} AS (SELECT asset, lane, trial_id, x, n, nx, m, first, stop_at, low AS i, {', '.join(f"{zero.get(n, '0.0::DOUBLE')} AS {n}" for n in names)} FROM ({lanes})
  UNION ALL SELECT {", ".join(keys)}, i, {', '.join(f'{expr} AS {column}' for column, expr in _STATE)} FROM {step})"""


#: The four exits of a 40-bar breakout over the whole series.
_WHOLE = f"""WITH RECURSIVE {_SEEN}, {_loop_sql("e", """SELECT asset, 0 AS lane, trial_id, x, 40 AS n, 20 AS nx, 3.0::DOUBLE AS m, 0::BIGINT AS low, 0 AS first, max(bar_idx) + 1 AS stop_at
  FROM v, (VALUES (0, 'channel'), (1, 'atr_trail'), (2, 'target_stop'), (3, 'time_stop')) plans(trial_id, x) GROUP BY ALL""")}"""


def _exits(spark: SparkSession) -> DataFrame:
    return plans(spark, {"exit": SHOWN["exit"]})


@query(
    "breakout_trades",
    f"""{_WHOLE} SELECT asset, trial_id, t_entry AS entry_idx, i AS exit_idx, CAST(t_side AS INT) AS side, {r("t_from", "entry_price")}, {r("t_to", "exit_price")}, {r("t_units", "units")}, {r("t_pnl", "pnl")} FROM e WHERE ended""",
)
def breakout_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simulation.simulated(src.order_bars(spark, sf_dir), _exits(spark), "trades")
    return rows.select("asset", "trial_id", "entry_idx", "exit_idx", "side", "entry_price", "exit_price", "units", "pnl")


@query(
    "breakout_totals",
    f"""{_WHOLE}, k AS (SELECT *, lag(equity) OVER (PARTITION BY asset, trial_id ORDER BY i) AS q FROM e),
y AS (SELECT *, CASE WHEN q > 0 THEN equity / q - 1 ELSE 0 END AS ret, max(equity) OVER (PARTITION BY asset, trial_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS peak FROM k)
SELECT asset, trial_id, {r("arg_max(equity, i)", "final")}, {r("avg(ret) FILTER (i > 0) / stddev_samp(ret) FILTER (i > 0) * sqrt(252)", "sharpe")}, {r("min(equity / peak - 1)", "max_dd")}, count(*) FILTER (ended) AS n_trades,
  count(*) FILTER (ended AND t_pnl > 0) AS n_wins, {r("coalesce(sum(t_pnl) FILTER (ended AND t_pnl > 0), 0)", "gain")}, {r("coalesce(-sum(t_pnl) FILTER (ended AND t_pnl <= 0), 0)", "loss")}, count(*) AS n_bars FROM y GROUP BY 1, 2""",
)
def breakout_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simulation.simulated(src.order_bars(spark, sf_dir), _exits(spark))
    return rows.select("asset", "trial_id", "final", "sharpe", "max_dd", "n_trades", "n_wins", "gain", "loss", "n_bars")


@query(
    "breakout_states",
    f"""{_WHOLE}, z AS (SELECT *, row_number() OVER (PARTITION BY asset, trial_id ORDER BY i DESC) AS k FROM e)
SELECT asset, trial_id, CAST(side AS INT) AS position, {r("CASE WHEN side <> 0 THEN units ELSE 0 END", "units")}, {r("CASE WHEN side <> 0 THEN entry END", "entry_price")}, CASE WHEN side <> 0 THEN since ELSE i END AS entry_idx,
  {r("CASE WHEN side <> 0 THEN stop END", "stop")}, {r("equity", "equity")}, {r("equity - cash", "unrealized")} FROM z WHERE k = 1""",
)
def breakout_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simulation.simulated(src.order_bars(spark, sf_dir), _exits(spark), "states")
    return rows.select("asset", "trial_id", "position", "units", "entry_price", "entry_idx", "stop", "equity", "unrealized")


@query(
    "breakout_next_orders",
    f"""{_WHOLE}, z AS (SELECT e.*, u40, l40, u20, l20, atr0 FROM e JOIN w ON w.asset = e.asset AND w.bar_idx = e.i WHERE i = stop_at - 1),
q AS (SELECT *, CASE WHEN side > 0 THEN l20 ELSE u20 END AS opp, ext - side * 3 * atr0 AS chandelier FROM z),
k AS (SELECT *, CASE WHEN x = 'atr_trail' AND side * (chandelier - stop) > 0 THEN chandelier WHEN x = 'channel' AND side * (opp - stop) > 0 THEN opp ELSE stop END AS level,
  CASE WHEN x = 'atr_trail' AND side * (chandelier - stop) > 0 THEN 'trail' WHEN x = 'channel' AND side * (opp - stop) > 0 THEN 'channel' ELSE 'hard' END AS how, x = 'time_stop' AND stop_at - since >= 20 AS late FROM q),
a AS (SELECT asset, trial_id, 'exit_on_open' AS kind, -side AS side, NULL AS level, units AS shares, '' AS detail_text FROM k WHERE side <> 0 AND late
  UNION ALL SELECT asset, trial_id, 'stop', -side, level, units, how FROM k WHERE side <> 0 AND NOT late
  UNION ALL SELECT asset, trial_id, 'target', -side, goal, units, '' FROM k WHERE side <> 0 AND x = 'target_stop'
  UNION ALL SELECT asset, trial_id, 'stop', 1, u40, least(cash * 0.01 / (3 * atr0), 2 * cash / abs(u40)), '' FROM k WHERE side = 0
  UNION ALL SELECT asset, trial_id, 'stop', -1, l40, least(cash * 0.01 / (3 * atr0), 2 * cash / abs(l40)), '' FROM k WHERE side = 0)
SELECT asset, trial_id, kind, CAST(side AS INT) AS side, {r("level", "level")}, {r("shares", "shares")}, detail_text FROM a""",
)
def breakout_next_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.simulated(src.order_bars(spark, sf_dir), _exits(spark), "next_orders")


def _lane_totals(name: str) -> str:
    """Totals of each lane over its bars from ``first`` on."""
    return f"""(SELECT asset, lane, trial_id, arg_max(equity, i) / 100000 - 1 AS total, avg(ret) FILTER (i >= first) / nullif(stddev_samp(ret) FILTER (i >= first), 0) * sqrt(252) AS sharpe, min(CASE WHEN i >= first THEN equity / peak - 1 END) AS dd,
  count(*) FILTER (ended) AS n_trades FROM (SELECT *, equity / lag(equity) OVER p - 1 AS ret, max(equity) OVER (PARTITION BY asset, lane, trial_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS peak FROM {name} WINDOW p AS (PARTITION BY asset, lane, trial_id ORDER BY i)) GROUP BY 1, 2, 3)"""


_LATTICE = ", ".join(f"({a * 6 + b * 2 + c}, {a}, {b}, {c}, {n}, {m}, {nx})" for a, n in enumerate((20, 40, 80)) for b, m in enumerate((2.0, 3.0, 4.0)) for c, nx in enumerate((10, 20)))


@query(
    "walk_forward_picks",
    f"""WITH RECURSIVE {_SEEN}, lat AS (SELECT * FROM (VALUES {_LATTICE}) t(trial_id, ca, cb, cc, n, m, nx)),
cnt AS (SELECT asset, count(*) AS n FROM b GROUP BY asset),
win AS (SELECT asset, n AS n_bars, unnest(range(0, (n - 170) // 50 + 1)) AS lane FROM cnt WHERE n >= 170),
bnd AS (SELECT asset, lane, lane * 50 AS train_start, lane * 50 + 150 AS test_start, least(lane * 50 + 200, n_bars) AS test_end FROM win),
{_loop_sql("tr", "SELECT asset, lane, trial_id, 'channel' AS x, n, nx, m::DOUBLE AS m, greatest(train_start, 85) - 85 AS low, greatest(train_start, 85) AS first, test_start AS stop_at FROM bnd, lat")},
s0 AS MATERIALIZED (SELECT k.*, ca, cb, cc, CASE WHEN n_trades >= 5 THEN coalesce(sharpe, 0) END AS score FROM {_lane_totals("tr")} k JOIN lat USING (trial_id)),
mid AS (SELECT asset, lane, median(score) AS mid FROM s0 GROUP BY 1, 2),
nb AS (SELECT a.asset, a.lane, a.trial_id, sum(z.score) AS t, count(z.score) AS k FROM s0 a JOIN s0 z ON a.asset = z.asset AND a.lane = z.lane AND abs(a.ca - z.ca) <= 1 AND abs(a.cb - z.cb) <= 1 AND abs(a.cc - z.cc) <= 1 WHERE a.score IS NOT NULL GROUP BY 1, 2, 3),
pk AS MATERIALIZED (SELECT * FROM (SELECT s0.*, row_number() OVER (PARTITION BY s0.asset, s0.lane ORDER BY (t + 0.5 * (18 - k) * mid) / (k + 0.5 * (18 - k)) DESC NULLS LAST, score DESC NULLS LAST, s0.trial_id) AS place
  FROM s0 JOIN nb USING (asset, lane, trial_id) JOIN mid USING (asset, lane)) WHERE place = 1),
{_loop_sql("ts", "SELECT asset, lane, trial_id, 'channel' AS x, lat.n, lat.nx, lat.m::DOUBLE AS m, greatest(test_start - 85, 0) AS low, test_start AS first, test_end AS stop_at FROM pk JOIN bnd USING (asset, lane) JOIN lat USING (trial_id)")},
o AS (SELECT * FROM {_lane_totals("ts")}),
f AS (SELECT bnd.*, pk.trial_id, pk.total AS it, coalesce(pk.sharpe, CASE WHEN pk.trial_id IS NOT NULL THEN 0 END) AS ish, pk.n_trades AS itr, o.total AS ot, coalesce(o.sharpe, CASE WHEN o.trial_id IS NOT NULL THEN 0 END) AS osh, o.dd AS od, o.n_trades AS otr
  FROM bnd LEFT JOIN pk USING (asset, lane) LEFT JOIN o USING (asset, lane))
SELECT asset, lane AS window_id, train_start, test_start, test_end, trial_id, {r("it", "is_total_return")}, {r("ish", "is_sharpe")}, itr AS is_n_trades, {r("ot", "oos_total_return")}, {r("osh", "oos_sharpe")}, {r("od", "oos_max_dd")}, otr AS oos_n_trades,
  {r("100000 * coalesce(product(1 + coalesce(ot, 0)) OVER (PARTITION BY asset ORDER BY lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)", "initial_equity", 2)} FROM f""",
)
def walk_forward_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    wins = search.walk_forward(src.order_bars(spark, sf_dir), lattice_plans(spark), 3, 150, 50)
    told = ("is_total_return", "is_sharpe", "is_n_trades", "oos_total_return", "oos_sharpe", "oos_max_dd", "oos_n_trades")
    return wins.select("asset", "window_id", "train_start", "test_start", "test_end", "trial_id", *told, F.round("initial_equity", 2).alias("initial_equity"))


#: What each bar of a lane puts into the order log.
_LOG = """SELECT asset, trial_id, i, 'entry_working' AS kind, 1 AS side, 'stop' AS detail_text, w_up AS level, 0 AS qty, 0 AS aux FROM e WHERE w_fresh
  UNION ALL SELECT asset, trial_id, i, 'entry_working', -1, 'stop', w_lo, 0, 0 FROM e WHERE w_fresh
  UNION ALL SELECT asset, trial_id, i, 'time_exit_submit', w_side, '', w_open, w_units, 0 FROM e WHERE w_late
  UNION ALL SELECT asset, trial_id, i, 'stop_working', w_side, CASE WHEN w_opp THEN 'channel' WHEN w_trails THEN 'trail' ELSE 'hard' END, w_lev, w_units, 0 FROM e WHERE w_rest
  UNION ALL SELECT asset, trial_id, i, 'target_working', w_side, '', w_goal, w_units, 0 FROM e WHERE w_rest AND w_aims
  UNION ALL SELECT asset, trial_id, i, 'exit_fill', w_side, CASE WHEN w_late THEN 'time' WHEN w_target1 THEN 'target' WHEN w_opp THEN 'channel' ELSE 'stop' END, t_to, w_units, w_made1 FROM e WHERE w_left1
  UNION ALL SELECT asset, trial_id, i, 'entry_fill', w_turn, 'stop', w_at, w_qty, w_stop2 FROM e WHERE w_opens
  UNION ALL SELECT asset, trial_id, i, 'stop_working', w_turn, CASE WHEN w_opp2 THEN 'channel' ELSE 'hard' END, w_lev2, w_qty, 0 FROM e WHERE w_opens
  UNION ALL SELECT asset, trial_id, i, 'target_working', w_turn, '', w_goal2, w_qty, 0 FROM e WHERE w_opens AND x = 'target_stop'
  UNION ALL SELECT asset, trial_id, i, 'exit_fill', w_turn, CASE WHEN w_target2 THEN 'target' WHEN w_opp2 THEN 'channel' ELSE 'stop_same_bar' END, t_to, w_qty, w_made2 FROM e WHERE w_left2
  UNION ALL SELECT asset, trial_id, i, 'exit_fill', t_side, 'ruin', t_to, t_units, t_pnl FROM e WHERE w_die"""


@query(
    "breakout_orders",
    f"""{_WHOLE}, g AS ({_LOG}) SELECT asset, trial_id, i AS bar_idx, kind, CAST(side AS INT) AS side, detail_text, {r("level", "level")}, {r("qty", "qty")}, {r("aux", "aux")} FROM g""",
)
def breakout_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simulation.simulated(src.order_bars(spark, sf_dir), _exits(spark), "orders")
    return rows.select("asset", "trial_id", "bar_idx", "kind", "side", "detail_text", "level", "qty", "aux")


@query(
    "breakout_exposures",
    f"""{_WHOLE}, y AS (SELECT e.asset, e.trial_id, i, equity, c, CASE WHEN side <> 0 THEN side * units ELSE 0 END AS u, CASE WHEN w_left1 THEN w_units ELSE 0 END + CASE WHEN w_opens AND NOT w_left2 THEN w_qty ELSE 0 END AS moved
  FROM e JOIN v ON v.asset = e.asset AND v.bar_idx = e.i)
SELECT asset, trial_id, count(*) AS n_bars, count(*) FILTER (u <> 0) AS held_bars, {r("avg(abs(u * c) / equity)", "gross")}, {r("avg(u * c / equity)", "net")}, {r("avg(moved * c / equity) * 252", "turnover")} FROM y GROUP BY 1, 2""",
)
def breakout_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, p = src.order_bars(spark, sf_dir), _exits(spark)
    return metrics.exposures(b, simulation.simulated(b, p, "all_trades").withColumn("exit_idx", F.coalesce("exit_idx", F.lit(1 << 40))), simulation.simulated(b, p, "bars"))
