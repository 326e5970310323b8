"""Queries over the driver tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.operators import backtest, book, metrics, recursive, search
from barloom.sources import bars as src

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Daily bars of orders, as ``src.order_bars``.
BARS = """b0 AS (
  SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS bar_idx FROM b0)"""
RETS = (
    BARS
    + """,
r AS (SELECT asset, ts, bar_idx, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY ts), 0) - 1 AS ret FROM b),
rets AS (SELECT * FROM r WHERE ret IS NOT NULL)"""
)


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None, digits: int = 4):
    """Registers a query; doubles are rounded to ``digits`` in it and in the columns {r:...} of its SQL."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def r(expr: str, name: str, digits: int = 4) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def ok(expr: str, of: str, n: int, w: str) -> str:
    return f"CASE WHEN count({of}) OVER {w} = {n} THEN {expr} END"


OHLCV = ", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume"))


@query("order_bars", f"WITH {BARS} SELECT asset, ts, bar_idx, {OHLCV} FROM b")
def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.order_bars(spark, sf_dir)


def _event_sql(unit: str) -> str:
    return f"""WITH b AS (SELECT event_type AS asset, date_trunc('{unit}', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)
SELECT asset, CAST(ts AS TIMESTAMP) AS ts, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS bar_idx, {OHLCV} FROM b"""


@query("event_bars_hour", _event_sql("hour"))
def event_bars_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_bars(spark, sf_dir, "hour")


@query("event_bars_day", _event_sql("day"))
def event_bars_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_bars(spark, sf_dir, "day")


@query(
    "activity_bars",
    f"""WITH e AS (SELECT event_type AS asset, ts, event_id, value, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 50 AS bucket FROM events)
SELECT asset, bucket, min(ts) AS first_ts, max(ts) AS last_ts, {r("arg_min(value, (ts, event_id))", "open")}, {r("max(value)", "high")}, {r("min(value)", "low")},
  {r("arg_max(value, (ts, event_id))", "close")}, count(*) AS volume FROM e GROUP BY 1, 2""",
)
def activity_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.activity_bars(spark, sf_dir)


@query(
    "ship_bars",
    f"""SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS ts, {r("max(l_extendedprice / l_quantity)", "high", 8)},
  {r("min(l_extendedprice / l_quantity)", "low", 8)}, {r("sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0 / sum(l_quantity)", "vwap", 8)}, {r("sum(l_quantity)", "volume", 8)}
FROM lineitem GROUP BY 1, 2""",
    digits=8,
)
def ship_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.ship_bars(spark, sf_dir)


@query("shared_bars", f"WITH {BARS} SELECT asset, ts, bar_idx, {OHLCV} FROM b WHERE ts IN (SELECT ts FROM b GROUP BY ts HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM b))")
def shared_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.shared_bars(src.order_bars(spark, sf_dir))


W20, W14, W30 = "w20", "w14", "w30"
WINDOWS = " WINDOW p AS (PARTITION BY asset ORDER BY ts), " + ", ".join(
    f"w{n} AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (10, 14, 20, 30, 60)
)
STEP = (
    BARS
    + """,
s AS (SELECT *, close - lag(close) OVER (PARTITION BY asset ORDER BY ts) AS ch, close - lag(close, 5) OVER (PARTITION BY asset ORDER BY ts) AS ch5,
  greatest(high - low, abs(high - lag(close) OVER (PARTITION BY asset ORDER BY ts)), abs(low - lag(close) OVER (PARTITION BY asset ORDER BY ts))) AS tr FROM b)"""
)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = src.order_bars(spark, sf_dir)
    return b.withColumns({"ch": F.col("close") - ind.lag(F.col("close")), "ch5": F.col("close") - ind.lag(F.col("close"), 5), "tr": ind.true_range()})


@query(
    "channels",
    f"""WITH {STEP} SELECT asset, bar_idx, {r(ok("max(high) OVER w20", "high", 20, W20), "don_high")}, {r(ok("min(low) OVER w20", "low", 20, W20), "don_low")},
  {r(ok("avg(close) OVER w20", "close", 20, W20), "sma")}, {r(ok("avg(tr) OVER w14", "tr", 14, W14), "atr")},
  {r(ok("avg(close) OVER w20 + 2 * stddev_pop(close) OVER w20", "close", 20, W20), "boll_high")},
  {r(ok("avg(close) OVER w20 - 2 * stddev_pop(close) OVER w20", "close", 20, W20), "boll_low")} FROM s{WINDOWS}""",
)
def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, low, _ = ind.donchian(20)
    up, down, middle = ind.bollinger(20, 2.0)
    return _steps(spark, sf_dir).select(
        "asset", "bar_idx", high.alias("don_high"), low.alias("don_low"), middle.alias("sma"), ind.sma(F.col("tr"), 14).alias("atr"),
        up.alias("boll_high"), down.alias("boll_low"),
    )


def _hurst_sql() -> str:
    import math

    x = [math.log(q) for q in range(1, 6)]
    m = sum(x) / 5
    v = sum((a - m) ** 2 for a in x)
    return " + ".join(f"({(a - m) / v!r}::DOUBLE) * ln(nullif(v{q}, 0))" for q, a in enumerate(x, 1))


@query(
    "regimes",
    f"""WITH {STEP}, h AS (SELECT *, {", ".join(f"close - lag(close, {q}) OVER (PARTITION BY asset ORDER BY ts) AS m{q}" for q in range(1, 6))} FROM s),
v AS (SELECT *, {", ".join(f"var_pop(m{q}) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS v{q}" for q in range(1, 6))},
  count(m5) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS n5 FROM h)
SELECT asset, bar_idx,
  {r(ok("least(greatest(abs(close - lag(close, 20) OVER p) / nullif(sum(abs(ch)) OVER w20, 0), 0), 1)", "ch", 20, W20), "er")},
  {r(ok("coalesce(corr(close, bar_idx) OVER w20, 0)", "close", 20, W20), "cti")},
  {r(ok("least(greatest(100 * log10(sum(tr) OVER w14 / nullif(max(high) OVER w14 - min(low) OVER w14, 0)) / log10(14), 0), 100)", "tr", 14, W14), "chop")},
  {r(ok("least(greatest(var_samp(ch5) OVER w60 / nullif(5 * var_samp(ch) OVER w60, 0), 0), 5)", "ch5", 60, "w60"), "vr")},
  {r(f"CASE WHEN n5 = 30 THEN ({_hurst_sql()}) / 2 END", "hurst")} FROM v{WINDOWS}""",
)
def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _steps(spark, sf_dir).withColumns({f"m{q}": F.col("close") - ind.lag(F.col("close"), q) for q in range(1, 6)})
    return s.select(
        "asset", "bar_idx", ind.efficiency_ratio(20, F.col("ch")).alias("er"), ind.trend_correlation(20).alias("cti"),
        ind.choppiness(14, F.col("tr")).alias("chop"), ind.variance_ratio(60, 5, F.col("ch"), F.col("ch5")).alias("vr"),
        ind.hurst(30, [F.col(f"m{q}") for q in range(1, 6)]).alias("hurst"),
    )


@query(
    "ranks",
    f"""WITH {STEP}, g AS (SELECT asset, bar_idx, tr, close, list(tr) OVER w30 AS ts, list(ch) OVER w30 AS cs, median(ch) OVER w30 AS md, count(*) OVER w30 AS n, count(ch) OVER w30 AS nc FROM s{WINDOWS})
SELECT asset, bar_idx,
  {r("CASE WHEN n = 30 THEN (len(list_filter(ts, lambda v: v < tr)) + (len(list_filter(ts, lambda v: v = tr)) + 1) / 2) / 30 END", "tr_rank")},
  {r("CASE WHEN nc = 30 THEN 100.0 * len(list_filter(range(2, 31), lambda i: (cs[i] > md AND cs[i] > cs[i - 1]) OR (cs[i] < md AND cs[i] < cs[i - 1]))) / 29 END", "away")}
FROM g""",
)
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("asset", "bar_idx", ind.percentile_rank(F.col("tr"), 30).alias("tr_rank"), ind.market_meanness(30, F.col("ch")).alias("away"))


STANCE = (
    BARS
    + """,
ch AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN max(high) OVER w END AS hi, CASE WHEN count(*) OVER w = 20 THEN min(low) OVER w END AS lo FROM b
  WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
sg AS (SELECT *, CASE WHEN high >= lag(hi) OVER p AND low > lag(lo) OVER p THEN 1 WHEN low <= lag(lo) OVER p AND high < lag(hi) OVER p THEN -1 END AS sig
  FROM ch WINDOW p AS (PARTITION BY asset ORDER BY ts)),
st AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 39 PRECEDING AND CURRENT ROW), 0) AS stance FROM sg)"""
)


def _stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    high, low, _ = ind.donchian(20)
    b = src.order_bars(spark, sf_dir).withColumns({"hi": high, "lo": low})
    b = b.withColumn("sig", ind.break_signal(F.col("hi"), F.col("lo")))
    return b.withColumn("stance", ind.stance(F.col("sig"), 40))


@query("stances", f"WITH {STANCE} SELECT asset, bar_idx, stance FROM st")
def stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stances(spark, sf_dir).select("asset", "bar_idx", "stance")


SPELLS = (
    STANCE
    + """,
cg AS (SELECT *, CASE WHEN stance <> coalesce(lag(stance) OVER (PARTITION BY asset ORDER BY bar_idx), 0) THEN 1 ELSE 0 END AS c FROM st),
rn AS (SELECT *, sum(c) OVER (PARTITION BY asset ORDER BY bar_idx) AS run FROM cg),
sp AS (SELECT asset, CAST(run AS BIGINT) AS run, min(stance) AS side, min(bar_idx) AS entry, max(bar_idx) + 1 AS exit, count(*) AS held FROM rn WHERE stance <> 0 GROUP BY 1, 2)"""
)


@query("spells", f"WITH {SPELLS} SELECT * FROM sp")
def spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.spells(_stances(spark, sf_dir))


@query("exposure", f"WITH {SPELLS} SELECT sp.asset, b.bar_idx, CAST(sum(side) AS BIGINT) AS units FROM sp JOIN b ON b.asset = sp.asset AND b.bar_idx >= entry AND b.bar_idx < exit GROUP BY 1, 2")
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.exposure(book.spells(_stances(spark, sf_dir)))


@query(
    "stance_loss",
    f"""WITH {STANCE},
t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER p), abs(low - lag(close) OVER p)) AS tr FROM st WINDOW p AS (PARTITION BY asset ORDER BY ts)),
a AS (SELECT *, CASE WHEN count(tr) OVER w = 20 THEN avg(tr) OVER w END AS atr FROM t WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, lag(stance) OVER p AS s1, nullif(lag(atr) OVER p, 0) AS a1, close - lag(close) OVER p AS d FROM a WINDOW p AS (PARTITION BY asset ORDER BY ts))
SELECT asset, bar_idx, {r("CASE WHEN hi IS NULL OR a1 IS NULL THEN 0.5 ELSE 0.5 - 0.5 * least(greatest((s1 * d / a1 - abs(close) * 0.0005 / a1 * abs(stance - s1)) / 2, -1), 1) END", "loss")} FROM z""",
)
def stance_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stances(spark, sf_dir)
    s = s.withColumn("tr", ind.true_range()).withColumn("atr", ind.sma(F.col("tr"), 20))
    s = s.withColumns({"s1": ind.lag(F.col("stance")), "a1": F.nullif(ind.lag(F.col("atr")), F.lit(0.0)), "d": F.col("close") - ind.lag(F.col("close"))})
    loss = ind.stance_loss(F.col("s1"), F.col("stance"), F.col("d") / F.col("a1"), F.abs(F.col("close")) * 0.0005 / F.col("a1"), F.col("hi").isNotNull())
    return s.select("asset", "bar_idx", loss.alias("loss"))


@query(
    "performance",
    f"""WITH {RETS} SELECT asset, count(*) AS n, {r("CASE WHEN stddev_samp(ret) = 0 THEN 0 ELSE avg(ret) / stddev_samp(ret) * sqrt(252) END", "sharpe")},
  {r("stddev_samp(ret) * sqrt(252)", "vol")}, {r("avg(CAST(ret > 0 AS INT))", "win_rate")}, {r("sum(CASE WHEN ret > 0 THEN ret END) / nullif(-sum(CASE WHEN ret < 0 THEN ret END), 0)", "profit_factor")}
FROM rets GROUP BY asset""",
)
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets, x = metrics.returns(src.order_bars(spark, sf_dir)), F.col("ret")
    return rets.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), metrics.sharpe(x, 252).alias("sharpe"), (F.stddev_samp(x) * F.sqrt(F.lit(252.0))).alias("vol"),
        F.avg((x > 0).cast("int")).alias("win_rate"), (F.sum(F.when(x > 0, x)) / F.nullif(-F.sum(F.when(x < 0, x)), F.lit(0.0))).alias("profit_factor"),
    )


@query(
    "curves",
    f"""WITH {RETS}, a AS (SELECT *, ret / 1000 AS x FROM rets), c AS (SELECT asset, ts, product(1 + x) OVER w AS equity, 1 + sum(x) OVER w AS added FROM a
  WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT asset, ts, {r("equity", "equity")}, {r("equity / greatest(max(equity) OVER w, 1) - 1", "drawdown")}, {r("added", "added")} FROM c
  WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
)
def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = metrics.returns(src.order_bars(spark, sf_dir)).withColumn("ret", F.col("ret") / 1000)
    added = 1 + F.sum("ret").over(src.by_bar().rowsBetween(Window.unboundedPreceding, 0))
    return metrics.curve(rets.withColumn("added", added)).select("asset", "ts", "equity", "drawdown", "added")


@query(
    "moments",
    f"""WITH {RETS}, m AS (SELECT asset, avg(ret) AS mu, stddev_pop(ret) AS sd, stddev_samp(ret) AS ss, count(*) AS n FROM rets GROUP BY asset),
k AS (SELECT asset, any_value(n) AS n, any_value(mu / ss) AS s, avg(pow((ret - mu) / sd, 3)) AS g3, avg(pow((ret - mu) / sd, 4)) AS g4 FROM rets JOIN m USING (asset) GROUP BY asset)
SELECT asset, n, {r("s", "sharpe_bar")}, {r("g3", "skew")}, {r("g4", "kurt")}, {r("s * sqrt(n - 1) / sqrt(1 - g3 * s + (g4 - 1) / 4 * s * s)", "z")} FROM k""",
)
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.moments(metrics.returns(src.order_bars(spark, sf_dir))).withColumn("z", metrics.sharpe_z())


@query(
    "correlations",
    f"""WITH {RETS} SELECT a.asset AS a, b.asset AS b, count(*) AS n, {r("corr(a.ret, b.ret)", "corr")}, {r("covar_samp(a.ret, b.ret)", "cov")}
FROM rets a JOIN rets b ON a.ts = b.ts AND a.asset < b.asset GROUP BY 1, 2""",
)
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.correlations(metrics.returns(src.order_bars(spark, sf_dir)))


@query(
    "against_benchmark",
    f"""WITH {RETS}, k AS (SELECT ts, ret AS base FROM rets WHERE asset = '1-URGENT'),
j AS (SELECT asset, ret, coalesce(base, 0) AS base FROM rets LEFT JOIN k USING (ts) WHERE asset <> '1-URGENT')
SELECT asset, {r("covar_samp(ret, base) / nullif(var_samp(base), 0)", "beta")}, {r("corr(ret, base)", "corr")} FROM j GROUP BY asset""",
)
def against_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.against(metrics.returns(src.order_bars(spark, sf_dir)), "1-URGENT")


@query(
    "block_stats",
    f"""WITH {RETS}, q AS (SELECT asset, ret, CAST(((row_number() OVER (PARTITION BY asset ORDER BY ts) - 1) * 8) // count(*) OVER (PARTITION BY asset) AS INT) AS block FROM rets)
SELECT asset, block, count(*) AS n, {r("sum(ret)", "s")}, {r("sum(ret * ret)", "s2")} FROM q GROUP BY 1, 2""",
)
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.block_stats(metrics.returns(src.order_bars(spark, sf_dir)), 8)


@query(
    "overfit_probability",
    f"""WITH {RETS}, q AS (SELECT asset, ret, ((row_number() OVER (PARTITION BY asset ORDER BY ts) - 1) * 8) // count(*) OVER (PARTITION BY asset) AS block FROM rets),
bs AS (SELECT asset, block, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS s2 FROM q GROUP BY 1, 2),
masks AS (SELECT m FROM range(0, 256) t(m) WHERE bit_count(m) = 4),
x AS (SELECT m, asset, sum(n) FILTER (i) AS n1, sum(s) FILTER (i) AS s1, sum(s2) FILTER (i) AS t1, sum(n) FILTER (NOT i) AS n0, sum(s) FILTER (NOT i) AS s0, sum(s2) FILTER (NOT i) AS t0
  FROM (SELECT *, (m >> CAST(block AS INT)) & 1 = 1 AS i FROM bs, masks) GROUP BY 1, 2),
y AS (SELECT m, asset, (s1 / n1) / sqrt((t1 - s1 * s1 / n1) / (n1 - 1)) AS inside, (s0 / n0) / sqrt((t0 - s0 * s0 / n0) / (n0 - 1)) AS outside FROM x),
wn AS (SELECT m, arg_max(asset, inside) AS winner, arg_max(outside, inside) AS level FROM y GROUP BY m),
k AS (SELECT m, winner, (sum(CAST(outside < level AS DOUBLE)) + 0.5 * sum(CAST(outside = level AS DOUBLE)) + 0.5) / (count(*) + 1) AS share FROM y JOIN wn USING (m) GROUP BY 1, 2)
SELECT winner, count(*) AS n_splits, {r("avg(CAST(share < 0.5 AS DOUBLE))", "pbo")}, {r("avg(ln(share / (1 - share)))", "mean_logit")} FROM k GROUP BY winner""",
)
def overfit_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = metrics.block_stats(metrics.returns(src.order_bars(spark, sf_dir)), 8)
    splits = backtest.overfit_probability(stats, 8, "asset")
    return splits.groupBy("winner").agg(
        F.count(F.lit(1)).alias("n_splits"), F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.avg("logit").alias("mean_logit")
    )


@query(
    "purged_paths",
    f"""WITH {RETS}, q AS (SELECT asset, ret, row_number() OVER w - 1 AS i, ((row_number() OVER w - 1) * 8) // count(*) OVER (PARTITION BY asset) AS g
  FROM rets WINDOW w AS (PARTITION BY asset ORDER BY ts)),
h AS (SELECT *, i - min(i) OVER (PARTITION BY asset, g) AS place FROM q),
t AS (SELECT a.x AS lo, b.x AS hi FROM range(0, 8) a(x), range(0, 8) b(x) WHERE a.x < b.x),
tr AS (SELECT lo, hi, asset, avg(ret) / stddev_samp(ret) AS score FROM h, t
  WHERE g NOT IN (lo, hi) AND NOT (place < 10 AND g - 1 IN (lo, hi)) GROUP BY 1, 2, 3),
best AS (SELECT lo, hi, arg_max(asset, score) AS asset FROM tr GROUP BY 1, 2),
tested AS (SELECT lo, hi, lo AS g FROM t UNION ALL SELECT lo, hi, hi FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY (1 << lo) + (1 << hi)) - 1 AS path FROM tested)
SELECT CAST(path AS INT) AS path, count(*) AS n, {r("avg(ret) / stddev_samp(ret)", "sharpe")} FROM p JOIN best USING (lo, hi) JOIN h USING (asset, g) GROUP BY 1""",
)
def purged_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.purged_paths(metrics.returns(src.order_bars(spark, sf_dir)))


@query(
    "session_returns",
    f"""WITH e AS (SELECT event_type AS asset, date_trunc('hour', ts) AS h, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2),
x AS (SELECT asset, h, ln(1 + close) - ln(1 + lag(close) OVER (PARTITION BY asset ORDER BY h)) AS ret FROM e)
SELECT asset, CAST(h - INTERVAL 390 MINUTE AS DATE) AS session, count(ret) AS n, {r("sum(ret)", "ret")} FROM x WHERE ret IS NOT NULL GROUP BY 1, 2""",
)
def session_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = src.event_bars(spark, sf_dir, "hour")
    x = b.select("asset", "ts", (F.ln(1 + F.col("close")) - F.ln(1 + ind.lag(F.col("close")))).alias("ret")).filter("ret IS NOT NULL")
    session = (F.col("ts") - F.expr("INTERVAL 390 MINUTES")).cast("date")
    return x.groupBy("asset", session.alias("session")).agg(F.count("ret").alias("n"), F.sum("ret").alias("ret"))


@query(
    "bars_per_year",
    f"""WITH {BARS}, a AS (SELECT asset, min(ts) AS first, max(ts) AS last, count(*) AS n FROM b GROUP BY asset),
y AS (SELECT asset, year(ts) AS y, count(*) AS n FROM b GROUP BY 1, 2),
f AS (SELECT y.asset, y.n * 365.25 / (CASE WHEN (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 THEN 366 ELSE 365 END) AS x
      FROM y JOIN a USING (asset) WHERE y > year(first) AND y < year(last)),
m AS (SELECT asset, median(x) AS x, count(*) AS years FROM f GROUP BY asset)
SELECT asset, CAST(greatest(1, round_even(CASE WHEN years >= 2 THEN x ELSE (n - 1) / (date_diff('day', first, last) / 365.25) END, 0)) AS BIGINT) AS per_year,
  coalesce(years, 0) AS years FROM a LEFT JOIN m USING (asset)""",
)
def bars_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_year(src.order_bars(spark, sf_dir))


@query(
    "walk_forward_windows",
    f"""WITH {BARS}, n AS (SELECT asset, count(*) AS n FROM b GROUP BY asset),
w AS (SELECT asset, n, unnest(range(0, (n - 520) // 125 + 1)) AS window_id FROM n WHERE n >= 520)
SELECT asset, window_id, window_id * 125 AS train_start, window_id * 125 + 500 AS train_end, window_id * 125 + 500 AS test_start, least(window_id * 125 + 625, n) AS test_end FROM w""",
)
def walk_forward_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.windows(src.order_bars(spark, sf_dir), 500, 125)


@query(
    "window_stats",
    f"""WITH {RETS}, n AS (SELECT asset, count(*) AS n FROM b GROUP BY asset),
w AS (SELECT asset, n, unnest(range(0, (n - 520) // 125 + 1)) AS window_id FROM n WHERE n >= 520),
j AS (SELECT r.asset, window_id, CASE WHEN bar_idx < window_id * 125 + 500 THEN 'train' ELSE 'test' END AS part, ret
  FROM rets r JOIN w ON r.asset = w.asset AND bar_idx >= window_id * 125 AND bar_idx < window_id * 125 + 625)
SELECT asset, window_id, part, count(*) AS n, {r("avg(ret)", "mean")}, {r("stddev_samp(ret)", "sd")} FROM j GROUP BY 1, 2, 3""",
)
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = src.order_bars(spark, sf_dir)
    known = search.windows(b, 500, 125).select("asset", "window_id")
    rows = search.in_windows(metrics.returns(b), 500, 125).join(known, ["asset", "window_id"], "left_semi")
    return rows.groupBy("asset", "window_id", "part").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))


_LIST = lambda xs: ", ".join(f"('{x}')" for x in xs)


@query(
    "templates",
    f"""WITH t AS (SELECT DISTINCT d AS direction, c AS channel, e AS entry, CASE WHEN e = 'stance' THEN 'channel' ELSE x END AS exit, f AS regime_filter,
  CASE WHEN f = 'none' THEN 'er' ELSE i END AS regime_indicator
  FROM (VALUES {_LIST(search.SWITCHES["direction"])}) a(d), (VALUES {_LIST(search.SWITCHES["channel"])}) b(c), (VALUES {_LIST(search.SWITCHES["entry"])}) g(e),
    (VALUES {_LIST(search.SWITCHES["exit"])}) h(x), (VALUES {_LIST(search.SWITCHES["regime_filter"])}) j(f), (VALUES {_LIST(search.SWITCHES["regime_indicator"])}) k(i))
SELECT *, concat_ws('|', direction, channel, entry, exit, regime_filter, regime_indicator) AS template_id FROM t""",
)
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.templates(spark)


@query(
    "plateau",
    f"""WITH p AS (SELECT p_partkey % 20 AS g, CAST((p_partkey // 20) % 5 AS INT) AS x, CAST((p_partkey // 100) % 5 AS INT) AS y, avg(p_retailprice) AS score FROM part GROUP BY 1, 2, 3),
k AS (SELECT *, CASE WHEN (x + y + g) % 7 <> 0 THEN score END AS s FROM p),
d AS (SELECT g, median(s) AS mid, least(3, max(x) + 1) * least(3, max(y) + 1) AS room FROM k GROUP BY g),
n AS (SELECT a.g, a.x, a.y, sum(b.s) AS t, count(b.s) AS n FROM k a JOIN k b ON a.g = b.g AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 WHERE a.s IS NOT NULL GROUP BY 1, 2, 3)
SELECT k.g, k.x, k.y, {r("(t + 0.5 * (room - n) * mid) / (n + 0.5 * (room - n))", "smooth", 3)} FROM k JOIN d USING (g) LEFT JOIN n USING (g, x, y)""",
    digits=3,
)
def plateau(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    xy = [F.floor(k / 20) % 5, F.floor(k / 100) % 5]
    cells = part.groupBy((k % 20).alias("g"), *(c.cast("int").alias(n) for c, n in zip(xy, "xy", strict=True))).agg(F.avg("p_retailprice").alias("score"))
    known = F.when((F.col("x") + F.col("y") + F.col("g")) % 7 != 0, F.col("score"))
    scores = cells.withColumns({"coord": F.array("x", "y"), "trial_id": F.col("x") * 5 + F.col("y"), "score": known})
    return search.plateau(scores, ["g"], 2).select("g", "x", "y", "smooth")


@query(
    "trade_list",
    f"""WITH t AS (SELECT o_orderpriority AS asset, CAST(count(*) AS DOUBLE) AS target FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
h AS (SELECT o_orderpriority AS asset, CAST(count(*) AS DOUBLE) AS held FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT' GROUP BY 1)
SELECT asset, {r("coalesce(held, 0)", "held")}, {r("coalesce(target, 0)", "target")},
  {r("sign(coalesce(target, 0) - coalesce(held, 0)) * floor(abs(coalesce(target, 0) - coalesce(held, 0)) / 10) * 10", '"order"')}
FROM t FULL JOIN h USING (asset)""",
)
def trade_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    count = lambda d, name: d.groupBy(F.col("o_orderpriority").alias("asset")).agg(F.count(F.lit(1)).cast("double").alias(name))
    held = o.filter("o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT'")
    return book.trade_list(count(o.filter("o_orderstatus = 'F'"), "target"), count(held, "held"), 10.0)


@query(
    "moved_rolls",
    f"""WITH {BARS}, k AS (SELECT asset, bar_idx, bar_idx % 3 <> 1 AS kept, CASE WHEN bar_idx % 7 = 0 THEN 1.0 ELSE 0.0 END AS roll FROM b),
o AS (SELECT *, last_value(CASE WHEN kept THEN bar_idx END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY bar_idx ROWS UNBOUNDED PRECEDING) AS onto FROM k)
SELECT asset, onto AS bar_idx, {r("sum(roll)", "roll")} FROM o WHERE onto IS NOT NULL GROUP BY 1, 2""",
)
def moved_rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = src.order_bars(spark, sf_dir).select("asset", "bar_idx", (F.col("bar_idx") % 3 != 1).alias("kept"), F.when(F.col("bar_idx") % 7 == 0, 1.0).otherwise(0.0).alias("roll"))
    return book.moved_rolls(b)


@query(
    "recursive_means",
    f"""WITH RECURSIVE {STEP}, m AS (SELECT *, coalesce(high - lag(high) OVER p, 0) AS up, coalesce(lag(low) OVER p - low, 0) AS dn FROM s WINDOW p AS (PARTITION BY asset ORDER BY ts)),
v AS MATERIALIZED (SELECT asset, bar_idx, close, tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pl, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mi FROM m),
e AS (SELECT asset, bar_idx, close AS ema, tr AS t, pl AS p, mi AS q, CAST(NULL AS DOUBLE) AS x FROM v WHERE bar_idx = 0 UNION ALL
  SELECT asset, bar_idx, ema, t, p, q, CASE WHEN bar_idx < 13 THEN NULL WHEN x IS NULL THEN dx ELSE x + (dx - x) / 14 END FROM
  (SELECT *, 100 * abs(p - q) / nullif(p + q, 0) AS dx FROM
    (SELECT v.asset, v.bar_idx, e.ema + (v.close - e.ema) * 2 / 21 AS ema, e.t + (v.tr - e.t) / 14 AS t, e.p + (v.pl - e.p) / 14 AS p, e.q + (v.mi - e.q) / 14 AS q, e.x
     FROM e JOIN v ON v.asset = e.asset AND v.bar_idx = e.bar_idx + 1)))
SELECT asset, bar_idx, {r("CASE WHEN bar_idx >= 19 THEN ema END", "ema")}, {r("CASE WHEN bar_idx >= 26 THEN x END", "adx")} FROM e""",
)
def recursive_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recursive.recursive_means(src.order_bars(spark, sf_dir), 20, 14)


@query(
    "buffered_levels",
    f"""WITH RECURSIVE {STANCE}, t AS MATERIALIZED (SELECT asset, bar_idx, avg(stance) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS p FROM st),
l AS (SELECT asset, bar_idx, least(greatest(0, p - 0.25), p + 0.25) AS level FROM t WHERE bar_idx = 0 UNION ALL
  SELECT t.asset, t.bar_idx, least(greatest(level, p - 0.25), p + 0.25) FROM l JOIN t ON t.asset = l.asset AND t.bar_idx = l.bar_idx + 1)
SELECT asset, bar_idx, {r("level", "level")} FROM l""",
)
def buffered_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stances(spark, sf_dir).select("asset", "bar_idx", F.avg("stance").over(ind.back(10)).alias("target"))
    return recursive.buffered_levels(s, 0.25)


@query("bootstrap_p")
def bootstrap_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.bootstrap_p(metrics.returns(src.order_bars(spark, sf_dir)))
