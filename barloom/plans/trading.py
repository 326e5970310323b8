"""Queries of sessions, books, contracts and next orders; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import book, calendar, metrics, portfolio, search, simulation
from barloom.plans import research
from barloom.plans.queries import BARS, RETS, query, r
from barloom.sources import bars as src

HOURS = """h AS (SELECT event_type AS asset, date_trunc('hour', ts) AS ts FROM events GROUP BY 1, 2),
m AS (SELECT asset, epoch(ts) / 60 AS b, lag(epoch(ts) / 60) OVER (PARTITION BY asset ORDER BY ts) AS a FROM h),
u AS (SELECT asset, median(b - a) AS spacing FROM m WHERE b > a GROUP BY asset),
w AS (SELECT *, CASE WHEN spacing <= 15 THEN 15 WHEN spacing <= 30 THEN 30 WHEN spacing <= 60 THEN 60 WHEN spacing <= 120 THEN 120 ELSE 240 END AS width FROM u)"""


@query(
    "cut_counts",
    f"""WITH {HOURS}, c AS (SELECT asset, spacing, width, unnest(range(0, 1440, width)) AS cut FROM w)
SELECT c.asset, c.cut, 1 + count(*) FILTER (floor((b - cut) / 1440) <> floor((a - cut) / 1440)) AS sessions,
  count(*) FILTER (floor((b - cut) / 1440) <> floor((a - cut) / 1440) AND b - a <= 1.5 * spacing) AS sliced
FROM c JOIN m ON c.asset = m.asset AND a IS NOT NULL GROUP BY 1, 2""",
)
def cut_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.cut_counts(src.event_bars(spark, sf_dir, "hour"))


@query("annualization")
def annualization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.annualization(src.event_bars(spark, sf_dir, "hour"))


@query(
    "irregular_bars",
    f"""WITH {HOURS} SELECT m.asset, any_value(spacing) < 1440 AND avg(CAST(abs((b - a) - spacing) * 60 <= 1 AS INT)) < 0.5 AS irregular
FROM m JOIN w ON m.asset = w.asset WHERE b > a GROUP BY 1""",
)
def irregular_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.irregular(src.event_bars(spark, sf_dir, "hour"))


@query(
    "record",
    f"""WITH {RETS}, x AS (SELECT asset, ts, ret / 1000 AS ret FROM rets), e AS (SELECT asset, ts, ret, product(1 + ret) OVER w AS equity FROM x WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, equity / greatest(1, max(equity) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM e),
g AS (SELECT asset, count(*) AS n_bars, arg_max(equity, ts) AS last, min(dd) AS max_dd, date_diff('day', min(ts), max(ts)) / 365.25 AS span, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe FROM d GROUP BY asset)
SELECT asset, n_bars, {r("last - 1", "total_return", 8)}, {r("max_dd", "max_dd", 8)}, {r("sharpe", "sharpe")}, {r("span * n_bars / (n_bars - 1)", "years")}, {r("pow(last, 1 / (span * n_bars / (n_bars - 1))) - 1", "cagr", 8)} FROM g""",
    digits=8,
)
def record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = metrics.returns(src.order_bars(spark, sf_dir)).withColumn("ret", F.col("ret") / 1000)
    out = metrics.record(rets, 252.0)
    return out.withColumns({c: F.round(c, 4) for c in ("sharpe", "years")})


@query(
    "order_lives",
    """WITH e AS (SELECT event_type AS asset, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS bar_idx, floor(value / 40) AS level, event_id FROM events),
o AS (SELECT asset, bar_idx, CASE WHEN event_id % 6 = 0 THEN 'entry_fill' ELSE 'stop_working' END AS kind, CAST(level AS INT) % 2 AS side, level FROM e),
g AS (SELECT *, bar_idx - row_number() OVER (PARTITION BY asset, kind, side, level ORDER BY bar_idx) AS k FROM o)
SELECT asset, kind, side, CAST(level AS DOUBLE) AS level, min(bar_idx) AS first_bar, max(bar_idx) AS last_bar, count(*) AS n_bars FROM g WHERE kind = 'stop_working' GROUP BY asset, kind, side, level, k
UNION ALL SELECT asset, kind, side, CAST(level AS DOUBLE), bar_idx, bar_idx, 1 FROM o WHERE kind <> 'stop_working'""",
)
def order_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    bar = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")).cast("long")
    level = F.floor(F.col("value") / 40)
    kind = F.when(F.col("event_id") % 6 == 0, "entry_fill").otherwise("stop_working")
    rows = e.select(F.col("event_type").alias("asset"), bar.alias("bar_idx"), kind.alias("kind"), (level.cast("int") % 2).alias("side"), F.lit("").alias("detail_text"), level.cast("double").alias("level"), F.lit(0.0).alias("qty"))
    return book.collapsed(rows, "asset").select("asset", "kind", "side", "level", "first_bar", "last_bar", "n_bars")


LEGS = """l AS (SELECT o_orderpriority AS asset, o_orderkey AS slot, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS side, CAST(o_custkey % 50 + 1 AS DOUBLE) AS shares, o_totalprice AS price,
  CASE WHEN o_orderkey % 5 = 0 THEN 50.0 ELSE 1.0 END AS pv, CASE WHEN o_orderkey % 5 = 0 THEN 2000.0 ELSE 0.0 END AS margin, o_totalprice * 0.9 AS stop FROM orders WHERE o_orderkey % 7 = 1)"""


@query(
    "book_targets",
    f"""WITH {LEGS}, b AS (SELECT *, CASE WHEN margin > 0 THEN margin ELSE pv * abs(price) END AS basis FROM l),
g AS (SELECT CASE WHEN sum(shares * basis) > 1500000 THEN 1500000 / sum(shares * basis) ELSE 1 END AS scale FROM b)
SELECT asset, {r("sum(shares * side) * any_value(scale)", "shares")}, {r("sum(shares * side) * any_value(scale) * arg_max(basis, slot)", "notional", 2)}, {r("sum(shares * abs(price - stop) * pv) * any_value(scale)", "open_risk", 2)}
FROM b, g GROUP BY asset""",
    digits=4,
)
def book_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    five = k % 5 == 0
    legs = spark.read.parquet(f"{sf_dir}/orders.parquet").filter(k % 7 == 1).select(
        F.col("o_orderpriority").alias("asset"), k.alias("slot"), F.when(k % 3 == 0, -1).otherwise(1).alias("side"), (F.col("o_custkey") % 50 + 1).cast("double").alias("shares"),
        F.col("o_totalprice").cast("double").alias("price"), F.when(five, 50.0).otherwise(1.0).alias("point_value"), F.when(five, 2000.0).otherwise(0.0).alias("margin"), (F.col("o_totalprice") * F.lit(0.9)).cast("double").alias("stop"),
    )
    out = book.book_targets(legs, 1_000_000.0, 1.5)
    return out.select("asset", "shares", F.round("notional", 2).alias("notional"), F.round("open_risk", 2).alias("open_risk"))


@query(
    "contract_book",
    """WITH t AS (SELECT 'A' || n_nationkey AS asset, CAST(sum(c_acctbal) AS DOUBLE) AS notional FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 4 <> 3 GROUP BY 1),
c AS (SELECT 'A' || n_nationkey AS asset, 'R' || n_nationkey AS root, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE 10.0 + n_nationkey END AS price, 100.0 AS unit, CASE WHEN n_nationkey = 8 THEN 0.0 ELSE 1.1 END AS rate,
  0.8 + n_nationkey / 50.0 AS ratio, CASE WHEN n_nationkey = 9 THEN 5000.0 ELSE 1.0 END AS low, 1e6 AS high FROM nation WHERE n_nationkey <> 2),
h AS (SELECT 'R' || s_nationkey AS root, CAST(count(*) AS DOUBLE) AS held FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY 1 UNION ALL SELECT 'ZZ', 4.0),
j AS (SELECT coalesce(ct.root, h.root) AS root, asset, coalesce(notional, 0) AS notional, coalesce(round_even(held, 0), 0) AS held, price, price * unit * rate AS value, rate, ratio, low, high
  FROM (SELECT * FROM c FULL JOIN t USING (asset)) ct FULL JOIN h ON ct.root = h.root),
n AS (SELECT *, CASE WHEN root IS NULL THEN 'no contract for this asset' WHEN asset IS NULL THEN 'held root is no contract of the table' WHEN notional = 0 AND value IS NULL THEN 'closed without a price'
  WHEN price IS NULL OR price <= 0 THEN 'no price' WHEN rate IS NULL OR rate <= 0 THEN 'no currency rate' WHEN value NOT BETWEEN low AND high THEN 'contract value out of range' END AS note FROM j WHERE notional <> 0 OR held <> 0),
w AS (SELECT *, CASE WHEN note IS NULL THEN notional * ratio / value END AS raw FROM n),
g AS (SELECT *, CASE WHEN note = 'closed without a price' THEN 0 WHEN note IS NULL THEN CASE WHEN raw = 0 THEN 0 WHEN held <> 0 AND sign(held) = sign(raw) AND abs(raw - held) <= 0.6 THEN held ELSE sign(raw) * floor(abs(raw) + 0.5) END END AS target FROM w)
SELECT asset, root, CAST(held AS BIGINT) AS held, CAST(target AS BIGINT) AS target, note, CASE WHEN target > held THEN 'BUY' WHEN target < held THEN 'SELL' WHEN target = held THEN 'hold' END AS action FROM g""",
)
def contract_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    k = F.col("n_nationkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    joined = read("customer").join(F.broadcast(read("nation")), F.col("c_nationkey") == k).filter(k % 4 != 3)
    targets = joined.groupBy(name("A", k).alias("asset")).agg(F.sum("c_acctbal").cast("double").alias("notional"))
    contracts = read("nation").filter(k != 2).select(
        name("A", k).alias("asset"), name("R", k).alias("root"), F.when(k % 6 != 5, 10.0 + k).alias("price"), F.lit(100.0).alias("unit"), F.when(k == 8, 0.0).otherwise(1.1).alias("rate"),
        (0.8 + k / 50.0).alias("ratio"), F.when(k == 9, 5000.0).otherwise(1.0).alias("low"), F.lit(1e6).alias("high"),
    )
    s = F.col("s_nationkey")
    held = read("supplier").filter(s % 3 == 0).groupBy(name("R", s).alias("root")).agg(F.count(F.lit(1)).cast("double").alias("contracts"))
    held = held.unionByName(spark.createDataFrame([("ZZ", 4.0)], "root string, contracts double"))
    return portfolio.contract_book(targets, contracts, held).select("asset", "root", "held", "target", "note", "action")


@query("slot_states")
def slot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.simulated(src.order_bars(spark, sf_dir), research.plans(spark), "states")


@query("next_orders")
def next_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.simulated(src.order_bars(spark, sf_dir), research.plans(spark), "next_orders")


@query(
    "aligned_returns",
    f"""WITH {RETS}, n AS (SELECT count(DISTINCT asset) AS n FROM rets), k AS (SELECT ts FROM rets, n GROUP BY ts HAVING count(DISTINCT asset) = any_value(n))
SELECT asset, ts, {r("ret", "ret")} FROM rets SEMI JOIN k USING (ts)""",
)
def aligned_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.aligned(metrics.returns(src.order_bars(spark, sf_dir))).select("asset", "ts", "ret")


@query(
    "added_returns",
    f"WITH {RETS} SELECT coalesce(a.ts, b.ts) AS ts, {r('coalesce(a.ret, 0) + coalesce(b.ret, 0)', 'ret')} FROM (SELECT * FROM rets WHERE asset = '1-URGENT') a FULL JOIN (SELECT * FROM rets WHERE asset = '5-LOW') b ON a.ts = b.ts",
)
def added_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = metrics.returns(src.order_bars(spark, sf_dir))
    return metrics.added(*(rets.filter(F.col("asset") == a) for a in ("1-URGENT", "5-LOW")))


@query(
    "benchmarks",
    f"""WITH {BARS}, m AS (SELECT *, min(low) OVER (PARTITION BY asset) AS least, lag(close) OVER (PARTITION BY asset ORDER BY ts) AS c0 FROM (SELECT asset, ts, CASE WHEN asset = '5-LOW' THEN low - 1e6 ELSE low END AS low, close FROM b))
SELECT asset, ts, CASE WHEN least > 0 THEN 'buy_and_hold' ELSE 'one_unit' END AS kind, {r("CASE WHEN least > 0 THEN (close - c0) / nullif(c0, 0) ELSE (close - c0) / 100000 END", "ret")} FROM m WHERE c0 IS NOT NULL""",
)
def benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = src.order_bars(spark, sf_dir)
    return metrics.benchmark_returns(b.withColumn("low", F.when(F.col("asset") == "5-LOW", F.col("low") - 1e6).otherwise(F.col("low"))))


@query(
    "breakevens",
    """WITH x AS (SELECT p_partkey % 40 AS g, CAST(p_size AS DOUBLE) AS cost, avg(p_retailprice) - 900 - 20 * p_size AS ret FROM part GROUP BY 1, 2, p_size),
l AS (SELECT *, lag(cost) OVER w AS x0, lag(ret) OVER w AS y0, row_number() OVER w AS i FROM x WINDOW w AS (PARTITION BY g ORDER BY cost)),
f AS (SELECT g, min(cost) AS c FROM l WHERE ret <= 0 GROUP BY g)
SELECT d.g, round(coalesce(CASE WHEN i = 1 THEN 0 ELSE x0 + (cost - x0) * y0 / (y0 - ret) END, 1e9), 4) + 0.0 AS breakeven FROM (SELECT DISTINCT g FROM x) d LEFT JOIN f USING (g) LEFT JOIN l ON l.g = f.g AND l.cost = f.c""",
)
def breakevens(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy((F.col("p_partkey") % 40).alias("g"), size.alias("cost")).agg((F.avg("p_retailprice")).alias("p")).withColumn("ret", F.col("p") - 900 - 20 * F.col("cost"))
    got = metrics.breakeven(rows, "g")
    return got.select("g", F.when(F.col("breakeven") == float("inf"), 1e9).otherwise(F.col("breakeven")).alias("breakeven"))


@query("exposures")
def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, plans = src.order_bars(spark, sf_dir), research.plans(spark, research.SHOWN | {"channel": ("donchian",)})
    return metrics.exposures(b, simulation.simulated(b, plans, "trades"), simulation.simulated(b, plans, "bars"))


@query("cost_sweep")
def cost_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = research.plans(spark, research.SHOWN | {"channel": ("donchian",), "entry": ("stop",)})
    return search.cost_totals(src.order_bars(spark, sf_dir), plans, (0.0, 5.0, 20.0)).select("asset", "trial_id", "cost", "total_return", "sharpe", "n_trades")


@query("walk_forward_matrix")
def walk_forward_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matrix(src.order_bars(spark, sf_dir), research.lattice_plans(spark), 3, (120, 150), (50,))


@query("walk_forward_costs")
def walk_forward_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cost_sweep(src.order_bars(spark, sf_dir), research.lattice_plans(spark), 3, 150, 50, (0.0, 10.0))


@query("walk_forward_whole_units")
def walk_forward_whole_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    account = simulation.Account(equity=3_000_000.0, whole_units=True)
    return search.walked(src.order_bars(spark, sf_dir), research.lattice_plans(spark), 3, 150, 50, account=account)[0]
