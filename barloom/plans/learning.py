"""Queries of learners, selection and contracts; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import forecast
from barloom.functions import indicators as ind
from barloom.operators import learners, metrics, portfolio, stance
from barloom.operators.ladders import ATR, COST, experts  # noqa: F401
from barloom.plans.queries import BARS, RETS, query, r
from barloom.sources import bars as src



@query("hedge_positions")
def hedge_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.hedge(experts(src.order_bars(spark, sf_dir))).select("asset", "bar_idx", "trade", "position")


@query("hedge_discounted")
def hedge_discounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.hedge(experts(src.order_bars(spark, sf_dir)), sharing=False).select("asset", "bar_idx", "trade", "position")


@query("ridge_forecasts")
def ridge_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, prior, stiff = forecast.spec("learned")
    rows = forecast.features(forecast.bands(src.order_bars(spark, sf_dir)), names)
    got = learners.ridge_forecasts(rows, prior=tuple(prior), penalty=tuple(stiff))
    return got.select("asset", "bar_idx", "forecast", forecast.position(F.col("forecast")).alias("position"))


def _kernel_sql(scale: int) -> str:
    import math

    weights = [(k + 1) * math.exp(-2 * k / scale) for k in range(3 * scale + 1)]
    norm = math.sqrt(sum(w * w for w in weights))
    terms = " + ".join(f"{w / norm!r}::DOUBLE * lag(ch, {k}) OVER p" for k, w in enumerate(weights))
    return _clipped(f"({terms}) / sg", 2.5)


def _clipped(x: str, most: float) -> str:
    """DuckDB's least and greatest pass over nulls."""
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, -{most}), {most}) END"


@query(
    "forecast_bands",
    f"""WITH {BARS}, c AS (SELECT *, close - lag(close) OVER (PARTITION BY asset ORDER BY ts) AS ch FROM b),
s AS (SELECT *, CASE WHEN count(ch) OVER w = 60 THEN nullif(stddev_samp(ch) OVER w, 0) END AS sg FROM c WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
k AS (SELECT asset, bar_idx, sg, (({_kernel_sql(4)}) + ({_kernel_sql(8)})) / 2 AS fast, {_clipped("(lead(open, 2) OVER p - lead(open) OVER p) / sg", 4)} AS y FROM s WINDOW p AS (PARTITION BY asset ORDER BY ts))
SELECT asset, bar_idx, {r("sg", "sigma")}, {r(_clipped("fast", 2), "fast")}, {r("y", "y")} FROM k""",
)
def forecast_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.bands(src.order_bars(spark, sf_dir)).select("asset", "bar_idx", "sigma", "fast", "y")


@query(
    "centred_ranks",
    f"""WITH {BARS}, x AS (SELECT asset, bar_idx, volume, list(volume) OVER w AS vs, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT asset, bar_idx, {r("CASE WHEN n = 50 THEN 2 * (len(list_filter(vs, lambda v: v < volume)) + 0.5 * len(list_filter(vs, lambda v: v = volume))) / 50 - 1 END", "place")} FROM x""",
)
def centred_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.order_bars(spark, sf_dir).select("asset", "bar_idx", forecast.centred_rank(F.col("volume"), 50).alias("place"))


@query("hedge_split")
def hedge_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = learners.ladder("hedge_split")
    followers = len(learners.ladder("hedge_split", "trend"))
    return learners.hedge(experts(src.order_bars(spark, sf_dir), every), sharing=False, followers=followers).select("asset", "bar_idx", "trade", "position")


def _rets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.returns(src.order_bars(spark, sf_dir))


@query("hrp_weights")
def hrp_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.hrp_weights(_rets(spark, sf_dir))


@query("effective_trials")
def effective_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.effective_trials(_rets(spark, sf_dir))


@query("nested_selection")
def nested_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.nested_selection(_rets(spark, sf_dir), 125, 0.2, 252.0)


@query("nested_returns")
def nested_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = _rets(spark, sf_dir)
    return portfolio.held_returns(rets, portfolio.nested_selection(rets, 125, 0.2, 252.0), 125)


@query(
    "trade_runs",
    f"""WITH {RETS}, o AS (SELECT asset, ts, CASE WHEN ret > 0.1 THEN 1 ELSE 0 END AS a FROM rets),
n AS (SELECT asset, a * (1 - coalesce(lag(a) OVER (PARTITION BY asset ORDER BY ts), 0)) AS x FROM o)
SELECT asset, CAST(sum(x) AS BIGINT) AS n_trades FROM n GROUP BY asset""",
)
def trade_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.trade_runs(_rets(spark, sf_dir).withColumn("ret", F.when(F.col("ret") > 0.1, F.col("ret")).otherwise(F.lit(0.0))))


@query(
    "hedge_ratios",
    f"""WITH {RETS}, j AS (SELECT a.asset AS name, a.ts, a.ret, b.ret AS base FROM rets a JOIN rets b USING (ts) WHERE b.asset = '1-URGENT' AND a.asset <> '1-URGENT'),
m AS (SELECT name, median(ret) AS mr, median(base) AS mb FROM j GROUP BY name),
w AS (SELECT name, any_value(mr) AS mr, any_value(mb) AS mb, 3 * 1.4826 * median(abs(ret - mr)) AS wr, 3 * 1.4826 * median(abs(base - mb)) AS wb FROM j JOIN m USING (name) GROUP BY name),
p AS (SELECT name, ts, least(greatest(ret, mr - wr), mr + wr) AS ret, least(greatest(base, mb - wb), mb + wb) AS base, row_number() OVER (PARTITION BY name ORDER BY ts DESC) AS i FROM j JOIN w USING (name))
SELECT name, count(*) AS n, {r("CASE WHEN count(*) >= 60 THEN least(greatest(stddev_samp(ret) / stddev_samp(base), 0.5), 2.5) ELSE 1 END", "ratio")}, {r("corr(ret, base)", "corr")}
FROM p WHERE i <= 120 GROUP BY name""",
)
def hedge_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets = _rets(spark, sf_dir)
    base = rets.filter("asset = '1-URGENT'").select("ts", F.col("ret").alias("base"))
    return portfolio.hedge_ratios(rets.filter("asset <> '1-URGENT'").select(F.col("asset").alias("name"), "ts", "ret").join(base, "ts"))


@query(
    "whole_contracts",
    """WITH t AS (SELECT c_custkey, c_acctbal / 1000 AS target, CAST(c_custkey % 9 - 4 AS DOUBLE) AS held FROM customer)
SELECT c_custkey, CAST(CASE WHEN target = 0 THEN 0 WHEN sign(held) = sign(target) AND held <> 0 AND abs(target - held) <= 0.6 THEN held
  ELSE sign(target) * floor(abs(target) + 0.5) END AS BIGINT) AS contracts FROM t""",
)
def whole_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    held = (F.col("c_custkey") % 9 - 4).cast("double")
    return c.select("c_custkey", portfolio.whole_contracts(F.col("c_acctbal") / 1000, held).alias("contracts"))


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order bars with the level of the committee's position within its band."""
    from barloom.operators import recursive

    bars = src.order_bars(spark, sf_dir)
    position = learners.hedge(experts(bars), sharing=False).select("asset", "bar_idx", F.col("position").alias("target"))
    return bars.join(recursive.buffered_levels(position, 0.125), ["asset", "bar_idx"])


@query("stance_totals")
def stance_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stance.held_levels(_held(spark, sf_dir))


@query("stance_trades")
def stance_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stance.held_levels(_held(spark, sf_dir), "trades")


@query("static_selection")
def static_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.static_selection(_rets(spark, sf_dir), -1.0, 252.0, weighting="hrp")
