"""Stored runs of research, and their replay.

A run is a folder of Parquet tables (bars, plans, windows, returns, holdings, portfolios) and a manifest row that is written last,
so a run without one is not whole. Replaying a target simulates again only the pairs of template and window that it is made
of, on the capital each window had, with every trade and order, and compares what comes out with what was stored.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import book, metrics, nested, search, simulation

VERSION, TARGETS = 1, ("best", "static", "nested")
TABLES = ("bars", "plans", "windows", "returns", "summary", "holdings", "portfolios")
MANIFEST = "schema_version int, warm long, account string, config string, n_bars long, n_templates long"
TOLERANCE = 1e-12


@dataclass
class Run:
    """A stored run: its tables by name, the account and the settings it was made with."""

    folder: str
    tables: dict[str, DataFrame]
    account: simulation.Account
    config: dict
    warm: int

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def researched(folder: str, bars: DataFrame, plans: DataFrame, dims: int, train: int = 500, test: int = 125, account: simulation.Account = simulation.Account(), select: dict | None = None, **how) -> Run:
    """Walk-forward of every template, both portfolios, and all of it stored in ``folder``, which must not exist.

    plans: trial_id, template, coord and plan columns. ``select`` has the settings of the portfolios.
    """
    spark = bars.sparkSession
    put = lambda d, name: d.write.mode("error").parquet(f"{folder}/{name}")
    get = lambda name: spark.read.parquet(f"{folder}/{name}")
    put(bars, "bars")
    put(plans, "plans")
    wins, rets = search.walked(get("bars"), get("plans"), dims, train, test, account=account, **how)
    put(wins, "windows")
    put(rets, "returns")
    put(search.summary(get("windows"), get("returns"), account.per_year), "summary")
    held, earned = nested.both_portfolios(get("summary"), get("windows"), get("returns"), per_year=account.per_year, **(select or {}))
    put(held, "holdings")
    put(earned, "portfolios")
    warm = plans.agg(F.max(search.warmup(plans)).alias("w")).first()["w"] or 0
    config = {"dims": dims, "train": train, "test": test, "how": how, "select": select or {}}
    row = (VERSION, warm, json.dumps(asdict(account)), json.dumps(config), get("bars").count(), get("plans").select("template").distinct().count())
    put(spark.createDataFrame([row], MANIFEST), "manifest")
    return load_run(spark, folder)


def load_run(spark: SparkSession, folder: str) -> Run:
    """A run as it was stored; an error if it is not whole or of another version."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect()
    if len(rows) != 1 or rows[0]["schema_version"] != VERSION:
        raise ValueError(f"{folder}: schema version {[r['schema_version'] for r in rows]}, this code reads {VERSION}")
    account = simulation.Account(**json.loads(rows[0]["account"]))
    return Run(folder, {t: spark.read.parquet(f"{folder}/{t}") for t in TABLES}, account, json.loads(rows[0]["config"]), rows[0]["warm"])


def needed(run: Run, target: str, template: str | None = None) -> DataFrame:
    """asset, template, window_id, weight of the pairs that a target is made of; ``template`` replays another than the best."""
    windows = run.windows.select(*nested.KEYS, "window_id")
    if target == "best":
        names = nested.best_template(run.summary) if template is None else run.summary.filter(F.col("template") == template).select(*nested.KEYS)
        return windows.join(names.withColumn("weight", F.lit(1.0)), nested.KEYS)
    held = run.holdings.filter(F.col("target") == target)
    if target == "static":
        return windows.join(held.select(*nested.KEYS, "weight"), nested.KEYS)
    if target == "nested":
        return held.select(*nested.KEYS, "window_id", "weight")
    raise ValueError(f"no target {target}; there are {', '.join(TARGETS)}")


def replayed(run: Run, pairs: DataFrame, output: str) -> DataFrame:
    """asset, template, window_id, weight and the rows of ``output`` ("bars", "all_trades", "orders", ...) of the pairs, simulated again.

    Pairs without a pick, or after a ruin, have no rows.
    """
    live = run.windows.filter("trial_id IS NOT NULL AND NOT ruined").join(pairs, [*nested.KEYS, "window_id"], "left_semi")
    spans = run.windows.join(pairs, [*nested.KEYS, "window_id"], "left_semi").select("asset", "window_id", F.col("test_start").alias("start"), F.col("test_end").alias("stop")).distinct()
    chosen = live.select("asset", "window_id", "trial_id", F.col("initial_equity").alias("capital")).join(F.broadcast(run.plans.drop("coord", "template", "capital")), "trial_id")
    rows = simulation.windowed(run.bars, spans, chosen, run.warm, output, run.account)
    named = rows.join(F.broadcast(run.plans.select("trial_id", "template")), "trial_id")
    return named.join(pairs, [*nested.KEYS, "window_id"])


def replay_returns(run: Run, target: str, template: str | None = None) -> DataFrame:
    """asset, bar_idx, window_id, ret of a target, from simulating its pairs again."""
    pairs = needed(run, target, template)
    earned = replayed(run, pairs, "bars").select(*nested.KEYS, "window_id", "bar_idx", "ret")
    # windows of the pairs that are flat, and all others of the run, are part of the series
    grid = run.returns.select(*nested.KEYS, "window_id", "bar_idx").join(pairs, [*nested.KEYS, "window_id"], "left_semi")
    rows = grid.join(earned, [*nested.KEYS, "window_id", "bar_idx"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    every = run.returns.select("asset", "window_id", "bar_idx").distinct().withColumns({"template": F.lit(None).cast("string"), "ret": F.lit(0.0)})
    first = run.config["select"].get("history_windows", nested.HISTORY_WINDOWS) if target == "nested" else None
    return nested.portfolio_returns(rows.unionByName(every), pairs, first)


def verification(run: Run, target: str, template: str | None = None) -> DataFrame:
    """target, n, missing, worst, ok, n_windows, n_windows_off: replayed returns against the stored ones, and trades window by window."""
    if target == "best":
        pairs = needed(run, target, template)
        stored = run.returns.join(pairs, [*nested.KEYS, "window_id"], "left_semi").select("asset", "bar_idx", "ret")
        stored = metrics.closed_after_ruin(stored.withColumnRenamed("bar_idx", "ts")).withColumnRenamed("ts", "bar_idx")
    else:
        stored = run.portfolios.filter(F.col("target") == target).select("asset", "bar_idx", "ret")
    again = replay_returns(run, target, template).select("asset", "bar_idx", "ret")
    counts = window_checks(run, target, template).agg(F.count(F.lit(1)).alias("n_windows"), F.coalesce(F.sum((F.col("n_stored") != F.col("n_replayed")).cast("long")), F.lit(0)).alias("n_windows_off"))
    told = metrics.verified(stored, again, ("asset", "bar_idx"), TOLERANCE).withColumn("target", F.lit(target)).join(F.broadcast(counts))  # one row each
    return told.withColumn("ok", F.col("ok") & (F.col("n_windows_off") == 0))


def window_checks(run: Run, target: str, template: str | None = None) -> DataFrame:
    """asset, template, window_id, n_stored, n_replayed: trades that ended in each window."""
    pairs = needed(run, target, template)
    ended = replayed(run, pairs, "all_trades").filter("closed").groupBy(*nested.KEYS, "window_id").agg(F.count(F.lit(1)).alias("n"))
    rows = run.windows.join(pairs.select(*nested.KEYS, "window_id"), [*nested.KEYS, "window_id"])
    none = F.lit(0).cast("long")
    return rows.join(ended, [*nested.KEYS, "window_id"], "left").select(*nested.KEYS, "window_id", F.coalesce("oos_n_trades", none).alias("n_stored"), F.coalesce("n", none).alias("n_replayed"))


def order_lives(run: Run, target: str, template: str | None = None) -> DataFrame:
    """The orders of a target as lives (``book.collapsed``) with the parameters' trial and the weight, in order of their first bars."""
    rows = replayed(run, needed(run, target, template), "orders")
    keys = [*nested.KEYS, "window_id", "trial_id", "weight"]
    rank = F.array_position(F.array(*map(F.lit, simulation.KINDS)), F.col("kind"))
    return book.collapsed(rows, *keys).withColumn("rank", rank).orderBy("asset", "first_bar", "template", "window_id", "rank", "side", "level")
