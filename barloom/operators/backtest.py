"""How much of a best trial is luck: cross-validation over halves and paths, bootstraps, deflated Sharpe ratios."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Splits of the blocks that are taken, drawn without replacement where there are more, and splits to a group.
MOST_SPLITS, GROUP_SPLITS = 20_000, 2048


def unranked(rank: int, n: int, k: int) -> int:
    """Bit mask of the rank-th of the ways to choose k of n, in order of the masks."""
    mask = 0
    for bit in range(n - 1, -1, -1):
        without = math.comb(bit, k)  # choices that leave this bit out come first
        if rank >= without:
            rank, k, mask = rank - without, k - 1, mask | 1 << bit
    return mask


def split_masks(n_blocks: int, most: int = MOST_SPLITS, seed: int = 0) -> list[int]:
    """Halves of the blocks as bit masks: all of them, or ``most`` drawn without replacement by their ranks."""
    total, k = math.comb(n_blocks, n_blocks // 2), n_blocks // 2
    if total <= most:
        return [unranked(r, n_blocks, k) for r in range(total)]
    rng, taken = np.random.default_rng(seed), set()
    for top in range(total - most, total):  # each draw is new, or its bound takes its place
        r = int(rng.integers(0, top + 1))
        taken.add(top if r in taken else r)
    return [unranked(r, n_blocks, k) for r in sorted(taken)]


def overfit_probability(blocks: DataFrame, n_blocks: int, key: str = "trial", family: str | None = None, most: int = MOST_SPLITS, seed: int = 0) -> DataFrame:
    """Symmetric cross-validation over halves of the blocks: split_id, winner, logit, inside, outside of each half.

    ``blocks`` (family, key, block, n, s, s2) are sufficient statistics, one row a trial and block. A half is its bit mask, which
    is the split's id; where there are more than ``most`` halves, so many are drawn. The best Sharpe in a half (the least key on
    ties) is ranked in the other within its family, ties counting half; inside and outside are the winner's Sharpe a bar in both.

    A group is a family and some of the splits. Sums over halves are products of the splits' bits with the family's sums by block,
    other halves the rest of the totals; what a family sends to a group is its trials times blocks, whatever the splits.
    """
    masks = split_masks(n_blocks, most, seed)
    chunks = -(-len(masks) // GROUP_SPLITS)
    group = [family] if family else []
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    rows = blocks.select(*group, F.col(key).alias("trial"), "block", F.col("n").cast("double"), F.col("s").cast("double"), F.col("s2").cast("double"), every.alias("chunk"))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        names = np.array(sorted(d["trial"].unique()))
        at = (np.searchsorted(names, d["trial"].to_numpy()), d["block"].to_numpy(int))
        n, s, q = (np.zeros((len(names), n_blocks)) for _ in range(3))
        for table, c in ((n, "n"), (s, "s"), (q, "s2")):
            np.add.at(table, at, d[c].to_numpy(float))
        c = int(d["chunk"].iloc[0])
        own = np.array(masks[c * GROUP_SPLITS : (c + 1) * GROUP_SPLITS], np.int64)
        step, out = max(1, (1 << 22) // len(names)), []
        for i in range(0, len(own), step):
            bits = (own[i : i + step, None] >> np.arange(n_blocks) & 1).astype(float)
            inside = _sharpes(*(bits @ x.T for x in (n, s, q)))
            outside = _sharpes(*((1 - bits) @ x.T for x in (n, s, q)))
            best = inside.argmax(axis=1)
            every_ = np.arange(len(best))
            level = outside[every_, best]
            rank = (outside < level[:, None]).sum(axis=1) + 0.5 * (outside == level[:, None]).sum(axis=1) + 0.5
            share = rank / (len(names) + 1)
            out.append(pd.DataFrame({"split_id": own[i : i + step], "winner": names[best], "logit": np.log(share / (1 - share)), "inside": inside[every_, best], "outside": level}))
        got = pd.concat(out, ignore_index=True)
        for g in group:
            got[g] = d[g].iloc[0]
        return got

    schema = ", ".join([*(f"{g} {kinds[g]}" for g in group), f"split_id long, winner {kinds[key]}, logit double, inside double, outside double"])
    return rows.groupBy(*group, "chunk").applyInPandas(run, schema)


def _sharpes(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Mean over deviation from counts, sums and sums of squares; 0 without spread."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = s / n
        var = (q - n * mean * mean) / (n - 1)
        return np.where(var > 0, mean / np.sqrt(np.where(var > 0, var, 1)), 0.0)


def overfit_summary(splits: DataFrame, per_year: float = 252.0, *family: str) -> DataFrame:
    """family, n_splits, pbo, mean_logit, prob_loss, and the line of the winners' annual Sharpe outside on that inside."""
    inside, outside = (F.col(c) * per_year**0.5 for c in ("inside", "outside"))
    return splits.groupBy(*family).agg(
        F.count(F.lit(1)).alias("n_splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.avg("logit").alias("mean_logit"),
        F.avg((F.col("outside") < 0).cast("double")).alias("prob_loss"), F.when(F.var_pop("inside") > 0, F.regr_slope(outside, inside)).alias("slope"),
        F.when(F.var_pop("inside") > 0, F.regr_intercept(outside, inside)).alias("intercept"),
    )


def paired_trades(flags: DataFrame, *keys: str) -> DataFrame:
    """keys, entry_idx, exit_idx, pnl from bars (keys, bar_idx, entered, exited, pnl): the k-th exit closes the k-th entry, on one bar too."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("bar_idx"))
    one = lambda test, *columns: flags.filter(test).select(*keys, *columns, nth.alias("_k"))
    return one("entered", F.col("bar_idx").alias("entry_idx")).join(one("exited", F.col("bar_idx").alias("exit_idx"), "pnl"), [*keys, "_k"]).drop("_k")


def trades_inside(trades: DataFrame, mask: DataFrame, *keys: str) -> DataFrame:
    """The trades all of whose bars, entry and exit included, a mask (keys, bar_idx, inside; every bar) selects.

    The mask becomes running counts of what it leaves out, so containment is two lookups by bar, not a search of intervals.
    """
    out = (~F.col("inside")).cast("long")
    upto = F.sum(out).over(Window.partitionBy(*keys).orderBy("bar_idx"))
    counts = mask.select(*keys, "bar_idx", out.alias("_o"), upto.alias("_c"))
    at = lambda c, *columns: counts.select(*keys, F.col("bar_idx").alias(c), *columns)
    met = trades.join(at("entry_idx", (F.col("_c") - F.col("_o")).alias("_before")), [*keys, "entry_idx"]).join(at("exit_idx", F.col("_c").alias("_after")), [*keys, "exit_idx"])
    return met.filter("_after = _before").select(*trades.columns)


def masked_totals(flags: DataFrame, mask: DataFrame, keys: tuple[str, ...], per_year: float = 252.0, additive: bool = True) -> DataFrame:
    """keys, n_trades, sharpe, total_return, max_dd, gain, loss of the selected bars as one record: what ``search.score`` reads.

    flags: keys, bar_idx, ret, entered, exited, pnl. Entries count where the mask selects their bar, gains and losses of trades
    only where it selects them whole; bars left out earn nothing.
    """
    k, by = list(keys), Window.partitionBy(*keys).orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = flags.join(mask.select(*k, "bar_idx", "inside"), [*k, "bar_idx"])
    on, earned = F.col("inside"), F.when(F.col("inside"), F.col("ret")).otherwise(F.lit(0.0))
    grown = 1 + F.sum(earned).over(by) if additive else F.product(1 + earned).over(by)
    rows = rows.withColumn("_e", grown)
    peak = F.greatest(F.max("_e").over(by), F.lit(1.0))
    rows = rows.withColumn("_d", F.col("_e") - peak if additive else F.col("_e") / peak - 1)
    x = F.when(on, F.col("ret"))
    spread = F.stddev_samp(x)
    got = rows.groupBy(*k).agg(
        F.sum((on & F.col("entered")).cast("long")).alias("n_trades"), F.when((F.count(x) >= 2) & (spread > 0), F.avg(x) / spread * per_year**0.5).otherwise(F.lit(0.0)).alias("sharpe"),
        (F.max_by("_e", "bar_idx") - 1).alias("total_return"), F.min("_d").alias("max_dd"),
    )
    own = trades_inside(paired_trades(flags, *k), mask, *k).groupBy(*k).agg(
        F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(F.lit(0.0))).alias("gain"), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(F.lit(0.0))).alias("loss")
    )
    return got.join(own, k, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("gain", "loss")})


def tested_groups(spark: SparkSession, n_groups: int, n_test: int) -> DataFrame:
    """mask, block, path: which groups each split tests, and the path that a tested group belongs to.

    Splits are all choices of ``n_test`` groups, numbered by their bit masks. A group's tests, in order of the
    splits, go to paths 0, 1, ..., so each path holds every group once.
    """
    masks = spark.range(1 << n_groups).filter(F.bit_count("id") == n_test).withColumnRenamed("id", "mask")
    tested = masks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).filter("shiftright(mask, block) & 1 = 1")
    path = F.row_number().over(Window.partitionBy("block").orderBy("mask")) - 1
    return tested.select("mask", "block", path.alias("path"))


def carried_until(trades: DataFrame, ends: DataFrame) -> DataFrame:
    """key, block, until: the last bar that the trade open at each boundary's embargo end holds.

    trades (key, entry_idx, exit_idx), ends (key, block, from_idx): the last trade entered before from_idx, if it leaves at or
    after it. A trial holds one trade at a time, so the last entry is a maximum, not a search.
    """
    key = next(c for c in trades.columns if c not in ("entry_idx", "exit_idx"))
    met = ends.join(trades, key).filter("entry_idx < from_idx")
    last = met.groupBy(key, "block").agg(F.max(F.struct("entry_idx", "exit_idx")).alias("t"), F.first("from_idx").alias("from_idx"))
    return last.filter("t.exit_idx >= from_idx").select(key, "block", F.col("t.exit_idx").alias("until"))


def purged_paths(
    rets: DataFrame, n_groups: int = 8, n_test: int = 2, embargo: int = 10, key: str = "asset", purge: int = 0, trades: DataFrame | None = None, bounds: DataFrame | None = None, family: str | None = None
) -> DataFrame:
    """Combinatorial purged cross-validation: family, path, n, sharpe of each out-of-sample path.

    In each split the trial with the best training Sharpe (the least key on ties) is taken in the tested groups.
    Training leaves out the tested groups, the last ``purge`` returns before each and the first ``embargo`` after each; with
    ``trades`` (key, entry_idx, exit_idx as places in the series) a trial's embargo lasts until the trade that it carries out of
    the tested group has closed. The series is reduced to sums for each trial, group and the tested groups that bar it before
    splits are formed, so work after the first aggregation depends on trials, groups and splits only. No trial with two
    training returns: the split is flat. ``bounds`` (key, g, lo, hi as places, without gaps) sets the groups, as ``snapped_groups`` does.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("ts")) - 1
    block = F.floor(nth * n_groups / n).cast("int")
    fam = [family] if family else []  # a trial is of one family
    put = rets.select(*fam, F.col(key).alias("trial"), "ret", block.alias("block"), n.alias("len"), nth.alias("nth"))
    bound = lambda g: F.ceil(F.lit(1) * g * F.col("len") / n_groups)
    ends = put.select("trial", "len").distinct().withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    ends = ends.select("trial", "g", bound(F.col("g")).alias("lo"), bound(F.col("g") + 1).alias("hi"))
    if bounds is not None:
        ends = bounds.select(F.col(key).alias("trial"), F.col("g").cast("int").alias("g"), "lo", "hi")
        starts = ends.groupBy("trial").agg(F.sort_array(F.collect_list("lo")).alias("_lo"))  # n_groups a trial
        put = put.join(starts, "trial").withColumn("block", (F.size(F.filter("_lo", lambda x: x <= F.col("nth"))) - 1).cast("int")).drop("_lo")
    if trades is not None:
        own = trades.select(F.col(key).alias("trial"), "entry_idx", "exit_idx")
        late = carried_until(own, ends.select("trial", F.col("g").alias("block"), (F.col("hi") + embargo).alias("from_idx"))).withColumnRenamed("block", "g")
        ends = ends.join(late, ["trial", "g"], "left")
    else:
        ends = ends.withColumn("until", F.lit(None).cast("long"))
    reach = ends.groupBy("trial").agg(F.collect_list(F.struct("g", (F.col("lo") - purge).alias("a"), F.greatest(F.col("hi") + embargo, F.coalesce(F.col("until") + 1, F.lit(0))).alias("z"))).alias("reach"))
    # the groups whose test bars a return from training, as bits: at most n_groups intervals a trial
    bars_ = F.aggregate("reach", F.lit(0).cast("long"), lambda acc, x: acc + F.when((F.col("nth") >= x["a"]) & (F.col("nth") < x["z"]), F.call_function("shiftleft", F.lit(1).cast("long"), x["g"])).otherwise(F.lit(0).cast("long")))
    sums = put.join(reach, "trial").withColumn("barred", bars_).groupBy(*fam, "trial", "block", "barred").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("s2"))
    tested = tested_groups(rets.sparkSession, n_groups, n_test)
    train = sums.join(F.broadcast(tested.select("mask").distinct()), F.expr("mask & barred = 0"))
    mean, more = F.sum("s") / F.sum("n"), F.sum("n") > 1
    var = F.when(more, (F.sum("s2") - F.sum("s") * mean) / (F.sum("n") - 1))
    scored = train.groupBy(*fam, "mask", "trial").agg(F.when(var > 0, mean / F.sqrt(var)).when(more, F.lit(0.0)).alias("score")).filter("score IS NOT NULL")
    best = scored.groupBy(*fam, "mask").agg(F.min(F.struct((-F.col("score")).alias("x"), F.col("trial"))).alias("b")).select(*fam, "mask", F.col("b.trial").alias("trial"))
    whole = sums.groupBy("trial", "block").agg(*(F.sum(c).alias(c) for c in ("n", "s", "s2")))
    paths = tested.join(best, "mask").join(whole, ["trial", "block"]).groupBy(*fam, "path")
    spread = (F.sum("s2") - F.sum("s") * mean) / (F.sum("n") - 1)
    return paths.agg(F.sum("n").alias("n"), F.when(spread > 0, mean / F.sqrt(spread)).otherwise(F.lit(0.0)).alias("sharpe"))


def _ratio(x: np.ndarray) -> float:
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    return x.mean() / sd if sd > 0 else 0.0


def resampled(n: int, block: float, rng: np.random.Generator) -> np.ndarray:
    """Rows of one stationary bootstrap sample: blocks of geometric length that wrap around."""
    jump = rng.random(n) < 1 / max(block, 1.0)
    jump[0] = True
    start = np.flatnonzero(jump)
    return (np.repeat(rng.integers(0, n, len(start)) - start, np.diff(np.append(start, n))) + np.arange(n)) % n


def bootstrap_p(rets: DataFrame, replicates: int = 500, block: float = 20.0, seed: int = 1, key: str = "asset", least: int = 20) -> DataFrame:
    """key, sharpe (a return), p: share of stationary-bootstrap replicates of the demeaned series whose Sharpe reaches the series' own.

    A series is a group, its replicates run in its task. Fewer than ``least`` returns or no spread: 0 and 1.
    """

    def run(d: pd.DataFrame) -> pd.DataFrame:
        x = d.sort_values("ts")["ret"].to_numpy(float)
        own, p = _ratio(x), 1.0
        if len(x) >= least and x.std() > 0:
            rng, flat = np.random.default_rng(seed), x - x.mean()
            p = float(np.mean([_ratio(flat[resampled(len(x), block, rng)]) >= own for _ in range(replicates)]))
        else:
            own = 0.0
        return pd.DataFrame({"k": [d["k"].iloc[0]], "sharpe": [own], "p": [p]})

    rows = rets.filter("ret IS NOT NULL").select(F.col(key).alias("k"), "ts", "ret")
    return rows.groupBy("k").applyInPandas(run, "k string, sharpe double, p double").withColumnRenamed("k", key)


def reality_check(rets: DataFrame, replicates: int = 500, block: float = 20.0, seed: int = 1, key: str = "asset", family: str | None = None) -> DataFrame:
    """family, best, statistic, p_value: whether the best mean return of a family is more than luck, on jointly resampled stamps.

    Every series draws the same rows for a replicate, so tasks need one series each: it gives its mean and its excess in every
    replicate, and the family's maxima are an aggregate. Series of a family have the same stamps; one without a stamp counts 0 there.
    """
    kind = rets.schema[family].dataType.simpleString() if family else "int"
    own = rets.withColumn("_f", F.col(family) if family else F.lit(0)).filter("ret IS NOT NULL")
    stamps = own.select("_f", "ts").distinct()
    stamps = stamps.withColumns({"nth": F.row_number().over(Window.partitionBy("_f").orderBy("ts")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("_f"))})

    def run(d: pd.DataFrame) -> pd.DataFrame:
        n = int(d["n"].iloc[0])
        x = np.zeros(n)
        x[d["nth"].to_numpy(int)] = d["ret"].to_numpy(float)
        rng = np.random.default_rng(seed)
        mean = x.mean()
        over = [math.sqrt(n) * (x[resampled(n, block, rng)].mean() - mean) for _ in range(replicates)]
        return pd.DataFrame({"_f": d["_f"].iloc[0], "k": d["k"].iloc[0], "n": n, "mean": mean, "nth": np.arange(replicates), "over": over})

    rows = own.select("_f", F.col(key).alias("k"), "ts", "ret").join(stamps, ["_f", "ts"])
    drawn = rows.groupBy("_f", "k").applyInPandas(run, f"_f {kind}, k string, n long, mean double, nth long, over double")
    tops = drawn.groupBy("_f", "nth").agg(F.max("over").alias("over"), F.first("n").alias("n"), F.min(F.struct((-F.col("mean")).alias("m"), F.col("k"))).alias("b"))
    stat = -F.col("b.m") * F.sqrt(F.col("n").cast("double"))
    told = tops.withColumn("_s", stat).groupBy("_f").agg(F.first("b.k").alias("best"), F.first("_s").alias("statistic"), F.avg((F.col("over") >= F.col("_s")).cast("double")).alias("p_value"))
    return told.select(*([F.col("_f").alias(family)] if family else []), "best", "statistic", "p_value")


#: Coefficients of Hart's rational function of the normal tail, from the highest power.
_TAIL_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(z: Column) -> Column:
    """Share of a standard normal below ``z``, to about 1e-15; null for null and NaN."""
    x = F.least(F.abs(z), F.lit(38.0))
    level = F.exp(-x * x / 2)
    power = lambda parts: reduce(lambda a, c: a * x + c, map(F.lit, parts[1:]), F.lit(parts[0]))
    far = reduce(lambda a, k: x + k / a, (4.0, 3.0, 2.0, 1.0), x + 0.65)
    tail = F.when(x < 7.07106781186547, level * power(_TAIL_ABOVE) / power(_TAIL_BELOW)).otherwise(level / far / math.sqrt(2 * math.pi))
    return F.when(z.isNotNull() & ~F.isnan(z), F.when(z > 0, 1 - tail).otherwise(tail))


def expected_max_sharpe(trials: int) -> float:
    """Expected best Sharpe of so many independent trials of variance 1 and no skill."""
    if trials <= 1:
        return 0.0
    q, euler = NormalDist().inv_cdf, 0.5772156649015329
    return (1 - euler) * q(1 - 1 / trials) + euler * q(1 - 1 / (trials * math.e))


def min_backtest_years(trials: Column, sharpe: Column, per_year: float) -> Column:
    """Years of record below which the best of so many trials without skill could show the annual Sharpe ratio."""
    return F.when((sharpe > 0) & (trials >= 2), 2 * F.ln(trials) / (sharpe * sharpe / per_year) / per_year).otherwise(F.lit(float("inf")))


def deflated_sharpe(moments: DataFrame, per_year: float, key: str = "asset", family: str | None = None) -> DataFrame:
    """The best series of each family with its Sharpe a year, the one that luck would give, PSR against 0 and the deflated PSR.

    ``moments`` (key, n, sharpe_bar, skew, kurt): one row a trial. All trials count, with the variance of their Sharpes.
    """
    group = [family] if family else []
    whole = moments.select(*group, key, "n", F.coalesce("sharpe_bar", F.lit(0.0)).alias("s"), F.coalesce("skew", F.lit(0.0)).alias("skew"), F.coalesce("kurt", F.lit(3.0)).alias("kurt"))
    told = whole.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_trials"), F.coalesce(F.var_samp("s"), F.lit(0.0)).alias("var_sharpe"),
        F.min(F.struct((-F.col("s")).alias("neg"), F.col(key), F.col("n"), F.col("s"), F.col("skew"), F.col("kurt"))).alias("b"),
    )
    ns = [r["n_trials"] for r in told.select("n_trials").distinct().collect()]
    top = F.lit(0.0)
    for n in ns:  # a few family sizes
        top = F.when(F.col("n_trials") == n, F.lit(expected_max_sharpe(n))).otherwise(top)
    best = told.select(*group, F.col(f"b.{key}").alias("best"), "n_trials", "var_sharpe", F.col("b.n").alias("n"), F.col("b.s").alias("s"), F.col("b.skew").alias("skew"), F.col("b.kurt").alias("kurt"), (F.sqrt("var_sharpe") * top).alias("star"))
    spread = F.sqrt(F.greatest(1 - F.col("skew") * F.col("s") + (F.col("kurt") - 1) / 4 * F.col("s") * F.col("s"), F.lit(1e-12)))
    z = lambda b: (F.col("s") - b) * F.sqrt(F.greatest(F.col("n") - 1, F.lit(1)).cast("double")) / spread
    year = F.sqrt(F.lit(float(per_year)))
    return best.select(
        *group, "best", "n_trials", "n", (F.col("s") * year).alias("sharpe_annual"), (F.col("star") * year).alias("star_annual"),
        normal_cdf(z(F.lit(0.0))).alias("psr"), normal_cdf(z(F.col("star"))).alias("dsr"),
        min_backtest_years(F.col("n_trials"), F.col("s") * year, per_year).alias("min_years"),
    )
