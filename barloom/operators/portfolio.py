"""Selection, weights and contracts.

Moments and correlations are Spark aggregates; clustering and bisection run on
their matrix of series by series, whose size does not depend on the bars.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.metrics import correlation


def merges(apart: np.ndarray, single: bool) -> list[tuple[list[int], list[int]]]:
    """Agglomerative clustering: the two clusters of each merge, nearest first (ties: lowest members); single or average linkage."""
    clusters, d, out = {i: [i] for i in range(len(apart))}, apart.astype(float).copy(), []
    np.fill_diagonal(d, np.inf)
    while len(clusters) > 1:
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        a, b = clusters[i], clusters.pop(j)
        out.append((a, b))
        d[i] = np.minimum(d[i], d[j]) if single else (len(a) * d[i] + len(b) * d[j]) / (len(a) + len(b))
        d[:, i], d[i, i] = d[i], np.inf
        d[j], d[:, j] = np.inf, np.inf
        clusters[i] = a + b
    return out


def hrp(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity weights; series without variance get none, and all share alike if none has any."""
    var, n = np.diag(cov), len(cov)
    live = np.flatnonzero(np.isfinite(var) & (var > 0))
    weights = np.zeros(n)
    if not len(live):
        return np.full(n, 1 / n)
    if len(live) == 1:
        weights[live] = 1.0
        return weights
    c = cov[np.ix_(live, live)]
    sd = np.sqrt(np.diag(c))
    steps = merges(np.sqrt(np.maximum(0, 0.5 * (1 - np.clip(np.nan_to_num(c / np.outer(sd, sd)), -1, 1)))), True)
    own = np.ones(len(live))

    def risk(part: list[int]) -> float:
        w = 1 / np.diag(c)[part]
        w /= w.sum()
        return float(w @ c[np.ix_(part, part)] @ w)

    todo = [steps[-1][0] + steps[-1][1]]
    while todo:
        part = todo.pop()
        if len(part) > 1:
            one, two = part[: len(part) // 2], part[len(part) // 2 :]
            a, b = risk(one), risk(two)
            own[one] *= b / (a + b) if a + b > 0 else 0.5
            own[two] *= a / (a + b) if a + b > 0 else 0.5
            todo += [one, two]
    weights[live] = own
    return weights


def clusters(corr: np.ndarray, most: int = 30) -> np.ndarray:
    """Labels of the cut of an average-linkage tree, into 2 to ``most`` clusters, with the best mean silhouette."""
    n = len(corr)
    if n < 3:
        return np.arange(n)
    apart = np.sqrt(0.5 * (1 - np.clip(np.nan_to_num(corr), -1, 1)))
    np.fill_diagonal(apart, 0.0)
    labels, best, found = np.arange(n), -np.inf, np.zeros(n, int)
    for a, b in merges(apart, False):
        labels = labels.copy()
        labels[b] = labels[a[0]]
        names, at = np.unique(labels, return_inverse=True)
        if not 2 <= len(names) <= min(most, n - 1):
            continue
        member = np.eye(len(names))[at]
        size, total = member.sum(0), apart @ member
        within = total[np.arange(n), at] / np.maximum(size[at] - 1, 1)
        other = np.where(member > 0, np.inf, total / size).min(1)
        score = np.where(size[at] > 1, (other - within) / np.maximum(np.maximum(other, within), 1e-300), 0.0).mean()
        if score >= best:
            best, found = score, at
    return found


def _matrices(d: pd.DataFrame, names: list[str], column: str) -> np.ndarray:
    out, at = np.full((len(names), len(names)), np.nan), {s: i for i, s in enumerate(names)}
    i, j = d["a"].map(at).to_numpy(), d["b"].map(at).to_numpy()
    out[i, j] = out[j, i] = d[column].to_numpy(float)
    return out


def pairs(rets: DataFrame, key: str = "asset", family: str | None = None) -> DataFrame:
    """family, a <= b, corr, cov on shared stamps of each pair of a family's series, each with itself included."""
    own = [family] if family else []
    a, b = (rets.select(*own, "ts", F.col(key).alias(x), F.col("ret").alias(f"r{x}")) for x in "ab")
    return a.join(b, [*own, "ts"]).filter("a <= b").groupBy(*own, "a", "b").agg(correlation("ra", "rb").alias("corr"), F.covar_samp("ra", "rb").alias("cov"))


def _by_family(rows: DataFrame, family: str | None, column: str, of) -> DataFrame:
    """series and ``of(their matrix)`` of each family: a matrix of its series by its series is a group."""
    own = f"{family} {rows.schema[family].dataType.simpleString()}, " if family else ""
    name, kind = column.split()

    def run(d: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(d["a"]) | set(d["b"]))
        out = pd.DataFrame({"series": names, name: of(d, names)})
        if family:
            out[family] = d[family].iloc[0]
        return out

    return rows.groupBy(*([family] if family else [])).applyInPandas(run, f"{own}series string, {name} {kind}")


def hrp_weights(rets: DataFrame, key: str = "asset", family: str | None = None) -> DataFrame:
    """family, series, weight."""
    return _by_family(pairs(rets, key, family), family, "weight double", lambda d, names: hrp(_matrices(d, names, "cov")))


def effective_trials(rets: DataFrame, key: str = "asset", family: str | None = None) -> DataFrame:
    """family, series, cluster, n_eff, var_sharpe: clusters of alike series, their number, and the variance of the clusters' Sharpe ratios.

    A cluster's return is the mean of its series on each stamp.
    """
    own = [family] if family else []
    labels = _by_family(pairs(rets, key, family), family, "cluster int", lambda d, names: clusters(_matrices(d, names, "corr")))
    series = rets.select(*own, "ts", F.col(key).cast("string").alias("series"), "ret")
    means = series.join(labels, [*own, "series"]).groupBy(*own, "cluster", "ts").agg(F.avg("ret").alias("ret"))
    ratio = F.coalesce(F.try_divide(F.avg("ret"), F.nullif(F.stddev_samp("ret"), F.lit(0.0))), F.lit(0.0))
    told = means.groupBy(*own, "cluster").agg(ratio.alias("s")).groupBy(*own).agg(F.count("s").alias("n_eff"), F.coalesce(F.var_samp("s"), F.lit(0.0)).alias("var_sharpe"))
    return labels.join(F.broadcast(told), own) if own else labels.crossJoin(F.broadcast(told))  # a row a family


def trade_runs(rets: DataFrame, key: str = "asset") -> DataFrame:
    """Trades of each series as its returns show them: runs of non-zero returns."""
    on = (F.coalesce("ret", F.lit(0.0)) != 0).cast("int")
    by = Window.partitionBy(key).orderBy("ts")
    marked = rets.withColumn("_on", on).withColumn("_new", F.col("_on") * (1 - F.coalesce(F.lag("_on").over(by), F.lit(0))))
    return marked.groupBy(key).agg(F.sum("_new").alias("n_trades"))


def picked(d: pd.DataFrame, least_sharpe: float, most: int, ceiling: float, method: str = "greedy") -> list[str]:
    """Series taken from a table of pairs (a, b, corr, cov, mean, sharpe), the last two of a where a = b; best first.

    "greedy": the best, then what lifts the Sharpe of the equal-weight mix most, while it rises, among those correlated at
    ``ceiling`` or less with all taken. "cluster": the best of each of at most ``most`` clusters of correlation.
    """
    own = d[d["a"] == d["b"]].set_index("a")
    names = own["sharpe"][own["sharpe"] >= least_sharpe].sort_index().sort_values(ascending=False, kind="stable").index.tolist()
    every = sorted(set(d["a"]) | set(d["b"]))
    place = {s: i for i, s in enumerate(every)}
    corr, cov = (_matrices(d, every, c) for c in ("corr", "cov"))
    mean = own["mean"].reindex(every).to_numpy(float)
    if method == "cluster" and len(names) > 1:
        at = [place[s] for s in names]
        apart = np.sqrt(0.5 * (1 - np.clip(np.nan_to_num(corr[np.ix_(at, at)]), -1, 1)))
        label = np.arange(len(at))
        for a, b in merges(apart, False)[: max(0, len(at) - most)]:
            label[b] = label[a[0]]
        return [s for k, s in enumerate(names) if label[k] not in label[:k]]

    def mixed(part: list[str]) -> float:
        at = [place[s] for s in part]
        var = cov[np.ix_(at, at)].mean()
        return mean[at].mean() / np.sqrt(var) if var > 0 else 0.0

    taken = names[:1]
    while taken and len(taken) < most:
        open_ = [s for s in names if s not in taken and all(abs(corr[place[s], place[t]]) <= ceiling for t in taken)]
        best = max(open_, key=lambda s: mixed([*taken, s]), default=None)
        if best is None or not mixed([*taken, best]) > mixed(taken):
            break
        taken.append(best)
    return taken


def static_selection(rets: DataFrame, least_sharpe: float, per_year: float, most: int = 8, ceiling: float = 0.6, method: str = "greedy", weighting: str = "equal", key: str = "asset") -> DataFrame:
    """series, weight: picked from the whole history, which makes what they earned in it a biased record."""
    one = rets.groupBy(F.col(key).alias("a")).agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("_s"))
    one = one.select("a", F.col("a").alias("b"), "mean", F.when(F.col("_s") > 0, F.col("mean") / F.col("_s") * per_year**0.5).otherwise(F.lit(0.0)).alias("sharpe"))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        taken = picked(d, least_sharpe, most, ceiling, method)
        weight = np.full(len(taken), 1 / max(len(taken), 1))
        if weighting == "hrp" and taken:
            part = d[d["a"].isin(taken) & d["b"].isin(taken)]
            weight = hrp(_matrices(part, taken, "cov"))
        return pd.DataFrame({"series": taken, "weight": weight})

    return pairs(rets, key).join(one, ["a", "b"], "left").groupBy().applyInPandas(run, "series string, weight double")


def nested_selection(rets: DataFrame, block: int, least_sharpe: float, per_year: float, most: int = 8, ceiling: float = 0.6, history: int = 60, key: str = "asset") -> DataFrame:
    """block_id, series, weight: series picked for each block from the returns before it, in equal shares.

    rets (key, ts, bar_idx, ret). Of the series whose Sharpe so far reaches ``least_sharpe`` the best is taken; then, while the
    Sharpe of the equal-weight mix rises, the one that lifts it most, among those that correlate at ``ceiling`` or
    less (and measurably) with all taken. What is before a block comes from sums for each block, accumulated; bars are
    read once and meet no boundaries.
    """
    put = rets.filter("ret IS NOT NULL").select(F.col(key).alias("k"), "ts", F.floor(F.col("bar_idx") / block).cast("long").alias("block_id"), "ret")
    a, b = put.select("ts", "block_id", F.col("k").alias("a"), F.col("ret").alias("x")), put.select("ts", F.col("k").alias("b"), F.col("ret").alias("y"))
    x, y = F.col("x"), F.col("y")
    sums = a.join(b, "ts").filter("a <= b").groupBy("a", "b", "block_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")
    )
    blocks = put.select(F.col("block_id")).distinct()
    grid = sums.select("a", "b").distinct().crossJoin(F.broadcast(blocks)).join(sums, ["a", "b", "block_id"], "left")  # pairs of series by blocks, no bars
    before = Window.partitionBy("a", "b").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    past = grid.select("a", "b", "block_id", *(F.sum(c).over(before).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))).filter(F.col("n") >= history)
    n = F.col("n")
    vx, vy, cxy = (F.col(p) - F.col(q) * F.col(s) / n for p, q, s in (("sxx", "sx", "sx"), ("syy", "sy", "sy"), ("sxy", "sx", "sy")))
    told = past.select(
        "block_id", "a", "b", F.when((vx > 0) & (vy > 0), cxy / F.sqrt(vx * vy)).alias("corr"), (cxy / (n - 1)).alias("cov"), (F.col("sx") / n).alias("mean"),
        F.when(vx > 0, F.col("sx") / n / F.sqrt(vx / (n - 1)) * per_year**0.5).otherwise(F.lit(0.0)).alias("sharpe"),
    )

    def run(d: pd.DataFrame) -> pd.DataFrame:
        taken = picked(d, least_sharpe, most, ceiling)
        return pd.DataFrame({"block_id": d["block_id"].iloc[0], "series": taken, "weight": 1 / max(len(taken), 1)})

    return told.groupBy("block_id").applyInPandas(run, "block_id long, series string, weight double")


def held_returns(rets: DataFrame, picked: DataFrame, block: int, key: str = "asset") -> DataFrame:
    """ts, ret of holding what was picked for each block."""
    put = rets.withColumn("block_id", F.floor(F.col("bar_idx") / block).cast("long"))
    both = put.join(picked, (put[key] == picked["series"]) & (put["block_id"] == picked["block_id"]))
    return both.groupBy("ts").agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))


def hedge_ratios(pairs_of: DataFrame, bars: int = 120, least: int = 60) -> DataFrame:
    """name, n, ratio, corr of rows (name, ts, ret, base): dollars of the hedge for a dollar held.

    Returns are pulled in to 3 robust deviations (1.4826 times the median absolute one) of their median over
    all stamps; the ratio of deviations over the last ``bars`` shared stamps is kept in 0.5 to 2.5. Below ``least``
    shared stamps or without spread it is 1.
    """
    def pulled(c: str, df: DataFrame) -> DataFrame:
        mid = df.groupBy("name").agg(F.median(c).alias("_m"))
        far = df.join(mid, "name").withColumn("_d", F.abs(F.col(c) - F.col("_m")))
        wide = far.groupBy("name").agg((3 * 1.4826 * F.median("_d")).alias("_w"))
        inside = F.least(F.greatest(F.col(c), F.col("_m") - F.col("_w")), F.col("_m") + F.col("_w"))
        return far.join(wide, "name").withColumn(c, F.when(F.col("_w") > 0, inside).otherwise(F.col(c))).drop("_m", "_d", "_w")

    rows = pulled("base", pulled("ret", pairs_of)).filter("ret IS NOT NULL AND base IS NOT NULL")
    last = rows.withColumn("_i", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ts")))).filter(F.col("_i") <= bars)
    raw = F.try_divide(F.stddev_samp("ret"), F.nullif(F.stddev_samp("base"), F.lit(0.0)))
    got = last.groupBy("name").agg(F.count(F.lit(1)).alias("n"), raw.alias("_r"), correlation("ret", "base").alias("corr"))
    usable = (F.col("n") >= least) & (F.col("_r") > 0)
    return got.select("name", "n", F.when(usable, F.least(F.greatest(F.col("_r"), F.lit(0.5)), F.lit(2.5))).otherwise(F.lit(1.0)).alias("ratio"), "corr")


def whole_contracts(target: Column, held: Column, slack: float = 0.6) -> Column:
    """Nearest whole number (halves away from 0), but what is held stays while the target is of its side and within ``slack``."""
    nearest = F.signum(target) * F.floor(F.abs(target) + 0.5)
    stays = (F.signum(held) == F.signum(target)) & (held != 0) & (F.abs(target - held) <= slack)
    return F.when(F.isnan(target) | target.isNull() | (target == 0), F.lit(0.0)).when(stays, held).otherwise(nearest).cast("long")


def future_level(level: Column, close: Column, price: Column, ratio: Column, tick: float) -> Column:
    """A price level restated on a future: the same move, over the hedge ratio, in whole ticks."""
    moved = price * (1 + (level / F.nullif(close, F.lit(0.0)) - 1) / ratio)
    return F.bround(moved / tick) * tick


def contract_book(targets: DataFrame, contracts: DataFrame, held: DataFrame, slack: float = 0.6) -> DataFrame:
    """A dollar book in whole contracts: one row an asset or root with a target or a holding, and a note where it is left out.

    targets (asset, notional), held (root, contracts), contracts (asset, root, price, unit, rate, ratio, low, high): a contract is
    worth price * unit * rate dollars and must lie in low..high; ratio is the hedge for a dollar held. A held root without a
    target is closed; assets without a contract, price or rate and holdings of unknown roots are told, not guessed.
    """
    known = contracts.withColumn("value", F.col("price") * F.col("unit") * F.col("rate"))
    rows = known.join(targets, "asset", "full_outer").join(held.withColumnRenamed("contracts", "held"), "root", "full_outer")
    rows = rows.withColumns({"notional": F.coalesce("notional", F.lit(0.0)), "held": F.coalesce(F.rint("held"), F.lit(0.0))}).filter((F.col("notional") != 0) | (F.col("held") != 0))
    note = (
        F.when(F.col("root").isNull(), "no contract for this asset")
        .when(F.col("asset").isNull(), "held root is no contract of the table")
        .when((F.col("notional") == 0) & F.col("value").isNull(), "closed without a price")
        .when(F.col("price").isNull() | (F.col("price") <= 0), "no price")
        .when(F.col("rate").isNull() | (F.col("rate") <= 0), "no currency rate")
        .when(~F.col("value").between(F.col("low"), F.col("high")), "contract value out of range")
    )
    rows = rows.withColumn("note", note)
    usable = F.col("note").isNull()
    raw = F.when(usable, F.col("notional") * F.col("ratio") / F.col("value"))
    closing = F.col("note") == "closed without a price"
    target = F.when(usable, whole_contracts(raw, F.col("held"), slack)).when(closing, F.lit(0).cast("long"))
    rows = rows.withColumns({"raw": raw, "target": target}).withColumn("delta", F.col("target") - F.col("held").cast("long"))
    action = F.when(F.col("delta") > 0, "BUY").when(F.col("delta") < 0, "SELL").when(F.col("delta") == 0, "hold")
    off = (F.col("target") - F.col("raw")) * F.col("value") / F.col("ratio")
    return rows.select("asset", "root", "notional", "value", "raw", F.col("held").cast("long").alias("held"), "target", "delta", action.alias("action"), off.alias("rounding_error"), "note")


def translated_orders(orders: DataFrame, contracts: DataFrame) -> DataFrame:
    """Orders (asset, kind, side, level, shares, close) restated on futures: level in ticks, contracts raw and whole.

    contracts (asset, root, price, value, ratio, tick). An order without a level counts at the last close.
    """
    rows = orders.join(F.broadcast(contracts), "asset")
    raw = F.col("shares") * F.coalesce("level", "close") * F.col("ratio") / F.col("value")
    moved = F.col("price") * (1 + (F.col("level") / F.nullif(F.col("close"), F.lit(0.0)) - 1) / F.col("ratio"))
    return rows.select(
        "asset", "root", "kind", "side", "level", (F.bround(moved / F.col("tick")) * F.col("tick")).alias("fut_level"), raw.alias("contracts_raw"), F.floor(F.abs(raw) + 0.5).cast("long").alias("contracts")
    )
