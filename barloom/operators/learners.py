"""Online learners over expert losses and discounted ridge forecasts.

Both restart cold at every bar over the last ``memory`` rounds. The restarts are
lanes: step j of all of them is one numpy operation, so a pass takes ``memory``
steps however long the history is. A group is CHUNK bars of an asset and the bars before
them that its restarts read, so groups are bounded, run in parallel and give what one pass
over the whole history would give.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Memory, lifetimes of the discounting rungs, expected switches of the sharing rungs.
MEMORY, LIFETIMES, SWITCHES = 250, (20, 40, 80, 160), (0.25, 0.5, 1, 2, 4, 8)


@dataclass(frozen=True)
class Expert:
    """A channel of n bars (highest and lowest, or an average with k ranges around it) and the side taken on a break of it."""

    kind: str
    n: int
    k: float = 0.0
    side: int = 1
    hold: int = 0  #: bars a break stays the stance; 0: n

    @property
    def span(self) -> int:
        return self.hold or self.n

    @property
    def label(self) -> str:
        base = str(self.n) if self.kind == "donchian" else f"kel{self.n}x{self.k:g}"
        return f"{'follow' if self.side > 0 else 'fade'}_{base}" + (f"_h{self.hold}" if self.hold else "")


#: Lookbacks of the ladders, width of their bands, memory and lifetimes of their learners.
RUNGS, LONG_RUNGS, WIDE = (10, 20, 40, 80), (20, 40, 80, 160), 2.0
FAST_LEARNER, SLOW_LEARNER = (250, (20, 40, 80, 160)), (750, (250, 500, 750))
FOLLOW_LEARNER, FADE_LEARNER, TOP_LEARNER = (500, (125, 250, 500)), (250, (10, 20, 40, 80)), (120, (10, 20, 40))
LADDERS = ("hedge", "hedge_wide", "hedge_slow", "hedge_wide_slow", "hedge_long", "hedge_split")


def _two(spans: tuple[int, ...], side: int, holds: tuple[int, ...] = (0,)) -> list[Expert]:
    return [Expert(kind, n, WIDE if kind == "keltner" else 0.0, side, hold) for kind in ("donchian", "keltner") for n in spans for hold in holds]


#: Bars to a group, besides those that are read before them.
CHUNK = 2048


def chunked(rows: DataFrame, lead: int) -> DataFrame:
    """Each row in the chunk of its bar and in those within ``lead`` bars after it; bars of an asset are numbered without gaps."""
    own, last = F.floor(F.col("bar_idx") / CHUNK).cast("long"), F.floor((F.col("bar_idx") + lead) / CHUNK).cast("long")
    return rows.withColumn("chunk", F.explode(F.sequence(own, last)))


def ladder(name: str = "hedge", mode: str = "learned") -> list[Expert]:
    """The experts of a ladder: following (trend), fading (countertrend), or both (learned)."""
    if name == "hedge_split":
        follow, fade = _two((20, 40, 80), 1), _two((5, 10, 20), -1, (1, 3))
    else:
        spans = LONG_RUNGS if name == "hedge_long" else RUNGS
        make = (lambda side: _two(spans, side)) if "wide" in name else (lambda side: [Expert("donchian", n, side=side) for n in spans])
        follow, fade = make(1), make(-1)
    return {"trend": follow, "countertrend": fade, "learned": follow + fade}[mode]


def learner_of(name: str) -> tuple[int, tuple[int, ...]]:
    """Memory and lifetimes of a ladder's learner."""
    return SLOW_LEARNER if name in ("hedge_slow", "hedge_wide_slow", "hedge_long") else FAST_LEARNER


def split_committee(loss: np.ndarray, followers: int, sharing: bool) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all experts and the weight on trading: one learner for each group, and one over the two committees.

    A committee's loss on a bar is what the weights of the bar before suffered.
    """
    def run(x: np.ndarray, learner: tuple[int, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        keep, share, slow = rungs(learner[0], learner[1], sharing)
        return committee(x, learner[0], keep, share, slow)

    parts = [loss[:, :followers], loss[:, followers:]]
    own = [run(x, learner)[0] for x, learner in zip(parts, (FOLLOW_LEARNER, FADE_LEARNER), strict=True)]
    top = np.full((len(loss), 2), 0.5)
    for g in range(2):
        top[1:, g] = np.clip((own[g][:-1] * parts[g][1:]).sum(1), 0, 1)
    weight, trade = run(top, TOP_LEARNER)
    return np.concatenate([weight[:, :1] * own[0], weight[:, 1:] * own[1]], axis=1), trade


def rungs(memory: int = MEMORY, lifetimes: tuple[int, ...] = LIFETIMES, sharing: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """Discount and share rate of each rung, and the discount of the layers above them."""
    slow = 1 - 1 / max(lifetimes)
    if sharing:
        return np.ones(len(SWITCHES)), np.array(SWITCHES, float) / memory, slow
    return 1 - 1 / np.array(lifetimes, float), np.zeros(len(lifetimes)), slow


def committee(loss: np.ndarray, memory: int, keep: np.ndarray, share: np.ndarray, slow: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bars, experts) after each bar's round, and the weight on trading at all.

    Each rung is AdaHedge with a discount ``keep`` and a fixed share; rungs are mixed by
    exponential weights at unit rate, and so is the mixture against a cash loss of 0.5.
    """
    bars, experts = loss.shape
    shape = (bars, len(keep), experts)
    behind, w = np.zeros(shape), np.full(shape, 1 / experts)
    gap, norm = np.zeros(shape[:2]), np.full(shape[:2], float(experts))
    lag, v = np.zeros(shape[:2]), np.full(shape[:2], 1 / len(keep))
    edge = np.zeros(bars)  # discounted loss of the mixture less that of cash
    for first in range(min(memory, bars) - 1, -1, -1):
        on, x = slice(first, bars), loss[: bars - first, None, :]
        felt = (w[on] * x).sum(2)
        with np.errstate(divide="ignore", invalid="ignore"):
            rate = np.log(experts) / gap[on]
            reach = behind[on] + x
            low = reach.min(2)
            soft = low - np.log(np.exp(-rate[..., None] * (reach - low[..., None])).sum(2) / norm[on]) / rate
        mixed = np.where(gap[on] > 0, soft, np.broadcast_to(x.min(2), felt.shape))
        gap[on] = keep * gap[on] + np.maximum(felt - mixed, 0)
        moved = keep[:, None] * behind[on] + x
        moved -= moved.min(2, keepdims=True)
        live = gap[on] > 0
        rate = np.log(experts) / np.where(live, gap[on], 1.0)
        raw = np.exp(-rate[..., None] * moved)
        total = raw.sum(2)
        weight = raw / total[..., None]
        if share.any():
            weight = (1 - share[:, None]) * weight + share[:, None] / experts
            with np.errstate(divide="ignore"):
                again = -np.log(weight) / rate[..., None]
            again -= again.min(2, keepdims=True)
            moved = np.where((live & (share > 0))[..., None], again, moved)
            total = np.exp(-rate[..., None] * moved).sum(2)
        w[on] = np.where(live[..., None], weight, 1 / experts)
        norm[on] = np.where(live, total, experts)
        behind[on] = moved
        edge[on] = slow * edge[on] + (v[on] * felt).sum(1) - 0.5
        late = slow * lag[on] + felt
        lag[on] = late - late.min(1, keepdims=True)
        odds = np.exp(-lag[on])
        v[on] = odds / odds.sum(1, keepdims=True)
    return (v[..., None] * w).sum(1), 1 / (1 + np.exp(edge))


def hedge(rows: DataFrame, memory: int = MEMORY, lifetimes: tuple[int, ...] = LIFETIMES, sharing: bool = True, followers: int | None = None) -> DataFrame:
    """asset, bar_idx, weights, trade, position of rows (asset, bar_idx, stances array, losses array).

    position: trade times the weighted stance, within [-1, 1]. A null in the arrays counts as stance 0 and loss 0.5. With
    ``followers`` the first so many experts and the rest have learners of their own, and a third one over them.
    """
    keep, share, slow = rungs(memory, lifetimes, sharing)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("bar_idx")
        stances, losses = (np.array(d[c].tolist(), float) for c in ("stances", "losses"))
        losses = np.nan_to_num(losses, nan=0.5)
        weights, trade = committee(losses, memory, keep, share, slow) if followers is None else split_committee(losses, followers, sharing)
        position = trade * np.clip((weights * np.nan_to_num(stances)).sum(1), -1, 1)
        out = pd.DataFrame({"asset": d["asset"], "bar_idx": d["bar_idx"], "weights": list(weights), "trade": trade, "position": position})
        return out[(d["bar_idx"] >= d["chunk"] * CHUNK).to_numpy()]

    lead = memory if followers is None else max(FOLLOW_LEARNER[0], FADE_LEARNER[0]) + TOP_LEARNER[0]
    return chunked(rows.select("asset", "bar_idx", "stances", "losses"), lead).groupBy("asset", "chunk").applyInPandas(
        run, "asset string, bar_idx long, weights array<double>, trade double, position double"
    )


def ridge(x: np.ndarray, y: np.ndarray, memory: int, keep: float, prior: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Coefficients (bars, features) at each bar from the pairs of the last ``memory`` bars that are two bars old or older.

    Pairs with a missing value weigh nothing; without pairs the coefficients are the prior. A coefficient of infinite
    precision stays at its prior, and its share is taken off y.
    """
    free = np.isfinite(penalty)
    if not free.all():
        out = np.tile(prior, (len(x), 1)).astype(float)
        if free.any():
            out[:, free] = ridge(x[:, free], y - x[:, ~free] @ prior[~free], memory, keep, prior[free], penalty[free])
        return out
    known = np.isfinite(x).all(1) & np.isfinite(y)
    a, b = np.where(known[:, None], x, 0.0), np.where(known, y, 0.0)
    gram, cross = a[:, :, None] * a[:, None, :], a * b[:, None]
    left, right = np.zeros_like(gram), np.zeros_like(cross)
    for k in range(2, memory + 2):
        if k >= len(x):
            break
        weight = keep ** (k - 2)
        left[k:] += weight * gram[:-k]
        right[k:] += weight * cross[:-k]
    return np.linalg.solve(left + np.diag(penalty), (right + penalty * prior)[..., None])[..., 0]


def ridge_forecasts(rows: DataFrame, memory: int = 500, horizon: int = 250, prior: tuple[float, ...] = (0.02, 0.02), penalty: tuple[float, ...] = (1000.0, 2500.0)) -> DataFrame:
    """asset, bar_idx, betas, forecast of rows (asset, bar_idx, features array, y); y of a bar is known two bars later.

    A forecast is null where a feature of its bar is.
    """
    keep, start, stiff = 1 - 1 / horizon, np.array(prior, float), np.array(penalty, float)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("bar_idx")
        x = np.array(d["features"].tolist(), float)
        betas = ridge(x, d["y"].to_numpy(float), memory, keep, start, stiff)
        out = pd.DataFrame({"asset": d["asset"], "bar_idx": d["bar_idx"], "betas": list(betas), "forecast": (betas * x).sum(1)})
        return out[(d["bar_idx"] >= d["chunk"] * CHUNK).to_numpy()]

    out = chunked(rows.select("asset", "bar_idx", "features", "y"), memory + 2).groupBy("asset", "chunk").applyInPandas(run, "asset string, bar_idx long, betas array<double>, forecast double")
    return out.withColumn("forecast", F.nanvl("forecast", F.lit(None).cast("double")))
