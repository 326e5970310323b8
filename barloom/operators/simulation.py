"""Order simulation of whole plans: entries, exits, sizing, costs, rolls and ruin of every trial in one ordered pass.

Trials are lanes of numpy arrays, so a bar costs the same vector operations for one trial or hundreds;
assets and shares of the trials are Spark groups and run in parallel.

Rules. What happens on bar i is decided by values of bar i - 1. An order that the open already trades
through fills at the open; of a stop and a target that only the bar's range reaches, the stop goes first.
A lane leaves and enters on different bars, but a stop (and a target whose prices certainly came after the
fill) counts on the entry bar too. A pullback rests as a limit order for some bars. Size risks a share of the
capital to the stop, or aims at a volatility, under a leverage cap. A close that leaves nothing closes the
account, a deficit stays. With ``fixed`` capital returns add up and there is no ruin. Bars before ``first``
only warm up. A position open at the end is marked at the last close.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trials to a group, and bars times trials up to which a group has so many.
LANES, ROOM = 256, 1 << 24
#: The columns of a plan and what they are where a plan does not say; a plan without capital has the account's.
PLAN = {
    "direction": "trend", "channel": "donchian", "entry": "stop", "exit": "channel", "regime_indicator": "er", "regime_filter": "none",
    "vol_filter": False, "bias_filter": "none", "sides": "both", "n_entry": 40, "n_exit": 20, "atr_n": 20, "channel_k": 2.0,
    "stop_mult": 3.0, "target_mult": 4.0, "trail_mult": 3.0, "pullback_mult": 0.5, "pullback_bars": 3, "max_hold": 20, "regime_n": 0,
    "regime_threshold": np.nan, "vol_lookback": 100, "vol_low": 0.10, "vol_high": 0.90, "bias_n": 200, "risk": 0.01, "leverage": 2.0,
    "vol_target": 0.0, "vol_target_n": 60, "capital": np.nan,
}
#: Length and threshold of each regime indicator; larger means more of a trend.
REGIMES = {"er": (20, 0.35), "adx": (14, 25.0), "cti": (20, 0.5), "chop": (14, 50.0), "vr": (60, 1.0), "mmi": (100, 25.0), "hurst": (100, 0.5)}
#: Names of exit reasons, order kinds, types and stop kinds.
REASONS = ("stop", "channel", "midline", "target", "time", "stop_same_bar", "ruin", "stance")
KINDS = (
    "entry_working", "entry_submit_market", "pullback_submit", "pullback_working", "pullback_expire", "pullback_cancel", "entry_fill",
    "entry_reject", "stop_working", "target_working", "time_exit_submit", "exit_fill", "roll",
)
ORDER_TYPES, STOP_KINDS = ("-", "stop", "limit", "pullback", "market"), ("hard", "channel", "trail")


@dataclass(frozen=True)
class Account:
    """Capital, costs a side (share of notional and per unit), contract terms; ``fixed`` capital does not compound."""

    equity: float = 100_000.0
    cost_rate: float = 0.0005
    cost_per_unit: float = 0.0
    point_value: float = 1.0
    margin: float = 0.0
    whole_units: bool = False
    roll_cost: float = 0.0
    fixed: bool = False
    per_year: float = 252.0


class Formed:
    """Indicator arrays of one asset's bars, NaN until formed, each computed once."""

    def __init__(self, bars: pd.DataFrame, cash: bool):
        self.h, self.l, self.c = (bars[x].astype(float).reset_index(drop=True) for x in ("high", "low", "close"))
        before = self.c.shift(1)
        self.tr = pd.concat([self.h - self.l, (self.h - before).abs(), (self.l - before).abs()], axis=1).max(axis=1)
        self.bars, self.cash, self.held = bars, cash, {}

    def get(self, name: str, *of) -> np.ndarray:
        key = (name, *of)
        if key not in self.held:
            self.held[key] = np.asarray(getattr(self, name)(*of), float)
        return self.held[key]

    def atr(self, n):
        return self.tr.rolling(n).mean()

    def sma(self, n):
        return self.c.rolling(n).mean()

    def middle(self, kind, n):
        if kind == "donchian":
            return (self.h.rolling(n).max() + self.l.rolling(n).min()) / 2
        return self.c.ewm(span=n, adjust=False, min_periods=n).mean() if kind == "keltner" else self.sma(n)

    def edge(self, kind, n, k, atr_n, side):
        if kind == "donchian":
            return self.h.rolling(n).max() if side > 0 else self.l.rolling(n).min()
        width = self.atr(atr_n) if kind == "keltner" else self.c.rolling(n).std(ddof=0)
        return self.middle(kind, n) + side * k * width

    def rank(self, atr_n, n):
        return self.atr(atr_n).rolling(n).rank(pct=True)

    def vol(self, n):
        return (self.c.pct_change() if self.cash else self.c.diff()).rolling(n).std()

    def learned(self):
        return self.bars["learned"]

    def column(self, name):
        return self.bars[name]

    def er(self, n):
        return ((self.c - self.c.shift(n)).abs() / self.c.diff().abs().rolling(n).sum().replace(0, np.nan)).clip(0, 1)

    def adx(self, n):
        return directional(self.h, self.l, self.tr, n)

    def cti(self, n):
        r = self.c.rolling(n).corr(pd.Series(np.arange(len(self.c), dtype=float)))
        return r.where(self.c.rolling(n).std() > 0, 0.0).where(self.c.rolling(n).count() == n).abs().clip(0, 1)

    def chop(self, n):
        span = (self.h.rolling(n).max() - self.l.rolling(n).min()).replace(0, np.nan)
        return 100 - (100 * np.log10(self.tr.rolling(n).sum() / span) / np.log10(n)).clip(0, 100)

    def vr(self, n, q=5):
        x = np.log(self.c) if self.cash else self.c
        return (x.diff(q).rolling(n).var() / (q * x.diff().rolling(n).var()).replace(0, np.nan)).clip(0, 5)

    def mmi(self, n):
        d = self.c.diff().to_numpy()
        out = np.full(len(d), np.nan)
        if len(d) > n:
            w = np.lib.stride_tricks.sliding_window_view(d[1:], n)
            m = np.median(w, axis=1)[:, None]
            a, b = w[:, 1:], w[:, :-1]
            out[n:] = 100 - 100 * (((a > m) & (a > b)) | ((a < m) & (a < b))).sum(axis=1) / (n - 1)
        return out

    def hurst(self, n, most=10):
        x = np.log(np.arange(1, most + 1))
        y = np.stack([np.log(self.c.diff(q).rolling(n).var(ddof=0).where(lambda v: v > 0)) for q in range(1, most + 1)])
        return ((x - x.mean()) @ y) / ((x - x.mean()) ** 2).sum() / 2


def directional(high: pd.Series, low: pd.Series, tr: pd.Series, n: int) -> pd.Series:
    """Wilder's directional index: each mean counts from its first value and is null before its n-th."""
    smooth = lambda x: x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
    up, down = high.diff(), -low.diff()
    rise, fall = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    span = smooth(tr).replace(0, np.nan)
    plus, minus = 100 * smooth(rise) / span, 100 * smooth(fall) / span
    return smooth(100 * (plus - minus).abs() / (plus + minus).replace(0, np.nan))


@dataclass
class Run:
    equity: np.ndarray  #: (bars, lanes)
    entries: np.ndarray
    trades: pd.DataFrame
    orders: pd.DataFrame | None
    position: np.ndarray
    units: np.ndarray
    entry_price: np.ndarray
    since: np.ndarray
    stop: np.ndarray
    target: np.ndarray
    last_atr: np.ndarray
    trending: np.ndarray  #: the logic of new entries after the last bar
    size: Callable[[np.ndarray, np.ndarray], np.ndarray]  #: units of an entry at a price, under a logic, after the last bar
    funded: np.ndarray  #: capital at the start
    gross: np.ndarray  #: sum over bars of the exposure at the close over equity, and the same with its sign
    net: np.ndarray

    def returns(self, account: Account) -> np.ndarray:
        out = np.zeros(self.equity.shape)
        if account.fixed:
            out[1:] = np.diff(self.equity, axis=0) / self.funded
        else:
            before = self.equity[:-1]
            out[1:] = np.where(before > 0, self.equity[1:] / np.where(before > 0, before, 1) - 1, 0.0)
        return out


def filled(plans: pd.DataFrame) -> pd.DataFrame:
    """The plans with every column of PLAN."""
    out = plans.copy()
    for name, value in PLAN.items():
        if name not in out:
            out[name] = value
        elif not (isinstance(value, float) and np.isnan(value)):
            out[name] = out[name].where(out[name].notna(), value)
    return out


class Inputs:
    """What lanes read bar by bar: prices and indicator values of their series, held once for each series and looked up by lane.

    ``of`` has the series of each lane. Shorter series end in NaN. Indicators are held as one column for each series and length,
    never once a lane; whether a lane's values have formed takes a byte a bar.
    """

    NAMES = ("upper", "lower", "upper_x", "lower_x", "mid_x", "atr", "regime", "rank", "bias", "vol", "direction")

    def __init__(self, series: list[pd.DataFrame], p: pd.DataFrame, of: np.ndarray, account: Account):
        self.n, m = max((len(b) for b in series), default=0), len(p)
        self.alone, self.of = len(series) == 1, of
        padded = lambda x: np.concatenate([np.asarray(x, float), np.full(self.n - len(x), np.nan)])
        self.prices = {k: np.stack([padded(b[k]) for b in series], axis=1) if series else np.zeros((0, 0)) for k in ("open", "high", "low", "close")}
        rolls = account.roll_cost > 0
        self.prices["roll"] = np.stack([padded(b["roll"].fillna(0) if rolls and "roll" in b else np.zeros(len(b))) for b in series], axis=1) if series else np.zeros((0, 0))
        formed = [Formed(b, account.margin <= 0) for b in series]

        def edges(x: dict, span: str, side: int) -> tuple:
            if x["channel"] == "ladder":  # a channel that the bars bring
                return "column", ("upper" if side > 0 else "lower") + ("_x" if span == "n_exit" else "")
            return "edge", x["channel"], int(x[span]), float(x["channel_k"]), int(x["atr_n"]), side

        middle = lambda x: ("column", "mid_x") if x["channel"] == "ladder" else ("middle", x["channel"], int(x["n_exit"]))
        length = lambda x: int(x["regime_n"]) or REGIMES[x["regime_indicator"]][0]
        if_ = lambda test, *spec: spec if test else ()
        wants = {
            "upper": lambda x: edges(x, "n_entry", 1), "lower": lambda x: edges(x, "n_entry", -1),
            "upper_x": lambda x: edges(x, "n_exit", 1) if x["exit"] == "channel" else (), "lower_x": lambda x: edges(x, "n_exit", -1) if x["exit"] == "channel" else (),
            "mid_x": lambda x: middle(x) if x["exit"] == "channel" else (), "atr": lambda x: ("atr", int(x["atr_n"])),
            "regime": lambda x: if_(x["regime_filter"] != "none", x["regime_indicator"], length(x)), "rank": lambda x: if_(x["vol_filter"], "rank", int(x["atr_n"]), int(x["vol_lookback"])),
            "bias": lambda x: if_(x["bias_filter"] == "sma", "sma", int(x["bias_n"])), "vol": lambda x: if_(x["vol_target"] > 0, "vol", int(x["vol_target_n"])),
            "direction": lambda x: ("learned",) if x["direction"] == "learned" else (x["direction"] == "trend",),
        }
        rows, constant = p.to_dict("records"), {(): 0.0, (True,): 1.0, (False,): -1.0}
        self.columns, self.ready = {}, np.ones((self.n, m), bool)
        for name, spec_of in wants.items():
            keys = [(int(k), spec_of(x)) for k, x in zip(of, rows, strict=True)]
            distinct = {key: i for i, key in enumerate(dict.fromkeys(keys))}
            table = np.empty((self.n, len(distinct)))
            for (k, spec), i in distinct.items():
                table[:, i] = constant[spec] if spec in constant else padded(formed[k].get(*spec))
            at = np.array([distinct[key] for key in keys], int)
            self.columns[name] = (table, at)
            self.ready &= ~np.isnan(table)[:, at]

    def price(self, name: str, i: int):
        row = self.prices[name][i]
        return row[0] if self.alone else row[self.of]

    def at(self, name: str, i: int) -> np.ndarray:
        table, lanes = self.columns[name]
        return table[i][lanes]


class Lanes:
    """The accounts of plans, one to a lane; ``step`` takes them over one bar.

    What a lane carries from bar to bar is its ``state``, arrays that can be stored and put back, so bars may come all at once or
    one at a time.
    """

    STATE = {
        "cash": float, "equity": float, "side": float, "units": float, "paid": float, "entry": float, "stop": float, "target": float, "extreme": float,
        "last_atr": float, "since": int, "until": int, "resting": bool, "rest_side": float, "rest_level": float, "rest_trend": bool, "follows": bool, "ruined": bool,
    }

    def __init__(self, plans: pd.DataFrame, account: Account, log: bool = False):
        self.plans, self.account, self.log, self.m = filled(plans), account, log, len(plans)
        m = self.m
        self.funded = np.where(np.isnan(capital := self.plans["capital"].to_numpy(float)), account.equity, capital)
        self.state = {k: np.zeros(m, kind) for k, kind in self.STATE.items()}
        self.state |= {"cash": self.funded.copy(), "equity": self.funded.copy(), "ruined": (self.funded <= 0) & (not account.fixed), "since": np.full(m, -1), "rest_trend": np.ones(m, bool), "follows": np.ones(m, bool)}
        self.closed: list[tuple] = []
        self.events: list[tuple] = []
        p = self.plans
        col = lambda name, kind=float: p[name].to_numpy(kind)
        exit_, entry = col("exit", str), col("entry", str)
        self.by_channel, self.by_trail, self.by_target, self.by_time = (exit_ == x for x in ("channel", "atr_trail", "target_stop", "time_stop"))
        self.threshold = np.array([REGIMES[x["regime_indicator"]][1] if np.isnan(x["regime_threshold"]) else x["regime_threshold"] for x in p.to_dict("records")], float)
        self.aim = col("vol_target") / np.sqrt(account.per_year)
        self.stop_mult, self.target_mult, self.trail_mult = col("stop_mult"), col("target_mult"), col("trail_mult")
        self.max_hold, self.pull_mult, self.pull_bars = col("max_hold"), col("pullback_mult"), col("pullback_bars", int)
        self.vol_low, self.vol_high, self.risk, self.leverage = col("vol_low"), col("vol_high"), col("risk"), col("leverage")
        self.trend_only, self.range_only = (col("regime_filter", str) == x for x in ("trend_only", "range_only"))
        self.ranked, self.biased = col("vol_filter", bool), col("bias_filter", str) == "sma"
        self.longs, self.shorts = col("sides", str) != "short_only", col("sides", str) != "long_only"
        self.confirms, self.pulls = entry == "close_confirm", entry == "pullback"

    def size(self, x: Inputs, j: int, at: np.ndarray, logic: np.ndarray, atr: np.ndarray) -> np.ndarray:
        """Units of an entry at the price, under the logic, on what bar j showed; ``atr`` is the last usable range."""
        account, m = self.account, self.m
        base = self.funded if account.fixed else self.state["cash"]
        with np.errstate(divide="ignore", invalid="ignore"):
            by_vol = base * self.aim / (x.at("vol", j) * account.point_value * (1.0 if account.margin > 0 else np.abs(at)))
            qty = np.where(self.aim > 0, by_vol, base * self.risk / (self.stop_mult * atr * account.point_value))
            qty = qty * np.fmax(x.at("direction", j) * np.where(logic, 1.0, -1.0), 0.0)
            one = np.full(m, account.margin) if account.margin > 0 else account.point_value * np.abs(at)
            qty = np.where(one > 0, np.fmin(qty, self.leverage * base / one), 0.0)
        return np.floor(qty) if account.whole_units else qty

    def say(self, bar: int, kind: int, who: np.ndarray, way, detail, level, qty=0.0, aux=0.0) -> None:
        if self.log and who.any():
            at = np.flatnonzero(who)
            pick = lambda v: np.broadcast_to(np.asarray(v, float), (self.m,))[at]
            self.events.append((np.full(len(at), bar), np.full(len(at), len(self.events)), at, np.full(len(at), kind), *(pick(v) for v in (way, detail, level, qty, aux))))

    def leave(self, bar: int, who: np.ndarray, at, why: np.ndarray) -> None:
        if not who.any():
            return
        v, account = self.state, self.account
        at = np.broadcast_to(np.asarray(at, float), (self.m,))
        gross = v["side"] * v["units"] * account.point_value * (at - v["entry"])
        cost = account.cost_rate * v["units"] * account.point_value * np.abs(at) + account.cost_per_unit * v["units"]
        pnl = gross - cost - v["paid"]
        v["cash"] = np.where(who, v["cash"] + gross - cost, v["cash"])
        k = np.flatnonzero(who)
        self.closed.append((k, v["since"][k], np.full(len(k), bar), v["side"][k], v["entry"][k], at[k], v["units"][k], pnl[k], (v["paid"] + cost)[k], why[k]))
        self.say(bar, 11, who, v["side"], why, at, v["units"], pnl)
        v["side"], v["units"] = np.where(who, 0.0, v["side"]), np.where(who, 0.0, v["units"])

    def pay_rolls(self, x: Inputs, bar: int, who: np.ndarray) -> None:
        v, account = self.state, self.account
        roll = x.price("roll", bar)
        who = who & (roll > 0)
        if account.roll_cost > 0 and who.any():
            due = account.roll_cost * v["units"] * roll
            v["cash"], v["paid"] = np.where(who, v["cash"] - due, v["cash"]), np.where(who, v["paid"] + due, v["paid"])
            self.say(bar, 12, who, v["side"], 0, x.price("close", bar), v["units"], due)

    def _bury(self, bar: int, close) -> None:
        """Accounts that a bar leaves without equity are closed at its close; what is left, a deficit too, stays."""
        v = self.state
        dead = ~v["ruined"] & (v["equity"] <= 0)
        if dead.any():
            self.leave(bar, dead & (v["side"] != 0), close, np.full(self.m, 6))
            v["equity"] = np.where(dead, v["cash"], v["equity"])
            v["resting"] = v["resting"] & ~dead
            v["ruined"] = v["ruined"] | dead

    def step(self, x: Inputs, i: int, first) -> np.ndarray:
        """Over bar i, to the equity at its close; returns which lanes entered. ``first``: bar from which a lane trades."""
        j, v, m, account = i - 1, self.state, self.m, self.account
        o, h, l, c, cj = x.price("open", i), x.price("high", i), x.price("low", i), x.price("close", i), x.price("close", j)  # noqa: E741
        upper, lower, upper_x, lower_x, mid_x, atr, regime, rank, bias, vol, direction = (x.at(name, j) for name in Inputs.NAMES)
        none = np.zeros(m, int)
        ready, ruined, say = x.ready[j], v["ruined"], self.say
        by_channel, by_trail, by_target, by_time = self.by_channel, self.by_trail, self.by_target, self.by_time
        usable = ready & (atr > 0) & ~ruined
        a = v["last_atr"] = np.where(usable, atr, v["last_atr"])
        sized = usable & ((self.aim <= 0) | (vol > 0))
        trending = direction > 0

        # exits
        held = (v["side"] != 0) & ~ruined
        late = held & by_time & (i - v["since"] >= self.max_hold)
        say(i, 10, late, v["side"], 0, o, v["units"])
        rest = held & ~late
        level, why, kind = v["stop"].copy(), none.copy(), none.copy()
        chandelier = v["extreme"] - v["side"] * self.trail_mult * a
        nearer = rest & by_trail & (v["side"] * (chandelier - level) > 0)
        level, kind = np.where(nearer, chandelier, level), np.where(nearer, 2, kind)
        opposite = np.where(v["side"] > 0, lower_x, upper_x)
        nearer = rest & by_channel & v["follows"] & (v["side"] * (opposite - level) > 0)
        level, kind, why = np.where(nearer, opposite, level), np.where(nearer, 1, kind), np.where(nearer, 1, why)
        aims = rest & (by_target | (by_channel & ~v["follows"]))
        goal, goal_why = np.where(by_target, v["target"], mid_x), np.where(by_target, 3, 2)
        say(i, 8, rest, v["side"], kind, level, v["units"])
        say(i, 9, aims, v["side"], 0, goal, v["units"])
        gapped = rest & (v["side"] * (o - level) <= 0)
        gained = aims & ~gapped & (v["side"] * (o - goal) >= 0)
        struck = rest & ~gapped & ~gained & np.where(v["side"] > 0, l <= level, h >= level)
        reached = aims & ~gapped & ~gained & ~struck & np.where(v["side"] > 0, h >= goal, l <= goal)
        out = late | gapped | gained | struck | reached
        at = np.where(struck, level, np.where(reached, goal, o))
        why = np.where(late, 4, np.where(gained | reached, goal_why, why))
        self.leave(i, out, at, why)
        stays = held & ~out & by_trail
        v["extreme"] = np.where(stays, np.where(v["side"] > 0, np.fmax(v["extreme"], h), np.fmin(v["extreme"], l)), v["extreme"])

        # lanes without usable values only manage what is open
        on = ~ruined & ~out
        idle = on & (~sized | (i < first))
        say(i, 5, idle & v["resting"], v["rest_side"], i >= first, v["rest_level"])
        v["resting"] &= ~idle
        self.pay_rolls(x, i, idle & (v["side"] != 0))
        go = on & ~idle
        allowed = np.where(self.trend_only, regime >= self.threshold, np.where(self.range_only, regime < self.threshold, True))
        allowed &= ~self.ranked | ((rank >= self.vol_low) & (rank <= self.vol_high))
        up_ok, down_ok = self.longs & (~self.biased | (cj > bias)), self.shorts & (~self.biased | (cj < bias))

        # resting pullbacks
        wait = go & (v["side"] == 0) & v["resting"]
        say(i, 3, wait, v["rest_side"], v["until"], v["rest_level"])
        filled_now = wait & np.where(v["rest_side"] > 0, l <= v["rest_level"], h >= v["rest_level"])
        take = np.where(filled_now, v["rest_side"], 0.0)
        at = np.where(v["rest_side"] > 0, np.fmin(o, v["rest_level"]), np.fmax(o, v["rest_level"]))
        logic, order = np.where(filled_now, v["rest_trend"], trending), np.where(filled_now, 3, 0)
        lapsed = wait & ~filled_now & (i >= v["until"])
        v["resting"] &= ~(filled_now | lapsed)
        say(i, 4, lapsed, v["rest_side"], v["until"], v["rest_level"])

        # new signals
        new = go & (v["side"] == 0) & ~filled_now & ~v["resting"] & allowed
        known = i >= 2 and x.ready[i - 2]
        rose = np.where(self.confirms, known & (cj > x.at("upper", i - 2)), h >= upper)
        fell = np.where(self.confirms, known & (cj < x.at("lower", i - 2)), l <= lower)
        high_at, low_at = np.where(self.confirms, o, upper), np.where(self.confirms, o, lower)
        watched = np.where(self.pulls, 3, np.where(trending, 1, 2))
        say(i, 0, new & ~self.confirms & up_ok, 1, watched, np.where(trending, high_at, low_at))
        say(i, 0, new & ~self.confirms & down_ok, -1, watched, np.where(trending, low_at, high_at))
        rose_first = ~self.confirms & (o >= high_at) & (o > low_at)
        fell_first = ~self.confirms & (o <= low_at) & (o < high_at)
        buys = new & up_ok & np.where(trending, rose & ~(fell_first & fell & down_ok), fell & ~(rose_first & rose & down_ok))
        sells = new & ~buys & down_ok & np.where(trending, fell, rose)
        turn = np.where(buys, 1.0, np.where(sells, -1.0, 0.0))
        mark = np.where(np.where(trending, buys, sells), high_at, low_at)
        say(i, 1, (turn != 0) & self.confirms, turn, 4, o)
        runs_through = np.where(turn > 0, np.fmax(o, mark), np.fmin(o, mark))
        comes_back = np.where(turn > 0, np.fmin(o, mark), np.fmax(o, mark))
        direct = (turn != 0) & ~self.pulls
        take = np.where(direct, turn, take)
        at = np.where(direct, np.where(self.confirms, o, np.where(trending, runs_through, comes_back)), at)
        order = np.where(direct, np.where(self.confirms, 4, np.where(trending, 1, 2)), order)
        placed = (turn != 0) & self.pulls
        v["resting"] |= placed
        v["rest_side"], v["rest_trend"] = np.where(placed, turn, v["rest_side"]), np.where(placed, trending, v["rest_trend"])
        v["rest_level"], v["until"] = np.where(placed, mark - turn * self.pull_mult * a, v["rest_level"]), np.where(placed, i + self.pull_bars, v["until"])
        say(i, 2, placed, turn, v["until"], v["rest_level"])

        # sizes
        opens = take != 0
        reach = self.stop_mult * a
        qty = self.size(x, j, at, logic, a)
        say(i, 7, opens & ~(qty > 0), take, order, at, qty)
        opens &= qty > 0
        fee = account.cost_rate * qty * account.point_value * np.abs(at) + account.cost_per_unit * qty
        v["cash"] = np.where(opens, v["cash"] - fee, v["cash"])
        for name, value in (("side", take), ("units", qty), ("paid", fee), ("entry", at)):
            v[name] = np.where(opens, value, v[name])
        v["stop"], v["target"] = np.where(opens, at - take * reach, v["stop"]), np.where(opens, at + take * self.target_mult * a, v["target"])
        v["extreme"], v["since"], v["follows"] = np.where(opens, at, v["extreme"]), np.where(opens, i, v["since"]), np.where(opens, logic, v["follows"])
        say(i, 6, opens, take, order, at, qty, v["stop"])

        # the entry bar's own stop and target
        if opens.any():
            level, why, kind = v["stop"].copy(), none + 5, none.copy()
            chandelier = at - v["side"] * self.trail_mult * a
            nearer = opens & by_trail & (v["side"] * (chandelier - level) > 0)
            level, kind = np.where(nearer, chandelier, level), np.where(nearer, 2, kind)
            opposite = np.where(v["side"] > 0, lower_x, upper_x)
            nearer = opens & by_channel & v["follows"] & (v["side"] * (opposite - level) > 0)
            level, kind, why = np.where(nearer, opposite, level), np.where(nearer, 1, kind), np.where(nearer, 1, why)
            aims = opens & (by_target | (by_channel & ~v["follows"]))
            goal = np.where(by_target, v["target"], mid_x)
            say(i, 8, opens, v["side"], kind, level, v["units"])
            say(i, 9, aims, v["side"], 0, goal, v["units"])
            aims &= (at == o) | (order == 1)
            through = opens & (v["side"] * (at - level) <= 0)
            beyond = aims & ~through & (v["side"] * (at - goal) >= 0)
            struck = opens & ~through & ~beyond & np.where(v["side"] > 0, l <= level, h >= level)
            reached = aims & ~through & ~beyond & ~struck & np.where(v["side"] > 0, h >= goal, l <= goal)
            why = np.where(beyond | reached, np.where(by_target, 3, 2), why)
            self.leave(i, through | beyond | struck | reached, np.where(struck, level, np.where(reached, goal, at)), why)
            kept = opens & (v["side"] != 0) & by_trail
            v["extreme"] = np.where(kept, np.where(v["side"] > 0, np.fmax(v["extreme"], h), np.fmin(v["extreme"], l)), v["extreme"])
        self.pay_rolls(x, i, go & (v["side"] != 0))
        v["equity"] = v["cash"] + np.where(v["side"] != 0, v["side"] * v["units"] * account.point_value * (c - v["entry"]), 0.0)
        if not account.fixed:
            self._bury(i, c)
        return opens

    def copied(self, log: bool) -> Lanes:
        """The same accounts at the same bar, apart from these."""
        out = Lanes(self.plans, self.account, log)
        out.state = {k: x.copy() for k, x in self.state.items()}
        return out

    def trades(self) -> pd.DataFrame:
        names = ["lane", "entry_idx", "exit_idx", "side", "entry_price", "exit_price", "units", "pnl", "cost", "reason"]
        out = pd.DataFrame({k: np.concatenate([x[q] for x in self.closed]) if self.closed else np.zeros(0) for q, k in enumerate(names)})
        return out.sort_values(["lane", "exit_idx", "entry_idx"], kind="stable").reset_index(drop=True)

    def orders(self) -> pd.DataFrame:
        names = ["bar_idx", "seq", "lane", "kind", "side", "detail", "level", "qty", "aux"]
        out = pd.DataFrame({k: np.concatenate([x[q] for x in self.events]) if self.events else np.zeros(0) for q, k in enumerate(names)})
        return out.sort_values(["lane", "seq"], kind="stable").reset_index(drop=True)


def simulate(bars: pd.DataFrame, plans: pd.DataFrame, account: Account = Account(), first: int = 0, log: bool = False) -> Run:
    """Run every plan (a row of PLAN columns) over ordered bars (open, high, low, close, and roll where rolls cost)."""
    return side_by_side([bars], plans, np.zeros(len(plans), int), account, [first], log)[0]


def side_by_side(series: list[pd.DataFrame], plans: pd.DataFrame, of: np.ndarray, account: Account, firsts: list[int], log: bool = False) -> list[Run]:
    """The run of each series with its own plans (``of``: series of each plan), all stepped together; a series trades from its ``first`` on."""
    lanes = Lanes(plans, account, log)
    x = Inputs(series, lanes.plans, of, account)
    n, m = x.n, lanes.m
    first = np.array(firsts, int)[of] if m else np.zeros(0, int)
    whole = advanced(lanes, x, first, np.array([len(b) for b in series], int)[of] if m else first)
    return [whole] if len(series) == 1 else [_own(whole, np.flatnonzero(of == k), len(b)) for k, b in enumerate(series)]


def advanced(lanes: Lanes, x: Inputs, first: np.ndarray, end: np.ndarray, begin: int = 1) -> Run:
    """The lanes over bars ``begin`` and later of their inputs; equity and entries have every bar, those before ``begin`` as they stand."""
    n, m, account = x.n, lanes.m, lanes.account
    equity, entries = np.tile(lanes.state["equity"], (n, 1)), np.zeros((n, m), np.int8)
    gross, net = np.zeros(m), np.zeros(m)
    with np.errstate(invalid="ignore"):
        for i in range(begin, n):
            entries[i] = lanes.step(x, i, first)
            equity[i] = lanes.state["equity"]
            held = np.flatnonzero((lanes.state["side"] != 0) & (i >= first) & (i < end) & (equity[i] > 0))
            if len(held):
                one = account.margin if account.margin > 0 else np.abs(np.broadcast_to(x.price("close", i), (m,))[held]) * account.point_value
                share = lanes.state["units"][held] * one / equity[i, held]
                gross[held] += share
                net[held] += share * lanes.state["side"][held]
    v = lanes.state
    last = v["last_atr"]
    if n:
        last = np.where(x.ready[n - 1] & (x.at("atr", n - 1) > 0) & ~v["ruined"], x.at("atr", n - 1), last)
    after = x.at("direction", n - 1) > 0 if n else np.ones(m, bool)
    trades, orders = lanes.trades(), lanes.orders() if lanes.log else None

    def size(at: np.ndarray, logic: np.ndarray) -> np.ndarray:
        return lanes.size(x, n - 1, at, logic, last)

    return Run(equity, entries, trades, orders, v["side"], v["units"], v["entry"], v["since"], v["stop"], v["target"], last, after, size, lanes.funded, gross, net)


def _own(run: Run, lanes: np.ndarray, n: int) -> Run:
    """The part of a run that some lanes made in their first n bars; a trade that ends later is open."""
    place = np.full(len(run.position), -1)
    place[lanes] = np.arange(len(lanes))
    t = run.trades[(place[run.trades["lane"].to_numpy(int)] >= 0) & (run.trades["entry_idx"] < n)]
    late = t[t["exit_idx"] >= n]
    pick = lambda x: x[lanes].copy()
    position, units, entry, since = (pick(x) for x in (run.position, run.units, run.entry_price, run.since))
    gone = since >= n
    position[gone], units[gone] = 0.0, 0.0
    k = place[late["lane"].to_numpy(int)]
    position[k], units[k], entry[k], since[k] = (late[c].to_numpy(float) for c in ("side", "units", "entry_price", "entry_idx"))
    own = lambda d: d.assign(lane=place[d["lane"].to_numpy(int)]).reset_index(drop=True)
    orders = run.orders
    if orders is not None:
        orders = own(orders[(place[orders["lane"].to_numpy(int)] >= 0) & (orders["bar_idx"] < n)])
    return Run(run.equity[:n, lanes], run.entries[:n, lanes], own(t[t["exit_idx"] < n]), orders, position, units, entry, since.astype(int), pick(run.stop), pick(run.target), pick(run.last_atr), pick(run.trending), run.size, pick(run.funded), pick(run.gross), pick(run.net))


SCHEMAS = {
    "totals": "final double, total_return double, sharpe double, max_dd double, n_trades long, n_wins long, gain double, loss double, held long, n_bars long, gross double, net double",
    "bars": "bar_idx long, ret double, equity double, entered boolean, exited boolean, pnl double",
    "trades": "trade_no long, entry_idx long, exit_idx long, side int, entry_price double, exit_price double, units double, pnl double, cost double, reason string",
    "all_trades": "entry_idx long, exit_idx long, side int, entry_price double, exit_price double, units double, pnl double, cost double, reason string, closed boolean",
    "states": "position int, units double, entry_price double, entry_idx long, stop double, target double, atr double, equity double, unrealized double",
    "blocked": "reason string, value double, low double, high double",
    "next_orders": "kind string, side int, level double, shares double, detail_text string",
    "orders": "bar_idx long, seq long, kind string, side int, detail int, detail_text string, level double, qty double, aux double",
}


def _totals(run: Run, account: Account, first: int, ids: np.ndarray) -> pd.DataFrame:
    """One row a lane, over the bars from ``first`` on (at 0 the first bar only funds the account)."""
    lanes = np.arange(len(ids))
    equity, rets = run.equity[first:], run.returns(account)[max(first, 1) :]
    t = run.trades
    win = t["pnl"].to_numpy(float) > 0 if len(t) else np.zeros(0, bool)
    lane = t["lane"].to_numpy(int)
    add = lambda v: np.bincount(lane, weights=v, minlength=len(ids)) if len(t) else np.zeros(len(ids))
    top = np.maximum.accumulate(np.vstack([run.funded, equity]), axis=0)[1:]
    spread = rets.std(axis=0, ddof=1) if len(rets) > 1 else np.zeros(len(ids))
    mean = rets.mean(axis=0) if len(rets) else np.zeros(len(ids))
    last = equity[-1] if len(equity) else run.funded
    held = add((t["exit_idx"] - t["entry_idx"]).to_numpy(float)) if len(t) else np.zeros(len(ids))
    open_since = np.where(run.position != 0, len(run.equity) - 1 - run.since, 0)
    return pd.DataFrame({
        "trial_id": ids[lanes], "final": last, "total_return": np.where(run.funded > 0, last / np.where(run.funded > 0, run.funded, 1) - 1, 0.0),
        "sharpe": np.where(spread > 0, mean / np.where(spread > 0, spread, 1), 0.0) * np.sqrt(account.per_year),
        "max_dd": (equity / top - 1).min(axis=0) if len(equity) else np.zeros(len(ids)), "n_trades": add(np.ones(len(t))).astype(int), "n_wins": add(win.astype(float)).astype(int),
        "gain": add(np.where(win, t["pnl"], 0.0)), "loss": add(np.where(win, 0.0, -t["pnl"].to_numpy(float))),
        "held": (held + open_since).astype(int), "n_bars": len(equity), "gross": run.gross / max(1, len(equity)), "net": run.net / max(1, len(equity)),
    })


def _frame(output: str, run: Run, account: Account, first: int, ids: np.ndarray, places: np.ndarray, bars: pd.DataFrame) -> pd.DataFrame:
    """``places``: bar_idx of each row that was simulated; what lies before ``first`` is left out."""
    if output == "totals":
        return _totals(run, account, first, ids)
    if output == "bars":
        rets, n, t = run.returns(account), len(run.equity), run.trades
        pnl, gone = np.zeros(run.equity.shape), np.zeros(run.equity.shape, bool)
        if len(t):
            at = (t["exit_idx"].to_numpy(int), t["lane"].to_numpy(int))
            np.add.at(pnl, at, t["pnl"].to_numpy(float))
            gone[at] = True
        own = lambda x: x[first:].T.reshape(-1)
        return pd.DataFrame({
            "trial_id": np.repeat(ids, n - first), "bar_idx": np.tile(places[first:], len(ids)), "ret": own(rets), "equity": own(run.equity),
            "entered": own(run.entries > 0), "exited": own(gone), "pnl": own(pnl),
        })
    if output == "all_trades":
        done = _frame("trades", run, account, first, ids, places, bars).drop(columns="trade_no").assign(closed=True)
        k = np.flatnonzero(run.position != 0)
        close = bars["close"].to_numpy(float)[-1] if len(bars) else np.nan
        open_ = pd.DataFrame({
            "trial_id": ids[k], "entry_idx": places[run.since[k]], "exit_idx": np.full(len(k), np.nan), "side": run.position[k].astype(int), "entry_price": run.entry_price[k],
            "exit_price": np.full(len(k), np.nan), "units": run.units[k], "pnl": run.position[k] * run.units[k] * account.point_value * (close - run.entry_price[k]),
            "cost": np.full(len(k), np.nan), "reason": "open_at_window_end", "closed": False,
        })
        out = pd.concat([x for x in (done, open_) if len(x)], ignore_index=True) if len(done) or len(open_) else done
        return out.astype({"exit_idx": "Int64"})
    if output == "trades":
        t = run.trades
        lane = t["lane"].to_numpy(int)
        return pd.DataFrame({
            "trial_id": ids[lane], "trade_no": t.groupby("lane").cumcount().to_numpy(int) if len(t) else np.zeros(0, int),
            "entry_idx": places[t["entry_idx"].to_numpy(int)], "exit_idx": places[t["exit_idx"].to_numpy(int)], "side": t["side"].to_numpy(int),
            **{k: t[k].to_numpy(float) for k in ("entry_price", "exit_price", "units", "pnl", "cost")}, "reason": np.array(REASONS)[t["reason"].to_numpy(int)],
        })
    if output == "states":
        held, last = run.position != 0, places[-1] if len(places) else -1
        only = lambda x: np.where(held, x, np.nan)
        close = bars["close"].to_numpy(float)[-1]
        return pd.DataFrame({
            "trial_id": ids, "position": run.position.astype(int), "units": run.units, "entry_price": only(run.entry_price),
            "entry_idx": np.where(held, places[np.maximum(run.since, 0)], last), "stop": only(run.stop), "target": only(run.target), "atr": run.last_atr,
            "equity": run.equity[-1], "unrealized": run.position * run.units * account.point_value * (close - np.where(held, run.entry_price, close)),
        })
    e = run.orders
    kind, detail = e["kind"].to_numpy(int), e["detail"].to_numpy(int)
    text = np.full(len(e), "", dtype=object)
    for kinds, table in (((0, 1, 6, 7), ORDER_TYPES), ((8,), STOP_KINDS), ((11,), REASONS), ((5,), ("warm-up", "indicators"))):
        some = np.isin(kind, kinds)
        text[some] = np.array(table, dtype=object)[detail[some]]
    return pd.DataFrame({
        "trial_id": ids[e["lane"].to_numpy(int)], "bar_idx": places[e["bar_idx"].to_numpy(int)], "seq": e.groupby("lane").cumcount().to_numpy(int) if len(e) else np.zeros(0, int),
        "kind": np.array(KINDS, dtype=object)[kind], "side": e["side"].to_numpy(int), "detail": detail, "detail_text": text,
        **{k: e[k].to_numpy(float) for k in ("level", "qty", "aux")},
    })


def next_orders(bars: pd.DataFrame, plans: pd.DataFrame, account: Account, first: int, ids: np.ndarray) -> pd.DataFrame:
    """The orders that work on the bar after the last."""
    lanes, of = Lanes(plans, account), np.zeros(len(plans), int)
    firsts = np.full(lanes.m, first)
    run = advanced(lanes, Inputs([bars], lanes.plans, of, account), firsts, np.full(lanes.m, len(bars)))
    return working(lanes, run, bars, firsts, ids)


def blocked(bars: pd.DataFrame, plans: pd.DataFrame, account: Account, ids: np.ndarray) -> pd.DataFrame:
    """Which filters bar entries on the bar after the last: the value that was read and the bounds it is outside of."""
    lanes = Lanes(plans, account)
    n, out = len(bars), []
    if not n:
        return pd.DataFrame({"trial_id": ids, "reason": "not_formed", "value": np.nan, "low": np.nan, "high": np.nan})
    x = Inputs([bars], lanes.plans, np.zeros(lanes.m, int), account)
    vol, atr, regime, rank = (x.at(c, n - 1) for c in ("vol", "atr", "regime", "rank"))
    formed = x.ready[n - 1] & (atr > 0) & ((lanes.aim <= 0) | (vol > 0))
    low = np.where(lanes.trend_only, lanes.threshold, -np.inf)
    high = np.where(lanes.range_only, lanes.threshold, np.inf)
    tests = [
        ("not_formed", ~formed, np.full(lanes.m, np.nan), np.full(lanes.m, np.nan), np.full(lanes.m, np.nan)),
        ("regime", formed & (lanes.trend_only & ~(regime >= low) | lanes.range_only & (regime >= high)), regime, low, high),
        ("volatility", formed & lanes.ranked & ~((rank >= lanes.vol_low) & (rank <= lanes.vol_high)), rank, lanes.vol_low, lanes.vol_high),
    ]
    for reason, who, value, a, b in tests:
        k = np.flatnonzero(who)
        out.append(pd.DataFrame({"trial_id": ids[k], "reason": reason, "value": value[k], "low": a[k], "high": b[k]}))
    return pd.concat([t for t in out if len(t)] or out[:1], ignore_index=True)


def working(lanes: Lanes, run: Run, bars: pd.DataFrame, first: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """What lanes that stand after ``bars`` have working on a bar whose prices are not known yet; the lanes stay as they are."""
    unknown = pd.DataFrame({c: [np.nan] for c in ("open", "high", "low", "close")})
    after = lanes.copied(log=True)
    with np.errstate(invalid="ignore"):
        after.step(Inputs([pd.concat([bars, unknown], ignore_index=True)], lanes.plans, np.zeros(lanes.m, int), lanes.account), len(bars), first)
    e = after.orders()
    e = e[e["kind"].isin([0, 1, 3, 8, 9, 10])]
    lane, kind = e["lane"].to_numpy(int), e["kind"].to_numpy(int)
    level = e["level"].to_numpy(float)
    names = {0: "entry", 1: "market_on_open", 3: "limit", 8: "stop", 9: "target", 10: "exit_on_open"}
    name = np.array([names[k] for k in kind], dtype=object)
    entry_type = np.where(kind == 0, e["detail"].to_numpy(int), 0)
    name = np.where(kind == 0, np.array(ORDER_TYPES, dtype=object)[entry_type], name)
    close = bars["close"].to_numpy(float)[-1] if len(bars) else np.nan
    shares = run.units[lane]
    for k in np.flatnonzero(np.isin(kind, (0, 1, 3))):
        at, logic = np.full(len(ids), close if np.isnan(level[k]) else level[k]), run.trending
        shares[k] = run.size(at, logic)[lane[k]]
    text = np.where(kind == 8, np.array(STOP_KINDS, dtype=object)[np.where(kind == 8, e["detail"].to_numpy(int), 0)], "")
    side = np.where(np.isin(kind, (8, 9, 10)), -e["side"].to_numpy(int), e["side"].to_numpy(int))
    return pd.DataFrame({"trial_id": ids[lane], "kind": name, "side": side, "level": level, "shares": shares, "detail_text": text})


def _run_group(output: str, b: pd.DataFrame, p: pd.DataFrame, account: Account, first: int) -> pd.DataFrame:
    ids = p["trial_id"].to_numpy(int)
    if output == "next_orders":
        return next_orders(b.reset_index(drop=True), p, account, first, ids)
    if output == "blocked":
        return blocked(b.reset_index(drop=True), p, account, ids)
    return _frame(output, simulate(b, p, account, first, output == "orders"), account, first, ids, b["bar_idx"].to_numpy(int), b)


BAR_COLUMNS = ["bar_idx", "open", "high", "low", "close"]


def _bar_columns(bars: DataFrame) -> list[str]:
    return BAR_COLUMNS + [c for c in ("roll", "learned", "upper", "lower", "upper_x", "lower_x", "mid_x") if c in bars.columns]


def _lanes_for(n_bars: int, room: int = ROOM) -> int:
    """Trials to a group whose series have so many bars: LANES, or fewer where bars times lanes would leave ``room``."""
    return int(max(1, min(LANES, room // max(1, n_bars))))


def _arrow(kind: str, run: Callable) -> tuple[Callable, str]:
    """A kernel of pandas frames as one of Arrow tables, and its schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(kind))

    def kernel(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        got = run(tuple(k.as_py() for k in key), left.to_pandas(), right.to_pandas())
        return pa.Table.from_pandas(got[schema.names], schema, preserve_index=False) if len(got) else schema.empty_table()

    return kernel, kind


def simulated(bars: DataFrame, plans: DataFrame, output: str = "totals", account: Account = Account(), first: int = 0) -> DataFrame:
    """asset, trial_id and the SCHEMAS columns of ``output`` for each asset and plan (trial_id and PLAN columns).

    A group is one asset and a share of the plans: LANES, or fewer where the longest series would make bars times lanes larger
    than ROOM. The plan table is small, the bars are not.
    """
    longest = bars.groupBy("asset").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    shares = max(1, -(-plans.count() // _lanes_for(longest)))
    dealt = plans.withColumn("share", F.pmod(F.xxhash64("trial_id"), F.lit(shares)))
    own = bars.select("asset").distinct().join(F.broadcast(dealt.select("share").distinct()))
    left = bars.select("asset", *_bar_columns(bars)).join(own, "asset")
    right = own.select(F.col("asset").alias("_a"), F.col("share").alias("_s")).join(dealt, F.col("_s") == F.col("share")).drop("share")

    def run(key: tuple, b: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        got = _run_group(output, b.sort_values("bar_idx"), p.sort_values("trial_id"), account, first)
        got.insert(0, "asset", key[0])
        return got

    kernel, schema = _arrow(f"asset string, trial_id int, {SCHEMAS[output]}", run)
    return left.groupBy("asset", "share").cogroup(right.groupBy("_a", "_s")).applyInArrow(kernel, schema)


def windowed(bars: DataFrame, spans: DataFrame, plans: DataFrame, warm: int, output: str = "totals", account: Account = Account()) -> DataFrame:
    """The same within each span (asset, window_id, start, stop) of bars, warmed up on ``warm`` bars before it and flat at its start.

    ``plans`` name trials of every window, or of one if they have asset and window_id. Windows that follow each other form a
    group of some hundred lanes, stepped side by side: a bar costs about the same for one lane or hundreds. Groups meet their
    bars by blocks of bars, an equality, so a bar goes to the few groups that hold it and to no other.
    """
    own = "window_id" in plans.columns
    per_window = plans.groupBy("asset", "window_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")) if own else plans.agg(F.count(F.lit(1)).alias("n"))
    size = spans.agg(F.max(F.col("stop") - F.col("start")).alias("n")).first()["n"] or 1
    n_plans = per_window.first()["n"] or 1
    lanes = _lanes_for(size + warm)
    wide = max(1, lanes // n_plans)  # windows to a group
    shares = max(1, -(-n_plans // lanes))
    grouped = spans.withColumn("pack", F.floor(F.col("window_id") / wide).cast("long"))
    bounds = grouped.groupBy("asset", "pack").agg(F.greatest(F.lit(0).cast("long"), F.min("start") - warm).alias("_low"), F.max("stop").alias("_high"))
    block = int(size + warm)
    cells = bounds.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_low") / block), F.floor((F.col("_high") - 1) / block))))
    held = bars.select("asset", *_bar_columns(bars)).withColumn("_b", F.floor(F.col("bar_idx") / block))
    held = held.join(cells, ["asset", "_b"]).filter("bar_idx >= _low AND bar_idx < _high").drop("_b", "_low", "_high")
    if own:
        dealt, left = plans.join(grouped, ["asset", "window_id"]).withColumn("share", F.lit(0).cast("long")), held.withColumn("share", F.lit(0).cast("long"))
    else:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))
        share = F.pmod(F.xxhash64("trial_id"), F.lit(shares)).cast("long")
        dealt = grouped.withColumn("share", every).join(F.broadcast(plans.withColumn("share", share)), "share")
        left = held.withColumn("share", every)
    right = dealt.withColumnsRenamed({"asset": "_a", "pack": "_p", "share": "_s"})

    def run(key: tuple, b: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        b, p = b.sort_values("bar_idx").reset_index(drop=True), p.sort_values(["window_id", "trial_id"]).reset_index(drop=True)
        at = b["bar_idx"].to_numpy()
        windows = p.drop_duplicates("window_id")
        low, start, high = (np.searchsorted(at, windows[c].to_numpy() - d) for c, d in (("start", warm), ("start", 0), ("stop", 0)))
        series = [b.iloc[x:y].reset_index(drop=True) for x, y in zip(low, high, strict=True)]
        of = np.searchsorted(windows["window_id"].to_numpy(), p["window_id"].to_numpy())
        firsts = (start - low).tolist()
        last = output in ("next_orders", "blocked")  # what is read after a span's last bar: a series at a time
        runs = [None] * len(series) if last else side_by_side(series, p, of, account, firsts, output == "orders")
        parts = []
        for k, (own_run, s) in enumerate(zip(runs, series, strict=True)):
            if last:
                got = _run_group(output, s, p[of == k].reset_index(drop=True), account, firsts[k])
            else:
                got = _frame(output, own_run, account, firsts[k], p["trial_id"].to_numpy(int)[of == k], s["bar_idx"].to_numpy(int), s)
            got.insert(0, "asset", key[0])
            got.insert(1, "window_id", int(windows["window_id"].iloc[k]))
            parts.append(got)
        return pd.concat(parts, ignore_index=True)

    kernel, schema = _arrow(f"asset string, window_id long, trial_id int, {SCHEMAS[output]}", run)
    return left.groupBy("asset", "pack", "share").cogroup(right.groupBy("_a", "_p", "_s")).applyInArrow(kernel, schema)
