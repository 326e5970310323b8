"""Live slots: the accounts of plans over a stream of closed bars, one state for each asset.

A micro-batch takes every account over its new bars with the very ``step`` of the batch simulation, on indicators of the
bars the state holds, so a stream gives the trades, orders and states of a batch over the same bars, bit for bit and after any
restart. Bars arrive closed and once (``streamed_bars``); one that is not later than the last one of its asset is late and
ignored.

The state of an asset is its accounts and its bars since ``warm`` bars before the plans took effect. New plans come with a new
``version``: the accounts start flat on the next bar, as a walk-forward window does, and all but ``warm`` bars are let go, so a
state is as large as what lies between two fits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators import simulation

#: What a stream can return, by new bar, new event or as it stands after a micro-batch.
OUTPUTS = ("bars", "trades", "orders", "states", "next_orders")
_STATE = "version string, n_seen long, last timestamp, held binary"


class Slots:
    """The accounts of one asset between two bars."""

    def __init__(self, plans: pd.DataFrame, account: simulation.Account, first: int):
        self.plans, self.account = plans, account
        self.bars = pd.DataFrame({c: np.zeros(0) for c in ("open", "high", "low", "close", "roll")})
        self.place = np.zeros(0, np.int64)  #: number of each held bar in the whole stream
        self.first = first
        self.values: dict[str, np.ndarray] | None = None
        self.n_trades, self.n_events = (np.zeros(len(plans), np.int64) for _ in range(2))

    def refitted(self, plans: pd.DataFrame, warm: int) -> Slots:
        """Other plans from the next bar on, flat."""
        new = Slots(plans, self.account, min(warm, len(self.bars)))
        new.bars, new.place = self.bars.iloc[len(self.bars) - new.first :].reset_index(drop=True), self.place[len(self.place) - new.first :]
        return new

    def update(self, bars: pd.DataFrame, place: np.ndarray, output: str) -> pd.DataFrame:
        """Over new bars, in order; the rows of ``output`` that they bring."""
        done = len(self.bars)
        own = bars.reindex(columns=self.bars.columns).astype(float)
        self.bars = own.reset_index(drop=True) if not done else pd.concat([self.bars, own], ignore_index=True)
        self.place = np.append(self.place, place)
        lanes = simulation.Lanes(self.plans, self.account, output == "orders")
        if self.values is not None:
            lanes.state = self.values
        x = simulation.Inputs([self.bars], lanes.plans, np.zeros(lanes.m, int), self.account)
        first, ids = np.full(lanes.m, self.first), self.plans["trial_id"].to_numpy(int)
        run = simulation.advanced(lanes, x, first, np.full(lanes.m, x.n), max(1, done))
        self.values = {k: v.copy() for k, v in lanes.state.items()}
        if output == "next_orders":
            return simulation.working(lanes, run, self.bars, first, ids)
        if output == "bars":
            return self._bars(run, min(x.n, max(done, self.first)), ids)
        got = simulation._frame(output, run, self.account, 0, ids, self.place, self.bars)
        if output in ("trades", "orders"):
            column, counted = ("trade_no", self.n_trades) if output == "trades" else ("seq", self.n_events)
            of = np.searchsorted(ids, got["trial_id"].to_numpy())
            got[column] = got[column].to_numpy() + counted[of]
            counted += np.bincount(of, minlength=len(ids))
        return got

    def _bars(self, run: simulation.Run, begin: int, ids: np.ndarray) -> pd.DataFrame:
        n = len(run.equity)
        now = run.equity[begin:]
        past = run.equity[np.maximum(np.arange(begin, n) - 1, 0)]
        if self.account.fixed:
            ret = (now - past) / run.funded
        else:
            ret = np.where(past > 0, now / np.where(past > 0, past, 1) - 1, 0.0)
        t, pnl, gone = run.trades, np.zeros(run.equity.shape), np.zeros(run.equity.shape, bool)
        if len(t):
            at = (t["exit_idx"].to_numpy(int), t["lane"].to_numpy(int))
            np.add.at(pnl, at, t["pnl"].to_numpy(float))
            gone[at] = True
        flat = lambda v: v.T.reshape(-1)
        return pd.DataFrame({
            "trial_id": np.repeat(ids, n - begin), "bar_idx": np.tile(self.place[begin:], len(ids)), "ret": flat(ret), "equity": flat(now),
            "entered": flat(run.entries[begin:] > 0), "exited": flat(gone[begin:]), "pnl": flat(pnl[begin:]),
        })


def streamed_slots(bars: DataFrame, plans: pd.DataFrame, account: simulation.Account = simulation.Account(), output: str = "trades", first: int = 0, warm: int = 0, version: str = "") -> DataFrame:
    """asset, trial_id and the columns of ``output`` from a stream of bars (asset, ts, open, high, low, close, and roll if it has one).

    ``plans`` is the table of slots, small, every asset's; ``first`` bars of a new asset only warm up. With another ``version``
    than a state was left with, its accounts start anew on the next bar, warmed on its last ``warm`` bars.
    """
    if output not in OUTPUTS:
        raise ValueError(f"no output {output}; there are {', '.join(OUTPUTS)}")
    plans = plans.sort_values("trial_id").reset_index(drop=True)
    schema = f"asset string, trial_id int, {simulation.SCHEMAS[output]}"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(frames)).drop_duplicates("ts", keep="last").sort_values("ts")
        seen, last = 0, None
        if state.exists:
            known, seen, last, held = state.get
            slots: Slots = pickle.loads(held)
            new = new[new["ts"] > last]
            if known != version:
                slots = slots.refitted(plans, warm)
        else:
            slots = Slots(plans, account, first)
        if len(new):
            got = slots.update(new, seen + np.arange(len(new)), output)
            state.update((version, seen + len(new), new["ts"].iloc[-1].to_pydatetime(), pickle.dumps(slots)))
            got.insert(0, "asset", key[0])
            yield got[names]

    held = bars.select("asset", "ts", *(c for c in ("open", "high", "low", "close", "roll") if c in bars.columns))
    return held.groupBy("asset").applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.NoTimeout)
