"""Plans that hold a level instead of working orders: the level known at a close is traded at the next open.

A level in [-1, 1] is a share of a full size. While it stays, nothing is traded; when it moves, the position is closed and
opened anew at the open, and the cost is of the units that change. There is no stop or target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from barloom.operators.simulation import Account, Formed

TOTALS = "asset string, final double, n_trades long, n_wins long, max_dd double, sharpe double, last_level double, units double"
TRADES = "asset string, entry_idx long, exit_idx long, side int, entry_price double, exit_price double, units double, pnl double, cost double, reason string"


def hold(bars: pd.DataFrame, level: np.ndarray, account: Account = Account(), first: int = 0, risk: float = 0.01, stop_mult: float = 3.0, atr_n: int = 20, leverage: float = 2.0, vol_target: float = 0.0, vol_target_n: int = 60) -> tuple[np.ndarray, list[tuple], float, float]:
    """Equity at each close, trades, and the level and units held at the end. ``level`` is NaN where it is not known yet: what is held stays."""
    o, c = bars["open"].to_numpy(float), bars["close"].to_numpy(float)
    n, f = len(c), Formed(bars, account.margin <= 0)
    atr, vol = f.get("atr", atr_n), f.get("vol", vol_target_n)
    roll = bars["roll"].fillna(0).to_numpy(float) if account.roll_cost > 0 and "roll" in bars else np.zeros(n)
    aim, pv = vol_target / np.sqrt(account.per_year), account.point_value
    equity, trades = np.full(n, account.equity), []
    cash, units, held, since, price, paid = account.equity, 0.0, 0.0, -1, 0.0, 0.0  # units are signed

    def cost(size: float, at: float) -> float:
        return account.cost_rate * abs(size) * pv * abs(at) + account.cost_per_unit * abs(size)

    def sized(want: float, j: int, at: float) -> float:
        if want == 0 or not atr[j] > 0 or (aim > 0 and not vol[j] > 0):
            return 0.0
        base = account.equity if account.fixed else cash
        one = vol[j] * pv * (1.0 if account.margin > 0 else abs(at)) if aim > 0 else stop_mult * atr[j] * pv / risk
        size = base * (aim if aim > 0 else 1.0) / one * abs(want)
        basis = account.margin if account.margin > 0 else pv * abs(at)
        size = min(size, leverage * base / basis) if basis > 0 and base > 0 else 0.0
        return float(np.sign(want)) * (np.floor(size) if account.whole_units else size)

    def leave(i: int, at: float, fee: float, why: str) -> None:
        trades.append((since, i, int(np.sign(units)), price, at, abs(units), units * pv * (at - price) - paid - fee, paid + fee, why))

    closed = False
    for i in range(1, n):
        if closed or (not account.fixed and equity[i - 1] <= 0):
            if not closed and units:
                fee = cost(units, c[i - 1])
                leave(i - 1, c[i - 1], fee, "ruin")
                cash, units, held = cash - fee, 0.0, 0.0
                equity[i - 1] = cash
            closed, equity[i] = True, cash
            continue
        cash += units * pv * (o[i] - c[i - 1])
        known = atr[i - 1] > 0 and not np.isnan(level[i - 1])
        want = 0.0 if i < first else float(level[i - 1]) if known else held
        if want != held:
            target = sized(want, i - 1, o[i])
            same = units * want > 0
            if same and target == units:
                held = want
            elif not (same and not account.fixed and cash <= 0):
                fee = cost(target - units if same and target else units, o[i]) if units else 0.0
                own = 0.0 if same and target else fee
                if units:
                    leave(i, o[i], own, "stance")
                opened = fee if same and target else cost(target, o[i]) if target else 0.0
                cash -= own + opened
                units, price, since, paid = target, o[i], i, opened
                held = want if target else 0.0
        cash += units * pv * (c[i] - o[i])
        if roll[i] > 0 and units:
            due = account.roll_cost * abs(units) * roll[i]
            cash, paid = cash - due, paid + due
        equity[i] = cash
    return equity, trades, held, units


def held_levels(rows: DataFrame, output: str = "totals", account: Account = Account(), **how: float) -> DataFrame:
    """Totals or trades of holding ``level`` for each asset of rows (asset, bar_idx, open, high, low, close, level)."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("bar_idx").reset_index(drop=True)
        equity, trades, level, units = hold(d, d["level"].to_numpy(float), account, **how)
        if output == "trades":
            out = pd.DataFrame(trades, columns=[x.split()[0] for x in TRADES.split(", ")[1:]])
            for k in ("entry_idx", "exit_idx"):
                out[k] = d["bar_idx"].to_numpy()[out[k].to_numpy(int)]
            out.insert(0, "asset", d["asset"].iloc[0])
            return out
        step = np.diff(equity)
        rets = step / account.equity if account.fixed else np.where(equity[:-1] > 0, step / np.where(equity[:-1] > 0, equity[:-1], 1), 0.0)
        spread = rets.std(ddof=1) if len(rets) > 1 else 0.0
        top = np.maximum.accumulate(np.append(account.equity, equity))[1:]
        return pd.DataFrame({
            "asset": [d["asset"].iloc[0]], "final": [equity[-1]], "n_trades": [len(trades)], "n_wins": [sum(t[6] > 0 for t in trades)], "max_dd": [(equity / top - 1).min()],
            "sharpe": [rets.mean() / spread * np.sqrt(account.per_year) if spread > 0 else 0.0], "last_level": [level], "units": [units],
        })

    more = ["roll"] if "roll" in rows.columns else []
    return rows.select("asset", "bar_idx", "open", "high", "low", "close", *more, "level").groupBy("asset").applyInPandas(run, TRADES if output == "trades" else TOTALS)
