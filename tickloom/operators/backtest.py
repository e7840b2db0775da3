"""Account ledger of decided weights: orders filled at the next open with slippage, fees and a participation cap."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scan import sequential
from ..series import RN, Series


def run_backtest(s: Series, decided="decided", cash=1_000_000.0, slippage_bps=0.0, max_participation: float | None = None, per_share=0.0, min_fee=0.0) -> Series:
    """Equity at every open and close, position and fees.

    The target of row t is sized on the equity marked at its close and filled at the open of row t+1.  Keys are runs
    (parameter set x symbol), which is where the parallel work is; the account itself is one chain of states.
    """
    def step(rows, st):
        money, qty, want, live = st
        n = len(rows[RN])
        out = {k: np.zeros(n) for k in ("position", "fees", "equity_open", "equity")}
        for i, (r, o, c, v, d) in enumerate(zip(*(rows[k].tolist() for k in (RN, "open", "close", "volume", decided)))):
            if r == 0 or not live:
                money, qty, want, live = cash, 0.0, 0.0, 1.0
            delta = want - qty
            if max_participation is not None and abs(delta) > max_participation * v:
                delta = np.sign(delta) * max_participation * v
            delta = float(np.trunc(delta))
            fee = 0.0
            if delta:
                px = o * (1 + np.sign(delta) * slippage_bps / 1e4)
                fee = max(per_share * abs(delta), min_fee) if per_share else 0.0
                money -= delta * px + fee
                qty += delta
            eq = money + qty * c
            out["position"][i], out["fees"][i], out["equity_open"][i], out["equity"][i] = qty, fee, money + qty * o, eq
            if d is not None and d == d:
                want = float(np.trunc(d * eq / c))
        return out, [money, qty, want, live]
    return sequential(s, ["open", "close", "volume", decided], step, [0.0, 0.0, 0.0, 0.0], {k: T.DoubleType() for k in ("position", "fees", "equity_open", "equity")})


def engine_returns(s: Series, equity_open="equity_open") -> Series:
    """Open-to-open returns of the ledger, zero on the last row."""
    s = s.flat().halo(0, 1)
    return s.add(engine_ret=F.coalesce(s.lead(equity_open, 1) / F.col(equity_open) - 1, F.lit(0.0)))


def parity_report(s: Series, a="engine_ret", b="pnl"):
    """Correlation and totals of two P&L definitions of the same decisions."""
    return s.flat().df.groupBy(*s.keys).agg(F.corr(a, b).alias("corr"), F.sum(a).alias("total_a"), F.sum(b).alias("total_b"))
