"""Path rules over arrays, written as running extremes between events instead of loops over rows.

Each function looks ahead over a growing stretch of rows, finds the first event in it with array operations, and starts
again behind that event; the work is a few passes over the rows plus one short pass for each event.
"""
from __future__ import annotations

import numpy as np

FIRST, LONGEST = 64, 1 << 16


def reflected_alarms(steps: np.ndarray, level: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums that never fall below zero, one per side (sides x rows); where one exceeds h there is an alarm and all return to
    zero.  A sum held at zero is its free sum less the smaller of its running minimum and minus its start."""
    n, at, look = steps.shape[1], 0, FIRST
    flags, level = np.zeros(n, bool), np.array(level, float)
    while at < n:
        free = np.cumsum(steps[:, at: at + look], axis=1)
        held = free - np.minimum(np.minimum.accumulate(free, axis=1), -level[:, None])
        hit = np.flatnonzero((held > h).any(axis=0))
        if len(hit):
            flags[at + hit[0]], level = True, np.zeros(len(level))
            at, look = at + int(hit[0]) + 1, FIRST
        else:
            level, at, look = held[:, -1], at + free.shape[1], min(2 * look, LONGEST)
    return flags, level


def ratchet(band: np.ndarray, close: np.ndarray, start: float, last: float) -> np.ndarray:
    """A band that only tightens downwards, and is taken anew after a close above it.  start, last: band and close before."""
    n, at, look, out = len(band), 0, FIRST, np.empty(len(band))
    before = np.concatenate(([last], close[:-1]))
    while at < n:
        tight = np.minimum.accumulate(np.concatenate(([start], band[at: at + look])))
        broken = np.flatnonzero(before[at: at + look] > tight[:-1])
        k = int(broken[0]) if len(broken) else len(tight) - 1
        out[at: at + k] = tight[1: k + 1]
        at += k
        if len(broken):
            out[at] = start = band[at]
            at, look = at + 1, FIRST
        else:
            start, look = tight[-1], min(2 * look, LONGEST)
    return out


def swings(row: np.ndarray, high: np.ndarray, low: np.ndarray, pct: float, state: list[float]):
    """Reversals by a share of the running extreme: (rows of reversal, pivot rows, prices, kinds) and the state
    (trend, row and value of the high, row and value of the low); a high row below zero means no state yet."""
    trend, top_at, top, bottom_at, bottom = state
    n, at, look, found = len(row), 0, FIRST, []
    if n and (top_at < 0 or row[0] == 0):
        trend, top_at, top, bottom_at, bottom, at = 0.0, row[0], high[0], row[0], low[0], 1
    while at < n:
        h, lo = high[at: at + look], low[at: at + look]
        peak = np.maximum.accumulate(np.concatenate(([top], h)))[1:]
        floor = np.minimum.accumulate(np.concatenate(([bottom], lo)))[1:]
        fall = (lo <= peak * (1 - pct)) & (trend >= 0)
        rise = (h >= floor * (1 + pct)) & (trend <= 0)
        turn = np.flatnonzero(fall | rise)
        upto = int(turn[0]) + 1 if len(turn) else len(h)
        tops, bottoms = np.flatnonzero(h[:upto] == peak[:upto]), np.flatnonzero(lo[:upto] == floor[:upto])
        if trend >= 0 and len(tops):
            top_at, top = row[at + tops[-1]], h[tops[-1]]
        if trend <= 0 and len(bottoms):
            bottom_at, bottom = row[at + bottoms[-1]], lo[bottoms[-1]]
        if len(turn):
            k = at + upto - 1
            if fall[upto - 1]:
                found.append((k, top_at, top, 1))
                trend, bottom_at, bottom = -1.0, row[k], low[k]
            else:
                found.append((k, bottom_at, bottom, -1))
                trend, top_at, top = 1.0, row[k], high[k]
        at, look = at + upto, FIRST if len(turn) else min(2 * look, LONGEST)
    # only the side that can still matter stays in the state
    if trend > 0:
        bottom_at = bottom = 0.0
    elif trend < 0:
        top_at = top = 0.0
    return found, [trend, float(top_at), float(top), float(bottom_at), float(bottom)]


def trailing(values: np.ndarray, carried: list[float], n: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Full windows of n values ending at each row: (rows that have one, windows x n, values carried to the next call)."""
    a = np.concatenate([np.asarray(carried, float), np.asarray(values, float)])
    seen = len(a) - len(values)
    win = np.lib.stride_tricks.sliding_window_view(a, n) if len(a) >= n else np.empty((0, n))
    rows = np.arange(n - 1, len(a)) - seen if len(a) >= n else np.empty(0, int)
    new = rows >= 0
    return rows[new], win[new], a[len(a) - min(n - 1, len(a)):].tolist()
