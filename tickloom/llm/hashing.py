"""64-bit hashes over byte strings as NumPy passes: words, runs of words, mixing."""
from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15                      # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
STEP = 1 << 18                                 # bytes hashed at once
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def remembered(f):
    """Results of `f` by its arguments; unlike a cached function of functools it travels to workers by value."""
    memo: dict = {}

    def call(*args):
        if args not in memo:
            memo[args] = f(*args)
        return memo[args]
    return call


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a splitmix generator; a bijection on 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@remembered
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), U)
    out[0] = 1
    return np.multiply.accumulate(out)


@remembered
def letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(BASE))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each maximal run of bytes other than white space, in order; long texts in slices cut at white space."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + STEP)
        if end < n:
            cut = max(text.rfind(b, at, end) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at:
                nxt = [p for p in (text.find(b, end) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
                cut = min(nxt) if nxt else n
            end = cut
        out.append(_slice(text[at:end]))
        at = end + (1 if end < n else 0)
    return np.concatenate(out) if out else np.empty(0, U)


def _slice(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, np.uint8)
    gap = np.concatenate(([True], SPACES[a], [True]))
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    s, e = turn[0::2], turn[1::2]
    n = len(a)
    top = max(STEP, 1 << (max(n, 1) - 1).bit_length())
    sums = np.zeros(n + 1, U)
    np.cumsum(letters()[a] * powers(BASE, top)[:n], out=sums[1:])
    return mix((sums[e] - sums[s]) * powers(INVERSE, top + 1)[s] + (e - s).astype(U))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the runs of `width` words, sorted; all words as one run when there are fewer; none without words."""
    n = len(words)
    if n == 0:
        return words
    w = min(n, width)
    h = np.full(n - w + 1, w, U)
    for k in range(w):
        h = mix(h * U(BASE) + words[k: n - w + 1 + k])
    return np.unique(h)
