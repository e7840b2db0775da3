"""Named boolean rules over series: composition, look-back windows and the declarative rule tree."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..series import Series, col
from . import indicators as I
from . import patterns as P

_ids = count()


def _name() -> str:
    return f"_cond{next(_ids)}"


@dataclass(frozen=True)
class Condition:
    """A rule with a name.  `plan` adds one boolean column to a series and says how it is called."""

    plan: Callable[[Series], tuple[Series, str]]
    name: str

    @classmethod
    def of(cls, expr: Column, name: str) -> Condition:
        def plan(s):
            n = _name()
            return s.add({n: F.coalesce(expr, F.lit(False))}), n
        return cls(plan, name)

    def _join(self, other: Condition, op, word: str) -> Condition:
        def plan(s):
            s, a = self.plan(s)
            s, b = other.plan(s)
            n = _name()
            return s.add({n: op(F.col(a), F.col(b))}, uses=[a, b]), n
        return Condition(plan, f"({self.name} {word} {other.name})")

    def __and__(self, other: Condition) -> Condition:
        return self._join(other, lambda a, b: a & b, "AND")

    def __or__(self, other: Condition) -> Condition:
        return self._join(other, lambda a, b: a | b, "OR")

    def __invert__(self) -> Condition:
        def plan(s):
            s, a = self.plan(s)
            n = _name()
            return s.add({n: ~F.col(a)}, uses=[a]), n
        return Condition(plan, f"NOT {self.name}")

    def within(self, n: int) -> Condition:
        """Held on any of the last n rows."""
        def plan(s):
            s, a = self.plan(s)
            s = s.ready([a], n - 1)
            k = _name()
            return s.add({k: F.max(a).over(s.rows(-n + 1))}, back=n - 1, uses=[a]), k
        return Condition(plan, f"{self.name} within {n}")

    def confirm(self, n: int) -> Condition:
        """Held on each of the last n rows."""
        def plan(s):
            s, a = self.plan(s)
            s = s.ready([a], n - 1)
            k = _name()
            return s.add({k: F.count(F.when(F.col(a), 1)).over(s.rows(-n + 1)) == n}, back=n - 1, uses=[a]), k
        return Condition(plan, f"{self.name} for {n} bars")

    def apply(self, s: Series, out: str = "signal") -> Series:
        s, n = self.plan(s)
        s = s.add({out: F.col(n)}, uses=[n])
        return s.drop(*[c for c in s.df.columns if c.startswith("_cond")])


INDICATORS = {"sma": lambda s, x, out, n=20: I.sma(s, x, n, out),
              "ema": lambda s, x, out, n=20: I.ema_first(s, x, n, out),
              "rsi": lambda s, x, out, n=14: I.rsi(s, x, n, out, seed="first")}
ACTIONS = ("crossover", "crossunder", "gt", "lt")


def _operand(s: Series, spec) -> tuple[Series, str | float]:
    if isinstance(spec, (int, float)):
        return s, float(spec)
    if isinstance(spec, str):
        return s, spec
    n = _name()
    return INDICATORS[spec["ind"]](s, spec.get("input", "close"), n, **spec.get("params", {})), n


def build_condition(spec: dict) -> Condition:
    """Compile {"all": [...]}, {"any": [...]}, {"not": {...}} and {"fn": name, "args": [...]} to one rule."""
    if "all" in spec or "any" in spec:
        parts = [build_condition(x) for x in spec.get("all", spec.get("any"))]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if "all" in spec else out | p
        return out
    if "not" in spec:
        return ~build_condition(spec["not"])
    fn, args = spec["fn"], spec["args"]
    if fn not in ACTIONS:
        raise ValueError(f"unknown action {fn!r}")

    def plan(s):
        s, a = _operand(s, args[0])
        s, b = _operand(s, args[1])
        n = _name()
        if fn in ("crossover", "crossunder"):
            # two numbers or a number on the left become columns first
            if not isinstance(a, str):
                s, a = s.add(_conda=F.lit(a)), "_conda"
            return getattr(P, fn)(s, a, b, n), n
        x, y = (col(v) if isinstance(v, str) else F.lit(v) for v in (a, b))
        return s.add({n: F.coalesce(x > y if fn == "gt" else x < y, F.lit(False))},
                     uses=[v for v in (a, b) if isinstance(v, str)]), n
    return Condition(plan, f"{fn}({', '.join(str(a) for a in args)})")
