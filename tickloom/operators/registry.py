"""Indicator registry: name, group, look-back as a function of the parameters, parameter ranges."""
from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..series import Series, SeriesSpec


@dataclass(frozen=True)
class IndicatorSpec:
    name: str
    group: str
    outputs: tuple[str, ...]
    lookback: Callable[..., int]
    params: dict[str, tuple]          # name -> (default, low, high)
    fn: Callable[..., Series]
    prefix_only: bool = True          # False: uses future rows on purpose (labels, research)


REGISTRY: dict[str, IndicatorSpec] = {}


def indicator(name: str, group: str, lookback: Callable[..., int], params: dict[str, tuple] | None = None,
              outputs: tuple[str, ...] = ("value",), prefix_only: bool = True):
    """Register `fn(series, ..., out=...) -> Series` under a unique name."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"indicator {name!r} already registered")
        REGISTRY[name] = IndicatorSpec(name, group, outputs, lookback, params or {}, fn, prefix_only)
        return fn
    return deco


def lookback(name: str, **params) -> int:
    spec = REGISTRY[name]
    args = {k: params.get(k, v[0]) for k, v in spec.params.items()}
    want = inspect.signature(spec.lookback).parameters
    return spec.lookback(**{k: v for k, v in args.items() if k in want})


def compute(df: DataFrame, spec: SeriesSpec, *wanted: str | tuple[str, dict], keep_rn: bool = False) -> DataFrame:
    """Add any number of registered indicators over one shared block layout."""
    jobs = [(w, {}) if isinstance(w, str) else w for w in wanted]
    back = max(lookback(n, **p) for n, p in jobs)
    s = Series.of(df, spec, back=back)
    for n, p in jobs:
        s = REGISTRY[n].fn(s, **p)
    return s.done(keep_rn)


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(s.name, s.group, ", ".join(s.outputs),
             ", ".join(f"{k}={v[0]}" for k, v in s.params.items()), lookback(s.name))
            for s in sorted(REGISTRY.values(), key=lambda r: (r.group, r.name))]
    return spark.createDataFrame(rows, "name string, group string, outputs string, params string, lookback int")


def catalog_markdown() -> str:
    lines = ["| name | group | outputs | params | lookback |", "|---|---|---|---|---|"]
    for s in sorted(REGISTRY.values(), key=lambda r: (r.group, r.name)):
        params = ", ".join(f"{k}={v[0]}" for k, v in s.params.items())
        lines.append(f"| {s.name} | {s.group} | {', '.join(s.outputs)} | {params} | {lookback(s.name)} |")
    return "\n".join(lines)
