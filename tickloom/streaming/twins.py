"""Structured Streaming twins of operators whose definition is incremental.

Keyed state lives in the RocksDB state store.  A twin is a small step function over the rows of one key in time order and
a short state; the same shape as `scan.sequential`, so batch rules such as stops and filters run here unchanged.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..paths import reflected_alarms, trailing
from ..session import ROCKSDB, shared_folder

_STATE = T.StructType([T.StructField("v", T.ArrayType(T.DoubleType()))])
SLICE = 1 << 16               # rows a step is given at once


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


class Scan(StatefulProcessor):
    """Apply `step(rows, state) -> (outputs, state)` to the new rows of a key, ordered by time."""

    def __init__(self, step: Callable, keys: list[str], order: list[str], keep: list[str], outputs: list[str], init: list[float]):
        self.step, self.keys, self.order, self.keep, self.outputs, self.init0 = step, keys, order, keep, outputs, init

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # columns without an index or a sorted copy; the step sees slices, so what it makes of them is bounded
        parts: dict[str, list[np.ndarray]] = {}
        for pdf in rows:
            for c in pdf.columns:
                parts.setdefault(c, []).append(pdf[c].to_numpy())
        cols = {c: np.concatenate(parts.pop(c)) for c in list(parts)}
        at = np.lexsort([cols[c] for c in reversed(self.order)])
        st = list(self.state.get()[0]) if self.state.exists() else list(self.init0)
        for i in range(0, len(at), SLICE):
            part = {c: v[at[i:i + SLICE]] for c, v in cols.items()}
            out, st = self.step(part, st)
            yield pd.DataFrame({**{c: part[c] for c in self.keep}, **{n: out[n] for n in self.outputs}})
        self.state.update(([float(x) for x in st],))

    def close(self) -> None:
        pass


def scan(df: DataFrame, keys: list[str], order: list[str], step: Callable, init: list[float], outputs: dict[str, T.DataType], keep: list[str]) -> DataFrame:
    """Stateful scan of a stream: rows come back with the outputs of `step`."""
    prepare(df.sparkSession)
    sch = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keep], *[T.StructField(n, t) for n, t in outputs.items()]])
    return df.groupBy(*keys).transformWithStateInPandas(Scan(step, keys, order, keep, list(outputs), init), sch, "Append", "None")


# ---------------------------------------------------------------- step functions
def ema_step(x: str, n: int):
    """[count, sum of the seed, value]; `peek` is what the next equal price would give without changing the state."""
    a = 2.0 / (n + 1)

    def step(rows, st):
        cnt, acc, val = st or (0.0, 0.0, 0.0)
        out = np.full(len(rows[x]), np.nan)
        for i, v in enumerate(rows[x].tolist()):
            if cnt < n:
                cnt, acc = cnt + 1, acc + v
                val = acc / n
            else:
                val = a * v + (1 - a) * val
            if cnt >= n:
                out[i] = val
        return {"ema": out}, [cnt, acc, val]
    return step


def ema_peek(value: Column, price: Column, n: int) -> Column:
    """Provisional value of the open bar."""
    a = 2.0 / (n + 1)
    return a * price + (1 - a) * value


def rsi_step(x: str, n: int = 14):
    def step(rows, st):
        cnt, prev, g, lo = st or (0.0, 0.0, 0.0, 0.0)
        out = np.full(len(rows[x]), np.nan)
        for i, v in enumerate(rows[x].tolist()):
            if cnt:
                d = v - prev
                up, dn = max(d, 0.0), max(-d, 0.0)
                if cnt <= n:
                    g, lo = g + up / n, lo + dn / n
                else:
                    g, lo = (g * (n - 1) + up) / n, (lo * (n - 1) + dn) / n
                if cnt >= n:
                    out[i] = 100.0 if lo == 0 else 100.0 - 100.0 / (1.0 + g / lo)
            prev, cnt = v, cnt + 1
        return {"rsi": out}, [cnt, prev, g, lo]
    return step


def window_step(x: str, n: int, measures: dict[str, Callable[[np.ndarray], np.ndarray]]):
    """Measures of the last n values of every row; the last n - 1 values are the state."""
    def step(rows, st):
        at, win, carried = trailing(rows[x], st, n)
        out = {}
        for name, f in measures.items():
            out[name] = np.full(len(rows[x]), np.nan)
            if len(at):
                out[name][at] = f(win)
        return out, carried
    return step


def rolling_max_step(x: str, n: int):
    return window_step(x, n, {"rolling_max": lambda w: w.max(axis=1)})


def bollinger_step(x: str, n: int = 20, k: float = 2.0):
    """Mean of the window and k population deviations around it."""
    return window_step(x, n, {"upper": lambda w: w.mean(axis=1) + k * w.std(axis=1), "middle": lambda w: w.mean(axis=1), "lower": lambda w: w.mean(axis=1) - k * w.std(axis=1)})


def rolling_step(x: str, n: int):
    return window_step(x, n, {"mean": lambda w: w.mean(axis=1), "std": lambda w: w.std(axis=1, ddof=1)})


def robust_z_step(x: str, window=500, min_obs=50, threshold=6.0):
    def step(rows, st):
        buf = list(st)
        m = len(rows[x])
        z, flag = np.zeros(m), np.zeros(m, dtype=bool)
        for i, v in enumerate(rows[x].tolist()):
            if len(buf) >= min_obs:
                a = np.asarray(buf)
                med = np.median(a)
                z[i] = (v - med) / (np.median(np.abs(a - med)) * 1.4826 + 1e-12)
                flag[i] = abs(z[i]) > threshold
            buf.append(v)
            if len(buf) > window:
                buf.pop(0)
        return {"z": z, "flag": flag}, buf
    return step


def cusum_step(x: str, mean: float, sd: float, k=0.5, h=5.0):
    def step(rows, st):
        z = (rows[x] - mean) / sd
        flag, level = reflected_alarms(np.stack([z - k, -z - k]), np.array(st or (0.0, 0.0)), h)
        return {"alarm": flag}, level.tolist()
    return step


def decay_step(score: str, ts: str, tau_hours=24.0):
    """Live decayed sentiment: value and time of the last story."""
    def step(rows, st):
        val, last = st or (0.0, -1.0)
        out = np.zeros(len(rows[score]))
        times = pd.to_datetime(rows[ts]).astype("int64") / 3.6e12 if not np.issubdtype(np.asarray(rows[ts]).dtype, np.datetime64) else np.asarray(rows[ts]).astype("datetime64[ns]").astype("int64") / 3.6e12
        for i, (v, t) in enumerate(zip(rows[score].tolist(), list(times))):
            val = (val * math.exp(-(t - last) / tau_hours) if last >= 0 else 0.0) + v
            last = t
            out[i] = val
        return {"index": out}, [val, last]
    return step


def pov_step(volume: str, qty: float, participation=0.1):
    """Child of a minute from the volume of the minute before and what is left of the order."""
    def step(rows, st):
        left, prev = st or (qty, 0.0)
        out = np.zeros(len(rows[volume]))
        for i, v in enumerate(rows[volume].tolist()):
            c = min(left, math.floor(participation * prev))
            left, prev, out[i] = left - c, v, c
        return {"child": out}, [left, prev]
    return step


# ---------------------------------------------------------------- native streaming operators
def tick_bars(ticks: DataFrame, rule: str, delay="0 seconds", keys=("symbol",), ts="ts", price="price", size="size", seq="seq") -> DataFrame:
    """Clock bars in append mode: a bar comes out once the watermark has passed its end, never twice.

    Late ticks inside the delay still count; a zero delay is the nearest to dropping every tick older than the open bar.
    """
    o = F.struct(ts, seq)
    w = ticks.withWatermark(ts, delay).groupBy(*keys, F.window(ts, rule).alias("_w"))
    return w.agg(F.min_by(price, o).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, o).alias("close"), F.sum(size).alias("volume")).select(
        *keys, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


class TimedBars(StatefulProcessor):
    """Bars that a processing-time timer can close without a new trade.  State: start, o, h, l, c, v of the open bar."""

    def __init__(self, interval_ms: int):
        self.interval = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bar", _STATE)

    def _frame(self, key, bars):
        return pd.DataFrame([(key[0], pd.Timestamp(int(b[0]), unit="ms"), *b[1:]) for b in bars], columns=["symbol", "ts", "open", "high", "low", "close", "volume"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable")
        cur, done = (list(self.state.get()[0]) if self.state.exists() else None), []
        for t, p, z in zip(pdf["ts"], pdf["price"].tolist(), pdf["size"].tolist()):
            ms = int(pd.Timestamp(t).value // 1_000_000)
            start = ms - ms % self.interval
            if cur and start < cur[0]:
                continue
            if cur and start > cur[0]:
                done.append(cur)
                cur = None
            cur = [cur[0], cur[1], max(cur[2], p), min(cur[3], p), p, cur[5] + z] if cur else [float(start), p, p, p, p, float(z)]
        self.state.update((cur,))
        self.handle.registerTimer(max(int(cur[0]) + self.interval, timerValues.getCurrentProcessingTimeInMs() + 1))
        yield self._frame(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            cur = list(self.state.get()[0])
            if timerValues.getCurrentProcessingTimeInMs() >= cur[0] + self.interval:
                self.state.clear()
                yield self._frame(key, [cur])
                return
        yield self._frame(key, [])

    def close(self) -> None:
        pass


BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def timed_bars(ticks: DataFrame, interval_ms: int) -> DataFrame:
    prepare(ticks.sparkSession)
    return ticks.select("symbol", "ts", "price", F.col("size").cast("double").alias("size")).groupBy("symbol").transformWithStateInPandas(TimedBars(interval_ms), BAR, "Append", "ProcessingTime")


class Orders(StatefulProcessor):
    """Order state from out-of-order, repeated broker events.  The seen execution ids belong to one order and stay small."""

    def __init__(self, states: tuple[str, ...], allowed: dict[str, tuple[str, ...]]):
        self.names, self.allowed = states, allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one read and one write per order and micro-batch: a call to the store costs more than the list
        self.state = handle.getValueState("order", "state string, filled double, notional double, execs array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
        st, filled, notional, execs = self.state.get() or (self.names[0], 0.0, 0.0, [])
        seen, out = set(execs), []
        for r in pdf.itertuples(index=False):
            bad = None
            if r.kind == "status":
                if r.state in self.allowed[st]:
                    st = r.state
                elif r.state != st:
                    bad = f"illegal transition {st}->{r.state}"
            elif r.exec_id not in seen:
                seen.add(r.exec_id)
                filled, notional = filled + r.qty, notional + r.qty * r.price
                new = "FILLED" if filled >= r.order_qty else "PARTIALLY_FILLED"
                bad = "overfill" if filled > r.order_qty else None
                if st != "FILLED":
                    if new in self.allowed[st]:
                        st = new
                    else:
                        bad = "fill after terminal"
            out.append((key[0], r.seq, st, filled, bad))
        self.state.update((st, filled, notional, list(seen)))
        yield pd.DataFrame(out, columns=["coid", "seq", "order_state", "filled", "anomaly"])

    def close(self) -> None:
        pass


def track_orders(events: DataFrame) -> DataFrame:
    """Needs coid, ts, seq, kind, state, exec_id, qty, price, order_qty."""
    from ..operators.ledger import NEXT, STATES
    prepare(events.sparkSession)
    return events.groupBy("coid").transformWithStateInPandas(Orders(STATES, NEXT), "coid bigint, seq bigint, order_state string, filled double, anomaly string", "Append", "None")


def book_fills_once(fills: DataFrame, fill_id="fill_id", ts="ts", within="1 hour", symbol="symbol", qty="qty") -> DataFrame:
    """Exactly-once positions from redelivered fills: repeats inside the watermark are dropped before the sum."""
    return fills.withWatermark(ts, within).dropDuplicatesWithinWatermark([fill_id]).groupBy(symbol).agg(F.sum(qty).alias("position"))


def session_signal(scores: DataFrame, key: str, usable="usable_at", open_offset="14 hours 30 minutes", delay="1 hour") -> DataFrame:
    """Sentiment per session: a story counts for the window that ends at the next open."""
    shifted = scores.withColumn("_u", F.col(usable) - F.expr("interval 1 microsecond"))
    w = shifted.withWatermark("_u", delay).groupBy(key, F.window("_u", "1 day", "1 day", open_offset).alias("_w"))
    return w.agg(F.sum("sentiment").alias("signal")).select(key, F.col("_w.end").alias("open_at"), "signal")


class Silence(StatefulProcessor):
    """Alarm row when a feed has sent nothing for `max_gap` of event time."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        top = max(int(pd.Timestamp(p["ts"].max()).value // 1_000_000) for p in rows)
        if self.last.exists():
            old = self.last.get()[0]
            self.handle.deleteTimer(old + self.gap)
            top = max(top, old)
        self.last.update((top,))
        self.handle.registerTimer(top + self.gap)
        yield pd.DataFrame({"symbol": [], "silent_since": []}).astype({"symbol": "object", "silent_since": "datetime64[ns]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"symbol": [key[0]], "silent_since": [pd.Timestamp(self.last.get()[0], unit="ms")]})

    def close(self) -> None:
        pass


def stale_feeds(ticks: DataFrame, max_gap_s: float, delay="10 seconds") -> DataFrame:
    prepare(ticks.sparkSession)
    d = ticks.select("symbol", "ts").withWatermark("ts", delay)
    return d.groupBy("symbol").transformWithStateInPandas(Silence(int(max_gap_s * 1000)), "symbol string, silent_since timestamp", "Append", "EventTime")


# ---------------------------------------------------------------- running a stream over stored files
def read_files(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(path)


def run_available(stream: DataFrame, mode="append") -> DataFrame:
    """Process what is there, then stop; the result is a table in the shared checkpoint folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/chk").trigger(availableNow=True).start()
    else:
        def save(df, epoch):
            df.write.mode("overwrite").parquet(f"{base}/out")
        q = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{base}/chk").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
