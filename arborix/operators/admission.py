"""A throttle that delays calls: each starts as soon as the window has room, and holds up those behind it.

The calls of a key are made one after the other.  A call waits until the tokens
of the calls that started within the window, and its own, fit the budget.  A
call that is turned away by the service is repeated after 1, 2, 4 ... seconds,
and what comes next waits for it as well.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000


class Throttle:
    """State of one key: when it is free, and what started within the window: (microseconds, tokens)."""

    def __init__(self, budget: float, seconds: int, retries: int, free: int = 0, started: list[tuple[int, float]] = ()):
        self.budget, self.span, self.retries, self.free = budget, seconds * SECOND, retries, free
        self.started = deque(started)

    def call(self, at: int, tokens: float, failures: int) -> tuple[int | None, int, bool]:
        """(start, attempts, failed); start is None for a call that no window has room for, which is not made."""
        if tokens > self.budget:
            return None, 0, True
        now, used = max(at, self.free), sum(n for _, n in self.started)
        while self.started and (self.started[0][0] + self.span <= now or used + tokens > self.budget):
            now = max(now, self.started[0][0] + self.span)
            used -= self.started.popleft()[1]
        self.started.append((now, tokens))
        waits = min(failures, self.retries + 1)
        self.free = now + SECOND * ((1 << waits) - 1)
        return now, min(failures, self.retries) + 1, failures > self.retries


def _columns(by: list[str], key: str, ts: str, tokens: str, failures: str | None):
    more = F.lit(0) if failures is None else F.coalesce(F.col(failures), F.lit(0))
    return [*by, key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), F.coalesce(F.col(tokens), F.lit(0)).cast("double").alias("_n"), more.cast("int").alias("_f")]


def _schema(rows: DataFrame, by: list[str], key: str) -> str:
    kind = lambda c: rows.schema[c].dataType.simpleString()
    return ", ".join([*(f"{c} {kind(c)}" for c in [*by, key]), "start timestamp", "waited double", "attempts int", "failed boolean"])


def admitted(calls: DataFrame, budget: float, key: str, by: list[str], ts: str = "ts", tokens: str = "tokens", failures: str | None = None, seconds: int = 60, retries: int = 2) -> DataFrame:
    """(by..., key, start, waited: seconds, attempts, failed) of each call, in the order of time and key.

    failures: how often the service turns a call away.  A key's calls are folded
    in one task, which holds no more of them than started within the window.
    Calls without a time come first, at the epoch.
    """
    rows = calls.select(*_columns(by, key, ts, tokens, failures)).withColumn("_at", F.coalesce("_at", F.lit(0)))
    n = len(by)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, state = None, None
        for b in batches:
            out = []
            for *names, at, tokens, failures in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or names[:n] != own:
                    own, state = names[:n], Throttle(budget, seconds, retries)
                start, tries, failed = state.call(at, tokens, failures)
                out.append((start, None if start is None else (start - at) / SECOND, tries, failed))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.timestamp("us", "UTC"), pa.float64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*by, key, "start", "waited", "attempts", "failed"])

    return rows.repartition(*by).sortWithinPartitions(*by, "_at", key).mapInArrow(run, _schema(calls, by, key))


def admitted_stream(calls: DataFrame, budget: float, key: str, by: list[str], ts: str = "ts", tokens: str = "tokens", failures: str | None = None, seconds: int = 60, retries: int = 2, late: str = "10 minutes") -> DataFrame:
    """:func:`admitted` over a stream: calls are folded as they come, in the order of time within a batch.

    The state of a key is its window; it goes by a timer when the watermark has
    passed the time at which the key is free and its window empty.
    """
    rows = calls.withWatermark(ts, late).select(*_columns(by, key, ts, tokens, failures), F.col(ts).alias("_ts"))

    def run(names, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        free, at, n = state.get if state.exists else (0, [], [])
        own = Throttle(budget, seconds, retries, free, list(zip(at, n, strict=True)))
        batch = pd.concat(list(frames)).sort_values(["_at", key], kind="stable")
        out = []
        for k, at, tokens, failures in zip(batch[key], batch["_at"], batch["_n"], batch["_f"], strict=True):
            start, tries, failed = own.call(int(at), float(tokens), int(failures))
            out.append((*names, k, pd.Timestamp(start, unit="us") if start is not None else None, None if start is None else (start - int(at)) / SECOND, tries, failed))
        state.update((own.free, [int(t) for t, _ in own.started], [float(x) for _, x in own.started]))
        last = max([own.free, *(t + own.span for t, _ in own.started)]) // 1000
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=[*by, key, "start", "waited", "attempts", "failed"])

    grouped = rows.groupBy(*by)
    return grouped.applyInPandasWithState(run, _schema(calls, by, key), "free long, at array<long>, n array<double>", "append", "EventTimeTimeout")
