"""Arrival-time state: rate limits, token buckets, breakers and daily sums.

Every rule is a step function on one event and the state of its key.  The batch
form walks the events of a key in order; the streaming form keeps the state
between micro-batches.  Both run the same step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class FixedWindow:
    """At most ``most`` events in a window that opens with its first event and lasts ``seconds``."""

    most: int = 120
    seconds: float = 60.0
    state = "opened double, used int"
    out = "admitted boolean, retry_after int"

    def lasts(self) -> float | None:
        """For how many seconds without an event the state matters; None: for ever."""
        return self.seconds

    def step(self, s: tuple | None, at: float, ok: bool) -> tuple[tuple, tuple]:
        if s is None or s[0] + self.seconds <= at:
            s = (at, 0)
        if s[1] >= self.most:
            left = s[0] + self.seconds - at
            return s, (False, max(1, int(-(-left // 1))))
        return (s[0], s[1] + 1), (True, 0)


@dataclass(frozen=True)
class TokenBucket:
    """Up to ``burst`` tokens, refilled at ``per_day`` a day; an event takes one."""

    burst: float = 1.0
    per_day: float = 7200.0
    state = "tokens double, at double"
    out = "admitted boolean, retry_after int"

    def lasts(self) -> float | None:
        return self.burst * 86400 / self.per_day

    def step(self, s: tuple | None, at: float, ok: bool) -> tuple[tuple, tuple]:
        rate = self.per_day / 86400
        tokens = self.burst if s is None else min(self.burst, s[0] + max(0.0, at - s[1]) * rate)
        at = at if s is None else max(at, s[1])
        if tokens >= 1:
            return (tokens - 1, at), (True, 0)
        return (tokens, at), (False, max(1, int(-(-(1 - tokens) / rate // 1))))


@dataclass(frozen=True)
class Breaker:
    """Opens for ``seconds`` after ``failures`` failures in a row; then one event may probe."""

    failures: int = 3
    seconds: float = 30.0
    state = "failed int, open_until double"
    out = "admitted boolean, retry_after int"

    def lasts(self) -> float | None:
        return None  # failures are counted until a success

    def step(self, s: tuple | None, at: float, ok: bool) -> tuple[tuple, tuple]:
        failed, until = s or (0, 0.0)
        if failed >= self.failures and at < until:
            return (failed, until), (False, max(1, int(-(-(until - at) // 1))))
        if ok:
            return (0, 0.0), (True, 0)
        return (failed + 1, at + self.seconds if failed + 1 >= self.failures else until), (True, 0)


Rule = FixedWindow | TokenBucket | Breaker


def decide(events: DataFrame, rule: Rule, keys: list[str], at: str, key: str, ok: str | None = None) -> DataFrame:
    """``(keys…, key, admitted, retry_after)`` of every event, in the order of arrival of its keys.

    ``at`` is a timestamp, ``key`` identifies an event and breaks ties, ``ok``
    says whether the event itself succeeded.  Events without a time are left
    out.  A rule decides every event by those before it, so the events of one
    key are walked in order; they come sorted, in batches, and what is held of
    them is the state alone, however many there are.
    """
    types = dict(events.dtypes)
    rows = events.where(F.col(at).isNotNull()).select(*keys, F.col(key), (F.unix_micros(at) / 1e6).alias("__at"), (F.col(ok) if ok else F.lit(True)).alias("__ok"))
    schema = ", ".join([*[f"{c} {types[c]}" for c in keys], f"{key} {types[key]}", rule.out])

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, state = None, None
        for pdf in frames:
            out = []
            # Missing keys come as unequal to themselves; as None they are one key.
            owners = pdf[keys].astype(object).where(pdf[keys].notna(), None).itertuples(index=False, name=None)
            for owner, t, good in zip(owners, pdf["__at"], pdf["__ok"]):
                if owner != before:
                    before, state = owner, None
                state, said = rule.step(state, float(t), bool(good))
                out.append(said)
            yield pd.concat([pdf[[*keys, key]].reset_index(drop=True), pd.DataFrame(out, columns=["admitted", "retry_after"])], axis=1)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "__at", key).mapInPandas(walk, schema)


def decide_stream(events: DataFrame, rule: Rule, keys: list[str], at: str, key: str, ok: str | None = None, idle: str = "1 hour") -> DataFrame:
    """The streaming twin of ``decide``: the state of a key is kept between batches.

    It is dropped when the key is idle for ``idle``, but not before it says
    nothing any more; a rule whose state never expires keeps it.
    """
    types = dict(events.dtypes)
    rows = events.where(F.col(at).isNotNull()).select(*keys, F.col(key), (F.unix_micros(at) / 1e6).alias("__at"), (F.col(ok) if ok else F.lit(True)).alias("__ok"))
    schema = ", ".join([*[f"{c} {types[c]}" for c in keys], f"{key} {types[key]}", rule.out])
    lasts = rule.lasts()
    millis = int(max(pd.Timedelta(idle).total_seconds(), lasts or 0) * 1000)

    def walk(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(["__at", key], kind="stable")
        s, out = (state.get if state.exists else None), []
        for t, good in zip(pdf["__at"], pdf["__ok"]):
            s, said = rule.step(s, float(t), bool(good))
            out.append(said)
        state.update(s)
        if lasts is not None:
            state.setTimeoutDuration(millis)
        yield pd.concat([pdf[[*keys, key]].reset_index(drop=True), pd.DataFrame(out, columns=["admitted", "retry_after"])], axis=1)

    return rows.groupBy(*keys).applyInPandasWithState(walk, schema, rule.state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def daily_ledger(events: DataFrame, at: str, amount: str, cap: float) -> DataFrame:
    """``(day, spent, within)``: what each UTC day spent, and whether it stayed within the cap."""
    day = events.where(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day")).agg(F.round(F.sum(amount), 3).alias("spent"))
    return day.withColumn("within", F.coalesce("spent", F.lit(0.0)) <= cap)


def counters_stream(requests: DataFrame, at: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Requests and failures by window and endpoint, with a bound on lateness."""
    return requests.withWatermark(at, late).groupBy(F.window(at, width), "endpoint").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") >= 400).alias("failed"))


def deduplicated_stream(requests: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Every request once, as long as its repeats come within the bound on lateness."""
    return requests.withWatermark(at, late).dropDuplicatesWithinWatermark([key])

