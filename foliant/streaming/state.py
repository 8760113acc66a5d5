"""Stateful operators: limiters, breakers and key health, as ordered folds and as streams.

In batch, rows are dealt by key and sorted within partitions, and each task streams through them with the
state of the current key alone, so a key of any length needs no more memory than its state. On streams
the same step functions run in ``transformWithStateInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple], schema: str) -> DataFrame:
    """Rows step(state, row) for the rows of each key in order; ``step`` changes the state it is given."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, fresh = None, None, True
        for frame in frames:
            out, columns = [], {c: frame[c].tolist() for c in frame}
            for k, name in enumerate(columns[key]):
                if fresh or name != current:
                    current, state, fresh = name, start(), False
                out.append(step(state, {c: v[k] for c, v in columns.items()}))
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


@dataclass
class TokenBucket:
    """Refills by elapsed time up to a capacity; a request takes tokens if there are enough."""

    rate: float
    capacity: float
    tokens: float | None = None
    at: float | None = None

    def consume(self, now: float, amount: float = 1.0) -> bool:
        tokens = self.capacity if self.tokens is None else self.tokens
        if self.at is not None and now > self.at:
            tokens = min(self.capacity, tokens + (now - self.at) * self.rate)
        self.at = now if self.at is None else max(self.at, now)
        taken = tokens >= amount
        self.tokens = tokens - amount if taken else tokens
        return taken


@dataclass
class DualLimiter:
    """Requests and tokens per minute; both must allow a request, and none is charged otherwise."""

    requests: TokenBucket
    tokens: TokenBucket

    def consume(self, now: float, amount: float) -> bool:
        for b in (self.requests, self.tokens):
            b.consume(now, 0.0)
        if self.requests.tokens < 1 or self.tokens.tokens < amount:
            return False
        return self.requests.consume(now, 1.0) and self.tokens.consume(now, amount)


@dataclass
class CircuitBreaker:
    """CLOSED, OPEN after ``threshold`` failures, HALF_OPEN after ``cooldown`` seconds; successes count over all time."""

    threshold: int = 5
    cooldown: float = 300.0
    recover: int = 3
    state: str = "CLOSED"
    changed: float = 0.0
    failures: int = 0
    successes: int = 0

    def _to(self, state: str, now: float) -> None:
        self.state, self.changed = state, now

    def allows(self, now: float) -> bool:
        if self.state == "OPEN" and now - self.changed >= self.cooldown:
            self._to("HALF_OPEN", now)
            self.failures = 0
        return self.state != "OPEN"

    def record(self, ok: bool, now: float) -> None:
        if ok:
            self.successes += 1
            if self.state == "HALF_OPEN" and self.successes >= self.recover:
                self._to("CLOSED", now)
                self.failures = 0
            elif self.state == "CLOSED":
                self.failures = 0
            return
        self.failures += 1
        if self.state == "HALF_OPEN" or self.state == "CLOSED" and self.failures >= self.threshold:
            self._to("OPEN", now)


@dataclass
class KeyHealth:
    """Quota and errors of one key: invalid keys and ten errors in a row end it, a spent day blocks it to the next."""

    limit: int = 20
    used: int = 0
    errors: int = 0
    active: bool = True
    blocked_until: float = 0.0

    def record(self, kind: str, now: float, cooldown: float = 60.0) -> None:
        if kind == "success":
            self.used += 1
            self.errors = 0
        elif kind == "daily_quota":
            self.used, self.blocked_until = self.limit, (now // 86400 + 1) * 86400
        elif kind in ("quota_exceeded", "rate_limit", "server_error"):
            self.blocked_until = max(self.blocked_until, now + cooldown)
        elif kind == "invalid_key":
            self.active, self.errors = False, 0
        else:
            self.errors += 1
            self.active = self.active and self.errors < 10

    def available(self, now: float) -> bool:
        return self.active and now >= self.blocked_until and self.used < self.limit


@dataclass
class PeriodicFlush:
    """Holds writes until there are ``size`` of them or ``interval`` seconds have passed since the last flush.

    A clock set back starts the interval anew and leaves the size to decide.
    """

    size: int = 10
    interval: float = 300.0
    held: int = 0
    last: float | None = None

    def add(self, now: float) -> int:
        """The number of writes flushed, 0 if they are held."""
        self.held += 1
        passed = 0.0 if self.last is None else now - self.last
        if self.last is None or passed < 0:
            self.last = now
        if self.held < self.size and passed < self.interval:
            return 0
        flushed, self.held, self.last = self.held, 0, now
        return flushed


def carry(buffer: list[str], found: list[str], size: int = 10) -> list[str]:
    """Names found join the buffer, of which the last ``size`` stay; without any, the buffer stands in."""
    if not found:
        return list(buffer)
    buffer += [x for x in found if x not in buffer]
    del buffer[:-size]
    return list(found)
