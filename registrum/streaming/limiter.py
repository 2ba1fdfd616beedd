"""The adaptive platform limiter as a state machine over a signal log: a batch replay and a streaming operator share it.

Events need (platform, at seconds, signal). Each platform's events are replayed in order of time in one group; platforms are
the parallelism, as the state of one is sequential by nature.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registrum.functions import fixed

ADJUSTMENTS = "platform string, at double, event_id long, signal string, limit int, blocked_until double, adjusted boolean"


@dataclass
class Limiter:
    base: int
    limit: int
    blocked_until: float = 0.0
    streak: int = 0
    unavailable: int = 0

    @classmethod
    def of(cls, platform: str) -> Limiter:
        n = max(1, fixed.PLATFORM_LIMITS.get(platform, fixed.DEFAULT_LIMIT))
        return cls(n, n)

    def lower(self, at: float, signal: str) -> bool:
        self.limit = max(1, self.limit - 1)
        self.blocked_until = max(self.blocked_until, at + fixed.COOLDOWN_SECONDS[signal])
        return True

    def apply(self, at: float, signal: str) -> bool:
        """Whether the signal changed the limit or the cooldown."""
        if signal == "success":
            self.unavailable = 0
            self.streak = self.streak + 1 if self.limit < self.base else 0
            if self.streak < fixed.RECOVERY_SUCCESSES:
                return False
            self.streak, self.limit = 0, self.limit + 1
            return True
        self.streak = 0
        if signal == "service_unavailable":
            self.unavailable = (self.unavailable + 1) % fixed.FAILURES_TO_REDUCE
            return self.unavailable == 0 and self.lower(at, signal)
        return signal in ("rate_limited", "blocked") and self.lower(at, signal)


def _steps(platform: str, state: Limiter, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["at", "event_id"])
    rows = []
    for at, event, signal in zip(pdf["at"], pdf["event_id"], pdf["signal"]):
        adjusted = state.apply(float(at), signal)
        rows.append((platform, float(at), int(event), signal, state.limit, state.blocked_until, bool(adjusted)))
    return pd.DataFrame(rows, columns=["platform", "at", "event_id", "signal", "limit", "blocked_until", "adjusted"])


def replay(events: DataFrame) -> DataFrame:
    """The state after every event of a finished log."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _steps(key[0], Limiter.of(key[0]), pdf)

    return events.select("platform", "at", "event_id", "signal").groupBy("platform").applyInPandas(run, ADJUSTMENTS)


def stream(events: DataFrame) -> DataFrame:
    """The same over a stream: state per platform survives restarts in the checkpoint."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = Limiter(**json.loads(state.get[0])) if state.exists else Limiter.of(key[0])
        out = _steps(key[0], held, pd.concat(list(parts)))
        state.update((json.dumps(asdict(held)),))
        yield out

    return events.select("platform", "at", "event_id", "signal").groupBy("platform").applyInPandasWithState(run, ADJUSTMENTS, "state string", "append", "NoTimeout")


def dispatch(tasks: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Fair dispatch of each phase at configured limits: phase, item, turn, started (in units of seconds), platform, host.

    Platforms take turns in first-seen order; a platform runs its limit at once, a host one task, whichever platforms share
    it, so a phase is one sequence by nature: its tasks are the authorities of a catalogue, some hundreds. The next platform
    with room starts its first task whose host is free; tasks it passes over go behind the others. tasks: item, platform, host, ordinal and
    perhaps phase.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        queues: dict[str, deque] = {}
        for item, platform, host in pdf.sort_values("ordinal")[["item", "platform", "host"]].itertuples(index=False):
            queues.setdefault(platform, deque()).append((item, host))
        names, at, now, running, rows = list(queues), 0, 0.0, [], []

        def eligible() -> tuple[int, str, str] | None:
            hosts = {h for _, _, h in running}
            for k in range(len(names)):
                i = (at + k) % len(names)
                p, q = names[i], queues[names[i]]
                if sum(x == p for _, x, _ in running) >= max(1, fixed.PLATFORM_LIMITS.get(p, fixed.DEFAULT_LIMIT)):
                    continue
                for _ in range(len(q)):  # tasks whose host is busy go behind the others
                    if q[0][1] not in hosts:
                        return i, *q.popleft()
                    q.rotate(-1)
            return None

        while any(queues.values()):
            while found := eligible():
                i, item, host = found
                running.append((now + seconds, names[i], host))
                rows.append((key[0], item, len(rows), now, names[i], host))
                at = (i + 1) % len(names)
            now = min(end for end, _, _ in running)
            running = [r for r in running if r[0] > now]
        return pd.DataFrame(rows, columns=["phase", "item", "turn", "started", "platform", "host"])

    t = tasks if "phase" in tasks.columns else tasks.withColumn("phase", F.lit(0))
    return t.select(F.col("phase").cast("int"), "item", "platform", "host", "ordinal").groupBy("phase").applyInPandas(run, "phase int, item string, turn int, started double, platform string, host string")


def worker_stagger(i: Column) -> Column:
    """Start delay of the i-th worker."""
    return F.least(F.lit(1.5), F.lit(0.5) + F.lit(0.15) * (i - 1))
