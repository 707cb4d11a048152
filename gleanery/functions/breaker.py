"""The source-health machine as plain functions, shared by batch and streaming.

A state is one integer: 0..fail_at-1 counts failures while closed, the next
`close_after` numbers count successes while half open, and any larger number is
the epoch millisecond until which the source stays open.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass


@dataclass(frozen=True)
class Breaker:
    fail_at: int = 2
    open_ms: int = 60_000
    close_after: int = 3

    @property
    def half(self) -> int:
        """Half open with no success yet."""
        return self.fail_at

    @property
    def finite(self) -> int:
        """Number of states that are not "open until"."""
        return self.fail_at + self.close_after

    def name(self, state: int) -> str:
        return "closed" if state < self.half else "half_open" if state < self.finite else "open"

    def call(self, state: int, ts: int, ok: bool) -> int:
        """State after a call at `ts`; while open and before its end the call is not made."""
        if state >= self.finite:
            if ts < state:
                return state
            state = self.half
        if state < self.half:
            if ok:
                return 0
            return state + 1 if state + 1 < self.fail_at else ts + self.open_ms
        if not ok:
            return ts + self.open_ms
        return state + 1 if state + 1 < self.finite else 0

    def run(self, state: int, calls):
        """Yield (index, before, after, alert) for every change; the return value is the last state."""
        for i, (ts, ok) in enumerate(calls):
            before = self.name(state)
            probing = before == "open" and ts >= state
            state = self.call(state, ts, ok)
            after = self.name(state)
            if probing:
                yield i, "open", "half_open", None
                before = "half_open"
            if before != after:
                alert = {("closed", "open"): "source_degraded", ("half_open", "closed"): "source_recovered"}.get((before, after))
                yield i, before, after, alert
        return state

    def transfer(self, ts: list[int], ok: list[bool], horizon: int | None = None) -> tuple[list[int], list[int], list[int]]:
        """What a stretch of calls does to every state it may be entered in.

        Returns the end state per finite entry state, and for an open entry state the
        steps (limit, end): entered with "open until" u, the end is that of the first
        limit >= u, and u itself beyond the last limit. Worked backwards, one pass.
        No u above `horizon` needs to be covered.
        """
        n = len(ts)
        after = list(range(self.finite))  # end state when entered after the last call
        probe = [0] * n  # end state when the call at i is the first probe
        for i in range(n - 1, -1, -1):
            reopened = bisect_left(ts, ts[i] + self.open_ms)
            opened = probe[reopened] if reopened < n else ts[i] + self.open_ms
            here = []
            for state in range(self.finite):
                new = self.call(state, ts[i], ok[i])
                here.append(after[new] if new < self.finite else opened)
            probe[i] = here[self.half]
            after = here
        limits, ends = [], []
        for t, end in zip(ts, probe):
            if horizon is not None and limits and limits[-1] >= horizon:
                break
            if ends and ends[-1] == end:
                limits[-1] = t
            else:
                limits.append(t)
                ends.append(end)
        return after, limits, ends

    def apply(self, state: int, finite: list[int], limits: list[int], ends: list[int]) -> int:
        if state < self.finite:
            return int(finite[state])
        at = bisect_left(limits, state)
        return int(ends[at]) if at < len(limits) else state
