"""Token usage of agent sessions: a state machine over their events that gives one row for every completed turn.

Sessions report running totals, and sometimes the usage of a turn by itself. A turn's usage is what it
reports; else the growth of the totals since it began. Totals that fall are a restart and count from zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FIELDS = ("input", "cached", "output", "total")
EVENTS = "session string, seq long, type string, model string, turn_id string, scope string, input long, cached long, output long, total long"
TURNS = "session string, turn_id string, model string, input long, cached long, output long, total long, reset boolean"
_STATE = "model string, turn_id string, base array<long>, last array<long>, own array<long>, seq long"


@dataclass
class Session:
    """What a session has said so far: model and turn, totals when the turn began and now, the turn's own usage."""

    model: str | None = None
    turn_id: str | None = None
    base: list[int] = field(default_factory=lambda: [0] * len(FIELDS))
    last: list[int] = field(default_factory=lambda: [0] * len(FIELDS))
    own: list[int] | None = None
    seq: int = -1

    def read(self, event: dict) -> tuple | None:
        """A completed turn (turn_id, model, input, cached, output, total, reset), or nothing. Events seen before change nothing."""
        if event["seq"] is not None:
            if event["seq"] <= self.seq:
                return None
            self.seq = event["seq"]
        kind = event["type"]
        usage = [int(event[f] or 0) for f in FIELDS]
        if kind == "turn_context":
            self.model, self.turn_id = event["model"] or self.model, event["turn_id"] or self.turn_id
        elif kind == "task_started":
            self.turn_id, self.base, self.own = event["turn_id"] or self.turn_id, list(self.last), None
        elif kind == "token_usage_record" and event["scope"] == "turn":
            self.own = usage
        elif kind in ("token_count", "token_usage_record"):
            self.last = usage
        elif kind == "task_complete":
            found, reset = delta(self.last, self.base)
            row = (event["turn_id"] or self.turn_id, self.model, *(self.own or found), reset and self.own is None)
            self.base, self.own = list(self.last), None
            return row
        return None


def delta(now: list[int], before: list[int]) -> tuple[list[int], bool]:
    """The growth of totals, and whether one of them fell: then all count from zero."""
    reset = any(n < b for n, b in zip(now, before))
    return [max(0, n - (0 if reset else b)) for n, b in zip(now, before)], reset


def completed_turns(events: DataFrame) -> DataFrame:
    """A row per completed turn of a stream of events (see EVENTS); of one session and batch in the order of seq, repeated events once."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = Session(*(list(x) if isinstance(x, (list, tuple)) or hasattr(x, "tolist") else x for x in state.get)) if state.exists else Session()
        rows = pd.concat([*parts]).sort_values("seq", kind="stable")
        rows = rows.astype(object).where(rows.notna(), None)
        out = [found for event in rows.to_dict("records") if (found := session.read(event))]
        state.update((session.model, session.turn_id, session.base, session.last, session.own, session.seq))
        yield pd.DataFrame([(key[0], *row) for row in out], columns=[c.split()[0] for c in TURNS.split(", ")])

    return events.groupBy("session").applyInPandasWithState(step, TURNS, _STATE, "append", GroupStateTimeout.NoTimeout)
