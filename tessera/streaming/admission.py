"""Live admission: tasks take slots of a server, beat while they run, and lose their slot when they stall."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from tessera.operators.state import PENDING

#: Milliseconds without a beat after which a task has stalled.
STALL_MS = 60_000


class Slots:
    """A server's running tasks: of each the time of its last beat, as stated and as seen here."""

    def __init__(self, held: str | None):
        self.tasks: dict[str, list[int]] = json.loads(held) if held else {}

    def evict(self, now: int, stall: int, clock: int) -> list[str]:
        """The tasks that have stalled by a clock (0: stated times, 1: seen ones), oldest first; their slots are free."""
        gone = sorted((t for t, beat in self.tasks.items() if now - beat[clock] >= stall), key=lambda t: (self.tasks[t][clock], t))
        for t in gone:
            del self.tasks[t]
        return gone

    def event(self, kind: str, task: str, at: int, seen: int, limit: int) -> str | None:
        """What an event leads to: a submitted task is ``admitted`` or ``refused``, a running one's end ``finished``; a beat to nothing."""
        if kind == "submit" and task not in self.tasks:
            if len(self.tasks) >= limit:
                return "refused"
            self.tasks[task] = [at, seen]
            return "admitted"
        if task not in self.tasks:
            return None
        if kind == "finish":
            del self.tasks[task]
            return "finished"
        self.tasks[task] = [max(at, self.tasks[task][0]), seen]
        return None


def admission(events: DataFrame, limit: int = PENDING, stall_ms: int = STALL_MS) -> DataFrame:
    """(server, task_id, at_ms, decision): decisions on a stream of (server, task_id, kind, at_ms), kinds ``submit``, ``beat``, ``finish``.

    A server's events of a batch are taken by their stated times, ties by kind (finish, beat, submit) and task. Before each one, tasks whose
    last stated beat is ``stall_ms`` old are ``evicted`` and free their slots. Where no events come, a processing-time timer does so
    by the time a beat was seen. Unknown tasks' beats and ends, and events without a time or task, lead to nothing.
    """
    kind_of = dict(events.dtypes)["server"]
    schema = f"server {kind_of}, task_id string, at_ms long, decision string"
    rank = {"finish": 0, "beat": 1, "submit": 2}

    def update(key, batches, state):
        import pandas as pd

        slots, now, out = Slots(state.get[0] if state.exists else None), state.getCurrentProcessingTimeMs(), []
        if state.hasTimedOut:
            out = [(t, now, "evicted") for t in slots.evict(now, stall_ms, 1)]
        else:
            rows = [r for pdf in batches for r in zip(pdf["at_ms"], pdf["kind"], pdf["task_id"]) if not any(pd.isna(x) for x in r) and r[1] in rank]
            for at, kind, task in sorted(rows, key=lambda r: (r[0], rank[r[1]], r[2])):
                out += [(t, int(at), "evicted") for t in slots.evict(int(at), stall_ms, 0)]
                if said := slots.event(kind, task, int(at), now, limit):
                    out.append((task, int(at), said))
        if slots.tasks:
            state.update((json.dumps(slots.tasks),))
            state.setTimeoutDuration(max(1, min(beat[1] for beat in slots.tasks.values()) + stall_ms - now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"server": [key[0]] * len(out), "task_id": [t for t, _, _ in out], "at_ms": [a for _, a, _ in out], "decision": [d for _, _, d in out]})

    return events.groupBy("server").applyInPandasWithState(update, schema, "held string", "append", "ProcessingTimeTimeout")
