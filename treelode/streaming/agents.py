"""Agents and leases as keyed state with event-time timers.

Events are ``(agent_id, path, req, kind, ttl_ms, at)`` with the kinds ``register``, ``beat``, ``request``,
``release`` and ``depart``.  Two operators follow each other:

* ``AgentBook``, by agent: who is registered, when it was last heard of, which paths it asked for.
  An agent that is silent for longer than the timeout crashes and releases its paths.
* ``LeaseBook``, by path: who holds it and until when.

Neither decides when a row arrives.  A row waits in the state under its own time until a timer says
that nothing earlier can come; rows of one time are decided in the order of ``req``.  All timers are
set from event times alone.  So a decision depends on the events, not on clocks or batches, and a
replay gives the same rows.  State of one key grows with its undecided rows; a key's rows are
decided one after the other, which its meaning asks for.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "agent_id BIGINT, path STRING, req BIGINT, kind STRING, ttl_ms BIGINT, at TIMESTAMP"
AGENT_ROW = "agent_id BIGINT, path STRING, req BIGINT, kind STRING, ttl_ms BIGINT, at TIMESTAMP, at_ms BIGINT"
LEASE_ROW = "path STRING, req BIGINT, agent_id BIGINT, outcome STRING, at_ms BIGINT, expiry BIGINT"
_FIELDS = ("agent_id", "path", "req", "kind", "ttl_ms")


def _plain(value):
    return None if pd.isna(value) else value if isinstance(value, str) else int(value)


class _InOrder(StatefulProcessor):
    """Holds rows under their time and hands them to ``decide`` once a timer of that time fires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at_ms BIGINT", "rows STRING")

    def timers(self, row: dict) -> tuple[int, ...]:
        """Times beside its own at which a row may have consequences."""
        raise NotImplementedError

    def decide(self, key: tuple, at: int, rows: list[dict]) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list[dict]] = defaultdict(list)
        times: set[int] = set()
        for batch in rows:
            for row in batch.to_dict("records"):
                at = int(row["at_ms"])
                held = {name: _plain(row[name]) for name in _FIELDS} | {"at": at}
                fresh[at].append(held)
                times.update((at, *self.timers(held)))
        for at, more in fresh.items():
            before = json.loads(self.waiting.getValue((at,))[0]) if self.waiting.containsKey((at,)) else []
            self.waiting.updateValue((at,), (json.dumps(before + more),))
        for at in times:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = int(expiredTimerInfo.getExpiryTimeInMs())
        rows = []
        if self.waiting.containsKey((at,)):
            rows = json.loads(self.waiting.getValue((at,))[0])
            self.waiting.removeKey((at,))
        rows.sort(key=lambda r: (r["req"] is None, r["req"] or 0))
        yield from self.decide(key, at, rows)

    def close(self) -> None:
        pass


class AgentBook(_InOrder):
    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.agent = handle.getValueState("agent", "state STRING, last_seen BIGINT")
        self.paths = handle.getMapState("paths", "path STRING", "req BIGINT")

    def timers(self, row: dict) -> tuple[int, ...]:
        return (row["at"] + self.timeout_ms + 1,) if row["kind"] in ("register", "beat") else ()

    def decide(self, key, at, rows) -> Iterator[pd.DataFrame]:
        state, seen = self.agent.get() if self.agent.exists() else (None, 0)
        out: list[tuple] = []

        def say(kind: str, path=None, req=None, ttl=None) -> None:
            out.append((int(key[0]), path, req, kind, ttl, pd.Timestamp(at, unit="ms"), at))

        def let_go() -> None:
            for (path,), (req,) in list(self.paths.iterator()):
                say("release", path, req)
            self.paths.clear()

        for row in rows:
            kind = row["kind"]
            if kind == "register":
                state, seen = "active", at
                say("registered")
            elif state is None or state == "departed":
                if kind == "request":
                    say("refused", row["path"], row["req"], row["ttl_ms"])
            elif kind == "beat":
                if state == "crashed":
                    say("recovered")
                state, seen = "active", at
            elif kind == "request":
                self.paths.updateValue((row["path"],), (row["req"],))
                say("request", row["path"], row["req"], row["ttl_ms"])
            elif kind == "release":
                say("release", row["path"], row["req"])
            elif kind == "depart":
                state = "departed"
                let_go()
                say("departed")
        if state == "active" and at - seen > self.timeout_ms:
            state = "crashed"
            let_go()
            say("crashed")
        if state is not None:
            self.agent.update((state, seen))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in AGENT_ROW.split(", ")])


class LeaseBook(_InOrder):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.holder = handle.getValueState("holder", "agent_id BIGINT, expiry BIGINT")

    def timers(self, row: dict) -> tuple[int, ...]:
        return (row["at"] + (row["ttl_ms"] or 0),) if row["kind"] == "request" else ()

    def decide(self, key, at, rows) -> Iterator[pd.DataFrame]:
        holder, expiry = self.holder.get() if self.holder.exists() else (None, 0)
        out: list[tuple] = []
        if holder is not None and expiry <= at:
            out.append((key[0], None, holder, "expired", expiry, expiry))
            holder = None
        for row in rows:
            agent, kind = row["agent_id"], row["kind"]
            if kind == "release":
                if holder == agent:
                    out.append((key[0], row["req"], agent, "released", at, None))
                    holder = None
            elif kind == "request" and holder in (None, agent):
                holder, expiry = agent, at + (row["ttl_ms"] or 0)
                out.append((key[0], row["req"], agent, "granted", at, expiry))
            elif kind in ("request", "refused"):
                out.append((key[0], row["req"], agent, "refused", at, None))
        if holder is not None:
            self.holder.update((holder, expiry))
        else:
            self.holder.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LEASE_ROW.split(", ")]).astype({"req": "Int64", "expiry": "Int64"})


def with_times(events: DataFrame) -> DataFrame:
    return events.withColumn("at_ms", F.unix_millis("at"))


def agent_book(events: DataFrame, timeout_ms: int) -> DataFrame:
    """What becomes of agents, and their requests and releases in the order of time.

    ``events`` is a stream with a watermark on ``at``, and the session's state store provider must be
    RocksDB (``build_session`` sets it).  Rows later than the watermark are not decided, and the newest
    rows wait until a later one moves it.  Rows without an agent or a time belong to nobody and are
    left out.
    """
    rows = with_times(events).where("agent_id is not null and at is not null")
    return rows.groupBy("agent_id").transformWithStateInPandas(
        AgentBook(timeout_ms), AGENT_ROW, "Append", "EventTime", eventTimeColumnName="at"
    )


def lease_book(events: DataFrame, timeout_ms: int) -> DataFrame:
    """Outcome of every request, and every lease that is released or runs out."""
    asked = agent_book(events, timeout_ms).where("path is not null")
    return asked.groupBy("path").transformWithStateInPandas(LeaseBook(), LEASE_ROW, "Append", "EventTime")
