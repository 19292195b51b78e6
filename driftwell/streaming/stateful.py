"""Keyed state with timers: reaction states of delivered tokens, and notices of changes that a reader has not seen yet.

State lives in the state store, a key at a time, and leaves it when its event-time timer fires. What goes out are
corrections: a key's later row restates an earlier one, and ``last_states`` keeps the newest of each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from driftwell.operators.feedback import BURST_S, BUTTONS, PREFETCH_S

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` whose streams keep their state in the store that timers need; ``spark`` stays as it is."""
    out = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        out.conf.set(name, spark.conf.get(name))
    out.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return out


def last_states(table: DataFrame, key: str | list[str]) -> DataFrame:
    """The newest row of each key of an update stream's table (``streams.run_to_table``), without the bookkeeping columns."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in table.columns if c not in (*keys, "version", "_epoch")]
    newest = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_epoch", "version")).alias("_last"))
    return newest.select(*keys, "_last.*")


SECOND = 1_000_000


def press_states(presses: list[tuple], delivered: int | None, expires: int | None) -> list[str]:
    """Statuses of a token's presses (microsecond, action), sorted by time, no two equal; the rules of ``reaction_states``."""
    first = []
    for at, action in presses:
        if expires is None:
            first.append("unknown")
        elif at > expires:
            first.append("expired")
        elif action == "undo":
            first.append("undo")
        else:
            first.append("prefetch" if delivered is not None and 0 <= at - delivered < PREFETCH_S * SECOND else "valid")
    out, lo, k, near = list(first), 0, 0, Counter()
    pressed = [(*presses[i], i) for i, s in enumerate(first) if s in ("valid", "prefetch")]
    while k < len(pressed):
        at, closes = pressed[k][0], False
        while k < len(pressed) and pressed[k][0] == at:
            near[pressed[k][1]] += 1
            closes |= first[pressed[k][2]] == "valid"
            k += 1
        while at - pressed[lo][0] > BURST_S * SECOND:
            near[pressed[lo][1]] -= 1
            lo += 1
        if closes and len(+near) >= BUTTONS:
            for *_, i in pressed[lo:k]:
                out[i] = "burst"
    undone = max((at for (at, _), s in zip(presses, first, strict=True) if s == "undo"), default=None)
    return ["cancelled" if s == "valid" and undone is not None and undone >= at else s for (at, _), s in zip(presses, out, strict=True)]


class ReactionStates(StatefulProcessor):
    """A token's presses until its expiry, ``BURST_S`` seconds and no later press; each batch tells what changed.

    All of a token's state is one value, read and written once a batch: each call of the store costs more than many presses.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "version long, timer long, presses array<struct<at:long,action:string,event_id:string,status:string>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        version, timer, presses = self.seen.get() or (0, None, [])
        held = {(p[0], p[1]): [p[2], p[3]] for p in presses}
        said, delivered, expires, latest = {}, None, None, None
        for r in rows:
            version += 1
            delivered, expires = r.delivered, r.expires
            latest = r.at if latest is None else max(latest, r.at)
            mine = held.setdefault((r.at, r.action), [r.event_id, None])
            if r.event_id != mine[0]:  # the same press told twice: the smaller id is the press, the other repeats it
                said[max(mine[0], r.event_id)] = "duplicate"
                if r.event_id < mine[0]:
                    mine[0], mine[1] = r.event_id, None
        keys = sorted(held, key=lambda k: (k[0], k[1] or ""))
        for k, status in zip(keys, press_states(keys, delivered, expires), strict=True):
            if held[k][1] != status:
                held[k][1] = status
                said[held[k][0]] = status
        ends = max(latest, expires or latest) + BURST_S * SECOND
        due = max(ends // 1000 + 1, timer or 0)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.seen.update((version, due, [(*k, *held[k]) for k in keys]))
        for event_id, status in said.items():
            yield Row(event_id=event_id, tid=key[0], status=status, version=version)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def reaction_stream(events: DataFrame, tokens: DataFrame, lateness: str = "5 minutes") -> DataFrame:
    """(event_id, tid, status, version) for a stream of (event_id, tid, action, received_at), with corrections.

    Statuses are those of ``reaction_states``. Tokens are met by a join of the stream with their table, which Spark
    broadcasts only where it has found it small. A token's state goes ``BURST_S`` seconds after its expiry, or after its
    last press if that is later; rows later than ``lateness`` are dropped, so no press can need the state any more.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    known = tokens.select("tid", micros("delivered_at").alias("delivered"), micros("expires_at").alias("expires"))
    rows = events.select("event_id", "tid", "action", "received_at", micros("received_at").alias("at")).withWatermark("received_at", lateness).join(known, "tid", "left")
    return rows.groupBy("tid").transformWithState(ReactionStates(), f"event_id string, tid {dict(events.dtypes)['tid']}, status string, version long", "Update", "EventTime")


def _ordered(axes: dict) -> list[tuple[str, str]]:
    """The values of a map in an order of their own, null before all others."""
    return sorted((k, "" if v is None else f"'{v}") for k, v in axes.items())


class ChangeNotices(StatefulProcessor):
    """The newest state of an entity for a reader and the newest one they acknowledged; silent keys leave after a while.

    Both are one value of the store, read and written once a batch.
    """

    def __init__(self, axes: list[str], keys: list[str], keep_ms: int) -> None:
        self.axes, self.keys, self.keep_ms = axes, keys, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        held = "struct<at:long,axes:map<string,string>>"
        self.said = handle.getValueState("said", f"version long, timer long, pending array<string>, first boolean, state {held}, sent {held}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        version, timer, before, was, *held = self.said.get() or (0, None, None, None, None, None)
        kinds, latest = {kind: v and tuple(v) for kind, v in zip(("state", "sent"), held, strict=True)}, None
        for r in rows:
            version += 1
            latest = r.micros if latest is None else max(latest, r.micros)
            mine, axes = kinds[r.kind], dict(r.axes or {})
            if mine is None or (r.micros, _ordered(axes)) > (mine[0], _ordered(mine[1])):
                kinds[r.kind] = (r.micros, axes)
        now, sent = kinds["state"], kinds["sent"]
        pending = [] if now is None else [a for a in self.axes if sent is None or now[1].get(a) != sent[1].get(a)]
        due = max(latest // 1000 + self.keep_ms, timer or 0)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.said.update((version, due, pending, sent is None, now, sent))
        if pending != list(before or []) or pending and was != (sent is None):
            yield Row(**dict(zip(self.keys, key, strict=True)), changed=pending, first=sent is None, version=version)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.said.clear()
        return iter(())

    def close(self) -> None:
        pass


def change_notices(rows: DataFrame, keys: list[str], axes: list[str], at: str = "at", lateness: str = "1 day", keep_days: int = 90) -> DataFrame:
    """(keys, changed, first, version): the axes in which an entity differs from what its reader acknowledged.

    ``rows`` has the keys, ``kind`` (``state`` for an observation, ``sent`` for the state that a reader acknowledged), ``at``
    and ``axes``, a map of values. A row says what is pending now: an acknowledgement of the present state takes the notice
    back with an empty list. ``first`` marks entities that were never sent, all of whose axes are new. Rows may come in any
    order within the lateness; of each kind the newest counts. A key that is silent for ``keep_days`` is forgotten.
    """
    schema = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys) + ", changed array<string>, first boolean, version long"
    rows = rows.select(*keys, "kind", F.col(at).alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("micros"), "axes").withWatermark("at", lateness)
    return rows.groupBy(*keys).transformWithState(ChangeNotices(axes, keys, keep_days * 86_400_000), schema, "Update", "EventTime")
