"""Delivery with retries: what is sent, what the receiver says, and when to offer it again.

A key's row is offered once; an answer settles only the version that was sent, so that a row replaced meanwhile is offered again. A
failure is offered again after the next of `DELAYS_MS`, a refusal (403) after `REFUSED_MS`; after the last try the row stays, and
any later version of it starts anew. Rows of a key, answers and timers meet in one state a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Waits after the first and second failure, and after a refusal.
DELAYS_MS, REFUSED_MS, REFUSED = (5_000, 30_000), 120_000, 403
STATE = "version long, payload string, sent long, failures int, due long, refused boolean"
OFFER = "version long, payload string, attempt int"


@dataclass(frozen=True)
class Held:
    """A row that waits; sent: the version that is on its way, due: when it is offered again (-1: not)."""

    version: int
    payload: str | None
    sent: int = -1
    failures: int = 0
    due: int = -1
    refused: bool = False


def offered(held: Held) -> tuple[Held, tuple]:
    return replace(held, sent=held.version, due=-1), (held.version, held.payload, held.failures + 1)


def row_came(held: Held | None, version: int, payload: str | None) -> tuple[Held, tuple | None]:
    """A newer version replaces what waits; it is offered at once unless one is on its way or a wait is running."""
    if held is not None and version <= held.version:
        return held, None
    if held is None or (held.sent < 0 and held.due < 0):
        return offered(Held(version, payload))
    return replace(held, version=version, payload=payload), None


def answer_came(held: Held | None, version: int, status: int, now: int) -> tuple[Held | None, tuple | None]:
    """A success ends the row if it was its last version, else that one is offered; an answer to what was not sent says nothing."""
    if held is None or held.sent != version:
        return held, None
    if 200 <= status < 300:
        return offered(Held(held.version, held.payload)) if held.version > version else (None, None)
    failures = held.failures + 1
    if status == REFUSED and not held.refused:
        return replace(held, sent=-1, failures=failures, due=now + REFUSED_MS, refused=True), None
    if failures <= len(DELAYS_MS):
        return replace(held, sent=-1, failures=failures, due=now + DELAYS_MS[failures - 1]), None
    return (offered(Held(held.version, held.payload))) if held.version > version else (replace(held, sent=-1, failures=failures), None)


def time_came(held: Held | None, now: int) -> tuple[Held | None, tuple | None]:
    if held is None or held.due < 0 or now < held.due:
        return held, None
    return offered(held)


class _Outbox(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("held", STATE)

    def _held(self) -> Held | None:
        return Held(*self.state.get()) if self.state.exists() else None

    def _keep(self, held: Held | None) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if held is None:
            self.state.clear()
            return
        self.state.update((held.version, held.payload, held.sent, held.failures, held.due, held.refused))
        if held.due >= 0:
            self.handle.registerTimer(held.due)

    def _said(self, key: tuple, offers: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *o) for o in offers], columns=["key", "version", "payload", "attempt"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, offers, now = self._held(), [], timerValues.getCurrentProcessingTimeInMs()
        for part in rows:
            for kind, version, payload, status in zip(part["kind"], part["version"], part["payload"], part["status"], strict=True):
                held, offer = row_came(held, int(version), payload) if kind == "row" else answer_came(held, int(version), int(status), now)
                offers += [offer] if offer else []
        self._keep(held)
        if offers:
            yield self._said(key, offers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, offer = time_came(self._held(), expiredTimerInfo.getExpiryTimeInMs())
        self._keep(held)
        if offer:
            yield self._said(key, [offer])

    def close(self) -> None:
        pass


def offers(events: DataFrame) -> DataFrame:
    """key, version, payload, attempt: what is to be sent now. events: key, kind ('row' or 'answer'), version, payload, status.

    Null keys are no records. Processing time; needs the RocksDB state store.
    """
    kind = events.schema["key"].dataType.simpleString()
    fine = events.where("key is not null").select("key", "kind", "version", "payload", "status")
    return fine.groupBy("key").transformWithStateInPandas(_Outbox(), f"key {kind}, {OFFER}", "Append", "ProcessingTime")
