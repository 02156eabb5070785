"""Which requests of a run are sent, as a state machine over a stream of events.

A run has ``slots`` for open batches. Requests wait in a queue; at a ``poll``,
batches of up to ``limit`` of them are opened as long as there are slots. A
``result`` completes its request, and the last one closes its batch. A ``lost``
batch frees its slot, and its requests without a result go back to the queue's
end in the same step; an ``ended`` batch frees its slot and takes back nothing.
``pause`` and ``resume`` stop and restart the sending. From ``timeout`` after
the first event on, a run sends nothing more.

All of that is keyed state of the run (RocksDB): the queue, the ids' places and
the open batches are maps, so an event costs as much in a long run as in a short
one. Events are taken by ``seq``; the log is the same however they are cut into
micro-batches, if these come in the order of ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexiweave.streaming.ledger import stateful_settings

EVENTS = "run string, seq long, at timestamp, kind string, id string, batch int"
LOG = "run string, seq long, step int, at timestamp, action string, batch int, ids array<string>"
#: Where a request is, if not in an open batch: in the queue, done, or in a batch that ended without it.
WAITING, DONE, LEFT = -1, -2, -3


@dataclass(frozen=True)
class Limits:
    """``slots`` None: any number of batches may be open."""

    slots: int | None
    limit: int
    timeout: timedelta


class Admission(StatefulProcessor):
    """The state of one run."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "started long, over boolean, paused boolean, batches int, first long, last long, open int")
        self.queue = handle.getMapState("queue", "at long", "id string")
        self.places = handle.getMapState("places", "id string", "batch int")
        self.open = handle.getMapState("open", "batch int", "ids array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        events = sorted(rows, key=lambda r: (r.seq, r.kind, r.id or "", r.batch or 0))
        if self.run.exists():
            state = list(self.run.get())
        else:
            state = [events[0].us, False, False, 0, 0, 0, 0]
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._wait_us() // 1000)
        for e in events:
            step = 0
            for action, batch, ids in self._event(state, e):
                us = self._deadline(state) if action == "timed_out" else e.us
                yield Row(run=key[0], seq=e.seq, step=step, us=us, action=action, batch=batch, ids=ids)
                step += 1
        self.run.update(tuple(state))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """A run that no event reaches any more is over as well; its log then ends with a row of ``seq`` null."""
        state = list(self.run.get())
        if not state[1]:
            state[1] = True
            self.run.update(tuple(state))
            yield Row(run=key[0], seq=None, step=0, us=self._deadline(state), action="timed_out", batch=None, ids=[])

    def close(self) -> None:
        pass

    def _wait_us(self) -> int:
        return self.limits.timeout // timedelta(microseconds=1)

    def _deadline(self, state: list) -> int:
        return state[0] + self._wait_us()

    def _place(self, id_: str) -> int | None:
        return self.places.getValue((id_,))[0] if self.places.containsKey((id_,)) else None

    def _wait(self, state: list, id_: str) -> None:
        self.places.updateValue((id_,), (WAITING,))
        self.queue.updateValue((state[5],), (id_,))
        state[5] += 1

    def _shut(self, state: list, batch: int) -> list[str]:
        """Close an open batch; the requests of it that have no result yet."""
        ids = list(self.open.getValue((batch,))[0])
        self.open.removeKey((batch,))
        state[6] -= 1
        return ids

    def _next(self, state: list) -> list[str]:
        """The next requests of the queue; those that got a result while they waited are passed over."""
        ids: list[str] = []
        while len(ids) < self.limits.limit and state[4] < state[5]:
            id_ = self.queue.getValue((state[4],))[0]
            self.queue.removeKey((state[4],))
            state[4] += 1
            if self._place(id_) == WAITING:
                ids.append(id_)
        return ids

    def _event(self, state: list, e: Row) -> Iterator[tuple[str, int | None, list[str]]]:
        """Actions that an event leads to; ``state`` is changed in place."""
        if not state[1] and e.us >= self._deadline(state):
            state[1] = True
            yield "timed_out", None, []
        if e.kind == "request" and e.id and self._place(e.id) is None:
            self._wait(state, e.id)
        elif e.kind == "result" and e.id:
            place = self._place(e.id)
            if place == DONE:
                return
            self.places.updateValue((e.id,), (DONE,))
            if place is None:
                yield "failed", None, [e.id]
                return
            yield "completed", place if place >= 0 else None, [e.id]
            if place >= 0:
                left = [i for i in self.open.getValue((place,))[0] if i != e.id]
                if left:
                    self.open.updateValue((place,), (left,))
                else:
                    self._shut(state, place)
                    yield "closed", place, []
        elif e.kind in ("lost", "ended") and e.batch is not None and self.open.containsKey((e.batch,)):
            ids = self._shut(state, e.batch)
            for id_ in ids:
                if e.kind == "lost":
                    self._wait(state, id_)
                else:
                    self.places.updateValue((id_,), (LEFT,))
            yield "requeued" if e.kind == "lost" else "closed", e.batch, ids
        elif e.kind in ("pause", "resume"):
            state[2] = e.kind == "pause"
        elif e.kind == "poll" and not state[1] and not state[2]:
            while self.limits.slots is None or state[6] < self.limits.slots:
                ids = self._next(state)
                if not ids:
                    break
                batch, state[3], state[6] = state[3], state[3] + 1, state[6] + 1
                self.open.updateValue((batch,), (ids,))
                for id_ in ids:
                    self.places.updateValue((id_,), (batch,))
                yield "submitted", batch, ids


def start_admission(spark: SparkSession, source: str, log_path: str, checkpoint: str, limits: Limits, files_per_trigger: int = 100, poll: str | None = None) -> StreamingQuery:
    """Take in the events of the JSON-lines files of ``source`` and add to the log what follows from them.

    With ``poll`` the query runs on, and a run's timeout also comes without an event.
    """
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(source).where("run is not null and seq is not null and at is not null")
    # Times are microseconds inside, as time stamps lose or gain a zone on their way through state.
    log = events.withColumn("us", F.unix_micros("at")).groupBy("run").transformWithState(Admission(limits), LOG.replace("at timestamp", "us long"), "Append", "ProcessingTime")
    log = log.select("run", "seq", "step", F.timestamp_micros("us").alias("at"), "action", "batch", "ids")
    writer = log.writeStream.format("parquet").option("path", log_path).option("checkpointLocation", checkpoint)
    with stateful_settings(spark):
        return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def run_admission(spark: SparkSession, source: str, log_path: str, checkpoint: str, limits: Limits, files_per_trigger: int = 100) -> DataFrame:
    """Take in all events there are; the log so far.

    A query with timers never runs out of batches, so it is stopped behind one without rows; the first batch may be such
    a one that was stopped before, and does not count.
    """
    query = start_admission(spark, source, log_path, checkpoint, limits, files_per_trigger)
    while not query.awaitTermination(0.2):
        done = query.recentProgress
        if len(done) > 1 and done[-1].numInputRows == 0:
            query.stop()
    return spark.read.schema(LOG).parquet(log_path)
