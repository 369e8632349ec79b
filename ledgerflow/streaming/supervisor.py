"""Keep a sync query running: restart it after failures, stop it between batches.

A failed query is started again from its checkpoint after a delay that doubles
with each failure in a row, up to ``longest_delay``. A ``BatchWatch`` listens
to the query's events: a batch that commits ends the row of failures, and the
failure's text is what the query's end event says. Each failure becomes a row
of the sync log, under the batch that was not committed.

A stop request (``StopGate.request``, e.g. from a signal handler) lets the
running micro-batch write, log and commit. A batch that begins afterwards is
turned away at the gate before it has written anything; the next start runs it.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ledgerflow.operators.sync_log import log_failure

FIRST_DELAY = 1.0
LONGEST_DELAY = 300.0
# How long to wait for a query's end event, which comes on another thread.
EVENT_WAIT = 10.0
POLL = 0.2


class StopRequested(Exception):
    """A batch that began after the request to stop; it has written nothing."""


class StopGate:
    """Every batch passes it before it does anything."""

    def __init__(self) -> None:
        self._stop = threading.Event()
        self.entered = -1  # the last batch that began

    def request(self) -> None:
        self._stop.set()

    @property
    def requested(self) -> bool:
        return self._stop.is_set()

    def wait(self, seconds: float) -> bool:
        """Wait for a request; True if there is one."""
        return self._stop.wait(seconds)

    def enter(self, batch_id: int) -> None:
        self.entered = batch_id
        if self.requested:
            raise StopRequested(f"batch {batch_id} is left to the next start")


class BatchWatch(StreamingQueryListener):
    """The committed batches of one query (over all its starts), and the text of its last failure."""

    def __init__(self) -> None:
        self.query_id: str | None = None
        self.run_id: str | None = None
        self.committed = -1
        self.in_this_run = 0
        self.error: str | None = None
        self._ended = threading.Event()

    def follow(self, query: StreamingQuery) -> None:
        self.query_id, self.run_id = str(query.id), str(query.runId)
        self.in_this_run, self.error = 0, None
        self._ended.clear()

    def ended(self) -> bool:
        """Wait for the end event of the run that is followed."""
        return self._ended.wait(EVENT_WAIT)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if str(progress.id) != self.query_id:
            return
        # Idle triggers report the batch to come, without having run it.
        if progress.numInputRows or progress.batchId <= self.committed:
            self.committed = max(self.committed, int(progress.batchId))
            self.in_this_run += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run_id:
            self.error = event.exception
            self._ended.set()


@dataclass
class Outcome:
    """How a supervised query ended."""

    starts: int = 0
    failures: int = 0
    delays: list[float] = field(default_factory=list)
    stopped: bool = False


def _short(error: object) -> str:
    """The line of an error's text that says what happened: Python's own exception if it has one, else the first."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    own = [line for line in lines if ": " in line and line.split(": ")[0].rpartition(".")[2].endswith(("Error", "Exception"))]
    return (own[-1] if own else lines[0] if lines else type(error).__name__)[:500]


def _wait(query: StreamingQuery, gate: StopGate) -> Exception | None:
    """Wait until the query ends, or a stop finds it between batches; what made it fail."""
    try:
        while not query.awaitTermination(POLL):
            if gate.requested and not query.status["isTriggerActive"]:
                query.stop()  # nothing is running; a batch that begins meanwhile is turned away
                return None
    except Exception as failed:  # noqa: BLE001 - whatever ended the query is retried
        return failed
    return None


def run_supervised(
    spark: SparkSession,
    start: Callable[[StopGate], StreamingQuery],
    gate: StopGate | None = None,
    log: tuple[str, str, T.DataType] | None = None,
    first_delay: float = FIRST_DELAY,
    longest_delay: float = LONGEST_DELAY,
    max_failures: int | None = None,
) -> Outcome:
    """Run ``start(gate)`` until it ends by itself or a stop is requested, starting it again after failures.

    ``log`` is (log path, run, key type): failures become rows of it. After
    ``max_failures`` in a row the last one is raised; without it there is no end
    to the attempts, as with a loop that tries again in the next cycle.
    """
    gate, watch, outcome = gate or StopGate(), BatchWatch(), Outcome()
    spark.streams.addListener(watch)
    in_a_row = 0
    try:
        while not gate.requested:
            outcome.starts += 1
            try:
                query = start(gate)
            except Exception as failed:  # noqa: BLE001 - e.g. a source that is not there yet
                error, text = failed, _short(failed)
            else:
                watch.follow(query)
                error = _wait(query, gate)
                if error is None or gate.requested:
                    break
                watch.ended()
                text = _short(watch.error or error)
                if watch.in_this_run:
                    in_a_row = 0
            in_a_row += 1
            outcome.failures += 1
            if log is not None:
                log_path, run, key_type = log
                log_failure(spark, log_path, run, max(watch.committed + 1, gate.entered), text, key_type)
            if max_failures is not None and in_a_row >= max_failures:
                raise error
            outcome.delays.append(min(longest_delay, first_delay * 2 ** min(in_a_row - 1, 60)))
            gate.wait(outcome.delays[-1])
    finally:
        spark.streams.removeListener(watch)
    outcome.stopped = gate.requested
    return outcome
