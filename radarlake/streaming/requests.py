"""Latest request wins, as a stream and as a worker.

Requests carry a serial that only grows. A newer one supersedes those before it; work
for an older one is cancelled and publishes nothing.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(requests: DataFrame, by: str = "viewer") -> DataFrame:
    """(by, serial, request): of each viewer, the request of the highest serial. Works on streams in update mode."""
    return requests.groupBy(by).agg(F.max("serial").alias("serial"), F.max_by("request", "serial").alias("request"))


def latest_in_windows(requests: DataFrame, window: str = "10 seconds", delay: str = "30 seconds", by: str = "viewer", ts: str = "ts") -> DataFrame:
    """The same for each time window, with late data dropped after ``delay`` so that state is bounded."""
    return requests.withWatermark(ts, delay).groupBy(F.window(ts, window), by).agg(F.max("serial").alias("serial"), F.max_by("request", "serial").alias("request"))


class PageWorker:
    """One page at a time; a newer request interrupts the running one.

    While the foreground is active, no background page is started.
    """

    def __init__(self, spark: SparkSession, build: Callable[[Any], Any]):
        self._spark, self._build = spark, build
        self._lock, self._serial, self._done = threading.Lock(), 0, None
        self._thread: threading.Thread | None = None
        self._idle = threading.Event()
        self._idle.set()

    def foreground(self, active: bool) -> None:
        if active:
            self._idle.clear()
        else:
            self._idle.set()

    def _tag(self, serial: int) -> str:
        return f"page-{id(self)}-{serial}"

    def request(self, what: Any) -> int:
        with self._lock:
            self._spark.interruptTag(self._tag(self._serial))
            self._serial += 1
            serial, self._done = self._serial, None
        before = self._thread

        def run() -> None:
            if before is not None:
                before.join()
            self._idle.wait()
            with self._lock:
                if serial != self._serial:
                    return
            self._spark.addTag(self._tag(serial))
            try:
                result, error = self._build(what), None
            except Exception as e:  # handed to whoever takes the completion
                result, error = None, e
            finally:
                self._spark.removeTag(self._tag(serial))
            with self._lock:
                if serial == self._serial:
                    self._done = (serial, result, error)

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()
        return serial

    def supersede(self) -> None:
        """Drop what is running and what is done."""
        with self._lock:
            self._spark.interruptTag(self._tag(self._serial))
            self._serial += 1
            self._done = None

    def take(self, timeout: float | None = None) -> tuple[int, Any] | None:
        """(serial, result) of the latest request once it is there; errors are raised."""
        if self._thread is not None:
            self._thread.join(timeout)
        with self._lock:
            done, self._done = self._done, None
        if done is None:
            return None
        if done[2] is not None:
            raise done[2]
        return done[0], done[1]
