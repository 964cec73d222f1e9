"""One heavy job at a time, with its own cancel and pause marks."""

from __future__ import annotations

import re
import threading
import time
from contextlib import contextmanager


class Cancelled(RuntimeError):
    """The job was cancelled; there is no partial result."""


#: Seconds between two events of one phase.
PROGRESS_SECONDS = 0.25


class Job:
    """listener: called with an event (job, phase, counters) at each change of phase, and else at most every PROGRESS_SECONDS. Events hold no names of files."""

    def __init__(self, job_id: str, listener=None) -> None:
        self.id, self._cancelled, self._paused, self._listener = job_id, threading.Event(), threading.Event(), listener
        self._phase, self._told = None, 0.0

    @property
    def cancelled(self) -> bool:
        return self._cancelled.is_set()

    def progress(self, phase: str, **counters: int) -> None:
        if self._listener is not None and (phase != self._phase or time.monotonic() - self._told >= PROGRESS_SECONDS * 0.99):
            self._phase, self._told = phase, time.monotonic()
            self._listener({"jobId": self.id, "phase": phase, **counters})

    def check(self, phase: str | None = None, **counters: int) -> None:
        """Tell of a phase, if one is given; wait while paused; raise Cancelled if cancelled."""
        if phase is not None:
            self.progress(phase, **counters)
        while self._paused.is_set() and not self._cancelled.is_set():
            time.sleep(0.05)
        if self._cancelled.is_set():
            raise Cancelled(self.id)


@contextmanager
def watched(job: Job | None, spark, phase: str, *counters: str):
    """Accumulators, one for each name, that tasks may add to; while the block runs, a thread tells the job of their sums, at most every PROGRESS_SECONDS and only when they have changed.
    Spark hands sums over as tasks end. Nones without a job."""
    if job is None:
        yield (None,) * len(counters)
        return
    sums, ended = tuple(spark.sparkContext.accumulator(0) for _ in counters), threading.Event()

    def tell() -> None:
        told = None
        while not ended.wait(PROGRESS_SECONDS):
            now = tuple(s.value for s in sums)
            if now != told:
                told = now
                job.progress(phase, **dict(zip(counters, now, strict=True)))

    thread = threading.Thread(target=tell, daemon=True)
    job.check(phase, **{c: 0 for c in counters})
    thread.start()
    try:
        yield sums
    finally:
        ended.set()
        thread.join()
    job.check()


class Jobs:
    """Registry of the session's active job. Spark jobs run under the tag of its id; cancelling interrupts their tasks, and Spark ends the Python workers of these."""

    def __init__(self, spark=None, listener=None) -> None:
        self._lock, self._active, self._spark, self._listener = threading.Lock(), None, spark, listener

    @contextmanager
    def run(self, job_id: str):
        if not re.fullmatch(r"[A-Za-z0-9-]{8,100}", job_id):
            raise ValueError("a job id has 8 to 100 letters, digits or hyphens")
        with self._lock:
            if self._active is not None:
                raise RuntimeError("another job is running")
            self._active = job = Job(job_id, self._listener)
        if self._spark is not None:
            self._spark.sparkContext.addJobTag(job_id)
            self._spark.sparkContext.setInterruptOnCancel(True)
        try:
            yield job
        finally:
            if self._spark is not None:
                self._spark.sparkContext.removeJobTag(job_id)
                self._spark.sparkContext.setInterruptOnCancel(False)
            with self._lock:
                self._active = None

    def _of(self, job_id: str) -> Job | None:
        with self._lock:
            return self._active if self._active is not None and self._active.id == job_id else None

    def cancel(self, job_id: str) -> bool:
        if (job := self._of(job_id)) is None:
            return False
        job._cancelled.set()
        if self._spark is not None:
            self._spark.sparkContext.cancelJobsWithTag(job_id)
        return True

    def pause(self, job_id: str) -> bool:
        return (job := self._of(job_id)) is not None and not job._paused.set()

    def resume(self, job_id: str) -> bool:
        return (job := self._of(job_id)) is not None and not job._paused.clear()
