"""A computation that can be watched and stopped: its Spark jobs run as one group."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from enum import Enum
from typing import Any

from pyspark.sql import SparkSession


class State(Enum):
    NOT_RUNNING = "not running"
    RUNNING = "running"
    PENDING_ABORTION = "pending abortion"
    ABORTED = "aborted"
    FINISHED = "finished"


class Computation:
    """Runs a function once at a time; listeners hear (old, new) states. An abort cancels the jobs and is no error.

    Other errors of the function pass through, after the state has gone to ABORTED.
    """

    def __init__(self, spark: SparkSession, work: Callable[[], Any]):
        self.spark, self.work = spark, work
        self.state, self.result = State.NOT_RUNNING, None
        self.listeners: list[Callable[[State, State], None]] = []
        self._group, self._lock = f"graphloom-{uuid.uuid4().hex}", threading.Lock()

    def _go(self, to: State, only_from: tuple[State, ...] | None = None) -> bool:
        with self._lock:
            if only_from is not None and self.state not in only_from:
                return False
            old, self.state = self.state, to
        for f in self.listeners:
            f(old, to)
        return True

    def compute(self) -> Any:
        if not self._go(State.RUNNING, (State.NOT_RUNNING, State.ABORTED, State.FINISHED)):
            raise RuntimeError("the computation is running")
        self.result = None
        sc = self.spark.sparkContext
        sc.setJobGroup(self._group, "graphloom", interruptOnCancel=True)
        try:
            self.result = self.work()
        except Exception:
            stopped = self.state is State.PENDING_ABORTION
            self._go(State.ABORTED)
            if not stopped:
                raise
        else:
            self._go(State.ABORTED if self.state is State.PENDING_ABORTION else State.FINISHED)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        return self.result

    def abort(self) -> None:
        if self._go(State.PENDING_ABORTION, (State.RUNNING,)):
            self.spark.sparkContext.cancelJobGroup(self._group)
