"""How far a scan is: jobs of one group, their tasks done, and a bounded record of it."""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import SparkSession


@dataclass
class Progress:
    """status (running, done, failed), percent of the tasks known so far that are done, and the last `most` states as (seconds, percent)."""

    most: int = 50
    status: str = "running"
    percent: int = 0
    tasks: int = 0
    done: int = 0
    error: str = ""
    ring: deque = field(default_factory=deque)

    def __post_init__(self):
        self.ring = deque(maxlen=self.most)


def _tasks(spark: SparkSession, group: str) -> tuple[int, int]:
    tracker, done, all_ = spark.sparkContext.statusTracker(), 0, 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            if s := tracker.getStageInfo(stage):
                done, all_ = done + s.numCompletedTasks, all_ + s.numTasks
    return done, all_


def watched(spark: SparkSession, action: Callable[[], object], on_progress: Callable[[Progress], None] = lambda p: None, every: float = 0.2, most: int = 50) -> tuple[object, Progress]:
    """Runs action() as a group of jobs and calls on_progress whenever its percentage rises. Returns what it returned and the last state.

    The percentage never falls: later jobs add tasks, so it stands still until they have caught up. It is 100 once the action has ended.
    """
    group, state, out = uuid.uuid4().hex, Progress(most), []

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "a scan", interruptOnCancel=True)
        try:
            out.append(action())
        except Exception as x:  # handed on below
            out.append(x)

    thread, began = InheritableThread(target=run), time.time()
    thread.start()
    while thread.is_alive():
        thread.join(every)
        state.done, state.tasks = _tasks(spark, group)
        now = min(99, 100 * state.done // max(state.tasks, 1))
        if now > state.percent:
            state.percent = now
            state.ring.append((time.time() - began, now))
            on_progress(state)
    failed = out and isinstance(out[0], Exception)
    state.status, state.percent = ("failed", state.percent) if failed else ("done", 100)
    state.error = str(out[0]) if failed else ""
    state.ring.append((time.time() - began, state.percent))
    on_progress(state)
    if failed:
        raise out[0]
    return out[0], state
