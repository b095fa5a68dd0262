"""Progress of Spark jobs, told to a callback while they run."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import SparkSession

T = TypeVar("T")


def with_progress(spark: SparkSession, action: Callable[[], T], callback: Callable[[int, int], None], interval: float = 0.2) -> T:
    """Run the action (such as writing a frame of pairs) and call callback(done, total) with the tasks of its jobs so far:
    never less done than before, and at the end done == total.  An error of the callback cancels the jobs."""
    sc, group = spark.sparkContext, f"progress-{uuid.uuid4().hex}"
    result: list[T] = []
    failure: list[BaseException] = []

    def work() -> None:
        sc.setJobGroup(group, "with progress", interruptOnCancel=True)
        try:
            result.append(action())
        except BaseException as e:  # noqa: BLE001  raised again by the caller's thread
            failure.append(e)

    def look() -> tuple[int, int]:
        done = total = 0
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                s = tracker.getStageInfo(stage)
                done += s.numCompletedTasks if s else 0
                total += s.numTasks if s else 0
        return done, total

    tracker, most = sc.statusTracker(), 0
    thread = InheritableThread(target=work)
    thread.start()
    try:
        while thread.is_alive():
            done, total = look()
            most = max(most, done)
            if total:
                callback(most, max(total, most))
            thread.join(interval)
    except BaseException:
        sc.cancelJobGroup(group)
        thread.join()
        raise
    if failure:
        raise failure[0]
    total = max(1, most, look()[1])
    callback(total, total)
    return result[0]
