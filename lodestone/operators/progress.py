"""How far a build has come, from Spark's own status tracker."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass
class Progress:
    """The jobs that a thread started inside ``watched``; may be asked from any thread, while they run or later."""

    spark: SparkSession
    group: str

    def tasks(self) -> tuple[int, int]:
        """Tasks done and tasks in all, of the jobs that Spark still remembers; what an ended job skipped doesn't count."""
        tracker = self.spark.sparkContext.statusTracker()
        done = all_ = 0
        for job in filter(None, map(tracker.getJobInfo, tracker.getJobIdsForGroup(self.group))):
            for stage in filter(None, map(tracker.getStageInfo, job.stageIds)):
                done += stage.numCompletedTasks
                all_ += stage.numTasks if job.status == "RUNNING" else stage.numCompletedTasks
        return done, all_

    def fraction(self) -> float:
        done, all_ = self.tasks()
        return done / all_ if all_ else 0.0


@contextmanager
def watched(spark: SparkSession, what: str = "index") -> Iterator[Progress]:
    """Jobs that this thread runs inside belong to one group, whose progress can be asked for."""
    sc, group = spark.sparkContext, f"{what}-{uuid.uuid4().hex}"
    before = sc.getLocalProperty("spark.jobGroup.id"), sc.getLocalProperty("spark.job.description")
    sc.setJobGroup(group, what)
    try:
        yield Progress(spark, group)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", before[0])
        sc.setLocalProperty("spark.job.description", before[1])
