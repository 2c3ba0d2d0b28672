"""Requests with a limit of time."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

Result = TypeVar("Result")
#: Seconds between two interrupts of a request that is over its limit: what it starts after the first is stopped by the next.
AGAIN = 0.2


class OverLimit(TimeoutError):
    """A request took longer than it may."""


def limited(spark: SparkSession, seconds: float, work: Callable[[], Result]) -> Result:
    """What work() returns, or OverLimit where its jobs still run after so many seconds.

    The calling thread's jobs carry a tag of their own, by which they are interrupted; those of other requests
    run on. Errors of work within its time are its own. Time that work spends outside Spark cannot be interrupted.
    """
    context = spark.sparkContext
    tag, done, late = f"request-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.set()
            context.cancelJobsWithTag(tag)
            while not done.wait(AGAIN):
                context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        return work()
    except Exception as error:
        if late.is_set():
            raise OverLimit(f"the request took more than {seconds} s") from error
        raise
    finally:
        done.set()
        context.removeJobTag(tag)
        watcher.join()
