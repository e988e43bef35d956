"""Submit independent Spark jobs side by side, so that a small stage does not leave the cluster idle."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def together(spark: SparkSession, *calls: Callable) -> list:
    """Results of the calls in order; the first error is raised."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(c)) for c in calls]]
