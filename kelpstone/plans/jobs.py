"""Several Spark jobs at a time from one driver: first come, first served, each with a future; leaving waits for all."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any


class Jobs:
    def __init__(self, workers: int = 4):
        self.pool = ThreadPoolExecutor(workers, thread_name_prefix="kelpstone")

    def __enter__(self) -> Jobs:
        return self

    def __exit__(self, *_) -> None:
        self.pool.shutdown(wait=True)

    def submit(self, job: Callable[..., Any], *args: Any) -> Future:
        return self.pool.submit(job, *args)


def run_all(jobs: Iterable[Callable[[], Any]], workers: int = 4) -> list[Any]:
    """Results in the order of the jobs; the first failure is raised."""
    with Jobs(workers) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]
