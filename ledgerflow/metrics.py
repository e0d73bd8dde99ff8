"""Timings of the stages of operations, handed to whoever wants them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass


@dataclass
class StageTiming:
    operation: str
    stage: str
    seconds: float = 0.0
    count: int = 0
    attempt: int = 1
    error: bool = False


Recorder = Callable[[StageTiming], None]


@contextmanager
def stage(recorder: Recorder | None, operation: str, name: str, attempt: int = 1) -> Iterator[StageTiming]:
    """Time a block; it may set `count`. The recorder is told also of a block that raises, whose error goes on.

    Frames are lazy, so a stage's time is that of the actions in it.
    """
    timing, start = StageTiming(operation, name, attempt=attempt), time.perf_counter()
    try:
        yield timing
    except BaseException:
        timing.error = True
        raise
    finally:
        timing.seconds = time.perf_counter() - start
        if recorder:
            recorder(timing)
