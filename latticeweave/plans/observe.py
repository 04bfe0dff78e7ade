"""Messages with levels, and seconds by stage."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

ERRORS, WARNINGS, STATUS, DEBUG = 1, 2, 4, 8


class Logger:
    """Messages of the levels that are on. Status messages have a depth, too: those at the threshold or beyond are left out, and each depth is indented.

    Messages go to Python's logging under the name "latticeweave".
    """

    _LEVELS = {ERRORS: logging.ERROR, WARNINGS: logging.WARNING, STATUS: logging.INFO, DEBUG: logging.DEBUG}

    def __init__(self, levels: int = ERRORS | WARNINGS, status_threshold: int = 1, sink: logging.Logger | None = None):
        self.levels, self.status_threshold = levels, status_threshold
        self.sink = sink or logging.getLogger("latticeweave")
        self.depth = 0

    def _say(self, level: int, message: str, *args) -> None:
        if self.levels & level:
            self.sink.log(self._LEVELS[level], message, *args)

    def error(self, message: str, *args) -> None:
        self._say(ERRORS, "ERROR: " + message, *args)

    def warning(self, message: str, *args) -> None:
        self._say(WARNINGS, "WARNING: " + message, *args)

    def debug(self, message: str, *args) -> None:
        self._say(DEBUG, message, *args)

    def status(self, message: str, *args) -> None:
        if self.depth < self.status_threshold:
            self._say(STATUS, "  " * self.depth + message, *args)

    @contextmanager
    def deeper(self) -> Iterator[None]:
        self.depth += 1
        try:
            yield
        finally:
            self.depth -= 1


@dataclass
class Profile:
    """Seconds by stage, in the order of their first use. Stages that materialise their rows are timed in full; lazy ones until their plan stands."""

    logger: Logger = field(default_factory=Logger)
    seconds: dict[str, float] = field(default_factory=dict)
    calls: dict[str, int] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        self.logger.status("%s...", name)
        began = time.perf_counter()
        try:
            with self.logger.deeper():
                yield
        finally:
            took = time.perf_counter() - began
            self.seconds[name] = self.seconds.get(name, 0.0) + took
            self.calls[name] = self.calls.get(name, 0) + 1
            self.logger.status("Done with %s (%.2f s)", name, took)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, self.calls[n], s) for n, s in self.seconds.items()], "stage string, calls int, seconds double")

    def text(self) -> str:
        """One line for each stage: name, calls and seconds."""
        width = max((len(n) for n in self.seconds), default=0)
        return "".join(f"{n:<{width}} {self.calls[n]:>6} {s:>12.6f}\n" for n, s in self.seconds.items())

    def write(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(self.text())
