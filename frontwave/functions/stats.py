"""Run statistics: named time intervals, scalars and series, as flat JSON."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession


class RunStats:
    """Intervals are in seconds. A checkpoint names the time since the one before; the first starts the clock."""

    def __init__(self, clock=time.perf_counter):
        self._clock = clock
        self._points: list[float] = []
        self._names: list[str] = []
        self._stopped = False
        self.scalars: dict[str, float] = {}
        self.series: dict[str, list[float]] = {}

    def start(self) -> None:
        if not self._points:
            self._points.append(self._clock())

    def checkpoint(self, name: str) -> None:
        self.start()
        self._points.append(self._clock())
        self._names.append(name)

    def stop(self) -> None:
        if not self._stopped:
            self.checkpoint("total")
            self._stopped = True

    def add_stat(self, name: str, value: float) -> None:
        self.scalars[name] = value

    def add_datapoint(self, name: str, value: float) -> None:
        self.series.setdefault(name, []).append(value)

    def intervals(self) -> dict[str, float]:
        out = {n: b - a for n, a, b in zip(self._names, self._points, self._points[1:], strict=False) if n != "total"}
        return out | ({"total": self._points[-1] - self._points[0]} if self._stopped else {})

    def as_dict(self) -> dict[str, object]:
        """All values; scalars and intervals first, then series, each in order of name."""
        self.stop()
        plain = self.intervals() | self.scalars
        return {k: plain[k] for k in sorted(plain)} | {k: self.series[k] for k in sorted(self.series)}

    def json_dump(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.as_dict(), f)

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row: a map of scalars and a map of series."""
        own = {k: v for k, v in self.as_dict().items() if not isinstance(v, list)}
        return spark.createDataFrame([({k: float(v) for k, v in own.items()}, {k: [float(x) for x in v] for k, v in self.series.items()})], "scalars map<string,double>, series map<string,array<double>>")
