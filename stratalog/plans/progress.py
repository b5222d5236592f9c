"""Progress of stages as observed metrics: counters that a stage adds up while it writes, without another pass over its rows."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener


class Observed:
    """Counters by stage, summed over all of a stage's writes; ``told(stage, counters)`` hears of each as it ends."""

    def __init__(self, told: Callable[[str, dict], None] | None = None):
        self._told, self._open, self._ended = told, [], []

    def watch(self, stage: str, rows: DataFrame, counters: dict[str, Column]) -> DataFrame:
        """``rows``, which must be written or collected once; its counters are there from then on."""
        observation = Observation()
        self._open.append((stage, observation))
        return rows.observe(observation, *(c.alias(name) for name, c in counters.items()))

    def totals(self, stage: str) -> dict[str, int]:
        """Sums over the writes of a stage so far; waits for those that have begun."""
        while self._open:
            of, observation = self._open.pop(0)
            self._ended.append((of, observation.get))
            if self._told:
                self._told(of, observation.get)
        out: dict[str, int] = {}
        for of, counters in self._ended:
            if of == stage:
                for name, value in counters.items():
                    out[name] = out.get(name, 0) + (value or 0)
        return out


class StreamProgress(StreamingQueryListener):
    """Sums of the metrics that streams observe under ``name``, batch by batch; ``told(counters)`` hears of each batch."""

    def __init__(self, name: str, told: Callable[[dict], None] | None = None):
        self.name, self.totals, self._told, self._seen = name, {}, told, set()
        self._ended = threading.Event()

    def wait(self, seconds: float = 60) -> None:
        """Until the stream has ended and all of its batches were heard of; listeners are told a moment later."""
        self._ended.wait(seconds)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.set()

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row, batch = progress.observedMetrics.get(self.name), (progress.runId, progress.batchId)
        if row is None or batch in self._seen or not progress.numInputRows:
            return
        self._seen.add(batch)
        counters = {k: v or 0 for k, v in row.asDict().items()}
        for k, v in counters.items():
            self.totals[k] = self.totals.get(k, 0) + v
        if self._told:
            self._told(counters)
