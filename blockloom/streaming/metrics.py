"""Progress figures of ingestion, from a streaming query's own events."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.streaming import StreamingQueryListener

# Metric names.
NAMES = ("indexed_height", "target_height", "finalized_height", "blocks_per_second", "handler_duration", "commit_duration", "rpc_errors", "queue_depth", "reorgs", "reorg_depth")


@dataclass
class Gauges:
    """Values by name; what was never set is not known, and without both heights nothing is caught up."""

    values: dict[str, float] = field(default_factory=lambda: dict.fromkeys(NAMES, 0.0))
    known: set[str] = field(default_factory=set)

    def set(self, name: str, value: float) -> None:
        if name not in self.values:
            raise KeyError(name)
        self.values[name] = float(value)
        self.known.add(name)

    def add(self, name: str, value: float) -> None:
        self.set(name, self.values[name] + value)

    @property
    def blocks_behind(self) -> float:
        return max(self.values["target_height"] - self.values["indexed_height"], 0.0)

    @property
    def caught_up(self) -> bool:
        return self.is_caught_up(0)

    def is_caught_up(self, tolerance: int) -> bool:
        """Within so many blocks of the head."""
        return {"target_height", "indexed_height"} <= self.known and self.blocks_behind <= tolerance

    def observe(self, client) -> None:
        """Heights of the chain, and the requests that failed so far."""
        self.set("target_height", client.latest())
        self.set("finalized_height", client.finalized())
        self.set("rpc_errors", client.errors)


class Listener(StreamingQueryListener):
    def __init__(self, gauges: Gauges):
        self.gauges = gauges

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.gauges.set("blocks_per_second", p.processedRowsPerSecond or 0.0)
        self.gauges.set("handler_duration", p.durationMs.get("addBatch", 0) / 1000)

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass
