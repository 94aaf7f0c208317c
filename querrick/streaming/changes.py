"""File changes as streams: debouncing, batches, and indexing of each batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from ..fixed import BATCH_MS, DEBOUNCE_MS


def filtered(events: DataFrame, extensions: tuple[str, ...] = (), always: tuple[str, ...] = ()) -> DataFrame:
    """Events (``path``, ``kind``) of files with those extensions (of all, if there are none); removals and files named in ``always`` pass."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    keep = (F.col("kind") == "unlink") | name.isin(*always) if always else F.col("kind") == "unlink"
    return events.where(keep | F.regexp_extract("path", r"(\.[^./]*)\z", 1).isin(*extensions)) if extensions else events


def debounced(events: DataFrame, path: str = "path", ts: str = "ts", quiet: str = f"{DEBOUNCE_MS} milliseconds", late: str | None = None) -> DataFrame:
    """``(path, opened, fires, n)``: bursts of events of a path, which end when it was quiet that long. Of a stream, ``late`` is the watermark."""
    source = events.where(F.col(ts).isNotNull())
    if late:
        source = source.withWatermark(ts, late)
    bursts = source.groupBy(path, F.session_window(ts, quiet).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return bursts.select(path, F.col("w.start").alias("opened"), F.col("w.end").alias("fires"), "n")


def batched(bursts: DataFrame, path: str = "path", width: str = f"{BATCH_MS} milliseconds") -> DataFrame:
    """``(batch, paths, events)``: what fires within a batch window, each path once."""
    rows = bursts.withColumn("batch", F.window(F.col("fires") - F.expr("INTERVAL 1 MICROSECOND"), width)["start"])
    each = rows.groupBy("batch", path).agg(F.sum("n").alias("n"))
    return each.groupBy("batch").agg(F.count(F.lit(1)).alias("paths"), F.sum("n").alias("events"))


class PolledListing(DataSource):
    """A stream of changes of a folder, removals too: each poll lists it and compares with the offset, which is the listing before."""

    @classmethod
    def name(cls) -> str:
        return "polled_listing"

    def schema(self) -> str:
        return "path string, kind string, size bigint, mtime double"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001, N802
        return _Poll(self.options["path"])


class _Poll(SimpleDataSourceStreamReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _listing(self) -> dict[str, list[float]]:
        from ..sources.listing import walk

        return {path: [size, mtime] for path, size, mtime in walk(self.root)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self._listing()
        return iter(_changes(start, now)), now

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(_changes(start, end))


def _changes(old: dict[str, list[float]], new: dict[str, list[float]]) -> list[tuple]:
    out = [(p, "add" if p not in old else "change", int(s), float(m)) for p, (s, m) in new.items() if old.get(p) != [s, m]]
    return sorted(out + [(p, "unlink", int(s), float(m)) for p, (s, m) in old.items() if p not in new])


class Watcher:
    """Applies changes as they come: each micro-batch of paths triggers one indexing run.

    Batches are serial. While paused, paths are put aside and come with the next
    batch; a run that fails leaves the batch to be run again from the checkpoint.
    """

    def __init__(self, apply: Callable[[DataFrame], object]) -> None:
        self.apply, self.until = apply, 0.0
        self.pending: set[str] = set()
        self.stats = {"batches": 0, "events": 0, "paths": 0, "deferred": 0, "failures": 0}

    def pause(self, seconds: float = float("inf")) -> None:
        """Rests for so long, or for what is left of an earlier pause if that is longer."""
        self.until = max(self.until, time.monotonic() + seconds)

    def resume(self) -> None:
        self.until = 0.0

    def is_paused(self) -> bool:
        return time.monotonic() < self.until

    def on_batch(self, events: DataFrame, batch_id: int) -> None:
        paths = events.select("path").distinct()
        told = {r["path"] for r in paths.toLocalIterator()}
        self.stats["events"] += events.count()
        if self.is_paused():
            self.pending |= told
            self.stats["deferred"] += len(told)
            return
        if not told and not self.pending:
            return
        whole = events.sparkSession.createDataFrame([(p,) for p in sorted(told | self.pending)], "path string")
        try:
            self.apply(whole)
        except Exception:
            self.stats["failures"] += 1
            raise
        self.pending.clear()
        self.stats["batches"] += 1
        self.stats["paths"] += whole.count()

    def start(self, events: DataFrame, checkpoint: str, once: bool = False, every_ms: int = BATCH_MS) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{every_ms} milliseconds")).start()
