"""Progress events and item states: as windows over a batch, and as streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from photonframe.functions.sequence import runs

# Statuses and what may follow them.
NEXT = {"pending": ["queued"], "queued": ["processing", "cancelled"], "processing": ["done", "skipped", "failed", "cancelled"], "done": [], "skipped": [], "failed": [], "cancelled": []}
FINISHED = [s for s, after in NEXT.items() if not after]


def running_totals(events: DataFrame, key: str, order: list[str], finished: str) -> DataFrame:
    """Events of each batch with how many items had finished at that point, the batch's
    total, and the fraction."""
    w = Window.partitionBy(key).orderBy(*order)
    done = F.sum(F.when(F.expr(finished), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.count("*").over(Window.partitionBy(key))
    return events.withColumns({"completed": done, "total": total, "fraction": done / total})


def last_status(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """The status after an item's last event: an aggregate, not a sort."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count("*").alias("n_events"))


def illegal_steps(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Events whose status may not follow the one before."""
    before = F.coalesce(F.lag(status).over(Window.partitionBy(key).orderBy(*order)), F.lit("pending"))
    allowed = F.create_map(*(x for s, after in NEXT.items() for x in (F.lit(s), F.array(*map(F.lit, after)).cast("array<string>"))))
    rows = events.withColumn("before", before)
    return rows.where((F.col(status) != F.col("before")) & ~F.coalesce(F.array_contains(F.element_at(allowed, F.col("before")), F.col(status)), F.lit(False)))


def throttled(events: DataFrame, key: str, order: list[str], seconds: float, final: str) -> DataFrame:
    """Events that go out: the first of each key, every final one, and each that comes at least
    so many seconds after the last one that went out. order: the time, then what settles ties.

    An event after a longer gap, and a final one, goes out whatever was before: it begins a run.
    Only inside of a run does one event depend on another, so runs, not keys, are walked, each
    in one pass that remembers a time."""
    span = round(seconds * 1e6)
    names = events.columns
    rows = events.withColumns({"_at": F.unix_micros(order[0]), "_final": F.coalesce(F.expr(final), F.lit(False))})
    cut = runs(rows, [key], order, lambda before: F.col("_final") | (F.col("_at") - before("_at") >= span), "_run")
    dealt = cut.repartition("_run").sortWithinPartitions("_run", *order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_run, last = None, 0
        for batch in batches:
            keep = []
            for run, at in zip(batch.column(len(names) + 2).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                keep.append(run != last_run or at - last >= span)
                last_run, last = run, at if keep[-1] else last
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names).filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(walk, events.schema)


@dataclass
class Item:
    """An item of a batch as its events leave it, and what may go out next."""

    status: str = "pending"
    last: int | None = None  # when progress last went out, in microseconds
    paused: bool = False
    cancelled: bool = False

    def take(self, at: int, status: str | None, progress: float | None, control: str | None, span: int) -> tuple[str, str | None] | None:
        """What goes out for an event: ("status", the new one) or ("progress", None); None where
        nothing does. Steps that may not follow are refused; an item that is cancelled before it
        starts ends as cancelled; a paused or cancelled item makes no progress."""
        if control == "cancel":
            self.cancelled, self.paused = True, False
        elif control == "pause":
            self.paused = not self.cancelled
        elif control == "resume":
            self.paused = False
        elif status is not None:
            if self.cancelled and status == "processing":
                status = "cancelled"
            if status not in NEXT.get(self.status, ()) or (self.paused and status == "processing"):
                return None
            self.status, self.last = status, None
            return "status", status
        elif progress is not None and self.status == "processing" and not self.paused and not self.cancelled:
            if self.last is None or at - self.last >= span or progress >= 1:
                self.last = at
                return "progress", None
        return None


LOG = "at timestamp, kind string, status string, progress double"


def item_log(events: DataFrame, key: str, seconds: float = 0.1, tie: str = "tie") -> DataFrame:
    """(key, at, kind, status, progress): what goes out for events (key, at, tie, status,
    progress, control), by the rules of ``Item``, in the order of time and tie. An item's events
    are walked in order in one pass; a task remembers one item."""
    span, kind = round(seconds * 1e6), events.schema[key].dataType.simpleString()
    rows = events.select(key, F.unix_micros("at").alias("at"), "status", "progress", "control", tie)
    rows = rows.repartition(key).sortWithinPartitions(key, "at", tie).drop(tie)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, item = None, None
        for batch in batches:
            out = []
            for name, at, status, progress, control in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if item is None or name != now:
                    now, item = name, Item()
                gone = item.take(at, status, progress, control, span)
                if gone is not None:
                    out.append((name, at, *gone, progress if gone[0] == "progress" else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [batch.schema.field(0).type, pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[key, "at", "kind", "status", "progress"])

    return rows.mapInArrow(walk, f"{key} {kind}, {LOG}")


class ItemProcessor(StatefulProcessor):
    """``item_log`` on a stream. Events wait until the watermark has passed them, in a map by
    time and tie, and a timer is set for each; when one rings, all that is due is taken in
    order. Late events within the watermark thus change nothing."""

    def __init__(self, key: str, seconds: float) -> None:
        self.key, self.span = key, round(seconds * 1e6)

    def init(self, handle) -> None:  # type: ignore[no-untyped-def]
        self.handle = handle
        self.item = handle.getValueState("item", "status string, last long, paused boolean, cancelled boolean")
        self.waiting = handle.getMapState("waiting", "at long, tie long", "status string, progress double, control string")

    def handleInputRows(self, key, rows, timerValues):  # type: ignore[no-untyped-def]  # noqa: N802,N803
        for frame in rows:
            for at, tie, status, progress, control in zip(frame["us"], frame["tie"], frame["status"], frame["progress"], frame["control"], strict=True):
                none = lambda v: None if pd.isna(v) else v
                self.waiting.updateValue((int(at), int(tie)), (none(status), none(progress), none(control)))
                self.handle.registerTimer(int(at) // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # type: ignore[no-untyped-def]  # noqa: N802,N803
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        ready = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] < due)
        item = Item(*self.item.get()) if self.item.exists() else Item()
        out = []
        for (at, tie), (status, progress, control) in ready:
            gone = item.take(at, status, progress, control, self.span)
            self.waiting.removeKey((at, tie))
            if gone is not None:
                out.append((key[0], pd.Timestamp(at, unit="us"), *gone, progress if gone[0] == "progress" else None))
        if ready:
            self.item.update((item.status, item.last, item.paused, item.cancelled))
        yield pd.DataFrame(out, columns=[self.key, "at", "kind", "status", "progress"])

    def close(self) -> None:
        pass


def item_log_stream(events: DataFrame, key: str, seconds: float = 0.1, late: str = "1 minute") -> DataFrame:
    """``item_log`` on a stream of (key, at, tie long, status, progress, control), by
    transformWithState; rows of the same time and tie are one. What the watermark has not
    passed when a stream ends stays in its state. Needs the RocksDB state store
    (``STATE_STORE``)."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    return rows.groupBy(key).transformWithStateInPandas(ItemProcessor(key, seconds), f"{key} {kind}, {LOG}", "append", "eventtime")


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def status_stream(events: DataFrame, key: str, time: str, status: str, late: str = "10 minutes") -> DataFrame:
    """Structured Streaming form of last_status: state is one row for each item, and late
    events within the watermark are still ordered by their time."""
    return events.withWatermark(time, late).groupBy(key).agg(F.max_by(status, time).alias("status"), F.max(time).alias("at"), F.count("*").alias("n_events"))


def progress_stream(events: DataFrame, key: str, time: str, finished: str, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Finished items of each batch in tumbling windows of event time."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), key).agg(F.count("*").alias("n"), F.sum(F.when(F.expr(finished), 1).otherwise(0)).alias("finished"))
