"""Stateful streaming: what the batch operators find with windows, kept between micro-batches for endless streams.

Each operator groups by stream id and runs as a stateful processor over the RocksDB store. Its state is a few numbers, the
pieces of one unfinished unit, or the tables that a stream has sent, so it never grows with the length of a stream.
Packets of a micro-batch are taken in their order; across micro-batches they are taken as they arrive. With ``idle`` a stream
from which nothing came for so many seconds is closed: what it held is given out and its state is forgotten. Such a query waits
for its timers and runs until it is stopped, also under ``availableNow``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riffle.operators.reassembly import MACHINES

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def packet_source(spark: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    """Packets from a folder that other writers add Parquet files to, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


class Processor(StatefulProcessor):
    """Rows of a micro-batch in their order, and timers for idle streams. Subclasses say what rows do and what is left at the end."""

    def __init__(self, stream: str, order: str, idle: float | None):
        self.stream, self.order, self.idle = stream, order, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open_state(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = list(rows)
        batch = (batch[0] if len(batch) == 1 else pd.concat(batch, ignore_index=True)).sort_values(self.order, kind="stable")
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.idle))
        yield from self.given(key[0], self.take(batch))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.given(key[0], self.end())

    def given(self, key, out: dict[str, object]) -> Iterator[pd.DataFrame]:
        frame = pd.DataFrame(out)
        if len(frame):
            frame.insert(0, self.stream, key)
            yield frame

    def close(self) -> None:
        pass


class Numbers(Processor):
    """Value state of a few numbers, and a function from it and the columns of a batch to new numbers and columns."""

    def __init__(self, stream: str, order: str, idle: float | None, schema: str, start: tuple, step: Callable[[tuple, pd.DataFrame], tuple[tuple, dict]]):
        super().__init__(stream, order, idle)
        self.schema, self.start, self.step = schema, start, step

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", self.schema)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        names = [f.split()[0] for f in self.schema.split(", ")]
        self.now.update(tuple(int(v) for v in initialState[names].iloc[-1]))

    def take(self, rows: pd.DataFrame) -> dict:
        now, out = self.step(tuple(self.now.get()) if self.now.exists() else self.start, rows)
        self.now.update(tuple(int(v) for v in now))
        return out

    def end(self) -> dict:
        self.now.clear()
        return {}


class Units(Processor):
    """A machine of ``operators.reassembly``: a value for the unfinished unit, a map for the tables of a stream."""

    def __init__(self, stream: str, order: str, idle: float | None, kind: str, options: dict):
        super().__init__(stream, order, idle)
        self.kind, self.options = kind, options

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.unit = handle.getValueState("unit", "held binary, fragment boolean, head binary")
        self.tables = handle.getMapState("tables", "number int", "data binary")

    def machine(self):
        found = MACHINES[self.kind](**self.options)
        if self.unit.exists():
            held, found.fragment, head = self.unit.get()
            found.held = bytes(held)
            if self.kind == "jfif":
                found.head = bytes(head)
        if self.kind == "jfif":
            found.tables = {k[0]: bytes(v[0]) for k, v in self.tables.iterator()}
        return found

    def take(self, rows: pd.DataFrame) -> dict:
        machine = self.machine()
        known = dict(getattr(machine, "tables", {}))
        done = [u for payload, marker in zip(rows["payload"], rows["marker"], strict=True) for u in machine.take(bytes(payload or b""), bool(marker))]
        self.unit.update((machine.held, machine.fragment, getattr(machine, "head", b"")))
        for number, data in getattr(machine, "tables", {}).items():
            if known.get(number) != data:
                self.tables.updateValue((number,), (data,))
        return {"unit": done}

    def end(self) -> dict:
        """What was held counts as a unit, as with ``tail`` in batches; images without their end are lost."""
        machine = self.machine()
        self.unit.clear()
        self.tables.clear()
        return {"unit": [machine.held] if self.kind in ("h264", "h265") and machine.held else []}


class Buffer(Processor):
    """A list of pieces that is given out as one when it holds enough bytes."""

    def __init__(self, stream: str, order: str, idle: float | None, least: int):
        super().__init__(stream, order, idle)
        self.least = least

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.size = handle.getValueState("size", "size long")
        self.pieces = handle.getListState("pieces", "piece binary")

    def take(self, rows: pd.DataFrame) -> dict:
        size, new, out = int(self.size.get()[0]) if self.size.exists() else 0, [], []
        for piece in rows["payload"]:
            new.append(bytes(piece or b""))
            size += len(new[-1])
            if size >= self.least:
                out.append(b"".join([*(self.held() if not out else []), *new]))
                size, new = 0, []
        if out:
            self.pieces.clear()
        if new:
            self.pieces.appendList([(p,) for p in new])
        self.size.update((size,))
        return {"data": out}

    def held(self) -> list[bytes]:
        return [bytes(p[0]) for p in self.pieces.get()]

    def end(self) -> dict:
        left = b"".join(self.held())
        self.pieces.clear()
        self.size.clear()
        return {"data": [left] if left else []}


def _run(rows: DataFrame, processor: Processor, out: str, initial: DataFrame | None = None) -> DataFrame:
    """The processor over all streams of ``rows``; the session's store becomes RocksDB, which these operators need."""
    rows.sparkSession.conf.set(STORE, ROCKSDB)
    first = initial.groupBy(processor.stream) if initial is not None else None
    mode = "None" if processor.idle is None else "ProcessingTime"
    return rows.groupBy(processor.stream).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode=mode, initialState=first)


def continuity(rows: DataFrame, stream: str = "pid", order: str = "off", initial: DataFrame | None = None, idle: float | None = None) -> DataFrame:
    """``pid, off, cc, discontinuous`` of each packet (pid, off, cc); the first of a stream counts as discontinuous, as 16 is expected there.

    A packet with ``failed`` set was not delivered: the counter expected next goes one back. ``initial`` (pid, expected) has what
    other clips of a stream have left.
    """

    def step(now: tuple, batch: pd.DataFrame) -> tuple[tuple, dict]:
        cc = batch["cc"].to_numpy(np.int64)
        failed = batch["failed"].to_numpy(bool) if "failed" in batch else np.zeros(len(cc), bool)
        after = (cc + 1 - failed) % 16
        return (after[-1],), {order: batch[order].to_numpy(), "cc": cc, "discontinuous": cc != np.append(now[0], after[:-1])}

    return _run(rows, Numbers(stream, order, idle, "expected long", (16,), step), f"{stream} long, {order} long, cc long, discontinuous boolean", initial)


def cycles(rows: DataFrame, stream: str = "pid", order: str = "off", initial: DataFrame | None = None, idle: float | None = None) -> DataFrame:
    """``pid, off, seq, cycles``: how often the sequence number (seq) has fallen so far. ``initial`` has ``pid, last, cycles``."""

    def step(now: tuple, batch: pd.DataFrame) -> tuple[tuple, dict]:
        seq = batch["seq"].to_numpy(np.int64)
        n = now[1] + np.cumsum(seq < np.append(now[0], seq[:-1]))
        return (seq[-1], n[-1]), {order: batch[order].to_numpy(), "seq": seq, "cycles": n}

    return _run(rows, Numbers(stream, order, idle, "last long, cycles long", (-1, 0), step), f"{stream} long, {order} long, seq long, cycles long", initial)


def units(rows: DataFrame, kind: str, stream: str, order: str, idle: float | None = None, **options) -> DataFrame:
    """``stream, unit``: access units or images as soon as they are complete, from ``stream, order, payload, marker``."""
    return _run(rows, Units(stream, order, idle, kind, options), f"{stream} long, unit binary")


def batches(rows: DataFrame, stream: str = "conv_id", order: str = "turn", least: int = 1316, idle: float | None = None) -> DataFrame:
    """``stream, data``: payloads are held back until there are ``least`` bytes, then all are sent as one."""
    return _run(rows, Buffer(stream, order, idle, least), f"{stream} long, data binary")
