"""Log entries from a stream of lines: each log's open block is its state."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracelake.sources.trace_source import Blocks

ENTRY = "trace_id string, entry_id long, line_number long, tag string, function string, source_file string, source_line int, body array<string>"
NAMES = [f.split()[0] for f in ENTRY.split(", ")]
#: Lines that a task holds of one log, rows that it puts out at once.
SPAN, ROWS = 1 << 17, 10_000


def _in_order(parts: Iterator[pd.DataFrame], span: int) -> Iterator[tuple[int, str]]:
    """(line_number, line) by number; beyond ``span`` lines they lie in a temporary file for each span of numbers, of which one is held at a time."""
    with tempfile.TemporaryDirectory(prefix="lines-") as folder:
        held, size, spans = [], 0, set()
        for pdf in parts:
            held.append(pdf[["line_number", "line"]])
            size += len(pdf)
            if spans or size > span:
                for at, rows in (some := pd.concat(held)).groupby(some["line_number"] // span, sort=False):
                    spans.add(at)
                    with open(os.path.join(folder, str(at)), "ab") as f:
                        pickle.dump((rows["line_number"].tolist(), rows["line"].tolist()), f)
                held, size = [], 0
        if held:
            rows = pd.concat(held).sort_values("line_number")
            yield from zip(rows["line_number"].tolist(), rows["line"].tolist(), strict=True)
        for at in sorted(spans):
            rows = []
            with open(os.path.join(folder, str(at)), "rb") as f:
                while f.peek(1):
                    rows += zip(*pickle.load(f), strict=True)
            os.remove(f.name)
            yield from sorted(rows, key=lambda r: r[0])


class Segmenter(StatefulProcessor):
    """Lines of a log come in order (within a micro-batch in any); a log that is silent for ``idle_ms`` is forgotten, its open block with it."""

    def __init__(self, idle_ms: int, span: int = SPAN):
        self.idle_ms, self.span = idle_ms, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "line string")
        self.known = handle.getValueState("known", "entries long, head long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.known.get() if self.known.exists() else (0, None)
        entries, head = int(known[0]), None if known[1] is None else int(known[1])
        held = [x[0] for x in self.open.get()] if head is not None else []
        blocks, out, before = Blocks(head, list(held)), [], len(held)
        for number, line in _in_order(rows, self.span):
            if entry := blocks.feed(number, line):
                entries += 1
                out.append((key[0], entries, *entry))
                if len(out) >= ROWS:
                    yield pd.DataFrame(out, columns=NAMES)
                    out = []
        if blocks.number is None:
            self.open.clear()
        elif blocks.number == head:  # the block goes on: only its new lines are written
            if len(blocks.lines) > before:
                self.open.appendList([(x,) for x in blocks.lines[before:]])
        else:
            self.open.put([(x,) for x in blocks.lines])
        self.known.update((entries, blocks.number))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if out:
            yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        self.known.clear()
        return iter([])

    def close(self) -> None:
        pass


def streamed_segments(lines: DataFrame, idle_ms: int = 3_600_000, span: int = SPAN) -> DataFrame:
    """``segment``'s rows of a streaming (trace_id, line_number, line), in append mode. Needs the RocksDB state store.

    State is a log's open block, its lines written once each, and two numbers; a task holds ``span`` lines of a log at once, and one block. A line after a log was forgotten begins a new log of that name.
    """
    return lines.groupBy("trace_id").transformWithStateInPandas(Segmenter(idle_ms, span), ENTRY, "append", "processingTime")
