"""Rounds from a stream of events: keyed state, a row when a round is closed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tracelake.operators.rounds import ROUND, Machine


#: Fixed value: the kinds of events, by their codes.
KINDS = "DPAN"
ROWS = 10_000


def streamed_rounds(events: DataFrame) -> DataFrame:
    """Closed rounds of a streaming (trace_id, at, kind, a, b), in append mode; events of a trace come in order, within a micro-batch in any.

    A trace's events of a micro-batch come in several batches, so they are put in order as a whole, in packed columns (33 bytes an event).
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        machine = Machine(json.loads(state.get[0]) if state.exists else None)
        parts = [[pdf["at"].to_numpy(), pdf["kind"].map(KINDS.find).to_numpy("int8"), pdf["a"].to_numpy("int64"), pdf["b"].to_numpy("int64")] for pdf in batches]
        at, kind, a, b = (np.concatenate(c) for c in zip(*parts, strict=True))
        order, out = np.argsort(at, kind="stable"), []
        for some in (order[i : i + ROWS] for i in range(0, len(order), ROWS)):
            for k, x, y in zip(kind[some].tolist(), a[some].tolist(), b[some].tolist(), strict=True):
                out += machine.feed(KINDS[k], x, y)
            if len(out) >= ROWS:
                yield frame(key[0], out)
                out = []
        state.update((json.dumps(machine.s),))
        yield frame(key[0], out)

    def frame(trace: str, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([{"trace_id": trace} | r for r in rows], columns=[f.split()[0] for f in ROUND.split(", ")])

    return events.groupBy("trace_id").applyInPandasWithState(run, ROUND, "state string", "append", "NoTimeout")
