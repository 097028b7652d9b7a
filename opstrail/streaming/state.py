"""Stateful processors, which run in tasks."""

from __future__ import annotations

import sys
from operator import itemgetter

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Processors travel to executors whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class FirstSeen(StatefulProcessor):
    """Gives the row of the smallest path of a key that is not remembered, and remembers the key."""

    def __init__(self, keep_seconds: int | None = None):
        self.keep = None if keep_seconds is None else keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "known boolean", self.keep)

    def handleInputRows(self, key, rows, timerValues):
        if self.seen.exists():
            return
        first = None
        for part in rows:  # a part at a time: one row is held
            row = min(zip(part["path"], part["length"]), key=itemgetter(0))
            first = row if first is None or row[0] < first[0] else first
        if first is not None:
            self.seen.update((True,))
            yield pd.DataFrame({"path": [first[0]], "length": [int(first[1])], "sha256": [key[0]]})

    def close(self) -> None:
        pass
