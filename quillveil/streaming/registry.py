"""The registry of identities as the state of a stream: numbers go on from batch to batch, over restarts, until the batch expires.

The state of a batch is kept by its key in the state store: the names that it
has seen, in pages by their checksum, and the highest number of each kind. A
micro-batch is reduced to the first place of each name before any number is
given, and reads and writes only the pages that its names are in, each once, so
what a task holds grows with identities, never with mentions. What comes out is a
row for each new identity; mentions are joined with those.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the state store must be for states with several parts and timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Pages of the names of a kind; a name is known by its page.
PAGES = 4096
#: Rows that are reduced to first places, and given out, at once.
ROWS = 1 << 18
OUTPUT = "batch string, kind string, name string, number int, at timestamp"


def _first(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(parts, ignore_index=True).groupby(["kind", "name"], as_index=False, sort=False)["at"].min()


def _page(name: str) -> int:
    return zlib.crc32(name.encode()) % PAGES


class Numbers(StatefulProcessor):
    """Numbers names by kind in the order of their first place in time, then by name.

    A row with the action ``discard`` ends the batch: what was numbered is
    forgotten, and so is what the same micro-batch brings; numbers begin anew
    with the next. A batch of which nothing came for ``keep_seconds`` of event
    time is forgotten, too.
    """

    def __init__(self, keep_seconds: int) -> None:
        self.keep = keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "kind string, page int", "names array<string>")
        self.highest = handle.getMapState("highest", "kind string", "number int")
        self.until = handle.getValueState("until", "ms long")

    def _forget(self) -> None:
        self.known.clear()
        self.highest.clear()

    def _wait_until(self, ms: int) -> None:
        before = self.until.get()[0] if self.until.exists() else None
        if before is None or ms > before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(ms)
            self.until.update((ms,))

    def _highest(self, kind: str) -> int:
        return self.highest.getValue((kind,))[0] if self.highest.containsKey((kind,)) else 0

    def _new(self, first: pd.DataFrame) -> pd.DataFrame:
        """The rows whose names are not known yet, which are from then on. A page is read and written once."""
        # of a batch that begins there is nothing to read
        any_known = self.known.exists()
        new = np.ones(len(first), bool)
        names = first["name"].to_numpy()
        for (kind, page), places in first.groupby(["kind", first["name"].map(_page)]).indices.items():
            before = []
            if any_known and self.known.containsKey((kind, int(page))):
                before = list(self.known.getValue((kind, int(page)))[0])
                have = set(before)
                new[places] = [name not in have for name in names[places]]
            added = names[places[new[places]]].tolist()
            if added:
                self.known.updateValue((kind, int(page)), (before + added,))
        return first[new]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, held, kept = [], 0, 0
        earliest, last, discarded = None, None, False
        for part in rows:
            part = part[part["at"].notna()]
            if not len(part):
                continue
            last = part["at"].max() if last is None else max(last, part["at"].max())
            earliest = part["at"].min() if earliest is None else min(earliest, part["at"].min())
            ends = part["action"] == "discard"
            discarded |= bool(ends.any())
            parts.append(part.loc[~ends & part["kind"].notna() & part["name"].notna(), ["kind", "name", "at"]])
            held += len(parts[-1])
            # mentions are reduced again once there are twice as many as names
            if held > 2 * kept + ROWS:
                parts = [_first(parts)]
                held = kept = len(parts[0])
        # the timer comes when the watermark has passed, rows may come before it
        if earliest is not None and self.until.exists() and earliest.timestamp() * 1000 >= self.until.get()[0]:
            self._forget()
        if discarded:
            self._forget()
            parts = []
        new = self._new(_first(parts)) if parts else pd.DataFrame()
        parts = []
        if last is not None:
            self._wait_until(int(last.timestamp() * 1000) + self.keep)
        if len(new):
            new = new.sort_values(["kind", "at", "name"], ignore_index=True)
            highest = {kind: self._highest(kind) for kind in new["kind"].unique()}
            new["number"] = (new["kind"].map(highest) + new.groupby("kind").cumcount() + 1).astype("int32")
            for kind, number in new.groupby("kind")["number"].max().items():
                self.highest.updateValue((kind,), (int(number),))
            new.insert(0, "batch", key[0])
            for begin in range(0, len(new), ROWS):
                yield new.iloc[begin : begin + ROWS][["batch", "kind", "name", "number", "at"]]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._new(initialState[["kind", "name"]].drop_duplicates(ignore_index=True))
        for kind, number in initialState.groupby("kind")["number"].max().items():
            self.highest.updateValue((kind,), (max(self._highest(kind), int(number)),))
        if len(initialState):
            self._wait_until(int(initialState["at"].max().timestamp() * 1000) + self.keep)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def register(mentions: DataFrame, keep_seconds: int = 7 * 86_400, late: str = "0 seconds", restored: DataFrame | None = None) -> DataFrame:
    """(batch, kind, name, number, at) of each identity when it is first seen, of a stream of mentions (batch, kind, name, at, action).

    Rows without a batch, a kind, a name or a time are passed over; a null action
    is a mention. Mentions later than the watermark allows are left out.
    ``restored`` is a registry of the output's columns that a new stream begins
    with. Equal mentions count once. The session's state store must be
    ``PROVIDER``.
    """
    rows = mentions.filter(F.col("batch").isNotNull()).select(F.col("batch").cast("string").alias("batch"), "kind", "name", F.col("at").cast("timestamp").alias("at"), F.coalesce("action", F.lit("seen")).alias("action"))
    grouped = rows.withWatermark("at", late).groupBy("batch")
    begun = restored.select("batch", "kind", "name", "number", "at").groupBy("batch") if restored is not None else None
    return grouped.transformWithStateInPandas(Numbers(keep_seconds), OUTPUT, "Append", "EventTime", begun)
