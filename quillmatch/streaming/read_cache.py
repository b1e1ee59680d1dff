"""The read cache as a stream: of equal requests, the first within each life of a cache entry is passed on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIFE_S = 12 * 3600


def first_reads(reads: DataFrame, life_s: int = LIFE_S, late: str = "1 hour") -> DataFrame:
    """A stream of (k string, at timestamp) to the reads that have to be made. A hit does not prolong an entry's life.

    Time is that of the reads. An entry is forgotten when the watermark, `late` behind the latest read, has passed its end. A read
    that comes late, but before that, is a hit if it lies less than a life from the entry on either side; an earlier one is made.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        made = []
        for at in sorted(x for frame in frames for x in frame["at"]):
            if last is None or abs(at.timestamp() - last) >= life_s:
                last = at.timestamp() if last is None else max(last, at.timestamp())
                made.append((key[0], at))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(int((last + life_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(made, columns=["k", "at"])

    rows = reads.where("at is not null").withWatermark("at", late).groupBy("k")
    return rows.applyInPandasWithState(fold, "k string, at timestamp", "last double", "append", GroupStateTimeout.EventTimeTimeout)
