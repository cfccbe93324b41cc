"""Streams of snapshot rows: running values per track, and a fold that follows arriving snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_max(stream: DataFrame) -> DataFrame:
    """(track_id, snapshot, last_max, at_last_max) of a stream (track_id, snapshot, mass) whose batches arrive in order of time.

    State per track is two numbers; of equal maxima the latest counts. Null masses are passed over.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, at = state.get if state.exists else (float("-inf"), -1)
        rows = pd.concat(list(batches)).dropna(subset=["mass"]).sort_values("snapshot", kind="stable")
        out = []
        for snapshot, mass in zip(rows["snapshot"], rows["mass"]):
            if mass >= best:
                best, at = float(mass), int(snapshot)
            out.append((key[0], int(snapshot), best, at))
        if out:
            state.update((best, at))
        yield pd.DataFrame(out, columns=["track_id", "snapshot", "last_max", "at_last_max"])

    return stream.groupBy("track_id").applyInPandasWithState(
        update, "track_id bigint, snapshot int, last_max double, at_last_max int", "best double, at int", "append", GroupStateTimeout.NoTimeout
    )


def follow(arrivals: DataFrame, run: Callable[[int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query on a stream with column ``snapshot`` that runs the fold for each arriving snapshot, in order.

    A batch that is repeated after a failure overwrites what it had written.
    """

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.select("snapshot").distinct().orderBy("snapshot").collect():  # a number per snapshot
            run(row.snapshot)

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
