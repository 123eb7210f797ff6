"""The sliding-window limiter: events of a client are accepted while fewer than ``limit`` accepted ones lie in the window.

Rejected events are not recorded, so this is sequential state, not a count over a window. A client's events are bounded
by what it may do in the window plus what was rejected; the batch form still streams a client's sorted events through in
batches, so that a client holding a third of all rows needs no more memory than its recent times.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FIELDS = "client string, event_id bigint, ts timestamp, accepted boolean"


def admit(times: list[int], recent: deque[int], limit: int, window: int) -> list[bool]:
    """Decisions for sorted times; ``recent`` holds accepted times and is updated. A limit of 0 or less accepts all."""
    out = []
    for t in times:
        while recent and t - recent[0] > window:
            recent.popleft()
        ok = limit <= 0 or len(recent) < limit
        if ok and limit > 0:
            recent.append(t)
        out.append(ok)
    return out


def limit_batch(events: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """(client, event_id, ts, accepted) of events (client, event_id, ts), in order of time and id. Null clients are one client."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, recent = None, deque()
        for pdf in batches:
            out = []
            for name, part in pdf.groupby("client", sort=False, dropna=False):
                if name != client:
                    client, recent = name, deque()
                out.append(part.assign(accepted=admit(part["us"].tolist(), recent, limit, seconds * 1_000_000)))
            if out:
                yield pd.concat(out)[["client", "event_id", "ts", "accepted"]]

    keyed = events.select(F.coalesce(F.col("client").cast("string"), F.lit("")).alias("client"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return keyed.repartition("client").sortWithinPartitions("client", "us", "event_id").mapInPandas(run, FIELDS)


def limit_stream(events: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """The same on a stream: the state of a client is its accepted times of the window, and ends with it.

    Each micro-batch is taken in order of time; an event older than accepted ones of an earlier batch is judged against
    what the state then holds.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = deque(state.get[0] if state.exists else [])
        pdf = pd.concat(list(batches)).sort_values(["us", "event_id"])
        accepted = admit(pdf["us"].tolist(), recent, limit, seconds * 1_000_000)
        state.update((list(recent),))
        yield pdf.assign(client=key[0], accepted=accepted)[["client", "event_id", "ts", "accepted"]]

    keyed = events.select(F.coalesce(F.col("client").cast("string"), F.lit("")).alias("client"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return keyed.groupBy("client").applyInPandasWithState(run, FIELDS, "recent array<bigint>", "append", GroupStateTimeout.NoTimeout)


def append_stream(rows: DataFrame, path: str, checkpoint: str, key: str = "url_source"):
    """Starts an incremental ingest that appends each micro-batch's new rows; returns the query."""
    from lontar.sources.sinks import append_new

    return rows.writeStream.foreachBatch(lambda df, _: append_new(df.dropDuplicates([key]), path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
