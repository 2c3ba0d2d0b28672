"""Captures as they arrive: what is pending is taken once, and a repeated run changes nothing."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from strataloom.operators.incorporate import Entity, Stored, incorporate_sessions


def incorporated(stream: DataFrame, load: Callable[[], Stored], save: Callable[[Stored], None], entity: Entity, checkpoint: str, session: str = "session") -> StreamingQuery:
    """Take all rows of a stream (session, ord, identifiers, values) that wait into the stored tables, all sessions of a batch in one pass, then stop.

    A batch that is run again after a failure finds its sessions' observations and leaves ids and values as
    they are. save must replace the tables as a whole, as load may read what it is about to replace. To stop
    early, stop the query that is returned; batches that are done stay done.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows.persist()
        try:
            if not rows.isEmpty():
                save(incorporate_sessions(load(), rows.withColumnRenamed(session, "session"), entity))
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Keeps the last `most` messages of all queries of a session, for whoever comes to look later. Add it with spark.streams.addListener."""

    def __init__(self, most: int = 500):
        self.messages: deque[dict] = deque(maxlen=most)

    def onQueryStarted(self, event):  # noqa: N802
        self.messages.append({"query": str(event.id), "event": "started"})

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.messages.append({"query": str(p.id), "event": "progress", "batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event):  # noqa: N802
        self.messages.append({"query": str(event.id), "event": "idle"})

    def onQueryTerminated(self, event):  # noqa: N802
        self.messages.append({"query": str(event.id), "event": "failed" if event.exception else "ended"})


def activity(events: DataFrame, at: str, kind: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by kind and tumbling window of a stream; rows later than `late` are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
