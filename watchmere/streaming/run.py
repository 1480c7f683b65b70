"""Running streams: sources, sinks, checkpoints and stopping."""

from __future__ import annotations

import signal
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import alerts as A
from ..session import shared


def start(stream: DataFrame, path: str, checkpoint: str, poll: str | None = None) -> StreamingQuery:
    """Append a stream to Parquet; without a poll interval it takes all there is and ends."""
    trigger = {"processingTime": poll} if poll else {"availableNow": True}
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def ndjson(alerts: DataFrame, path: str, checkpoint: str, poll: str = "1 second", on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append alerts as JSON documents; on_batch sees each batch as well, at least once."""

    def put(batch: DataFrame, n: int) -> None:
        kept = batch.persist()
        A.document(kept).select("doc").write.mode("overwrite").text(f"{path.rstrip('/')}/batch={n}")  # a batch that runs again replaces itself
        if on_batch:
            on_batch(kept, n)
        kept.unpersist()

    return alerts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=poll).start()


def replay(stream: DataFrame) -> DataFrame:
    """All of a stream's results over what its source holds now."""
    spark, folder = stream.sparkSession, shared(stream.sparkSession)
    query = start(stream, f"{folder}/out", f"{folder}/checkpoint")
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def events_of(lines: DataFrame, sources: dict[str, str], year: int = 2026) -> DataFrame:
    """Events of a stream of lines (value, file) by each file's source; what can't be parsed is left out.

    Lines that bring their byte (at) keep their order in the file where times are equal.
    """
    from pyspark.sql import functions as F

    from ..sources import files, parsers

    parsed = F.lit(None)
    for path, source in sources.items():
        parsed = F.when(F.col("file") == path, parsers.parse(F.col("value"), source, year)).otherwise(parsed)
    seq = F.shiftleft("at", 12) + F.pmod(F.xxhash64("file"), F.lit(4096)) if "at" in lines.columns else F.xxhash64("file", "value")
    return files.to_events(lines.select("value", "file", parsed.alias("parsed"), seq.alias("_seq")))


def live(parts: dict[str, DataFrame], sink: Callable[[DataFrame, int], None], folder: str, poll: str | None = "1 second") -> list[StreamingQuery]:
    """Run detectors, each as a query that appends its alerts to a table, and a query that hands all new alerts to a sink.

    Without a poll interval all there is is taken, and the queries have ended on return.
    """
    spark, folder = next(iter(parts.values())).sparkSession, folder.rstrip("/")
    queries = [start(df, f"{folder}/detected/{name}", f"{folder}/checkpoint/{name}", poll) for name, df in parts.items()]
    if not poll:
        for q in queries:
            q.awaitTermination()
    found = None
    for name, df in parts.items():
        spark.createDataFrame([], df.schema).write.mode("ignore").parquet(f"{folder}/detected/{name}")  # the folder may not be there yet
        part = spark.readStream.schema(df.schema).parquet(f"{folder}/detected/{name}")
        found = part if found is None else found.unionByName(part)
    found = sink.follow(found) if hasattr(sink, "follow") else found
    trigger = {"processingTime": poll} if poll else {"availableNow": True}
    last = found.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint/alerts").outputMode("append").trigger(**trigger).start()
    if not poll:
        last.awaitTermination()
    return [*queries, last]


def wait(queries: list[StreamingQuery], max_seconds: float | None = None, on_status: Callable[[dict], None] | None = None, every: float = 5.0) -> None:
    """Until a query ends, the time is over or the process is asked to stop; then stop all of them and raise what went wrong."""
    stopped = []
    before = {s: signal.signal(s, lambda *_: stopped.append(1)) for s in (signal.SIGINT, signal.SIGTERM)}
    end = time.monotonic() + max_seconds if max_seconds else None
    try:
        while all(q.isActive for q in queries) and not stopped and (end is None or time.monotonic() < end):
            queries[-1].awaitTermination(max(0.1, min(every, end - time.monotonic()) if end else every))
            if on_status:
                on_status(status(queries[-1]))
    finally:
        for q in queries:
            if q.isActive:
                q.stop()
        for s, handler in before.items():
            signal.signal(s, handler)
    for q in queries:
        if q.exception() is not None:
            raise q.exception()


def status(query: StreamingQuery) -> dict:
    """What the query is doing: batches, rows in, rows a second, state rows."""
    p = query.lastProgress
    if p is None:
        return {"active": query.isActive, "batch": -1, "rows": 0, "rows_per_second": 0.0, "state_rows": 0}
    return {"active": query.isActive, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)}


#: Events of one batch of a replay, about.
BATCH_ROWS = 1_000_000


def paced(events: DataFrame, folder: str, files: int = 16, speed: float = 0.0, limit: int | None = None) -> DataFrame:
    """A stream that replays a table of events in time order: as many files as asked, more if one held over BATCH_ROWS; one a batch.

    The table is cut by ranges of time of about as many events each in one job; equal
    times stay together.  Each range is then copied by itself to where the stream looks.
    speed: events' seconds per second of the wall clock (0: as fast as it goes); the
    ranges are then copied one after the other at that pace by a thread of the driver.
    """
    import threading

    from pyspark.sql import functions as F

    spark, ordered = events.sparkSession, events if limit is None else events.orderBy("@timestamp", "_seq").limit(limit)
    n = max(files, -(-ordered.count() // BATCH_ROWS))
    ordered.repartitionByRange(n, "@timestamp").write.mode("overwrite").parquet(f"{folder}/ranges")
    spark.createDataFrame([], events.schema).write.mode("overwrite").parquet(f"{folder}/in")
    ranges = spark.read.schema(events.schema).parquet(f"{folder}/ranges").groupBy(F.col("_metadata.file_path").alias("file"))
    cut = ranges.agg(F.min("@timestamp").alias("lo"), F.max("@timestamp").alias("hi")).orderBy("lo").collect()  # one row a batch

    def put() -> None:
        for i, r in enumerate(cut):
            spark.read.schema(events.schema).parquet(r["file"]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            if speed and i + 1 < len(cut) and r["lo"] is not None:
                time.sleep((cut[i + 1]["lo"] - r["lo"]).total_seconds() / speed)

    threading.Thread(target=put, daemon=True).start() if speed else put()
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
