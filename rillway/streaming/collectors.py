"""Collectors: what is counted as a stream's records are applied, micro-batch by micro-batch, as a table."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQueryListener

from rillway.streaming.jobs import shared

METRICS = "observed"


class Collector(StreamingQueryListener):
    """Keeps the observed metrics of one query's micro-batches; the driver holds one row per micro-batch."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.rows, self.run, self.ended = names, {}, None, threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if (found := p.observedMetrics.get(METRICS)) is not None:
            self.rows.setdefault(str(p.runId), {})[p.batchId] = (p.batchId, p.numInputRows, *(found[n] for n in self.names))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if self.run is None or str(event.runId) == self.run:
            self.ended.set()


def collected(stream: DataFrame, counters: dict[str, Column], name: str) -> tuple[DataFrame, DataFrame]:
    """Runs the stream over all there is: (its rows, what was counted). The second has batch, input_rows and the
    counters, aggregates over each micro-batch's rows, which are taken in the pass that writes them."""
    spark, out = stream.sparkSession, shared(stream.sparkSession, name)
    collector = Collector(list(counters))
    spark.streams.addListener(collector)
    try:
        seen = stream.observe(METRICS, *(c.alias(n) for n, c in counters.items()))
        query = seen.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
        collector.run = str(query.runId)
        query.awaitTermination()
        collector.ended.wait(60)
    finally:
        spark.streams.removeListener(collector)
    rows = [tuple(r) for r in collector.rows.get(collector.run, {}).values()]
    return spark.read.schema(stream.schema).parquet(f"{out}/data"), spark.createDataFrame(rows, _schema(stream, counters))


def _schema(stream: DataFrame, counters: dict[str, Column]) -> str:
    """Batch, input rows, and the counters with their types."""
    types = stream.groupBy().agg(*(c.alias(n) for n, c in counters.items())).schema
    return ", ".join(["batch long", "input_rows long", *(f"{f.name} {f.dataType.simpleString()}" for f in types)])
