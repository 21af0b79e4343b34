"""Structured Streaming: the batch operators over streams, state carried by sinks that can be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import cluster, sampling, sketch
from ..sources import writers
from ..storage import materialize, new_path


def windowed_distinct(stream: DataFrame, window: str = "30 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(window_start, truth, estimate) of a stream of (ts, city), with a watermark so that old windows leave the state."""
    stamped = stream.withColumn("ts", stream["ts"].cast("timestamp"))
    return sketch.windowed_counts(stamped.withWatermark("ts", late), window, slide)


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "5 seconds", mode: str = "append") -> StreamingQuery:
    """Starts a query whose batches go to sink(batch, number); every None: what is there now, then stop."""
    writer = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, through a file sink in the shared folder (append), or the last state through one table a batch (complete)."""
    spark = df.sparkSession
    checkpoint = new_path(spark, f"{name}-checkpoint")
    if mode == "append":
        path = new_path(spark, name)
        df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(path)
    kept: dict[str, DataFrame] = {}

    def last(batch: DataFrame, _: int) -> None:
        kept["state"] = materialize(batch, name)

    start(df, last, checkpoint, None, mode).awaitTermination()
    return kept["state"]


class StreamedDistinct:
    """Distinct cities by sliding window of a stream of (ts, city), all windows since its beginning.

    The state is a written table of distinct slices of time and cities; a batch adds its own, so a
    batch that is run again changes nothing, and events are deduplicated before they meet the state.
    """

    def __init__(self, window: str = "30 seconds", slide: str = "10 seconds") -> None:
        self.window, self.slide = window, slide
        self.slices: DataFrame | None = None

    def __call__(self, batch: DataFrame, number: int) -> None:
        fresh = sketch.by_slice(batch, self.window, self.slide)
        if self.slices is not None:
            fresh = self.slices.unionByName(fresh).distinct()
        self.slices = materialize(fresh, "slices")

    def counts(self) -> DataFrame:
        """(window_start, truth, estimate) of all that came."""
        return sketch.counts_of_slices(self.slices, self.window, self.slide)


class StreamedReservoir:
    """A sample of fixed size over an unbounded stream, with its tag report after every batch.

    The sample is a written table; a batch merges its own bottom-k into it, so a batch that is run again
    changes nothing. With a folder, each batch also writes its report there as lines of text.
    """

    def __init__(self, size: int = 100, tiers: int = 3, key: str = "event_id", folder: str | None = None) -> None:
        self.size, self.tiers, self.key, self.folder = size, tiers, key, folder
        self.seen: dict[int, int] = {}
        self.sample: DataFrame | None = None
        self.reports: list[DataFrame] = []

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.seen[number] = batch.where("size(tags) > 0").count()
        fresh = sampling.reservoir(batch, self.size, self.key)
        if self.sample is not None:
            fresh = sampling.reservoir(self.sample.unionByName(fresh).dropDuplicates([self.key]), self.size, self.key)
        self.sample = materialize(fresh, "reservoir")
        self.reports.append(materialize(sampling.top_tiers(sampling.tag_counts(self.sample), self.tiers), "tiers"))
        if self.folder is not None:
            seen = sum(n for k, n in self.seen.items() if k <= number)
            writers.lines(writers.tag_report(seen, self.reports[-1]), f"{self.folder}/batch={number}")


class ChunkedBfr:
    """BFR over a stream of chunks of points: a batch is a chunk; a batch that is run again is left out."""

    def __init__(self, k: int = cluster.CLUSTERS, first_points: int = 10_000) -> None:
        self.k, self.first_points, self.state, self.done = k, first_points, cluster.State(), -1

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number > self.done and not batch.isEmpty():
            cluster.step(self.state, batch, self.k, self.first_points)
        self.done = max(self.done, number)

    def result(self) -> cluster.State:
        return cluster.finish(self.state)


def stop_on(spark: SparkSession, fatal: Callable[[str], bool]):
    """A listener that stops all other streams once one has ended with an error for which fatal(message) holds, and remembers which."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        stopped: list[str] = []

        def onQueryStarted(self, event) -> None: ...

        def onQueryProgress(self, event) -> None: ...

        def onQueryIdle(self, event) -> None: ...

        def onQueryTerminated(self, event) -> None:
            if event.exception and fatal(event.exception):
                self.stopped.append(str(event.id))
                for query in spark.streams.active:
                    query.stop()

    listener = Listener()
    spark.streams.addListener(listener)
    return listener
