"""Traces and manifests as streams: windowed call counts, and rebuilding the graph when manifests arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.build import Graph, build_graph
from ..operators.estate import Config
from ..schema import MANIFEST
from ..sources.manifests import estate, read_manifests


def call_counts(spans: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(start, end, source, target, count) of streamed spans; rows later than ``late`` behind the newest are dropped by the watermark."""
    seen = spans.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "source", "target").agg(F.count("*").alias("count"))
    return seen.select("w.start", "w.end", "source", "target", "count")


def follow_manifests(spark: SparkSession, folder: str, state: str, done: Callable[[Graph], None], config: Config = Config()) -> StreamingQuery:
    """Rebuilds the graph of all manifests in ``folder`` whenever new files arrive, and hands it to ``done``; ``state`` keeps the stream's progress."""
    arrived = spark.readStream.schema(MANIFEST).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)

    def rebuild(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            done(build_graph(estate(read_manifests(spark, folder)), config))

    return arrived.writeStream.foreachBatch(rebuild).option("checkpointLocation", state).trigger(availableNow=True).start()
