"""Dependencies that arrive as a stream (from lockfile rows, say) are matched in micro-batches; late ages are summed per window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veristrata.operators import advisories as adv


def watch(deps: DataFrame, advisories: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of deps (project, ecosystem, name, version) is matched with what `advisories` reads at that time; sink(rows, batch) writes
    project, ecosystem, name, version, advisory, verdict. A batch may come again after a failure, with the same number: sinks overwrite by it.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        found = adv.match(batch, advisories())
        rows = batch.select("project", *adv.PACKAGE, "version").distinct().join(found, [*adv.PACKAGE, "version"])
        sink(rows.select("project", *adv.PACKAGE, "version", "advisory", "verdict"), number)
        batch.unpersist()

    return deps.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """window, source, n, newest: records (source, ts) by window of their time; those later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), "source").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))
