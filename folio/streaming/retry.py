"""Another look for entries that weren't resolved: requests arrive as a stream, a micro-batch resolves and settles them.

What a batch writes goes to rows that still exist, so an entry deleted while it was looked up stays deleted. A batch that
failed is repeated whole, under the same version of the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import triage
from ..scratch import written
from .tables import KeyedTable

RESULT = ["status", "resolved", "provenance", "conflicts"]


def settled(entries: DataFrame, resolve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """entry_id and RESULT of the entries that are unresolved and untouched; one without a title in the end is notFound."""
    s, pinned = F.col("status"), F.coalesce("pinned", F.lit(False))
    asked = entries.filter(triage.is_unresolved(s) & ~triage.is_untouchable(s, pinned))
    done = resolve(asked).select("entry_id", *RESULT).join(asked.select("entry_id", F.col("title").alias("__t"), pinned.alias("__p")), "entry_id")
    title = F.coalesce(F.nullif(F.col("resolved.title"), F.lit("")), F.col("__t"))
    return done.withColumn("status", triage.settle(s, F.col("__p"), title)).drop("__t", "__p")


def retry_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """done, still: how many were looked up again, and how many of them are still unresolved. One row."""
    return before.select("entry_id").join(after, "entry_id", "left").agg(F.count("*").alias("done"), F.count_if(triage.is_unresolved(F.col("status"))).alias("still"))


def retry_batches(requests: DataFrame, table: KeyedTable, resolve: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "retry"):
    """Start a query over a stream of entry_id; returns the query. resolve: entries -> entry_id and RESULT.

    The requests are observed under `name`, for a Progress listener.
    """

    def run(batch: DataFrame, number: int) -> None:
        # Either is written once: the batch is read, and its entries are looked up, one time only.
        ids = written(batch.select("entry_id"))
        live = table.read().join(ids, "entry_id", "left_semi")
        table.update(number, written(settled(live, resolve)), RESULT)

    seen = requests.observe(name, F.count(F.lit(1)).alias("requests"), F.count_if(F.col("entry_id").isNull()).alias("without_id"))
    return seen.writeStream.queryName(name).foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Requests and batches so far, per observed name, from the running queries' own progress. Disabled, it notes nothing."""

    def __init__(self, enabled: bool = True):
        self.enabled, self.batches, self.totals, self.ended = enabled, {}, {}, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if not self.enabled:
            return
        for name, row in event.progress.observedMetrics.items():
            counted = row.asDict()
            if any(counted.values()):
                self.batches[name] = self.batches.get(name, 0) + 1
            total = self.totals.setdefault(name, {})
            for k, v in counted.items():
                total[k] = total.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.enabled:
            self.ended.append(str(event.id))
