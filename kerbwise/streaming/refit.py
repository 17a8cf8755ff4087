"""Lookup tables kept up to date by the stream: counts per batch, lookups from their sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwise.operators.cleaning import clean
from kerbwise.operators.impact import LEVEL_KEYS, lookup_counts, lookups_from, score
from kerbwise.session import cut

COUNT_KEYS = ("corridor", *LEVEL_KEYS[0], "hot", "dur_trust_us")
COUNT_SCHEMA = (
    "corridor string, cause string, priority string, tier string, hot boolean, dur_trust_us bigint, n bigint, epoch bigint"
)


class LookupStore:
    """Counts behind the lookup tables in a shared folder, one part per batch.

    A batch replaces its own part only, so a batch that is run again after a failure leaves the store
    as it was, and the lookups as of any batch are the sums of the parts up to it. Medians and shares
    follow from the summed counts exactly; they never depend on how the log was split into batches.
    A part holds distinct labels and durations, not incidents. Reads list the parts, one folder a batch.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def update(self, cleaned: DataFrame, epoch: int) -> None:
        """Write the counts of one batch, in place of those of an earlier attempt at it."""
        lookup_counts(cleaned).write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")

    def counts(self, epoch: int | None = None) -> DataFrame:
        """Counts over all batches up to ``epoch`` (all of them if not given)."""
        parts = self.spark.read.schema(COUNT_SCHEMA).option("basePath", self.folder).parquet(self.folder)
        if epoch is not None:
            parts = parts.filter(F.col("epoch") <= epoch)
        return parts.groupBy(*COUNT_KEYS).agg(F.sum("n").alias("n"))

    def lookups(self, epoch: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Clearance medians and corridor criticality as of ``epoch``."""
        return lookups_from(cut(self.counts(epoch)))


def refit_enrich(stream: DataFrame, store: LookupStore, out: str, checkpoint: str) -> DataFrame:
    """Score incidents as they arrive with lookups that include their own batch.

    Every batch first adds its counts to ``store``, then is scored as of itself and written to its own
    part of ``out``. Both writes replace what an earlier attempt at the batch left. Returns the rows
    written so far with the ``epoch`` of their batch. An empty batch writes an empty part.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        cleaned = clean(batch)
        store.update(cleaned, epoch)
        score(cleaned, *store.lookups(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.option("basePath", out).parquet(out)
