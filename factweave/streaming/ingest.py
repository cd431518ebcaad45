"""Incremental ingest of facts with Structured Streaming.

Every micro-batch is upserted by content keys, so a batch delivered twice changes nothing; relations are judged
for the pairs that the batch's facts take part in. Progress is in the stream's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from factweave.operators.dedupe import latest_facts
from factweave.plans.pipeline import relate_new
from factweave.schema import FACT
from factweave.session import cut
from factweave.sources.store import Store


def fact_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Facts arriving as Parquet files in a folder."""
    return spark.readStream.schema(FACT).option("maxFilesPerTrigger", str(files_per_batch)).parquet(path)


def ingest_stream(facts: DataFrame, store: Store, checkpoint: str, relate: bool = True) -> StreamingQuery:
    """Starts the upsert of a stream of facts into a store; it ends when all that is there has been taken in."""

    def take(batch: DataFrame, _: int) -> None:
        new = cut(latest_facts(batch))
        if new.isEmpty():
            return
        store.save("facts", new)
        if relate:
            relate_new(store, new.select("fact_id"))

    return facts.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
