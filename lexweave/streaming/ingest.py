"""A landing folder as a stream of ingests (an extension: the archive itself is batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexweave.operators import relational
from lexweave.plans.archive import Archive
from lexweave.sources.shared import saved


def follow(spark: SparkSession, archive: Archive, landing: str, checkpoint: str) -> StreamingQuery:
    """Ingests text files as they land, a micro-batch at a time: pseudonyms are numbered across all
    documents, so batches go one after another. A batch that Spark repeats after a failure finds
    its documents there and adds nothing."""

    def one(batch: DataFrame, epoch: int) -> None:
        catalog = archive.table("catalog")
        rows = batch.withColumn("document_id", F.sha2("uri", 256)).join(catalog.select("document_id"), "document_id", "left_anti")
        first = (catalog.agg(F.max("ingest_seq")).first()[0] or 0) + 1
        # numbered without their texts
        numbers = relational.numbered(rows.select("uri").distinct(), ["uri"], saved).select("uri", (F.col("number") + (first - 1)).alias("ingest_seq"))
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
        archive.ingest(rows.join(numbers, "uri").withColumn("created_at", now))

    texts = spark.readStream.format("text").option("wholetext", True).load(landing).select(F.col("value").alias("raw_text"), F.col("_metadata.file_path").alias("uri"))
    return texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
