"""Streaming ingest of location batches into keyed tables, with a quarantine.

A message is a line of JSON, {"locations": [...]}. What does not decode, has an unknown source or a source without a table,
goes to the quarantine; a store error is tried once more and then quarantines the rows too. Sources are told apart row by row.
Writes are by key, so a batch that is delivered twice changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..operators.keyed import Store
from ..schema import ADDRESS_TABLE_OF, LOCATION, SOURCES

MESSAGE = StructType([StructField("locations", ArrayType(LOCATION)), StructField("_corrupt_record", StringType())])
TRIGGER = "30 seconds"


def messages(spark: SparkSession, folder: str, files: int = 50) -> DataFrame:
    """New files of lines below `folder`, so many at a time."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files).format("text").load(folder)


def decoded(lines: DataFrame) -> DataFrame:
    """(value, bad, pos, location columns); bad says why a line cannot be used."""
    m = F.from_json("value", MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.select("value", m.alias("m")).withColumn("bad", F.when(F.col("m._corrupt_record").isNotNull() | F.col("m").isNull() | F.col("m.locations").isNull(), "undecodable"))
    each = rows.select("value", "bad", F.posexplode_outer("m.locations").alias("pos", "l")).select("value", "bad", "pos", "l.*")
    # The source comes as its name or its code.
    names = F.create_map(*(x for n, c in SOURCES.items() for x in (F.lit(str(c)), F.lit(n))))
    each = each.withColumn("source", F.coalesce(F.try_element_at(names, F.col("source")), F.col("source"), F.lit("Unknown")))
    known = F.col("source").isin("Geonames", *ADDRESS_TABLE_OF)
    return each.where("bad is not null or pos is not null").withColumn("bad", F.coalesce("bad", F.when(~known, "unsupported source")))


def ingest_batch(store: Store, lines: DataFrame, batch_id: int, quarantine: str, insert: Callable | None = None) -> None:
    """One micro-batch: decode, split by source, upsert, quarantine."""
    rows = decoded(lines).withColumn("_order", F.monotonically_increasing_id()).persist()
    try:
        bad = rows.where("bad is not null").select("value", "bad").distinct()
        for source in ("Geonames", *ADDRESS_TABLE_OF):
            part = rows.where((F.col("source") == source) & F.col("bad").isNull()).drop("value", "bad", "pos")
            if part.isEmpty():
                continue
            run = insert or ((lambda p: store.insert_cities(p, "_order")) if source == "Geonames" else (lambda p, s=source: store.insert_addresses(p, s, "_order")))
            for again in (False, True):
                try:
                    run(part)
                    break
                except Exception as e:
                    if again:
                        failed = rows.where((F.col("source") == source) & F.col("bad").isNull()).select("value", F.lit(f"store: {type(e).__name__}").alias("bad")).distinct()
                        bad = bad.union(failed)
        if not bad.isEmpty():
            # A folder a batch: a batch that runs again writes its own anew.
            bad.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").json(f"{quarantine}/batch={batch_id}")
    finally:
        rows.unpersist()


def ingest(store: Store, folder: str, checkpoint: str, quarantine: str, once: bool = False, files: int = 50, insert: Callable | None = None):
    """A running query; once: all that is there, then stop. Shut down with query.stop() after processAllAvailable()."""
    writer = messages(store.spark, folder, files).writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)
    return writer.foreachBatch(lambda lines, n: ingest_batch(store, lines, n, quarantine, insert)).start()


def enqueue(locations: DataFrame, folder: str) -> None:
    """Writes locations as messages into the landing folder, a message a source and partition. Nothing for no rows."""
    if not locations.isEmpty():
        grouped = locations.select("source", F.struct(*locations.columns).alias("l"), F.spark_partition_id().alias("p"), (F.monotonically_increasing_id() % (1 << 33) / 10_000).cast("bigint").alias("chunk"))
        batch = grouped.groupBy("source", "p", "chunk").agg(F.to_json(F.struct(F.collect_list("l").alias("locations"))).alias("value"))
        batch.select("value").write.mode("append").text(f"{folder}/{uuid.uuid4().hex}")
