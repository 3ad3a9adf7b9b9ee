"""Streams into versioned tables: each batch once, whatever is lost between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldtrace.plans import ingest
from fieldtrace.sources.versions import Tables


def store_stream(rows: DataFrame, folder: str, table: str, name: str, checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Adds the rows of a stream (with bundle_id) to a table, or with mode `complete` puts each result in its place.

    Without a `trigger` it reads what there is and ends.  The batch's number is noted in the version that has its rows.  A batch that Spark brings again, as it does when a run
    ends between the two, is known and left alone.
    """

    def keep(batch: DataFrame, number: int) -> None:
        tables = Tables(batch.sparkSession, folder)
        if mode == "complete":
            tables.replace({table: batch}, note=(name, number))
        else:
            tables.append({table: batch}, note=(name, number))

    writer = rows.writeStream.queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(keep)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def ingest_stream(spark: SparkSession, uploads: str, folder: str, checkpoint: str, members: str, each: int = 8, trigger: dict | None = None, **options) -> StreamingQuery:
    """Ingests the archives that arrive in a folder, at most `each` in a batch, and stores their bundles.

    A bundle that comes again replaces its own rows.
    """

    def keep(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.collect()]  # `each` names at most
        if paths and Tables(batch.sparkSession, folder).noted("uploads") < number:
            ingest.store(ingest.ingest(batch.sparkSession, paths, store_at=members, **options), folder, ("uploads", number))

    kind = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(kind).option("maxFilesPerTrigger", each).load(uploads).select(F.col("path"))
    writer = found.writeStream.queryName("uploads").option("checkpointLocation", checkpoint).foreachBatch(keep)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
