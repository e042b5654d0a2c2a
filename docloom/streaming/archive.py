"""Streaming forms of the incremental operators.

The archive grows by files; a stream of document rows is appended exactly once per document_id. Counts
over event time use watermarks, so state is dropped once a window can no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docloom.sources import tables


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append_new(stream: DataFrame, folder: str, name: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends rows whose key the table does not hold yet; takes what is there, then ends.

    A batch that is repeated after a failure finds its keys and adds nothing twice.
    """

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = tables.read_table(spark, folder, name).select(key)
        fresh = batch.dropDuplicates([key]).join(known, key, "left_anti")
        tables.append_table(fresh.select(*batch.columns), folder, name)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows per window of event time and value of ``by``; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def distinct_stream(stream: DataFrame, key: str, time: str, late: str = "2 days") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
