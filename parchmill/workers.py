"""Size of the batches of whole texts: those that go to Python workers, and those that Parquet is read in."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows that go to a Python worker at a time: whole texts, of which it and the JVM hold a few batches.
BATCH_ROWS, SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that a task reads from Parquet at a time: their texts are one array in the JVM, which is doubled by copies as it fills.
READ_ROWS, READ_SETTING = 512, "spark.sql.parquet.columnarReaderBatchSize"


def small_batches(spark: SparkSession) -> None:
    """Batches of texts of ``BATCH_ROWS`` rows at most, read ``READ_ROWS`` at a time, from now on; smaller ones stay, and Spark's limit in bytes holds too."""
    rows = int(spark.conf.get(SETTING))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(SETTING, str(BATCH_ROWS))
    if int(spark.conf.get(READ_SETTING)) > READ_ROWS:
        spark.conf.set(READ_SETTING, str(READ_ROWS))
