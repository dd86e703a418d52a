"""Documents as they arrive: the same stateless plan over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.plans import convert

_FILES = "path string, modificationTime timestamp, length long, content binary"


def convert_arrivals(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Convert every file that appears below ``path`` once and append the results to ``out``."""
    files = spark.readStream.format("binaryFile").schema(_FILES).load(path).select(F.xxhash64("path").alias("doc_id"), "path", "content")

    def sink(batch: DataFrame, _: int) -> None:
        with convert.Conversion(batch) as found:  # a batch leaves nothing kept behind
            found.results().write.mode("append").parquet(out)

    return files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
