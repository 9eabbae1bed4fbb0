"""Documents that arrive in a folder, processed once each: a file stream that stops when all there is has been read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources import files as files_


def arrivals(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """(path, content) of a folder's files as they come, at most so many a batch."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", most_files).load(folder).select("path", "modificationTime", "content")


def process(spark: SparkSession, folder: str, checkpoint: str, documents: str, rejects: str, each: Callable[[DataFrame, int], None] | None = None, most_files: int = 1000, seconds: float | None = None):
    """Read what has arrived since the last call: documents and rejects are written to tables, and each(documents, batch) is called.

    A batch's rows go to a folder of its number, which a repeated batch writes over: so a batch that broke off
    counts once. Returns the finished query; seconds: stop waiting after so long.
    """

    def batch(df: DataFrame, n: int) -> None:
        parsed = files_.parse(df.select("path", "content"))
        parsed.where("error is null").drop("error").write.mode("overwrite").parquet(f"{documents}/batch={n}")
        good = df.sparkSession.read.parquet(f"{documents}/batch={n}")
        # files that aren't among the written documents are the rejects; nothing is read or parsed twice but those
        lost = df.select("path", "content").join(good.select("path"), "path", "left_anti")
        files_.parse(lost).where("error is not null").select("path", "doc_type", "error").write.mode("overwrite").parquet(f"{rejects}/batch={n}")
        if each:
            each(good, n)

    q = arrivals(spark, folder, most_files).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(int(seconds)) if seconds else q.awaitTermination()
    return q


def once(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """A stream's rows without repeats of key that come within a delay of each other; state older than that is let go."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def request_rates(stream: DataFrame, service: str, at: str, tokens: str, delay: str = "2 minutes") -> DataFrame:
    """Requests and tokens of each service by minute, every ten seconds."""
    return stream.withWatermark(at, delay).groupBy(service, F.window(at, "60 seconds", "10 seconds")).agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens"))
