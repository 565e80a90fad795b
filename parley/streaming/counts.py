"""Word counts that grow as messages arrive: a file stream whose batches are merged into a table of counts.

This is the engine's chunked parse as a stream: the result after any split into batches is that of one batch over all.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as T


class IncrementalCounts:
    """Counts as immutable Parquet parts in levels: one part for each batch, and `fan` parts of a level merged into one of the next,
    so that a batch costs its own words and now and then a merge. A batch that is run again writes the same parts."""

    def __init__(self, spark: SparkSession, path: str, fan: int = 4):
        self.spark, self.path, self.fan = spark, path, fan

    def _part(self, level: int, k: int) -> str:
        return os.path.join(self.path, f"level={level}", f"part={k}")

    def merge(self, batch: DataFrame, k: int) -> None:
        T.counted(batch.select("text")).write.mode("overwrite").parquet(self._part(0, k))
        level, last = 0, k
        while (last + 1) % self.fan == 0:  # the last part of a full level
            parts = [self._part(level, j) for j in range(last - self.fan + 1, last + 1)]
            level, last = level + 1, (last + 1) // self.fan - 1
            self.spark.read.parquet(*parts).groupBy("word").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(self._part(level, last))
        self.last = k

    def counts(self, batches: int) -> DataFrame:
        """word, n after so many batches: the parts that no later level holds."""
        parts, level, n = [], 0, batches
        while n:
            parts += [self._part(level, j) for j in range(n // self.fan * self.fan, n)]
            level, n = level + 1, n // self.fan
        return self.spark.read.parquet(*parts).groupBy("word").agg(F.sum("n").alias("n"))

    def run(self, source: str, schema, checkpoint: str, files_at_once: int = 1) -> DataFrame:
        """Takes in all files that are there, batch by batch, and returns the counts."""
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
        self.last = -1
        query = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return self.counts(self.last + 1)
