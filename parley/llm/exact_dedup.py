"""Exact deduplication as a stateful stream.

Texts are equal if they are identical after every byte of white space is deleted. Documents arrive as files. A first stream reads
each once and writes a narrow row for it: doc_id, length, digest, and where its content lies (file and row). A second stream
keeps state by digest, in RocksDB on the executors' disks with changelogs in the shared checkpoint, and without a watermark, so
nothing expires: how many rows have the digest, which of them stays, and the locator of its content. Both streams take what has
arrived and stop; started again on the same folder they take the new files only, and an executor that is lost costs the batch
at hand.

A hit, a digest of more than one row, is checked on the full bytes: in each task equal contents of a digest become one before
anything is shuffled, and a digest that ends with more than one content is resolved by its contents instead. Only rows that a
sieve of SLOTS marks can pass are read for that, and none is lost by it: with many groups the sieve lets everything through.

A group that holds a third of all rows is one partial state of each task and one content of each task. Where the rows get their
result, the group's are the left side of a join by digest, whose oversized partitions Spark splits (skew join); no text is in them.

Of a group the row with the most code points stays, then the smallest doc_id, then the first in the order of locators; a row
without doc_id comes after all that have one. Defined results: a null text counts as empty, and all texts of white space are
equal to it; several rows with one doc_id are rows of their own, of which one at most is kept; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.llm.common import shared_path, stored, whole_text

#: Each trigger takes about as many bytes of files for each core.
BYTES_A_CORE = 32 << 20
SLOTS = 1 << 20
#: Stores of the state for each core. Each is a database with files of its own, so there are as many as can work at once, and not
#: as many as a shuffle has parts; a folder keeps the number it was begun with.
STORES_A_CORE = 2
_BACKEND = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# The white space that equality ignores, U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def content(text: Column) -> Column:
    """What is compared: the text without white space."""
    return F.translate(text, SPACE, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(rows: DataFrame) -> DataFrame:
    """Rows of Parquet files -> doc_id, text, file, row."""
    return rows.select("doc_id", whole_text().alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def narrow(rows: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, text, file, row -> doc_id, length, digest, file, row."""
    return rows.select("doc_id", F.length("text").alias("length"), digest(content(F.col("text"))).alias("digest"), "file", "row")


def _rank() -> Column:
    """The least of a group stays."""
    return F.struct((-F.col("length")).alias("length"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "row")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ExactDedup:
    """Deduplication of all files that have arrived at `path`; `folder` holds checkpoints and narrow rows from run to run."""

    def __init__(self, spark: SparkSession, path: str, folder: str | None = None, digest: Callable[[Column], Column] = sha256, bytes_a_core: int = BYTES_A_CORE):
        self.spark, self.path, self.digest = spark, path.rstrip("/"), digest
        self.folder = folder or shared_path(spark, "exact-dedup")
        self.bytes_a_trigger = bytes_a_core * spark.sparkContext.defaultParallelism

    def _source(self, schema: StructType, path: str) -> DataFrame:
        return self.spark.readStream.schema(schema).option("maxBytesPerTrigger", str(self.bytes_a_trigger)).parquet(path)

    def take(self) -> None:
        """Runs both streams over what has arrived since the last call."""
        whole = self.spark.read.parquet(self.path).schema
        one_or_many = f"{self.path[:-1]}[{self.path[-1]}]"  # as a pattern, which may match a folder or a single file
        rows = narrow(located(self._source(whole, one_or_many)), self.digest)
        writer = rows.writeStream.format("parquet").option("path", f"{self.folder}/rows").option("checkpointLocation", f"{self.folder}/reading")
        writer.trigger(availableNow=True).start().awaitTermination()
        stores = str(STORES_A_CORE * self.spark.sparkContext.defaultParallelism)
        with _settings(self.spark, {"spark.sql.streaming.stateStore.providerClass": _BACKEND, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.internal.stateStore.partitions": stores}):
            state = self._source(rows.schema, f"{self.folder}/rows").groupBy("digest").agg(F.min(_rank()).alias("kept"), F.count("*").alias("rows"))
            writer = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{self.folder}/state")
            writer.trigger(availableNow=True).start().awaitTermination()

    def rows(self) -> DataFrame:
        """The narrow rows of all that was taken."""
        return self.spark.read.parquet(f"{self.folder}/rows")

    def state(self) -> DataFrame:
        """digest, keep_id, file, row, size: what is held of each digest."""
        held = self.spark.read.format("statestore").load(f"{self.folder}/state")
        kept, size = (F.col("value").getField(name) for name in held.schema["value"].dataType.names)
        return held.select(F.col("key.digest").alias("digest"), kept["doc_id"].alias("keep_id"), kept["file"].alias("file"), kept["row"].alias("row"), size.alias("size"))

    def contents(self, hits: DataFrame) -> DataFrame:
        """digest, content, and the columns of `located`, of all rows whose digest may be one of hits."""
        slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS))
        marked = hits.select(slot.alias("_slot")).distinct()  # at most SLOTS numbers
        rows = located(self.spark.read.parquet(self.path)).withColumn("content", content(F.col("text")))
        rows = rows.withColumn("digest", self.digest(F.col("content"))).withColumn("_slot", slot)
        return rows.join(F.broadcast(marked), "_slot", "left_semi").drop("_slot")

    def collided(self, hits: DataFrame) -> DataFrame:
        """The digests of hits under which more than one content lies, by comparison of all bytes."""
        distinct = self.contents(hits).groupBy("digest").agg(F.size(F.collect_set("content")).alias("contents"))
        return distinct.where("contents > 1").select("digest")

    def result(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, digest of every row that was taken."""
        hits = stored(self.state().where("size > 1"), "groups")
        collided = stored(self.collided(hits), "collided")
        rows = self.rows()
        parts = []
        if not collided.isEmpty():
            # another text has this digest: the rows below it are grouped by their contents
            open_rows = self.contents(collided).join(collided, "digest", "left_semi").withColumn("length", F.length("text"))
            groups = open_rows.groupBy("digest", "content").agg(F.min(_rank()).alias("kept"), F.count("*").alias("size"))
            groups = groups.select("digest", "content", F.col("kept.doc_id").alias("keep_id"), F.col("kept.file").alias("keep_file"), F.col("kept.row").alias("keep_row"), "size")
            parts.append(self._told(open_rows.join(groups, ["digest", "content"])))
            rows, hits = (x.join(collided, "digest", "left_anti") for x in (rows, hits))
        # rows of a hot digest stay where they are: Spark splits skewed partitions of the left side of this join
        groups = hits.withColumnRenamed("file", "keep_file").withColumnRenamed("row", "keep_row")
        parts.append(self._told(rows.join(groups, "digest", "left")))
        return reduce(DataFrame.unionAll, parts)

    @staticmethod
    def _told(rows: DataFrame) -> DataFrame:
        alone = F.col("size").isNull()
        here = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
        return rows.select(
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            (alone | here).alias("kept"),
            "digest",
        )


def deduplicated(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of the files at path, and of all that was taken into folder before."""
    run = ExactDedup(spark, path, folder)
    run.take()
    return run.result().select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark, os.path.join(sf_dir, "documents.parquet"))


def sql() -> str:
    """The rows of op11 in DuckDB."""
    return r"""with c as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as content from documents)
    select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by content) as group_size, row_number() over w = 1 as kept, sha256(content) as text_sha256
    from c window w as (partition by content order by n desc, doc_id)"""
