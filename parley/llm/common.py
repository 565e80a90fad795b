"""What the operators share: tables, shared storage, and small session helpers."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import shared_root, table

# The bytes that separate words, U+0020 and U+0009 to U+000D.
WORD_SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{WORD_SPACE}]+"

__all__ = ["SALTS", "WORD", "WORD_SPACE", "discard", "release", "shared_path", "shared_root", "stored", "table", "whole_text", "with_least"]


def whole_text(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str = "stage") -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Empties what `stored` wrote, once nothing reads it any more."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(df.stored_at)


def release(spark: SparkSession) -> None:
    """Lets the JVM collect what no DataFrame refers to any more, so that Spark's cleaner deletes the shuffle files of jobs
    that are over. Without it they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


SALTS = 64


def with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with the least value of their key as `name`. The rows of one key are dealt over SALTS tasks, each of which learns
    the least value from a table with one row for each key and salt: no task gets all rows of a hot key."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "_salt").agg(F.min(value).alias("_part"))
    least = parts.groupBy(key).agg(F.min("_part").alias(name))
    return salted.join(parts.select(key, "_salt").join(least, key), [key, "_salt"]).drop("_salt")
