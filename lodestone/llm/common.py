"""Shared helpers: inputs, the shared folder and lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, and what it is replaced by before splitting.
WHITE = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; one of our own only where it is unset and all executors
    are threads of this process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs no earlier stage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder as Parquet and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a key above which it is spread, at least, and over how many tasks.
HOT, SPREAD = 256, 64


def join_spread(rows: DataFrame, key: str, by: str, once: DataFrame, once_key: str, n: str) -> DataFrame:
    """`rows` joined to `once`, which has one row per key with the number `n` of its rows. Rows of a key that has more than its
    part are spread by a hash of `by` over SPREAD copies of its one row. Such keys are fewer than four to a shuffle
    partition, which is what is broadcast."""
    spark = rows.sparkSession
    total = once.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.col(n) > max(HOT, total / (4 * shuffle_partitions(spark)))
    keys = once.filter(hot).select(F.col(once_key).alias("_hot"))
    copies = once.withColumn("_c", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    dealt = rows.join(F.broadcast(keys), F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumn("_d", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.lit(SPREAD))).cast("int"))
    return dealt.join(copies, (F.col(key) == F.col(once_key)) & (F.col("_d") == F.col("_c"))).drop("_hot", "_c", "_d")


def give_back() -> None:
    """Return to the system what this Python worker has freed: workers are reused from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def words_of(text) -> F.Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text column, in order (null: none)."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.array_remove(F.split(spaced, " "), "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
