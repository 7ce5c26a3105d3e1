"""A streaming feed of findings: JSON lines that arrive late or twice become one row per fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.host import FINDING

SCHEMA = FINDING + ", seen_at timestamp"


def fingerprint() -> F.Column:
    """Identity of a finding: check, file and subject; nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in ("check_id", "file", "subject")]
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The stream of findings in a folder of JSON-lines files."""
    return spark.readStream.schema(SCHEMA).json(path)


def deduplicated(feed: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each fingerprint once within the watermark; state is bounded by what arrives in that time. Rows without a time are
    dropped from the stream, since no watermark covers them."""
    return feed.filter("seen_at IS NOT NULL").withColumn("fingerprint", fingerprint()).withWatermark("seen_at", lateness).dropDuplicatesWithinWatermark(["fingerprint"])


def counts_per_window(feed: DataFrame, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Findings per check, severity and tumbling window."""
    return feed.withWatermark("seen_at", lateness).groupBy(F.window("seen_at", window), "check_id", "severity").agg(F.count(F.lit(1)).alias("n")).select("window.start", "check_id", "severity", "n")
