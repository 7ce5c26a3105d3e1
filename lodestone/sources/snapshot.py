"""Snapshots of repositories as DataFrames: files, lines, commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: files over this size aren't read as text.
MAX_BYTES = 2 * 1024 * 1024


def files(spark: SparkSession, root: str, repo: str, tracked: DataFrame | None = None) -> DataFrame:
    """(repo, path, size, is_binary, text) of a checked-out tree at `root` (any store that Spark reads), without .git; of the
    paths in `tracked` (column path) alone, if it is given. Text is null for binary files and those over MAX_BYTES, which
    aren't opened. An empty tree gives an empty table."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    whole = found.filter(~F.col("path").rlike(r"/\.git/"))
    # the length is known from the listing: content is read for small files alone
    raw = whole.filter(F.col("length") <= MAX_BYTES).unionByName(whole.filter(F.col("length") > MAX_BYTES).withColumn("content", F.lit(None).cast("binary")))
    path = F.regexp_replace("path", "^.*?" + root.split("://")[-1].strip("/").replace(".", r"\.") + "/", "")
    small = raw.select(F.lit(repo).alias("repo"), path.alias("path"), F.col("length").alias("size"), F.when(F.col("length") <= MAX_BYTES, F.col("content")).alias("content")).filter(~F.col("path").rlike(r"^\.git/"))
    binary = F.coalesce(F.col("content").cast("string").contains("\x00"), F.lit(False)) | F.coalesce(~F.is_valid_utf8(F.col("content").cast("string")), F.lit(False))
    if tracked is not None:
        small = small.join(tracked.select(F.col("path").alias("_t")).distinct(), F.col("path") == F.col("_t"), "left_semi")
    marked = small.withColumn("is_binary", binary)
    return marked.select("repo", "path", "size", "is_binary", F.when(~F.col("is_binary"), F.col("content").cast("string")).alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """(repo, path, line, text): lines from 1 without their line ends; a final line end opens no line."""
    body = F.regexp_replace("text", r"\r?\n\z", "")
    return files.filter("text IS NOT NULL AND text <> ''").select("repo", "path", F.posexplode(F.split(body, r"\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def commits(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """(repo, o, f): commit and touched file from a log of `\\x01<id>` lines, each followed by one path per line."""
    # a row per commit, so that a large log is split over tasks
    each = spark.read.text(path, lineSep="\x01")
    entry = each.filter("value <> ''").select(F.split("value", r"\r?\n").alias("l"))
    return entry.select(F.lit(repo).alias("repo"), F.get("l", F.lit(0)).alias("o"), F.explode(F.filter(F.slice("l", 2, F.size("l")), lambda x: x != "")).alias("f")).distinct()
