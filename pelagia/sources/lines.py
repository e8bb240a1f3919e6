"""Text whose line order matters, read in parallel: numbered lines and numbered tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import staged


def _numbered(df: DataFrame, count: str, out: str) -> DataFrame:
    """Adds ``out``, the running sum of ``count`` before each row of (file, block, seq), per file from 0.

    Sums run inside blocks of a file; what came in earlier blocks is added from a small table of a row a block.
    """
    inside = Window.partitionBy("file", "block").orderBy("seq")
    own = df.withColumn(out, F.sum(count).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(count))
    sizes = df.groupBy("file", "block").agg(F.sum(count).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy("file").orderBy("block")) - F.col("__n")).drop("__n")
    return own.join(before, ["file", "block"]).withColumn(out, F.col(out) + F.col("__before")).drop("__before")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, line, value): lines of text files with their number in the file, from 0."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    return _numbered(text.withColumn("one", F.lit(1)), "one", "line").select("file", "line", "value")


def fields(value: str = "value"):
    """The words of a line, without what follows a ``!``."""
    return F.split(F.trim(F.regexp_replace(value, r"!.*$", "")), r"\s+")


def numbered_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, n, token): all words of text files in their order, from 0."""
    text = spark.read.text(path).select(F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("words"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    placed = _numbered(text.withColumn("count", F.size("words")), "count", "first")
    return placed.select("file", "first", F.posexplode("words").alias("k", "token")).select("file", (F.col("first") + F.col("k")).alias("n"), "token")


def followed(nexts: DataFrame, start: int, steps: int) -> DataFrame:
    """Rows (rank, at): the first ``steps`` places of the list that begins at ``start`` and goes on by ``nexts`` (at, next).

    Places are found by doubling: after k rounds those of the first 2 ** k ranks are known, and pointers reach 2 ** k places ahead. The list ends where a place has no row.
    """
    spark = nexts.sparkSession
    jump = staged(nexts.select("at", "next"), "jumps")
    known = spark.createDataFrame([(0, start)], "rank long, at long").where(F.lit(steps > 0))
    reach = 1
    while reach < steps:
        ahead = known.join(jump, "at").select((F.col("rank") + reach).alias("rank"), F.col("next").alias("at"))
        known = staged(known.union(ahead.where(F.col("rank") < steps)), "ranks")
        reach *= 2
        if reach < steps:
            far = jump.select(F.col("at").alias("next"), F.col("next").alias("__far"))
            jump = staged(jump.join(far, "next").select("at", F.col("__far").alias("next")), "jumps")
    return known


def matrix(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Rows (i, j, value) of a stream of numbers stored n to a row, i running fastest."""
    t = numbered_tokens(spark, path)
    return t.select((F.col("n") % n).cast("int").alias("i"), F.floor(F.col("n") / n).cast("int").alias("j"), F.col("token").cast("double").alias("value"))
