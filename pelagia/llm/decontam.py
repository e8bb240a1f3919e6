"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ``width`` consecutive words (the whole item if it is shorter). A window
is a set of positioned 2-word shingles, ordered by how rare they are in the corpus. Exact containment
needs every shingle, so the necessary prefix is the rarest one alone: document shingles are joined with
those prefix shingles by hash, the shingle's offset gives the only place where the window can stand,
length and position bounds drop places outside the text, and the words there are compared in full.
A window of one word has no shingle: it is joined with the single words of the documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Runs of characters outside words.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH = 13
#: Bytes of window text that are broadcast at once; a larger benchmark is joined in blocks of this size.
BLOCK_BYTES = 32 << 20


def word_array(text: Column) -> Column:
    """Words of a text in its own case; the first and the last element may be empty."""
    return F.split(F.coalesce(text, F.lit("")), GAPS)


def word_count(words: Column) -> Column:
    """Number of words of a :func:`word_array`."""
    n = F.size(words)
    ends = F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0) + F.when((n > 1) & (F.get(words, n - 1) == ""), 1).otherwise(0)
    return (n - ends).cast("long")


def _shingle(at: Column) -> Column:
    """Hash of the 2-word shingle of ``words`` at a place; a last word counts as one."""
    return F.xxhash64(F.lower(F.get("words", at)), F.lower(F.get("words", at + 1)))


def _shingles(df: DataFrame, *keep: str) -> DataFrame:
    """Rows (keep..., words, pos, h) for each place of ``words``, but for a last word with one before it."""
    last = F.greatest(F.size("words") - 2, F.lit(0))
    places = df.select(*keep, "words", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    return places.select(*keep, "words", "pos", _shingle(F.col("pos")).alias("h"))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Different windows of all items: wtext (words joined by spaces), len, words, items (sorted item ids as strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.filter(word_array(F.translate("text", UPPER, LOWER)), lambda w: w != "").alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - width + 1, F.lit(1)))
    windows = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("all", s, width))).alias("words"))
    windows = windows.groupBy(F.array_join("words", " ").alias("wtext")).agg(F.first("words").alias("words"), F.collect_set("item").alias("items"))
    return windows.withColumn("len", F.size("words"))


#: Stands for "the document itself" among shingle hashes.
ITSELF = -7046029254386353131


def find_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Where each window stands in each document: (doc_key, n_words, start, len, items).

    ``docs`` has doc_key and words; each of its rows also gives a row with a null start. ``windows`` is read
    more than once: stage it. Documents are scanned once for the shingle counts and once for each block
    of at most ``BLOCK_BYTES`` of windows, and once more for each block if there are windows of one word.
    """
    total = windows.agg(F.sum(F.length("wtext")), F.count("*"), F.count_if(F.col("len") == 1)).first()
    blocks = 1 + int((total[0] or 0) + 64 * total[1]) // BLOCK_BYTES
    parts = _shingles(windows.filter("len > 1"), "wtext")
    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))

    # rarity: occurrences of the windows' shingles in all documents
    wanted = parts.select("h").distinct()
    counted = [
        _shingles(docs).select("h").join(F.broadcast(wanted.filter(block_of("h") == b)), "h").groupBy("h").count()
        for b in range(blocks)
    ]
    counts = staged(reduce(DataFrame.unionByName, counted), "rarity")
    rarest = Window.partitionBy("wtext").orderBy(F.coalesce("count", F.lit(0)), "h", "pos")
    anchors = parts.drop("words").join(counts, "h", "left").withColumn("k", F.row_number().over(rarest)).filter("k = 1")
    anchors = staged(anchors.join(windows.drop("words"), "wtext").select("h", F.col("pos").alias("at"), "wtext", "len", "items"), "anchors")

    def block(b: int) -> DataFrame:
        by_shingle = anchors.filter(block_of("wtext") == b).groupBy("h").agg(F.collect_list(F.struct("at", "wtext", "len", "items")).alias("anchored"))
        itself = by_shingle.sparkSession.range(1 if b == 0 else 0).select(F.lit(ITSELF).alias("h"), F.array().cast(by_shingle.schema["anchored"].dataType).alias("anchored"))
        last = F.greatest(F.size("words") - 2, F.lit(0))
        places = docs.select("doc_key", "words", F.explode(F.sequence(F.lit(-1), last)).alias("pos"))
        h = F.when(F.col("pos") < 0, F.lit(ITSELF)).otherwise(_shingle(F.col("pos")))
        found = places.select("doc_key", "words", "pos", h.alias("h")).join(F.broadcast(by_shingle.unionByName(itself)), "h")
        found = found.select("doc_key", "pos", "words", F.explode_outer("anchored").alias("w")).withColumn("start", F.col("pos") - F.col("w.at"))
        inside = (F.col("start") >= 0) & (F.col("start") + F.col("w.len") <= F.size("words"))
        there = F.translate(F.array_join(F.slice("words", F.col("start") + 1, F.col("w.len")), " "), UPPER, LOWER)
        n_words = F.when(F.col("w").isNull(), word_count(F.col("words")))
        found = found.filter(F.col("w").isNull() | (inside & (there == F.col("w.wtext"))))
        return found.select("doc_key", n_words.alias("n_words"), "start", F.col("w.len").alias("len"), F.col("w.items").alias("items"))

    def single_words(b: int) -> DataFrame:
        single = windows.filter((F.col("len") == 1) & (block_of("wtext") == b)).select("wtext", "len", "items")
        places = docs.select("doc_key", F.posexplode("words").alias("start", "word"))
        found = places.join(F.broadcast(single), F.translate("word", UPPER, LOWER) == F.col("wtext"))
        return found.select("doc_key", F.lit(None).cast("long").alias("n_words"), "start", "len", "items")

    found = [block(b) for b in range(blocks)] + [single_words(b) for b in range(blocks if total[2] else 0)]
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = 5) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (hit words are ``percent`` % or more).

    The columns of ``docs`` besides ``doc_id`` and ``text`` are ignored. A null text and one without words
    have no words and aren't contaminated; null ids and repeated rows give a row each; items that are null,
    empty or without words have no window; repeated items count by their ids. Empty tables are fine.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("of")).alias("doc_key")
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = staged(benchmark_windows(benchmark, width), "windows")
    found = find_windows(docs.select(key, word_array(F.col("text")).alias("words")), windows)

    # hit words: union of [start, start + len) by the furthest end so far
    earlier = Window.partitionBy("doc_key").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(earlier), F.lit(0))))
    found = found.withColumn("fresh", fresh).groupBy("doc_key").agg(
        F.count("n_words").alias("copies"), F.max("n_words").alias("n_words"), F.coalesce(F.sum("fresh"), F.lit(0)).cast("long").alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select(
        F.col("doc_key.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
    )


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
