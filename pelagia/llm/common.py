"""Shared helpers of the training-data operators: joins that spread hot keys, words, hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged

#: Bytes that are not part of a folded word: everything in ASCII except 0-9 and a-z.
_KEEP = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
FOLD_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else (c if c >= 128 or c in _KEEP else 32) for c in range(256)
)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Ids that may be broadcast (16 bytes each in the hash table); more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` (long) is in ``ids``, staged; broadcast only after they are counted."""
    ids = ids.select("doc_id")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` (long) is not among ``ids``; rows with a null id stay. Broadcast only after a count."""
    ids = staged(ids.select(F.col("doc_id").alias("gone_id")).filter("gone_id is not null").distinct(), "gone")
    if ids.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), docs["doc_id"] == ids["gone_id"], "left_anti")
    named = docs.filter("doc_id is not null")
    return named.join(ids, named["doc_id"] == ids["gone_id"], "left_anti").union(docs.filter("doc_id is null"))


#: A key with more than one in so many rows is hot: there are fewer of them than this.
HOT_PARTS = 10_000


def with_matches(left: DataFrame, right: DataFrame, keys: list[str], many: str, total: int, salt: list[str]) -> DataFrame:
    """``left`` with ``match``, the struct of the other columns of ``right`` (staged, a row for each of ``keys``), or null.

    ``many`` of ``right`` counts the rows of a key, of ``total``. Hot keys, fewer than ``HOT_PARTS``, are broadcast; the others are joined by
    shuffle, in which rows of hot keys and of null ones are spread by ``salt``.
    """
    match = F.struct(*[c for c in right.columns if c not in keys])
    is_hot = F.col(many) * HOT_PARTS > total
    hot = right.where(is_hot).select(*keys, match.alias("__hot"))
    cold = right.where(~is_hot).select(*keys, match.alias("__cold"), F.lit(0).alias("__salt"))
    out = left.join(F.broadcast(hot), keys, "left")
    apart = F.col("__hot").isNotNull()
    for k in keys:
        apart = apart | F.col(k).isNull()
    out = out.withColumn("__salt", F.when(apart, 1 + F.pmod(F.xxhash64(*salt), F.lit(1 << 20)).cast("int")).otherwise(0))
    out = out.join(cold, [*keys, "__salt"], "left").withColumn("match", F.coalesce("__hot", "__cold"))
    return out.select(*left.columns, "match")


#: Bytes and rows of the batches that tasks pass to Python at most, so that what a worker holds at once is bounded.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 5000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to bounded sizes, where they aren't smaller already. Takes effect on plans that run later."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(name, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def folded_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of 0-9, a-z and non-ASCII characters."""
    return text.translate(FOLD_WORDS).split() if text else []


def space_words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D."""
    if not text:
        return []
    return text.lower().split() if lower else text.split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2**64, grown on demand."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def hash_texts(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the space-separated words of a few texts, and where each text's words begin in them.

    Returns (hashes, bounds): words of texts[i] are hashes[bounds[i]:bounds[i + 1]]. A word's hash is a
    polynomial in its bytes modulo 2**64, finalised with its length; it is the same in every process.
    """
    texts = [t or b"" for t in texts]
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buf = _LOWER[buf]
    gap = _SPACES[buf]
    inside = ~gap
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        change = np.concatenate([[0], change])
    starts, ends = change[0::2], change[1::2]
    up, down = _power_tables(len(buf) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)])])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    places = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return h, np.searchsorted(starts, places)


def text_runs(texts: list[bytes | None], most: int = 1 << 21):
    """Slices of consecutive texts of about ``most`` bytes together (one text may be longer)."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
