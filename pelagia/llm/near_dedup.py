"""Near-duplicate documents by b-bit MinHash over word shingles.

One pass gives each document's set size, a 128-bit digest of its set, 16 band keys from 64 minima and the low
4 bits of 256 minima packed into 1024 bits. Documents with equal sets fold into one representative.
Representatives that share a band key are candidates; the packed bits give a similarity estimate, corrected for chance
agreement, and pairs far below the threshold are dropped by it; the others are compared on their full sets
(:mod:`.linking`). A link of similarity 0.8 shares no band with probability 2e-4, and is dropped by the estimate, which lies
six standard deviations under the threshold, with probability under 1e-8.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from .common import among, hash_texts, mix, small_batches, text_runs, with_matches
from .linking import link_groups, packed_sets

MINIMA, BANDS, ROWS, BITS = 256, 16, 4, 4
_FACTORS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
SIGNATURES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"


def shingle_sets(texts: list[bytes | None], width: int, lower: bool = True):
    """The sorted distinct hashes of each text's ``width``-word shingles; fewer words are one shingle."""
    for a, b in text_runs(texts):
        h, bounds = hash_texts(texts[a:b], lower)
        rolled = mix(h)
        for k in range(1, width):
            rolled = rolled[: max(0, len(h) - k)] * np.uint64(0x9E3779B97F4A7C15) + mix(h[k:])
        rolled = mix(rolled)
        for i in range(b - a):
            first, last = bounds[i], bounds[i + 1]
            if first == last:
                yield np.empty(0, np.uint64)
            elif last - first < width:
                own = mix(h[first:last])
                whole = own[0]
                with np.errstate(over="ignore"):
                    for x in own[1:]:
                        whole = whole * np.uint64(0x9E3779B97F4A7C15) + x
                yield mix(np.array([whole ^ np.uint64(last - first)]))
            else:
                yield np.unique(rolled[first : last - width + 1])


def minima(values: np.ndarray) -> np.ndarray:
    """The smallest value under each of the hash functions."""
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), 2048):
        out = np.minimum(out, (values[k : k + 2048, None] * _FACTORS).min(axis=0))
    return out


def sketch(low: np.ndarray) -> np.ndarray:
    """The low bits of finalised minima, 16 to a 64-bit word."""
    nibbles = (mix(low) & np.uint64(15)).reshape(-1, 16)
    return np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def set_digest(values: np.ndarray) -> list[int]:
    """128 bits that are the same for equal sets."""
    d1 = np.add.reduce(mix(values), dtype=np.uint64)
    d2 = np.bitwise_xor.reduce(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)
    return _signed(np.array([d1, d2], np.uint64))


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _signatures(width: int):
    def run(batches):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        names = [x.split()[0] for x in SIGNATURES.split(", ")]
        for batch in batches:
            cols = [[] for _ in names]
            for doc, values in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), width)):
                bands, bits = [], b""
                if len(values):
                    low = minima(values)
                    rows = mix(low[: BANDS * ROWS]).reshape(BANDS, ROWS)
                    key = np.arange(BANDS, dtype=np.uint64)
                    for k in range(ROWS):
                        key = mix(key * np.uint64(31) + rows[:, k])
                    bands, bits = _signed(key), sketch(low).tobytes()
                for c, x in zip(cols, (doc, len(values), *set_digest(values), bands, bits), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1).to_pylist(), width))
            digests = np.array([set_digest(v) for v in sets], np.int64).reshape(-1, 2)
            columns = [batch.column(0), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([v.tobytes() for v in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "d1", "d2", "payload"])

    return run


def least_estimate(percent: int) -> float:
    """Estimates below this, six standard deviations under the threshold, are not compared in full."""
    p = percent / 100
    return p - 6 * (p * (1 - p) / MINIMA) ** 0.5


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept (it is that id).

    Words are runs of characters other than space and 0x09-0x0D, A-Z lower-cased. A text with fewer than
    ``width`` words is one shingle; null and empty texts have none and are linked with nothing. Rows with
    a null id are linked with nothing, have a null component and are kept. Repeated rows are equal sets of one
    id and all returned; rows that share an id but not the text are one document, linked by any of
    its texts. Columns besides ``doc_id`` and ``text`` are ignored. Empty tables give no row. Jobs run while this is called.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = staged(texts.mapInArrow(_signatures(width), SIGNATURES), "signatures")
    of_set = ["d1", "d2", "n_shingles"]
    own = signed.filter("doc_id is not null and n_shingles > 0")
    sets = own.groupBy(*of_set).agg(F.min("doc_id").alias("id"), F.count("*").alias("many"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    sets = staged(sets, "equal")
    total = own.count()
    found = []
    # ids of several rows, and those of several texts, which join their sets
    ids = own.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(F.struct(*of_set)).alias("a"), F.max(F.struct(*of_set)).alias("b")).where("rows > 1")
    ids = staged(ids.select("doc_id", (F.col("a") != F.col("b")).alias("several")), "repeated")
    repeated = bool(ids.take(1))
    if repeated and ids.where("several").take(1):
        mine = own.join(ids.where("several"), "doc_id", "left_semi").select("doc_id", *of_set)
        mine = with_matches(mine, sets.select(*of_set, "many", "id"), of_set, "many", total, ["doc_id"])
        found = [mine.select(F.col("doc_id").alias("u"), F.col("match.id").alias("v")).where("u <> v").distinct()]
    member = staged(sets.select(F.posexplode("bands").alias("band", "h"), "id").select(F.xxhash64("band", "h").alias("key"), "id").distinct(), "member")
    sizes = sets.groupBy("id").agg(F.sum("n_shingles").alias("n")) if found else sets.select("id", F.col("n_shingles").alias("n"))

    def known(asked: Callable[[], DataFrame]) -> DataFrame:
        """The full sets of representatives and their packed signatures, staged."""
        ids = staged(asked().select(F.col("id").alias("doc_id")), "asked")
        values = among(texts, ids).select("doc_id", "text")
        values = values.mapInArrow(_sets(width), "doc_id long, d1 long, d2 long, payload binary").withColumnRenamed("doc_id", "id")
        if repeated:
            values = values.dropDuplicates(["id", "d1", "d2"])
        return staged(values.join(sets.select("id", "d1", "d2", "sketch"), ["id", "d1", "d2"]).select("id", "payload", "sketch"), "sets")

    labels = link_groups(member, sizes, known, packed_sets, 8, percent, least_estimate(percent), found)
    named = sets.join(labels.withColumnRenamed("u", "id"), "id", "left").select(*of_set, "many", F.coalesce("component", "id").alias("component"))
    named = staged(named, "classes")
    keys = signed.select("doc_id", "n_shingles", *[F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in ("d1", "d2")])
    out = with_matches(keys, named, of_set, "many", total, ["doc_id"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("match.component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
