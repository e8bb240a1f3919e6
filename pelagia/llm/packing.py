"""Packing of token pieces into as few fixed-size sequences as possible by minimum bin slack.

The plan is made from the number of pieces of each length, at most ``capacity`` counters whatever the
input; pieces are then dealt to the plan's places by rank within their length. Ranks come from counts
per (length, bucket) and row numbers inside a bucket, so that one length with a third of all rows is
spread over tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import staged
from .common import shuffle_width
from .tokens import default_vocabulary, tokenizer

CAPACITY = 2048
END_ID = 0
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, row_hash long"


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """The fullest feasible choice of lengths (with multiplicities) for ``room``: (length, times) pairs.

    Subset sums are the bits of one integer; after each length the reachable sums are kept, so the
    choice is read back from the last length to the first. Long lengths come first.
    """
    sums, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        if not length:
            continue
        steps.append((length, sums))
        left, take = min(int(counts[length]), room // length), 1
        while left > 0:  # powers of two reach every multiplicity up to the count
            k = min(take, left)
            sums |= (sums << (k * length)) & mask
            left -= k
            take *= 2
        if sums >> room & 1:
            break
    at = sums.bit_length() - 1
    chosen = []
    for length, before in reversed(steps):
        times = 0
        while not before >> at & 1:
            at -= length
            times += 1
        if times:
            chosen.append((length, times))
    return chosen


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, times), ...]) per pattern; repeats x times sum to ``counts`` for each length.

    Each bin starts with the longest piece left; the rest of it is the fullest choice of what remains.
    A pattern is used as often as the counts allow, so the number of patterns depends on ``capacity``
    (at most the sum of capacity / length over all lengths), never on the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    out = []
    top = len(left) - 1
    while True:
        while top > 0 and not left[top]:
            top -= 1
        if top <= 0:
            return out
        left[top] -= 1
        pattern = dict(fullest(left, capacity - top))
        left[top] += 1
        pattern[top] = pattern.get(top, 0) + 1
        repeats = min(int(left[n]) // times for n, times in pattern.items())
        for n, times in pattern.items():
            left[n] -= repeats * times
        out.append((repeats, sorted(pattern.items(), reverse=True)))


def plan_table(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, list[np.ndarray]]:
    """Per length the intervals of ranks: first rank, times a bin, first bin, offset in the bin."""
    seen: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first_bin = 0
    for repeats, pattern in patterns:
        offset = 0
        for n, times in pattern:
            rows.setdefault(n, []).append((seen.get(n, 0), times, first_bin, offset))
            seen[n] = seen.get(n, 0) + repeats * times
            offset += n * times
        first_bin += repeats
    return {n: [np.array(c, np.int64) for c in zip(*r, strict=True)] for n, r in rows.items()}


def _pieces(vocabulary: str, capacity: int, end_id: int):
    def run(batches):
        encode = tokenizer(vocabulary).encode
        tail, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            cols = [[], [], [], [], [], []]
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("row_hash").to_pylist(), encode(batch.column("text").to_pylist()))
            for doc, row_hash, ids in rows:
                ids += tail
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    for c, x in zip(cols, (doc, k // width, k // 4, len(part) // 4, zlib.crc32(part), row_hash), strict=True):
                        c.append(x)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "row_hash"])

    return run


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every whole text with its end id; null texts count as empty."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row_hash", F.xxhash64("doc_id", "text"))
    return docs.mapInArrow(_pieces(vocabulary or default_vocabulary(), capacity, end_id), PIECE_SCHEMA)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``length`` (1 to ``capacity``), ``doc_id``, ``piece`` and ``row_hash``.

    ``pieces`` is read several times: stage it first. Equal rows keep a place each. Empty input gives no row.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    table = plan_table(plan(counts, capacity))

    width = 4 * shuffle_width(spark)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("row_hash", "piece"), F.lit(width)))
    sizes = pieces.groupBy("length", "bucket").count()
    by_length = Window.partitionBy("length").orderBy("bucket")
    before = sizes.select("length", "bucket", (F.sum("count").over(by_length) - F.col("count")).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("row_hash", "doc_id", "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("before", "bucket")

    def place(frames):
        for df in frames:
            bins, offsets = np.zeros(len(df), np.int64), np.zeros(len(df), np.int64)
            lengths, ranks = df["length"].to_numpy(), df["rank"].to_numpy()
            for n in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == n)
                first, times, first_bin, offset = table[n]
                k = np.searchsorted(first, ranks[rows], side="right") - 1
                nth = ranks[rows] - first[k]
                bins[rows] = first_bin[k] + nth // times[k]
                offsets[rows] = offset[k] + nth % times[k] * n
            yield df.drop(columns=["rank"]).assign(sequence_id=pd.Series(bins, index=df.index), offset=pd.Series(offsets, index=df.index))

    return ranked.mapInPandas(place, ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts and empty texts are one piece, the end id. Null and repeated ids are rows like any other.
    Columns besides ``doc_id`` and ``text`` are ignored; an empty table gives no piece.
    """
    pieces = staged(token_pieces(docs, vocabulary, capacity, end_id), "pieces")
    packed = pack_pieces(pieces, capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
