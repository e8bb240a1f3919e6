"""Token ids in a word-aligned binary format (Simple-8b) and back.

A block holds the ids of consecutive documents. Its ``words`` are little-endian 64-bit words: the top
4 bits select one of the packings below, the low 60 bits hold that many values from the low end up.
Selector 15 is an escape: its one value is the next entry of the block's ``escapes`` (64-bit values that
no packing holds). A block's own offsets (``doc_ids``, ``doc_lens``, ``first``) let it be decoded
alone, by whole arrays per selector. Blocks are rows of a Parquet table, so executors that are lost
leave no half-written files and readers need nothing but Spark's readers.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import new_path
from .common import shuffle_width
from .tokens import default_vocabulary, tokenizer

#: (values, bits) of selectors 0 to 13, fixed by the format; 60 zero bits are left for none of them.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15

BLOCK_IDS = 1 << 16
BLOCK_SCHEMA = "shard int, block int, first long, n_ids long, doc_ids array<long>, doc_lens array<long>, words binary, escapes binary"


#: Bits of each number of 16 bits.
_BITS_OF_16 = np.concatenate([[0], np.repeat(np.arange(1, 17), 1 << np.arange(16))]).astype(np.uint8)


def bit_lengths(v: np.ndarray) -> np.ndarray:
    """Bits of each unsigned 64-bit number; 0 has none."""
    out = _BITS_OF_16[v & np.uint64(0xFFFF)]
    for k in range(16, int(v.max(initial=0)).bit_length(), 16):
        part = _BITS_OF_16[v >> np.uint64(k) & np.uint64(0xFFFF)]
        out = np.where(part > 0, part + np.uint8(k), out)
    return out


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Simple-8b words and escapes of unsigned 64-bit values."""
    v = values.astype(np.uint64)
    n = len(v)
    if not n:
        return b"", b""
    # bits of the widest of the values from each place on, for longer and longer runs; zeros follow the last value
    widest, runs = np.concatenate([bit_lengths(v), np.zeros(60, np.uint8)]), 1
    chosen = np.full(n, ESCAPE, np.uint8)
    for k in range(len(PACKINGS) - 1, -1, -1):
        count, bits = PACKINGS[k]
        while runs < count:
            more = min(runs, count - runs)
            widest[:-more] = np.maximum(widest[:-more], widest[more:])
            runs += more
        chosen[widest[:n] <= bits] = k
    step = np.array([c for c, _ in PACKINGS] + [1, 1], np.int64)[chosen].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, np.int64)
    kind = chosen[starts]
    out = kind.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([v, np.zeros(60, np.uint64)])
    for k, (count, bits) in enumerate(PACKINGS):
        rows = np.flatnonzero(kind == k)
        if len(rows):
            shift = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[rows] |= np.bitwise_or.reduce(padded[starts[rows, None] + np.arange(count)] << shift, axis=1)
    return out.astype("<u8").tobytes(), v[starts[kind == ESCAPE]].astype("<u8").tobytes()


def unpack(words: bytes, escapes: bytes, n: int) -> np.ndarray:
    """The n values of :func:`pack`."""
    w = np.frombuffer(words, "<u8")
    kind = (w >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in PACKINGS] + [1, 1], np.int64)[kind]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for k, (count, bits) in enumerate(PACKINGS):
        rows = np.flatnonzero(kind == k)
        if len(rows):
            shift = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[at[rows, None] + np.arange(count)] = (w[rows, None] >> shift) & np.uint64((1 << bits) - 1)
    out[at[kind == ESCAPE]] = np.frombuffer(escapes, "<u8")
    if len(out) < n:
        raise ValueError("a block holds fewer ids than it says")
    return out[:n]


def _blocks(vocabulary: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        encode = tokenizer(vocabulary).encode
        shard = TaskContext.get().partitionId()
        tail = np.array([end_id], "<u4").tobytes()
        ids, docs, lens, size, block, first = [], [], [], 0, 0, 0

        def row():
            words, escapes = pack(np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((shard, pa.int32()), (block, pa.int32()), (first, pa.int64()), (size, pa.int64()), (docs, pa.list_(pa.int64())), (lens, pa.list_(pa.int64())), (words, pa.binary()), (escapes, pa.binary()))],
                ["shard", "block", "first", "n_ids", "doc_ids", "doc_lens", "words", "escapes"],
            )

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids.append(text + tail)
                docs.append(doc)
                lens.append(len(text) // 4 + 1)
                size += lens[-1]
                if size >= BLOCK_IDS:
                    yield row()
                    ids, docs, lens, first, size, block = [], [], [], first + size, 0, block + 1
        if docs:
            yield row()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2) -> None:
    """Encode every whole text and write Simple-8b blocks in ascending ``doc_id`` order to ``path``.

    Columns besides ``doc_id`` and ``text`` are ignored. Null texts count as empty, null ids come
    first, rows with one id are ordered by their text's hash and all kept; an empty table gives no block.
    Shards are ranges of ``doc_id``, numbered in order; each is written by one task, block after block.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ranged = docs.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    ranged.mapInArrow(_blocks(vocabulary or default_vocabulary(), end_id), BLOCK_SCHEMA).write.parquet(path)


def _decoded(batches):
    for batch in batches:
        for r in batch.to_pylist():
            ids = unpack(r["words"], r["escapes"], r["n_ids"]).astype("<u4")
            ends = np.cumsum(r["doc_lens"])
            begins = ends - r["doc_lens"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["shard"]] * len(ends), pa.int32()),
                    pa.array(r["doc_ids"], pa.int64()),
                    pa.array(begins + r["first"], pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary()),
                ],
                ["shard", "doc_id", "place", "ids"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, ids): ``ids`` are little-endian 32-bit, ``start`` the number of ids before them."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row a shard: as many as partitions were written
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    docs = blocks.mapInArrow(_decoded, "shard int, doc_id long, place long, ids binary")
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "ids")


def token_digest(tokens: DataFrame) -> DataFrame:
    """Per document of :func:`read_tokens`: doc_id, start, n_tokens, ids_crc32."""
    return tokens.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_digest(read_tokens(spark, path))
