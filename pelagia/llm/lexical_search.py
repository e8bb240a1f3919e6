"""Ranked lexical search: MaxScore over shards of postings.

One scan tokenises whole texts and keeps, for the terms that queries ask for, postings by shard: a run of documents of one
task. Document counts and lengths are summed over all shards; then each shard is searched by itself. Its terms have
an upper bound each, the largest score of one posting in the shard. For one query, terms in ascending order of their bounds are
non-essential as long as their bounds together can't reach the current least score of the best documents: only documents of
essential lists are looked at, and non-essential lists are probed, largest bound first, only for documents that can still qualify.
Shards give their best documents, and a window ranks these.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import staged
from .common import folded_words, small_batches

BEST = 20
#: Saturation and length shares of a score, in thousandths of a term and per cents.
SATURATION, LENGTH_SHARE = 12, 25
#: Documents and postings of a shard at most (a batch of documents is never split).
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 20
#: Bytes of query texts that are searched for in one pass over the postings, and so broadcast with tasks, at most (one item may have more).
BLOCK_BYTES = 16 << 20
#: Documents that are scored together; the least score is raised between such runs.
STRIDE = 2048


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """Score of one occurrence in the query of a posting's term, in whole numbers of 64 bits."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // all_terms
    return weights * ((1_000_000_000 * tf) // (1000 * tf + SATURATION * m))


def best_documents(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, best: int = BEST, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, int]:
    """MaxScore: places of the ``best`` documents with a score above 0, their scores, and the number of postings that were read.

    ``lists`` are a query's terms: places of documents (ascending) and scores in each. Of equal scores the smaller of ``ids`` is better.
    """
    lists = [x for x in lists if len(x[0])]
    bounds = np.array([int(s.max()) for _, s in lists], np.int64)
    order = np.argsort(bounds, kind="stable")
    lists, bounds = [lists[k] for k in order], bounds[order]
    reach = np.cumsum(bounds)  # what the lists up to one can give together
    places, scores, least, read = np.empty(0, np.int64), np.empty(0, np.int64), 1, 0
    if not len(lists):
        return places, scores, read
    # documents of the list with the largest bound come first: they raise the least score for all others
    first = lists[-1][0]
    for rest in (False, True):
        essential = int(np.searchsorted(reach, least, "left"))
        if essential == len(lists):
            break
        if rest:
            todo = np.unique(np.concatenate([p for p, _ in lists[essential:]]))
            todo = todo[~np.isin(todo, first, assume_unique=True)]
        else:
            todo = first
        for a in range(0, len(todo), stride):
            if rest:
                essential = int(np.searchsorted(reach, least, "left"))
                if essential == len(lists):
                    break
            run = todo[a : a + stride]
            total, known = np.zeros(len(run), np.int64), np.zeros(len(run), bool)
            for k in range(len(lists) - 1, -1, -1):
                if k < essential:  # non-essential: only while a document can qualify
                    able = known & (total + reach[k] >= least)
                    if not able.any():
                        run = run[:0]
                        break
                    if not able.all():
                        run, total, known = run[able], total[able], known[able]
                at, score = lists[k]
                low, high = np.searchsorted(at, (run[0], run[-1] + 1))
                read += int(min(high - low, len(run)))
                found = low + np.searchsorted(at[low:high], run)
                hit = found < high
                hit[hit] = at[found[hit]] == run[hit]
                total[hit] += score[found[hit]]
                known |= hit
            if len(run):
                keep = total >= least
                places, scores = np.concatenate([places, run[keep]]), np.concatenate([scores, total[keep]])
                if len(places) > best:
                    keep = np.lexsort((ids[places], -scores))[:best]
                    places, scores = places[keep], scores[keep]
                if len(places) == best:
                    least = max(1, int(scores.min()))
    keep = np.lexsort((ids[places], -scores))[:best]
    return places[keep], scores[keep], read


_SHARD = "docs long, words long, terms array<int>, sizes array<int>, ids binary, unnamed binary, lengths binary, places binary, counts binary"
_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 5]
_NAMES = [x.split()[0] for x in _SHARD.split(", ")]


def _shard(ids: list[int | None], lengths: list[int], found: dict[int, tuple[list[int], list[int]]]) -> pa.RecordBatch:
    """One row: documents by place, and the wanted terms' postings one behind the other."""
    pack = lambda values, kind: np.array(values, kind).tobytes()
    places, counts = ([x for pair in found.values() for x in pair[k]] for k in (0, 1))
    row = [
        len(ids), sum(lengths), list(found), [len(at) for at, _ in found.values()], pack([x or 0 for x in ids], "<i8"), pack([x is None for x in ids], bool),
        pack(lengths, "<i8"), pack(places, "<i4"), pack(counts, "<i4"),
    ]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _KINDS, strict=True)], _NAMES)


def _postings(number: dict[bytes, int]):
    """Texts (doc_id, text) as shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        lengths: list[int] = []
        found: dict[int, tuple[list[int], list[int]]] = {}
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = folded_words(text)
                if not words:
                    continue
                for t, n in Counter(filter(None, map(number.get, words))).items():
                    at, tf = found.setdefault(t, ([], []))
                    at.append(len(ids))
                    tf.append(n)
                    size += 1
                ids.append(doc)
                lengths.append(len(words))
            if len(ids) >= SHARD_DOCS or size >= SHARD_POSTINGS:
                yield _shard(ids, lengths, found)
                ids, lengths, found, size = [], [], {}, 0
        if ids:
            yield _shard(ids, lengths, found)

    return run


def _search(items: list[tuple[int, dict[int, int]]], weights: dict[int, int], n_docs: int, all_words: int, best: int):
    """Shards as each item's best documents (item, doc_id, score) in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lengths"], "<i8")
                places, counts = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("places", "counts"))
                weight = np.repeat(np.array([weights[t] for t in row["terms"]], np.int64), row["sizes"])
                score = impacts(weight, counts, lengths[places], n_docs, all_words)
                named = ~np.frombuffer(row["unnamed"], bool)[places]  # documents without an id are not ranked
                ends = np.cumsum(row["sizes"]).tolist()
                lists = {t: (places[a:b][keep], score[a:b][keep]) for t, a, b in zip(row["terms"], [0, *ends], ends) for keep in (named[a:b],)}
                out: list[tuple[int, int, int]] = []
                for item, terms in items:
                    at, total, _ = best_documents([(lists[t][0], lists[t][1] * q) for t, q in terms.items() if t in lists], ids, best)
                    out += zip([item] * len(at), ids[at].tolist(), total.tolist(), strict=True)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["item", "doc_id", "score"])

    return run


def _items(items: DataFrame) -> DataFrame:
    """Texts and bytes of items of equal ids together."""
    size = F.sum(F.coalesce(F.length("text"), F.lit(0)) + 16).alias("size")
    return items.select("item_id", F.col("text").cast("binary").alias("text")).groupBy("item_id").agg(F.collect_list("text").alias("texts"), size)


def _blocks(items: DataFrame) -> int:
    return max(1, math.ceil((items.agg(F.sum("size")).first()[0] or 0) / BLOCK_BYTES))


def ranked(hits: DataFrame, best: int) -> DataFrame:
    """``hits`` (item_id, doc_id, score) with ``rank``, of each item the best ones."""
    order: list[Column] = [F.desc("score"), F.asc("doc_id")]
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return hits.withColumn("rank", place).filter(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """Per item of ``items`` (item_id, text) its ``best`` documents of ``docs`` (doc_id, text): item_id, rank, doc_id, score.

    Terms are runs of 0-9, a-z and other characters than ASCII, A-Z lower-cased, of whole texts, however long. Only scores above 0 are returned; of equal
    scores the smaller ``doc_id`` is first. Null and empty texts have no terms and count nowhere. Documents with a null id count in the
    statistics but are not ranked; rows that share an id are ranked one by one. Item rows that share an id are one item with the terms of all
    of them, repeats included; a null ``item_id`` is an item, too. Other columns are ignored; without items, or without documents, no row is returned.

    Items are searched in blocks of ``BLOCK_BYTES`` of text, each with a scan of the documents; a task holds one shard's postings. Jobs run while this is called.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = staged(_items(items), "items")
    blocks = _blocks(items)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kind = items.schema["item_id"].dataType
    out: DataFrame | None = None
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = mine.select("item_id", "texts").collect()  # a block's bytes
        number: dict[bytes, int] = {}
        queries: list[tuple[int, dict[int, int]]] = []
        for k, row in enumerate(rows):
            terms = Counter(w for t in row["texts"] for w in folded_words(bytes(t)))
            queries.append((k, {number.setdefault(w, len(number) + 1): n for w, n in terms.items()}))
        hits = _block_hits(texts, number, queries, best)
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], f"item long, item_id {kind.simpleString()}")
        hits = hits.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")
        out = hits if out is None else out.union(hits)
    return ranked(out, best)


def _block_hits(texts: DataFrame, number: dict[bytes, int], queries: list[tuple[int, dict[int, int]]], best: int) -> DataFrame:
    shards = staged(texts.mapInArrow(_postings(number), _SHARD), "postings")
    n_docs, all_words = (x or 0 for x in shards.agg(F.sum("docs"), F.sum("words")).first())
    lists = shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df"))
    weights = {r["terms"]: term_weight(n_docs, r["df"]) for r in lists.collect()}  # a row a term of the block
    return shards.mapInArrow(_search(queries, weights, n_docs, all_words, best), "item long, doc_id long, score long")


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
