"""Removal of long word runs that stand in an earlier document, by difference-cover anchors.

A perfect difference set D modulo v has, for any two places i and j, a shift d < v with both i + d and
j + d in D modulo v. Short windows of ``width - v + 1`` words are therefore hashed only where the place
modulo v is in D: two equal runs of ``width`` words share such an anchor at the same shift. Anchors that
two documents share are extended to the full windows around them, and a window goes if the smallest
``doc_id`` that has it is smaller than the document's own.

Both steps deal hashes to tasks, sort them there and look at neighbours. What is shared inside one batch is
known before the shuffle, so a passage that a third of all documents hold sends one row a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _power_tables, hash_texts, mix, shuffle_width, space_words, text_runs

WIDTH = 50
PERIOD = 31
#: A perfect difference set modulo 31: each residue but 0 is the difference of one pair.
COVER = np.array([1, 5, 11, 24, 25, 27])
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def window_hashes(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``width`` word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(h) + 1)
    h = mix(h + np.uint64(seed))
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)])])
    return mix((total[width:] - total[:-width]) * down[:n])


def _word_hashes(texts):
    for a, b in text_runs(texts):
        h, bounds = hash_texts(texts[a:b])
        for i in range(b - a):
            yield h[bounds[i] : bounds[i + 1]]


def anchors(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the anchors of one document."""
    short = window_hashes(h, width - PERIOD + 1)
    places = np.flatnonzero(_IN_COVER[np.arange(len(short)) % PERIOD])
    return short[places], places


def _batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in cols.values()], list(cols))


def _anchor_rows(width: int):
    def run(batches):
        for batch in batches:
            found, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for doc, h in zip(batch.column(0).to_pylist(), _word_hashes(batch.column(1).to_pylist())):
                own = np.unique(anchors(h, width)[0])
                found.append(own)
                docs.append(np.full(len(own), doc, np.int64))
            h, doc = np.concatenate(found), np.concatenate(docs)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            group = np.cumsum(first) - 1
            other = np.zeros(len(h), bool)
            other[1:] = ~first[1:] & (doc[1:] != doc[:-1])
            shared = np.bincount(group, other, minlength=group[-1] + 1 if len(group) else 0)[group] > 0
            key = np.concatenate([h[first], mix(doc[shared].view(np.uint64))])
            known = np.concatenate([np.zeros(first.sum(), bool), np.ones(shared.sum(), bool)])
            yield _batch(known=known, key=key, h=np.concatenate([h[first], h[shared]]), doc_id=np.concatenate([doc[first], doc[shared]]))

    return run


def _shared_anchors(batches):
    """Rows sorted by (known, h, doc_id): those known to be shared, and neighbours of one hash and two documents."""
    held = None
    for batch in batches:
        known = batch.column("known").to_numpy(zero_copy_only=False)
        h, doc = batch.column("h").to_numpy(), batch.column("doc_id").to_numpy()
        hit = known.copy()
        if held is not None:
            known, h, doc, hit = (np.concatenate([[x], y]) for x, y in zip(held, (known, h, doc, hit), strict=True))
        if not len(h):
            continue
        same = (h[1:] == h[:-1]) & ~known[1:] & ~known[:-1]  # one row of a hash and document comes from each batch
        hit[1:] |= same
        hit[:-1] |= same
        held = (known[-1], h[-1], doc[-1], hit[-1])
        keep = np.flatnonzero(hit[:-1])
        yield _batch(doc_id=doc[keep], h=h[keep])
    if held is not None and held[3]:
        yield _batch(doc_id=np.array([held[2]]), h=np.array([held[1]]))


def _window_rows(width: int):
    def run(batches):
        for batch in batches:
            w1s, w2s, docs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            ids, hits = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc, hit, h in zip(ids, hits, _word_hashes(batch.column(1).to_pylist())):
                own, places = anchors(h, width)
                places = places[np.isin(own, np.array(hit, np.int64).view(np.uint64))]
                n = len(h) - width + 1
                if n <= 0 or not len(places):
                    continue
                edge = np.zeros(n + PERIOD + 1, np.int64)
                np.add.at(edge, np.maximum(places - PERIOD + 1, 0), 1)
                np.add.at(edge, np.minimum(places, n - 1) + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge[:n]) > 0)
                w1, at = np.unique(window_hashes(h, width)[starts], return_index=True)
                w1s.append(w1)
                w2s.append(window_hashes(h, width, 1)[starts][at])
                docs.append(np.full(len(w1), doc, np.int64))
            w1, w2, doc = np.concatenate(w1s), np.concatenate(w2s), np.concatenate(docs)
            order = np.lexsort((doc, w2, w1))
            w1, w2, doc = w1[order], w2[order], doc[order]
            first = np.ones(len(w1), bool)
            first[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            lowest = doc[first][np.cumsum(first) - 1]
            known = doc > lowest
            yield _batch(
                known=np.concatenate([np.zeros(first.sum(), bool), np.ones(known.sum(), bool)]),
                key=np.concatenate([w1[first], mix(doc[known].view(np.uint64))]),
                w1=np.concatenate([w1[first], w1[known]]), w2=np.concatenate([w2[first], w2[known]]),
                doc_id=np.concatenate([doc[first], doc[known]]),
            )

    return run


def _later_windows(batches):
    """Rows sorted by (known, w1, w2, doc_id): those known to go, and those with a smaller document of one window."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        known = batch.column(0).to_numpy(zero_copy_only=False)
        w1, w2, doc = (batch.column(k).to_numpy() for k in (2, 3, 4))
        first = np.ones(len(w1), bool)
        first[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        group = np.cumsum(first) - 1
        lowest = doc[first]
        if held is not None and held[:2] == (w1[0], w2[0]):
            lowest[0] = held[2]
        goes = known | (doc > lowest[group])
        if not known[-1]:
            held = (w1[-1], w2[-1], lowest[-1])
        yield _batch(doc_id=doc[goes], w=w1[goes])


def _kept(width: int):
    def run(batches):
        for batch in batches:
            texts, gone = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = []
            dirty = [i for i, g in enumerate(gone) if g]
            covers = {}
            for i, h in zip(dirty, _word_hashes([texts[i] for i in dirty])):
                starts = np.flatnonzero(np.isin(window_hashes(h, width), np.array(gone[i], np.int64).view(np.uint64)))
                edge = np.zeros(len(h) + 1, np.int64)
                edge[starts] += 1
                edge[starts + width] -= 1
                covers[i] = np.cumsum(edge)[:-1] > 0
            for i, text in enumerate(texts):
                words = space_words(text)
                n = len(words)
                if i in covers:
                    words = [words[k] for k in np.flatnonzero(~covers[i])]
                rows.append((n, n - len(words), b" ".join(words)))
            n, removed, kept = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and ``kept``, the words that stay, joined by one space (UTF-8 bytes).

    Words are runs of characters other than space and 0x09-0x0D. A word goes if a window of ``width`` words over
    it also starts in a document with a smaller id. Null texts have no words; rows with a null id keep all of
    theirs and take nothing from others; rows that share an id don't remove from each other. Columns besides
    ``doc_id`` and ``text`` are ignored; an empty table gives no row. Windows are compared by 128 bits of hash.
    """
    if width <= PERIOD:
        raise ValueError(f"windows need more than {PERIOD} words")
    n = shuffle_width(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    lost = texts.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<long>").alias("gone"))
    # a computed key, so that both joins with the texts are served by one exchange
    texts = texts.filter("doc_id is not null").select(F.coalesce("doc_id", F.lit(0)).alias("key"), "text")
    rows = texts.mapInArrow(_anchor_rows(width), "known boolean, key long, h long, doc_id long")
    shared = rows.repartition(n, "key").sortWithinPartitions("known", "h", "doc_id").mapInArrow(_shared_anchors, "doc_id long, h long")
    hits = shared.groupBy(F.col("doc_id").alias("key")).agg(F.collect_set("h").alias("hits"))
    rows = texts.join(hits, "key").select("key", "text", "hits").mapInArrow(_window_rows(width), "known boolean, key long, w1 long, w2 long, doc_id long")
    later = rows.repartition(n, "key").sortWithinPartitions("known", "w1", "w2", "doc_id").mapInArrow(_later_windows, "doc_id long, w long")
    gone = later.groupBy(F.col("doc_id").alias("key")).agg(F.collect_set("w").alias("gone"))
    rows = texts.join(gone, "key", "left").select(F.col("key").alias("doc_id"), "text", "gone").union(lost)
    return rows.mapInArrow(_kept(width), "doc_id long, n_words long, n_removed long, kept binary")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
