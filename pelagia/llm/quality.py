"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages: its UTF-8 bytes in runs of ``PASSAGE`` bytes, whole texts, however long. Each passage is encoded: how its
classes of characters follow each other, how long, how varied and how repetitive its words are; a small learned layer makes
its representation. Labels are known of documents only, so a gated attention network learns with the classifier which passages tell:
the weight of passage k is softmax_k(w . (tanh(V h_k) * sigmoid(U h_k))), and the document's score is that of the weighted sum of
its passages' representations. The sums are kept while a text is read, so that a task holds a few passages of a long text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, small_batches

KEEP_AT = 0.3
#: Bytes of a passage, and passages that are encoded together.
PASSAGE, TOGETHER = 400, 2048
#: Labelled documents that the network is fitted on, and bytes that each of them has, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 1 << 18
#: Sizes of a passage's representation and of the attention's inside.
HIDDEN, GATES = 32, 16
EPOCHS, AT_ONCE, RATE, DECAY = 40, 64, 4e-3, 1e-4

# Classes of bytes; bytes above 127 are letters.
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "!?", "'\"-()", "#$%&*@+=~^_`", "|<>[]{}/\\"]
CLASSES = len(_GROUPS) + 2
_CLASS = np.full(256, CLASSES - 1, np.uint8)
_CLASS[128:] = CLASSES - 2
for _k, _group in enumerate(_GROUPS):
    for _c in _group:
        _CLASS[ord(_c)] = _k
_SPACE = np.isin(_CLASS, (3, 4))
#: How far back a word is looked for.
LOOK_BACK = (1, 2, 3, 4, 6, 8)
WIDTH = CLASSES * CLASSES + 5 + len(LOOK_BACK)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin, their lengths, and hashes of their bytes."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    begin, size = change[0::2], change[1::2] - change[0::2]
    if not len(begin):
        return begin, size, np.empty(0, np.uint64)
    first = np.zeros(len(data), np.int64)
    first[begin] = begin
    place = np.arange(len(data)) - np.maximum.accumulate(first)
    code = mix(place.astype(np.uint64) * np.uint64(256) + data)
    code[~inside[1:-1]] = 0
    return begin, size, np.add.reduceat(code, begin)


def passage_features(data: np.ndarray) -> np.ndarray:
    """A row of numbers for each passage of some bytes; words belong to the passage in which they begin."""
    n = max(1, -(-len(data) // PASSAGE))
    out = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return out
    kind = _CLASS[data].astype(np.int64)
    at = np.arange(len(data)) // PASSAGE
    follows = np.bincount(at[1:] * CLASSES**2 + kind[:-1] * CLASSES + kind[1:], minlength=n * CLASSES**2).reshape(n, -1)
    out[:, : CLASSES**2] = np.sqrt(follows / np.maximum(1, follows.sum(axis=1, keepdims=True)))
    begin, size, h = _words(data)
    if len(begin):
        of = begin // PASSAGE
        words = np.bincount(of, minlength=n)
        share = lambda values: np.bincount(of, values, minlength=n) / np.maximum(1, words)
        mean = share(size)
        order = np.lexsort((h, of))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
        rest = [np.log1p(words), np.log1p(mean), np.log1p(np.maximum(0, share(size.astype(float) ** 2) - mean**2)), np.bincount(of[order], new, minlength=n) / np.maximum(1, words), np.log1p(np.bincount(at, minlength=n))]
        for back in LOOK_BACK:
            same = np.zeros(len(h))
            same[back:] = h[back:] == h[:-back]
            rest.append(share(same))
        out[:, CLASSES**2 :] = np.stack(rest, axis=1)
    return out


def encoded(text: bytes | None) -> Iterator[np.ndarray]:
    """Features of all passages of a text, some at once; an empty text is one passage without bytes. Words at such a cut count in parts."""
    data = np.frombuffer(text or b"", np.uint8)
    for a in range(0, max(1, len(data)), PASSAGE * TOGETHER):
        yield passage_features(data[a : a + PASSAGE * TOGETHER])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Gated attention over passages. ``weights`` are W, b (representation), V, U, w (attention), c, d (classifier)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def _passages(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        big_w, b, big_v, big_u, w, _, _ = self.weights
        h = np.tanh(x @ big_w + b)
        t, g = np.tanh(h @ big_v), _sigmoid(h @ big_u)
        return h, t, g, (t * g) @ w

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, runs: Iterator[np.ndarray]) -> float:
        """Score of one document from its passages' features, of which only a run is held at once."""
        top, total, sums = -np.inf, 0.0, np.zeros(HIDDEN)
        for x in runs:
            h, _, _, e = self._passages(self.normal(x))
            most = max(top, float(e.max()))
            a = np.exp(e - most)
            shrink = np.exp(top - most)
            top, total, sums = most, total * shrink + a.sum(), sums * shrink + a @ h
        return float(_sigmoid(sums / total @ self.weights[5] + self.weights[6][0]))

    def gradients(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss of documents whose normal features begin at ``starts``, and its slope by each weight."""
        _, _, big_v, big_u, w, c, d = self.weights
        doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        h, t, g, e = self._passages(x)
        a = np.exp(e - np.maximum.reduceat(e, starts)[doc])
        a /= np.add.reduceat(a, starts)[doc]
        z = np.add.reduceat(a[:, None] * h, starts)
        logit = z @ c + d[0]
        loss = float((np.logaddexp(0, logit) - labels * logit).mean())
        dl = (_sigmoid(logit) - labels) / len(labels)
        dz = (dl[:, None] * c)[doc]
        da = (h * dz).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, starts)[doc])
        both = de[:, None] * w
        dt, dg = both * g * (1 - t * t), both * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ big_v.T + dg @ big_u.T) * (1 - h * h)
        return loss, [x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ dl, np.array([dl.sum()])]


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Weights that fit documents' passages to their labels (Adam, the same for the same rows in the same order)."""
    rng = np.random.default_rng(seed)
    rows = np.concatenate(bags).astype(np.float64)
    scale = rows.std(axis=0)
    network = Network(rows.mean(axis=0), np.where(scale > 1e-6, scale, 1.0), [])
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    start = float(np.log(labels.mean() / (1 - labels.mean())))
    network.weights = [draw(WIDTH, HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, GATES), draw(HIDDEN, GATES), draw(GATES), draw(HIDDEN), np.array([start])]
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in network.weights]
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for a in range(0, len(order), AT_ONCE):
            some = order[a : a + AT_ONCE]
            starts = np.concatenate([[0], np.cumsum([len(bags[k]) for k in some])[:-1]])
            x = network.normal(np.concatenate([bags[k] for k in some]).astype(np.float64))
            _, slopes = network.gradients(x, starts, labels[some])
            step += 1
            for value, slope, pair in zip(network.weights, slopes, moments, strict=True):
                pair[0] += 0.1 * (slope - pair[0])
                pair[1] += 0.001 * (slope * slope - pair[1])
                value -= rate * (pair[0] / (1 - 0.9**step) / (np.sqrt(pair[1] / (1 - 0.999**step)) + 1e-8) + DECAY * value)
    return network


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [np.concatenate(list(encoded(t))).tobytes() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), batch.column(1), batch.column(2)], ["bag", "quality", "place"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network | float:
    """The fitted network, or one score for all if there are not labels of both kinds.

    It learns from at most ``sample_rows`` labelled documents of at most ``SAMPLE_BYTES`` bytes that aren't held out, drawn by a hash of their ids. Equal texts with
    one label count once. An id's label is the least of its rows; labels other than 0 and 1 are left out.
    """
    marked = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    marked = marked.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).filter(F.length("text") <= SAMPLE_BYTES)
    sample = texts.join(F.broadcast(marked), "doc_id")  # at most sample_rows small rows
    sample = sample.groupBy("text", "quality").agg(F.min("place").alias("place"))
    rows = sorted(sample.mapInArrow(_bags, "bag binary, quality int, place long").collect(), key=lambda r: (r["place"], r["quality"]))
    values = np.array([r["quality"] for r in rows], float)
    if not len(values) or values.min() == values.max():
        return 0.5 if not len(values) else 0.02 + 0.96 * float(values[0])
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in rows], values)


def _scores(network: Network | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [network if isinstance(network, float) else network.score(encoded(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1, higher: better), predicted (1 from ``KEEP_AT`` on).

    Scores depend on the text alone; equal texts have equal scores. Null and empty texts are one passage without bytes. Null and
    repeated ids are rows like any other (a null id is not held out); other columns are ignored; an empty table gives no
    row. Without labels of both kinds (``labels``: doc_id, quality) all scores are one: 0.98 or 0.02 by the kind there is, 0.5 with none.
    """
    small_batches(docs.sparkSession)
    network = train(docs, labels, sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    scored = texts.mapInArrow(_scores(network), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
