"""Toxicity scores over deobfuscated words.

A noisy channel writes words with leetspeak, marks or spaces between letters, hidden and repeated letters.
A character trigram model, counted over all documents, and the channel's costs form a lattice for each
odd-looking chunk; its best path (Viterbi) is the restored word. Documents are scored by a sparse logistic
model over restored words and their beginnings, fitted on a bounded sample of the labelled documents.

Decoding is bounded for any input: a run of more than ``RUN`` equal signs is read as one of ``RUN``, and a chunk that is then longer than ``LONGEST``
signs is read in pieces between signs that stand for no letter; a piece that is still longer holds no word.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from .common import small_batches
from .tokens import forget

#: Toxic texts that a feature needs at least; with fewer toxic texts nothing is learned and all scores are one.
LEAST_TOXIC = 5
#: Labelled documents that the classifier is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Features that the classifier may use, at most.
FEATURES = 2_000
BEGINNINGS = (4, 5, 6)
REJECT_AT = 0.7
MEMO_WORDS = 300_000
#: Equal signs in a row that are looked at, and signs of a chunk that is decoded at once.
RUN, LONGEST = 4, 64

# Letters of the character model; everything else is a gap (symbol 0).
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
SYMBOLS = 64
# Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l",
}
#: Signs that may hide a letter.
HIDES = "*#"
#: Costs (negative logarithms) of the channel.
LEET_COST, DROP_COST, HIDE_COST, REPEAT_COST = 0.5, 0.7, 4.0, 1.0
_CODES = np.zeros(0x110000, np.uint8)
for _i, _c in enumerate(LETTERS):
    _CODES[ord(_c)] = _i + 1
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_EDGES = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "«»“”‘’…–—¿¡"


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of letter trigrams (gaps included) of some texts, by code."""
    total = np.zeros(SYMBOLS**3, np.int64)
    for text in texts:
        if text:
            c = _CODES[np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)].astype(np.int64)
            c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one gap in a row
            total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=len(total))
    return total


def _count_rows(batches):
    forget()
    for batch in batches:
        total = trigram_counts(batch.column(0).to_pylist())
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(total[codes])], ["code", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Negative log probabilities [a, b, c] of letter c after a and b, counted over every whole text."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_rows, "code long, n long")
    counts = np.zeros(SYMBOLS**3)
    for r in rows.groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most SYMBOLS ** 3 rows
        counts[r["code"]] = r["n"]
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = counts.sum(axis=0)
    backoff = (pairs + 0.1) / (pairs.sum(axis=1, keepdims=True) + 0.1 * SYMBOLS)
    return -np.log((counts + 5 * backoff[None]) / (counts.sum(axis=2, keepdims=True) + 5))


_DOUBLED = re.compile(r"(.)\1")


class Restorer:
    """Best source word of an observed chunk under the channel and the character model."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.rows = model.reshape(SYMBOLS * SYMBOLS, SYMBOLS).tolist()

    def odd(self, core: str) -> bool:
        """Whether a chunk is worth decoding: it isn't a plain word of single letters, nor only digits."""
        if core.isalpha():
            return bool(_DOUBLED.search(core))
        return not core.isdigit()

    def options(self, sign: str, previous: str) -> list[tuple[int, float]]:
        """Codes of the letters that a sign may stand for, 0 for none, with their costs."""
        code = int(_CODES[ord(sign)])
        if code:
            return [(code, 0.0), (0, REPEAT_COST)] if sign == previous else [(code, 0.0)]
        out = [(int(_CODES[ord(c)]), LEET_COST) for c in LEET.get(sign, "")]
        if sign in HIDES:
            out += [(c, HIDE_COST) for c in range(1, 27)]
        return [*out, (0, DROP_COST if not sign.isalnum() else 3 * DROP_COST + 2)]

    def restore(self, observed: str) -> str:
        """Viterbi over pairs of source letters (at most ``LONGEST`` signs); a step keeps, replaces or drops the observed sign.

        Each state points back to the one before, so that a path is written out once. Signs that may hide any letter are stepped over as arrays.
        """
        states: list[tuple[int, int]] = [(0, 0)]
        costs: list[float] = [0.0]
        back: list[tuple[list[int], list[int]]] = []
        previous = ""
        for sign in observed:
            options = self.options(sign, previous)
            step = self._many if len(options) > 8 else self._few
            states, costs, origin, letter = step(states, costs, options)
            back.append((origin, letter))
            previous = sign
        ends = [c + self.rows[a * SYMBOLS + b][0] for (a, b), c in zip(states, costs, strict=True)]
        at, made = ends.index(min(ends)), []
        for origin, letter in reversed(back):
            if letter[at]:
                made.append(LETTERS[letter[at] - 1])
            at = origin[at]
        return "".join(reversed(made))

    def _few(self, states: list, costs: list, options: list) -> tuple[list, list, list, list]:
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for k, ((a, b), cost) in enumerate(zip(states, costs, strict=True)):
            row = self.rows[a * SYMBOLS + b]
            for c, extra in options:
                # a dropped sign costs what a likely letter would, or short readings always win
                state, total = ((b, c), cost + extra + row[c]) if c else ((a, b), cost + extra + 2.0)
                if state not in best or total < best[state][0]:
                    best[state] = total, k, c
        found, origin, letter = zip(*best.values(), strict=True)
        return list(best), list(found), origin, letter

    def _many(self, states: list, costs: list, options: list) -> tuple[list, list, list, list]:
        first, second = np.array(states).T
        letters, extra = (np.array(x) for x in zip(*options, strict=True))
        total = np.array(costs)[:, None] + extra + np.where(letters > 0, self.model[first[:, None], second[:, None], letters], 2.0)
        state = np.where(letters > 0, second[:, None] * SYMBOLS + letters, first[:, None] * SYMBOLS + second[:, None]).ravel()
        order = np.lexsort((np.arange(total.size), total.ravel(), state))
        best = order[np.concatenate([[True], np.diff(state[order]) > 0])]
        pairs = list(zip((state[best] // SYMBOLS).tolist(), (state[best] % SYMBOLS).tolist(), strict=True))
        return pairs, total.ravel()[best].tolist(), (best // len(letters)).tolist(), letters[best % len(letters)].tolist()


_RUNS = re.compile(rf"(.)\1{{{RUN},}}", re.DOTALL)
_NO_LETTER = re.compile("[^" + re.escape(LETTERS + "".join(LEET) + HIDES) + "]+")


def pieces_of(chunk: str) -> list[str]:
    """A chunk, or what is decoded of one that is too long."""
    if len(chunk) > RUN:
        chunk = _RUNS.sub(lambda m: m[1] * RUN, chunk)
    return [chunk] if len(chunk) <= LONGEST else [x for x in dict.fromkeys(_NO_LETTER.split(chunk)) if 0 < len(x) <= LONGEST]


class Reader:
    """Restored words of texts, remembered by chunk."""

    def __init__(self, model: np.ndarray, wanted: dict[str, int] | None = None):
        self.restorer = Restorer(model)
        self.wanted = wanted
        self.memo: dict[str, tuple] = {}
        words = [w for w in wanted or () if not w.endswith("~")]
        self.beginnings = {w[:n] for w in words for n in range(1, len(w))}
        self.starts = {w.rstrip("~")[:3] for w in wanted or ()}
        self.elsewhere: dict[str, bool] = {}

    def _leads_elsewhere(self, start: str) -> bool:
        """Whether three signs are letters that stand for themselves, and no wanted word begins with them: the decoder keeps letters that aren't repeated."""
        return self.wanted is not None and len(start) == 3 and all(_CODES[ord(c)] for c in start) and start[0] != start[1] != start[2] and start not in self.starts

    def _joined(self, chunks: list[str]) -> list[str]:
        """Chunks that may be one wanted word in pieces, with a sign between them that stands for no letter."""
        out = []
        for k, chunk in enumerate(chunks):
            made = chunk if chunk[0].isalnum() else chunk.lstrip(_EDGES)
            parts, following = [made], k + 1
            while made in self.beginnings and following < len(chunks) and len(chunks[following]) <= LONGEST:
                last = chunks[following].rstrip(_EDGES)
                if made + last in self.wanted:
                    out.append("-".join([*parts, last]))
                made += chunks[following]
                parts.append(chunks[following])
                following += 1
        return out

    def _of_chunk(self, chunk: str) -> tuple:
        """Numbers of what the restored words of a chunk have of the wanted features; a plain word is its own restored one."""
        words = set()
        for piece in pieces_of(chunk):
            core = piece.strip(_EDGES)
            if core:
                words.add(self.restorer.restore(core) if self.restorer.odd(core) else core)
            if len(core) < len(piece) and any(c in LEET or c in HIDES for c in piece):  # a sign at the edge may be a letter
                whole = piece.strip(".,;:")
                if not core or (whole != core and len(set(whole) - set(core)) <= 2 and len(whole) - len(core) <= 2):
                    words.add(self.restorer.restore(whole))
        words.discard("")
        found = {w for w in words} | {f"{w[:n]}~" for w in words for n in BEGINNINGS if len(w) >= n}
        return tuple(found) if self.wanted is None else tuple(self.wanted[f] for f in found if f in self.wanted)

    def features(self, text: str | None) -> set:
        """Features of one text: words, and beginnings of words marked by ``~``; of those wanted, their numbers."""
        if not text:
            return set()
        text = text.lower()
        pieces = text.split()
        chunks = set(pieces)
        chunks.update("-".join(m[0].split()) for m in _SPACED.finditer(text))
        if self.beginnings:
            chunks.update(self._joined(pieces))
        found: set = set()
        for c in chunks:
            start = c[:3]
            other = self.elsewhere.get(start)
            if other is None:
                if len(self.elsewhere) > MEMO_WORDS:
                    self.elsewhere.clear()
                other = self.elsewhere[start] = self._leads_elsewhere(start)
            if other and len(c) <= LONGEST:
                continue
            got = self.memo.get(c)
            if got is None:
                if len(self.memo) > MEMO_WORDS:
                    self.memo.clear()
                got = self._of_chunk(c)
                if len(c) <= LONGEST:  # longer ones are rare, and would fill the memory
                    self.memo[c] = got
            if got:
                found.update(got)
        return found


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _feature_counts(model: np.ndarray):
    def run(batches):
        forget()
        reader = Reader(model)
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(reader.features(text))
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[k][f] for f in names], pa.int64()) for k in (1, 0))], ["feature", "pos", "neg"])

    return run


def _sparse(model: np.ndarray, wanted: dict[str, int]):
    def run(batches):
        forget()
        reader = Reader(model, wanted)
        for batch in batches:
            rows = [sorted(reader.features(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "found"])

    return run


def fit_logistic(rows: list[list[int]], labels: np.ndarray, n_features: int, penalty: float = 2e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Sparse logistic regression (accelerated proximal gradient, absolute penalty): weights and intercept."""
    weights, bias = np.zeros(n_features), 0.0
    if not len(labels) or labels.min() == labels.max():
        return weights, -6.0 if not len(labels) or not labels.max() else 6.0
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    n = len(rows)
    step = 4.0 / (1 + max(map(len, rows)) ** 0.5)
    ahead_w, ahead_b, t = weights.copy(), bias, 1.0

    def loss(w, b):
        z = b + np.bincount(at, w[col], minlength=n)
        return z, np.logaddexp(0, z).mean() - (labels * z).mean()

    for _ in range(steps):
        z, now = loss(ahead_w, ahead_b)
        error = (1 / (1 + np.exp(-z)) - labels) / n
        gw, gb = np.bincount(col, error[at], minlength=n_features), error.sum()
        while True:
            w = ahead_w - step * gw
            w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
            b = ahead_b - step * gb
            dw, db = w - ahead_w, b - ahead_b
            if loss(w, b)[1] <= now + gw @ dw + gb * db + (dw @ dw + db * db) / (2 * step) + 1e-12:
                break
            step /= 2
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = w + (t - 1) / t_next * (w - weights), b + (t - 1) / t_next * (b - bias)
        weights, bias, t, step = w, b, t_next, step * 1.1
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> tuple[dict[str, float], float]:
    """Weights by feature and the intercept, from at most ``sample_rows`` labelled documents that aren't held out.

    Equal texts count once. Labels of one id count as toxic if any row says so; labels other than 0 and 1 are left out. A feature
    is learned from if ``LEAST_TOXIC`` toxic texts or a 200th of them have it, whichever is more.
    """
    marked = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(marked), "doc_id")  # at most sample_rows small rows
    sample = staged(sample.dropDuplicates(["text", "toxic"]).select("text", "toxic"), "sample")
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return {}, -6.0 if not pos else 6.0
    counts = sample.mapInArrow(_feature_counts(model), "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = counts.filter((F.col("pos") >= max(LEAST_TOXIC, pos // 200)) & (F.col("pos") * neg > 3 * F.col("neg") * pos))
    gain = F.col("pos") * F.log(F.col("pos") / pos) - F.col("pos") * F.log((F.col("pos") + F.col("neg")) / (pos + neg))
    best = counts.withColumn("gain", gain).orderBy(F.desc("gain"), "feature").limit(features).select("feature").collect()
    wanted = {r["feature"]: k for k, r in enumerate(best)}
    table = sample.mapInArrow(_sparse(model, wanted), "toxic int, found array<int>").collect()  # at most sample_rows rows
    rows, toxic = [r["found"] for r in table], np.array([r["toxic"] for r in table], float)
    weights, _ = fit_logistic(rows, toxic, len(wanted))
    # the features that the penalty leaves are fitted again with hardly any, so that one of them can decide
    chosen = set(np.flatnonzero(weights > 0).tolist())
    weights, bias = fit_logistic([[c for c in r if c in chosen] for r in rows], toxic, len(wanted), penalty=1e-5)
    return {f: float(weights[k]) for f, k in wanted.items() if weights[k]}, bias


def _scores(model: np.ndarray, weights: dict[str, float], bias: float):
    names, values = list(weights), list(weights.values())
    wanted = {f: k for k, f in enumerate(names)}

    def run(batches):
        forget()
        reader = Reader(model, wanted)
        for batch in batches:
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(values[k] for k in sorted(reader.features(t))))))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from REJECT_AT on).

    Scores depend on the text alone. Null and empty texts have the score of a text without features. Null and
    repeated ids are rows like any other (a null id is not held out); columns of ``docs`` besides ``doc_id`` and
    ``text`` are ignored. Without labels of both kinds all scores are near the kind there is (near 0 with none).
    """
    small_batches(docs.sparkSession)
    model = character_model(docs)
    weights, bias = train(docs, labels, model, sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_scores(model, weights, bias), "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT_AT).cast("int").alias("predicted")
    )


def _rejects(model: np.ndarray, weights: dict[str, float], bias: float, reject_at: float):
    score = _scores(model, weights, bias)

    def run(batches):
        for batch in batches:
            (found,) = score([pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["doc_id", "text"])])
            yield batch.select(["row"]).filter(pa.array([x < reject_at for x in found.column(1).to_pylist()], pa.bool_()))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of ``docs`` that :func:`toxicity_scores` does not predict as toxic, all columns unchanged.

    Each row is judged by its own text, whatever its id; null and empty texts are kept unless there are
    only toxic labels. Texts pass through Python once more than the model's counts need.
    """
    small_batches(docs.sparkSession)
    model = character_model(docs)
    weights, bias = train(docs, labels, model, sample_rows)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("row"))
    kept = rows.mapInArrow(_rejects(model, weights, bias, reject_at), rows.select("row").schema)
    return kept.select("row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
