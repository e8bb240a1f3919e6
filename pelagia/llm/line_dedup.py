"""Fuzzy line dedup by MinHash over character shingles.

Lines that are equal after stripping share a 128-bit digest and count as one. Each line gets 17 band keys of 4
minima; different lines that share a key are candidates. Four bits of 64 minima estimate their similarity, and pairs far below the
threshold are dropped by it; the others are linked when the Jaccard similarity of their shingle sets is
reached in full (:mod:`.linking`), and distributed union-find keeps the first occurrence of each component. A pair of
similarity 0.8 shares no band with probability 1.3e-4, one of 0.9 with 4e-8, and is dropped by the estimate, which lies
seven standard deviations under the threshold, with probability under 1e-8.

Candidates are named by half of the digest. Where two lines of a table have that half in common, one of
them is compared with others and the other one is only linked with its equals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from .common import among, mix, shuffle_width, small_batches, with_matches
from .linking import Sets, link_groups, numbered
from .near_dedup import sketch
from .substring_dedup import _batch

SHINGLE, BANDS, ROWS, SKETCHED = 8, 17, 4, 64
_FACTORS = (mix(np.arange(1001, 1001 + BANDS * ROWS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: Parts of the range of keys and lines for each shuffle partition; a task holds one part at a time.
_PARTS = 8
#: Lines whose keys are held at once, and records that leave a task at once.
_LINES, _RECORDS = 1 << 16, 1 << 21
#: What tasks tell about lines: keys that must meet, keys known to be shared, lines, further places of lines.
KEY, MEMBER, LINE, AGAIN = range(4)
_PAIR = np.dtype([("key", np.int64), ("id", np.int64)])
_PLACE = np.dtype([("d1", np.int64), ("d2", np.int64), ("doc_id", np.int64), ("place", np.int32), ("many", np.int32)])
#: Characters of lines whose shingles are held at once (a single line may have more).
_CHARS = 1 << 18


def line_digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=16).digest()


def line_digests(lines: list[str]) -> np.ndarray:
    """Digests as rows of two signed numbers."""
    return np.frombuffer(b"".join(map(line_digest, lines)), np.int64).reshape(-1, 2)


def text_lines(text: str | None) -> list[str]:
    return text.split("\n") if text is not None else []


def character_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 8-character shingles of each (not empty) line, and where each line's begin; short lines are one."""
    padded = [x if len(x) >= SHINGLE else x + "\0" * (SHINGLE - len(x)) for x in lines]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32)
    n = max(0, len(chars) - SHINGLE + 1)
    # a polynomial in the characters, of twice as many in each step
    h, base = chars.astype(np.uint64), 0x9E3779B97F4A7C15
    for k in (1, 2, 4):
        h = h[:-k] * np.uint64(base) + h[k:]
        base = base * base % (1 << 64)
    sizes = np.array([len(x) for x in padded], np.int64)
    inside = np.ones(n, bool)
    ends = np.cumsum(sizes)
    for k in range(1, SHINGLE):  # shingles that cross into the next line
        inside[(ends[:-1] - k)] = False
    starts = np.concatenate([[0], np.cumsum(sizes - SHINGLE + 1)[:-1]]) if len(sizes) else np.empty(0, np.int64)
    return mix(h[inside]), starts


def _runs(lines: list[str]):
    """Slices of lines of about ``_CHARS`` characters together."""
    begin = size = 0
    for i, x in enumerate(lines):
        if size and size + len(x) > _CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(x)
    if begin < len(lines):
        yield begin, len(lines)


def line_minima(lines: list[str]) -> np.ndarray:
    """The smallest value of each line's shingles under each of the hash functions, a row a line."""
    out = np.empty((len(lines), BANDS * ROWS), np.uint32)
    for a, b in _runs(lines):
        values, starts = character_shingles(lines[a:b])
        values = (values >> np.uint64(32)).astype(np.uint32)
        hashed = np.empty_like(values)
        for k in range(BANDS * ROWS):
            np.multiply(values, _FACTORS[k], out=hashed)
            out[a:b, k] = np.minimum.reduceat(hashed, starts)
    return out


def line_bands(lines: list[str]) -> np.ndarray:
    """Band keys, a row a line."""
    low = line_minima(lines)
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(lines), 1))
    for k in range(ROWS):
        keys = mix(keys * np.uint64(31) + low[:, k * BANDS : (k + 1) * BANDS])
    return keys


def line_sketches(lines: list[str]) -> np.ndarray:
    """Packed low bits of the minima, a row a line."""
    return sketch(line_minima(lines)[:, :SKETCHED]).reshape(len(lines), SKETCHED // 16)


def least_estimate(percent: int) -> float:
    """Estimates below this, seven standard deviations under the threshold, are not compared in full."""
    p = percent / 100
    return p - 7 * (p * (1 - p) / SKETCHED) ** 0.5


def line_sets(lines: list[str]) -> Sets:
    """The distinct shingles of each line as numbers."""
    parts = [character_shingles(lines[a:b]) for a, b in _runs(lines)]
    values = np.concatenate([v for v, _ in parts])
    sizes = np.concatenate([np.diff(starts, append=len(v)) for v, starts in parts])
    code = numbered(values).astype(np.int64)
    several = int(code.max()) + 1
    # a line's number in front makes one sort do for all lines
    own = np.sort(np.repeat(np.arange(len(lines)), sizes) * several + code)
    own = own[np.concatenate([[True], own[1:] != own[:-1]])]
    return (own % several).astype(np.int32), np.concatenate([[0], np.bincount(own // several, minlength=len(lines)).cumsum()])


def _packed(kind: int, part: np.ndarray, records: np.ndarray):
    """Rows (kind, part, records) of the records of each part, as bytes."""
    order = np.argsort(part, kind="stable")
    for k in range(0, len(order), _RECORDS):
        own, chunk = part[order[k : k + _RECORDS]], np.ascontiguousarray(records[order[k : k + _RECORDS]])
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        ends = pa.array(np.append(cuts, len(own)) * chunk.itemsize, pa.int32())
        packed = pa.Array.from_buffers(pa.binary(), len(cuts), [None, ends.buffers()[1], pa.py_buffer(chunk)])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), kind, np.int32)), pa.array(own[cuts]), packed], ["kind", "part", "records"])


def _pairs(key: np.ndarray, line: np.ndarray) -> np.ndarray:
    out = np.empty(len(key), _PAIR)
    out["key"], out["id"] = key.view(np.int64), line
    return out


def _scanned(parts: int):
    """What a batch of documents knows of its lines and of their keys, as packed records by part.

    Of a line that a batch has several times the first place and their count are dealt by the line, the other places by
    themselves. A batch sends one line of each key on, dealt by the key, and says at once which keys are shared, dealt by lines.
    """
    part_of = lambda x: ((x >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)

    def run(batches):
        for batch in batches:
            number: dict[str, int] = {}
            numbers, docs, places = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, line in enumerate(text_lines(text)):
                    if line := line.strip():
                        numbers.append(number.setdefault(line, len(number)))
                        docs.append(doc)
                        places.append(i)
            if not number:
                continue
            lines, which = list(number), np.array(numbers)
            digests = line_digests(lines)
            seen = np.zeros(len(which), _PLACE)
            seen["d1"], seen["d2"], seen["doc_id"], seen["place"] = digests[which, 0], digests[which, 1], docs, places
            order = np.lexsort((seen["place"], seen["doc_id"], which))
            first, which = np.diff(which[order], prepend=-1) != 0, which[order]
            seen = seen[order]
            seen["many"][first] = np.bincount(which)
            again = seen[~first]
            yield from _packed(LINE, part_of(seen["d1"][first].view(np.uint64)), seen[first])
            yield from _packed(AGAIN, part_of(mix(again["doc_id"].view(np.uint64) * np.uint64(31) + again["place"].astype(np.uint64))), again)
            for k in range(0, len(lines), _LINES):
                key = line_bands(lines[k : k + _LINES]).ravel()
                order = np.argsort(key)
                key, line = key[order], digests[k + order // BANDS, 0]
                first = np.append(True, key[1:] != key[:-1])
                known = ~first | ~np.append(first[1:], True)
                yield from _packed(KEY, part_of(key[first]), _pairs(key[first], line[first]))
                yield from _packed(MEMBER, part_of(mix(line[known].view(np.uint64))), _pairs(key[known], line[known]))

    return run


def _rows(kind: int, a, b, doc_id=None, place=None, many=None) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(a), kind, np.int32))]
    for x, of in ((a, np.int64), (b, np.int64), (doc_id, np.int64), (place, np.int32), (many, np.int64)):
        columns.append(pa.nulls(len(a), pa.from_numpy_dtype(of)) if x is None else pa.array(np.ascontiguousarray(x, of)))
    return pa.RecordBatch.from_arrays(columns, ["kind", "a", "b", "doc_id", "place", "many"])


def _members(pairs: np.ndarray):
    """Pairs whose key comes from two different lines."""
    key, line = pairs["key"], pairs["id"]
    order = np.lexsort((line, key))
    key, line = key[order], line[order]
    new = np.append(True, (key[1:] != key[:-1]) | (line[1:] != line[:-1]))  # batches send the same line again
    key, line = key[new], line[new]
    same = key[1:] == key[:-1]
    hit = np.append(same, False) | np.append(False, same)
    yield _rows(MEMBER, key[hit], line[hit])


def _lines(seen: np.ndarray):
    """Each line with its first place and the count of all; the places of those that occur several times."""
    seen = seen[np.lexsort((seen["place"], seen["doc_id"], seen["d2"], seen["d1"]))]
    first = np.append(True, (seen["d1"][1:] != seen["d1"][:-1]) | (seen["d2"][1:] != seen["d2"][:-1]))
    many, one = np.add.reduceat(seen["many"], np.flatnonzero(first), dtype=np.int64), seen[first]
    yield _rows(LINE, one["d1"], one["d2"], one["doc_id"], one["place"], many)
    yield from _places(seen[many[np.cumsum(first) - 1] > 1])


def _places(seen: np.ndarray):
    yield _rows(AGAIN, seen["d1"], seen["d2"], seen["doc_id"], seen["place"])


def _gathered(batches):
    """Packed records sorted by (kind, part), a part at a time where its records must meet."""

    def solve(kind: int, packed: list[bytes]):
        records = np.frombuffer(b"".join(packed), _PAIR if kind in (KEY, MEMBER) else _PLACE)
        if kind == MEMBER:
            yield _rows(MEMBER, records["key"], records["id"])
        else:
            yield from {KEY: _members, LINE: _lines, AGAIN: _places}[kind](records)

    held, at = [], None
    for batch in batches:
        for kind, part, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = (kind, part if kind in (KEY, LINE) else None)
            if held and now != at:
                yield from solve(at[0], held)
                held = []
            held.append(records)
            at = now
        if held and at[1] is None:
            yield from solve(at[0], held)
            held = []
    if held:
        yield from solve(at[0], held)


def _chosen_lines(batches):
    """Lines at wanted places, each once a batch."""
    for batch in batches:
        found: dict[bytes, str] = {}
        for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = text_lines(text)
            for i in places:
                if i < len(lines) and (x := lines[i].strip()):
                    found[line_digest(x)] = x
        d = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        sizes = pa.array([len(x) for x in found.values()], pa.int64())
        texts = pa.array([x.encode("utf-8", "replace") for x in found.values()], pa.binary())
        sketches = pa.array([x.tobytes() for x in line_sketches(list(found.values()))], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), sizes, texts, sketches], ["id", "d2", "n", "payload", "sketch"])


def _read(payloads: list[bytes]) -> Sets:
    return line_sets([x.decode("utf-8", "replace") for x in payloads])


def _without(at: int):
    """Rows (row, gone) without the lines that go; the text is the row's field ``at``."""

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            text_column = row.field(at).cast(pa.string())
            rows = []
            for text, gone in zip(text_column.to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not gone:
                    rows.append((text.count("\n") + 1 if text is not None else 0, 0, text))
                    continue
                lines = text_lines(text)
                drop = {g["place"] for g in gone if g["place"] < len(lines) and int.from_bytes(line_digest(lines[g["place"]].strip())[:8], "little", signed=True) == g["d1"]}
                rows.append((len(lines), len(drop), "\n".join(x for i, x in enumerate(lines) if i not in drop)))
            n, removed, kept = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([row, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_lines", "n_removed", "kept"])

    return run


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` as ``row``, with ``kept`` (the text without repeated lines), ``n_lines`` and ``n_removed``.

    Lines end at a newline and are compared stripped; blank lines stay. Of each component of lines that reach
    ``percent`` % similarity the one of smallest (doc_id, line number) stays, the others go from every
    document. Null texts stay null; rows with a null id are left as they are and repeat nothing; rows that
    share an id are one document, a line that both have at one place is one occurrence. All columns of
    ``docs`` are returned, whatever their names; an empty table gives no row. A line's set is held by one task, so that
    memory grows with the longest line, at about 40 bytes a character. Jobs run while this is called.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = texts.filter("doc_id is not null and text is not null")
    width = shuffle_width(spark)
    rows = named.mapInArrow(_scanned(_PARTS * width), "kind int, part long, records binary").repartition(width, "part")
    rows = rows.sortWithinPartitions("kind", "part").mapInArrow(_gathered, "kind int, a long, b long, doc_id long, place int, many long")
    known = staged(rows, "known")
    lines = known.where(F.col("kind") == LINE).select(F.col("a").alias("d1"), F.col("b").alias("d2"), F.struct("doc_id", "place").alias("first"), "many")
    places = known.where(F.col("kind") == AGAIN).select(F.col("a").alias("d1"), F.col("b").alias("d2"), "doc_id", "place")
    member = staged(known.where(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("id")).distinct(), "members")
    alike = staged(lines.join(member.select(F.col("id").alias("d1")).distinct(), "d1"), "alike")
    wanted = staged(alike.groupBy("first.doc_id").agg(F.collect_list("first.place").alias("places")), "wanted")
    chosen = among(named, wanted).join(wanted, "doc_id").select("text", "places").mapInArrow(_chosen_lines, "id long, d2 long, n long, payload binary, sketch binary")
    chosen = staged(chosen, "chosen")
    if chosen.groupBy("id").count().filter("count > 1").limit(1).count():  # rows that share an id, or half of a digest
        chosen = staged(chosen.dropDuplicates(["id"]), "chosen")

    labels = link_groups(member, chosen.select("id", "n"), lambda asked: chosen.select("id", "payload", "sketch"), _read, 1, percent, least_estimate(percent))
    linked = chosen.select(F.col("id").alias("d1"), "d2").join(labels.withColumnRenamed("u", "d1"), "d1")
    linked = staged(alike.join(linked, ["d1", "d2"]).select("d1", "d2", "first", "many", "component"), "linked")
    kept = linked.groupBy("component").agg(F.min("first").alias("keep"))
    of_linked = staged(linked.join(kept, "component").select("d1", "d2", "first", "many", "keep"), "kept")
    of_equal = lines.filter("many > 1").join(linked, ["d1", "d2"], "left_anti").select("d1", "d2", "many", F.col("first").alias("keep"))
    repeated = staged(of_linked.filter("many > 1").select("d1", "d2", "many", "keep").unionByName(of_equal), "repeated")
    gone = with_matches(places, repeated, ["d1", "d2"], "many", places.count(), ["doc_id", "place"])
    gone = gone.filter(F.struct("doc_id", "place") != F.col("match.keep")).select("doc_id", "place", "d1")
    gone = gone.union(of_linked.filter("many = 1 and first <> keep").select("first.doc_id", "first.place", "d1"))
    gone = gone.groupBy(F.col("doc_id").alias("key")).agg(F.collect_set(F.struct("place", "d1")).alias("gone"))

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # rows without an id find nothing, and are spread by their text
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0)
    whole = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("key"), spread.alias("spread"))
    done = whole.join(gone.withColumn("spread", F.lit(0).cast("long")), ["key", "spread"], "left").select("row", "gone")
    schema = whole.select("row").schema
    for name, kind in (("n_lines", "long"), ("n_removed", "long"), ("kept", "string")):
        schema = schema.add(name, kind)
    return done.mapInArrow(_without([c.lower() for c in docs.columns].index("text")), schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
