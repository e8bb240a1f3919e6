"""A trie of conversations' beginnings as mergeable tables.

Turns are sorted once across all tasks (by group of conversations, conversation and turn), so that a very long conversation spreads over
several. A node is named by a polynomial hash of its turns modulo a prime of 127 bits, which needs only the hash
of the node above and the turn: a task that begins inside a conversation gets the state at that place from a row that each
task gives about its end. Each task builds a partial trie of its turns, a table of nodes with members and lists of conversations that end there;
such tables are merged in rounds by hash of the node: members are summed, lists are put together. Subtrees are then summed
bottom-up along *paths*: the nodes of one smallest member lie below each other, and paths hang on others. Sums over paths double
their reach each round, and running sums along a path, again across tasks, give each node its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from .common import shuffle_width, with_matches

#: Conversations that share a beginning: ids from one multiple of this to the next.
GROUP = 20
#: A conversation takes over fewer turns than this.
TAKEN = 4
#: A prime, and the factor of one turn.
PRIME, FACTOR = (1 << 127) - 1, 0x5DEECE66D1F4A7C15BF58476D1CE4E5
#: Nodes of a partial table at most, and tables that a merge puts together.
NODES, FAN_IN = 50_000, 16
WORD = r"[^\x20\x09-\x0D]+"


def taken(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % TAKEN


def group_of(conv_id: int) -> int:
    """The multiple of ``GROUP`` towards zero."""
    return conv_id - (conv_id % GROUP if conv_id >= 0 else -(-conv_id % GROUP))


def _pack(x: int) -> bytes:
    return x.to_bytes(16, "big")


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows sorted across tasks, with ``part`` and the place ``seq`` inside it; texts are already digested. At the end of each part a row (``part`` known, ``seq`` -1) of its last conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    conv = F.col("conv_id").cast("long")
    rows = conversations.select(conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).filter("conv_id is not null")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    rows = rows.select(
        base.alias("base"), (F.col("conv_id") != base).alias("later"), "conv_id", "turn",
        F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))).alias("digest"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("tie"),
    )
    rows, order = staged(rows, "digests"), ["base", "later", "conv_id", "turn", "digest", "tie"]
    rows = rows.repartitionByRange(shuffle_width(conversations.sparkSession), *order).sortWithinPartitions(*order)
    rows = rows.select(F.spark_partition_id().alias("part"), "base", "conv_id", "digest", "words")
    return staged(rows.mapInArrow(_placed, "part int, seq long, base long, conv_id long, local long, digest binary, words long"), "turns")


_PLACED = ["part", "seq", "base", "conv_id", "local", "digest", "words"]
_PLACED_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``local`` is the place in the conversation as far as this part has it. The last row has the hash of the part's last conversation in place of a digest."""
    seq, conv, base, local, total, power, part = 0, None, 0, 0, 0, 1, None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(5)]
        seqs, locals_ = range(seq, seq + batch.num_rows), []
        for part, base, c, digest, _ in zip(*columns, strict=True):  # noqa: B007
            if c != conv:
                conv, local, total, power = c, 0, 0, 1
            locals_.append(local)
            local += 1
            total = (total + int.from_bytes(digest, "big") * power) % PRIME
            power = power * FACTOR % PRIME
        seq += batch.num_rows
        part_, base_, conv_, digest_, words_ = columns
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((part_, list(seqs), base_, conv_, locals_, digest_, words_), _PLACED_KINDS, strict=True)], _PLACED)
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, -1, base, conv, local, _pack(total), 0), _PLACED_KINDS, strict=True)], _PLACED)


@dataclass
class Begin:
    """What a part must know of those before it: of its first group the beginning, of its first conversation how far it has come."""

    base: int | None = None
    head: list[tuple[bytes, int]] = field(default_factory=list)
    #: The part in which the group begins: ends are listed by it.
    chunk: int = 0
    conv: int | None = None
    place: int = 0
    depth: int = 0
    node: int = 0


def _begins(turns: DataFrame) -> tuple[dict[int, Begin], dict[int, bool]]:
    """By part: its state at the start, and whether its last conversation goes on in the next one. The driver gets a few rows a part."""
    firsts = {r["part"]: (r["base"], r["conv_id"]) for r in turns.filter("seq = 0").collect()}
    lasts = {r["part"]: r for r in turns.filter("seq = -1").collect()}
    parts = sorted(firsts)
    # turns that conversations at the edges of parts may hand on
    asked = {x for p in parts for x in (*firsts[p], lasts[p]["base"], lasts[p]["conv_id"])}
    spark = turns.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(x,) for x in sorted(asked)], "conv_id long"))  # at most four a part
    found: dict[int, list[tuple[bytes, int]]] = {}
    for r in turns.filter(f"seq >= 0 and local < {TAKEN - 1}").join(wanted, "conv_id").select("conv_id", "part", "local", "digest", "words").orderBy("part", "local").collect():
        found.setdefault(r["conv_id"], []).append((bytes(r["digest"]), r["words"]))
    begins, goes_on, state = {}, {}, Begin()
    for k, p in enumerate(parts):
        base, conv = firsts[p]
        last = lasts[p]
        begins[p] = Begin(state.base, state.head, state.chunk, state.conv, state.place, state.depth, state.node) if state.base == base else Begin()
        goes_on[p] = k + 1 < len(parts) and firsts[parts[k + 1]][1] == last["conv_id"]
        c, b = last["conv_id"], last["base"]
        chunk = begins[p].chunk if begins[p].base == b else p
        head = found.get(b, [])[: TAKEN - 1]
        # the last conversation's state at the end of the part, from the hash of all its turns here
        known = begins[p] if begins[p].conv == c else Begin()
        inside, place = int.from_bytes(last["digest"], "big"), known.place
        own = 0 if c == b else taken(c)
        start = 0 if c == b else min(own, len(head))
        node = known.node if known.conv == c else sum(int.from_bytes(d, "big") * pow(FACTOR, i, PRIME) for i, (d, _) in enumerate(head[:start]))
        before = [int.from_bytes(d, "big") * pow(FACTOR, i, PRIME) for i, (d, _) in enumerate(found.get(c, [])[: TAKEN - 1]) if place <= i < min(own, place + last["local"])]
        inside = inside * pow(FACTOR, place, PRIME) - sum(before)
        node = (node + inside * pow(FACTOR, start - own, PRIME)) % PRIME
        place += last["local"]
        state = Begin(b, head, chunk, c, place, start + max(0, place - own), node)
    return begins, goes_on


_PARTIAL = "kind int, node binary, above binary, depth long, words long, conv_id long, n_convs long, part long, ends array<long>"
_PARTIAL_NAMES = [x.split()[0] for x in _PARTIAL.split(", ")]
_PARTIAL_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]


def _partial_tries(begins: dict[int, Begin], goes_on: dict[int, bool]):
    """Turns sorted by (part, seq) as tables of nodes (kind 0) and of ends (kind 1), combined as far as they are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[tuple[int, int], list] = {}
        ends: dict[tuple[int, int, int], list[int]] = {}
        part = conv = base = None
        head: list[tuple[bytes, int]] = []
        place = depth = node = skip = chunk = 0
        power = 1

        def table(slot: int) -> pa.RecordBatch:
            rows = [(0, _pack(k), above, d, w, c, n, slot, None) for (k, d), (above, w, c, n) in nodes.items()]
            rows += [(1, _pack(k), None, d, 0, None, 0, of, e) for (k, d, of), e in ends.items()]
            nodes.clear()
            ends.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _PARTIAL_KINDS, strict=True)], _PARTIAL_NAMES)

        def member(above: bytes | None, words: int) -> None:
            known = nodes.get((node, depth))
            if known is None:
                nodes[node, depth] = [above, words, conv, 1]
            else:
                known[2] = min(known[2], conv)
                known[3] += 1

        def step(digest: bytes, words: int) -> None:
            nonlocal node, depth, power
            above = _pack(node)
            node = (node + int.from_bytes(digest, "big") * power) % PRIME
            power = power * FACTOR % PRIME
            depth += 1
            member(above, words)

        def ended() -> None:
            if conv is not None:
                ends.setdefault((node, depth, chunk), []).append(conv)

        for batch in batches:
            for p, b, c, digest, words in zip(*[batch.column(x).to_pylist() for x in ("part", "base", "conv_id", "digest", "words")], strict=True):
                if p != part:
                    if part is not None and not goes_on[part]:
                        ended()
                    part, begin = p, begins[p]
                    base, head, chunk = begin.base, list(begin.head), begin.chunk
                    conv, place, depth, node = begin.conv, begin.place, begin.depth, begin.node
                    power = pow(FACTOR, depth, PRIME)
                    if conv is not None and conv != c:  # it has ended where the last part did
                        conv = None
                    elif conv is not None:
                        skip = 0 if c == b else taken(c)
                if c != conv:
                    ended()
                    if b != base:
                        base, head, chunk = b, [], p
                    conv, place, depth, node, power = c, 0, 0, 0, 1
                    skip = 0 if c == b else taken(c)
                    member(None, 0)
                    if c != b:
                        for d, w in head[:skip]:
                            step(d, w)
                if c == b and place == len(head) < TAKEN - 1:
                    head.append((digest, words))
                if place >= skip:
                    step(digest, words)
                place += 1
                if len(nodes) + len(ends) >= NODES:
                    yield table(part)
        if part is not None and not goes_on[part]:
            ended()
        if nodes or ends:
            yield table(part)

    return run


def merged(tables: DataFrame, parts: int) -> DataFrame:
    """Nodes of all partial tables: merges by hash of the node, of ``FAN_IN`` tables in each round but the last."""
    rows = tables.filter("kind = 0").select("node", "above", "depth", "words", "conv_id", "n_convs", "part")
    together = [F.first("above").alias("above"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")]
    while parts > FAN_IN * FAN_IN:
        parts = -(-parts // FAN_IN)
        rows = rows.groupBy("node", "depth", F.floor(F.col("part") / FAN_IN).alias("part")).agg(*together)
    return rows.groupBy("node", "depth").agg(*together)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, depth, ids as text) in order as a digest of each node's ids; a node's rows may come in several batches."""
    now, digest = None, hashlib.sha256()
    for batch in batches:
        out = []
        for node, depth, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            if (node, depth) != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (node, depth), hashlib.sha256(text.encode())
            else:
                digest.update(f",{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.string()))], ["node", "depth", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.binary()), pa.array([now[1]], pa.int64()), pa.array([digest.hexdigest()])], ["node", "depth", "ends_sha256"])


def end_digests(tables: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256): lists of one part are merged and sorted; of a node, which part comes first has the smaller ids."""
    ends = tables.filter("kind = 1").groupBy("node", "depth", F.col("part").alias("chunk")).agg(F.array_join(F.array_sort(F.flatten(F.collect_list("ends"))).cast("array<string>"), ",").alias("text"))
    ends = ends.repartition(shuffle_width(tables.sparkSession), "node", "depth").sortWithinPartitions("node", "depth", "chunk")
    return ends.select("node", "depth", "text").mapInArrow(_digests, "node binary, depth long, ends_sha256 string")


def path_totals(paths: DataFrame, top: int) -> DataFrame:
    """``paths`` (conv_id, up, *sums) with each sum over the path and all that hang on it. ``top`` is the one path without ``up``.

    A round adds what hangs as many paths below as the rounds before have covered, and doubles that reach.
    """
    sums = [c for c in paths.columns if c not in ("conv_id", "up")]
    now = paths
    while now.filter("up is not null").limit(1).count():
        below = now.filter("up is not null").groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums], F.count("*").alias("many"))
        below = staged(below, "below")
        moving = now.filter(F.col("up") != top)
        over = now.select(F.col("conv_id").alias("up"), F.col("up").alias("next_up")).join(below.select(F.col("conv_id").alias("up"), "many"), "up")
        jumped = with_matches(moving, staged(over, "over"), ["up"], "many", now.count(), ["conv_id"]).select("conv_id", F.col("match.next_up").alias("next_up"))
        rows = now.drop("up").join(jumped, "conv_id", "left").join(below, "conv_id", "left")
        now = staged(rows.select("conv_id", F.col("next_up").alias("up"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums]), "totals")
    return now.drop("up")


def _running(sums: list[str]):
    """Sorted rows (part, conv_id, ..., sums) with sums from a conversation's first row in this part on; a last row (node null) has the totals of its last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, total, last = None, [0] * len(sums), None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(c).to_pylist() for c in sums]
            out: list[list[int]] = [[] for _ in sums]
            for c, *row in zip(batch.column("conv_id").to_pylist(), *values, strict=True):
                if c != conv:
                    conv, total = c, [0] * len(sums)
                total = [a + b for a, b in zip(total, row, strict=True)]
                for column, x in zip(out, total, strict=True):
                    column.append(x)
            last = batch.slice(batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([pa.array(out[sums.index(n)], pa.int64()) if n in sums else batch.column(n) for n in batch.schema.names], batch.schema.names)
        if last is not None:
            end = dict(zip(sums, total, strict=True)) | {"node": None}
            yield pa.RecordBatch.from_arrays([pa.array([end[n]], last.schema.field(n).type) if n in end else last.column(n) for n in last.schema.names], last.schema.names)

    return run


def running_sums(rows: DataFrame, sums: list[str]) -> DataFrame:
    """``rows`` (node, conv_id, depth, ...) with each sum over the conversation's rows of this depth and deeper ones.

    Rows are sorted across tasks; the driver adds up the ends of parts, a row each.
    """
    spark = rows.sparkSession
    order = [F.col("conv_id"), F.desc("depth")]
    rows = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    rows = staged(rows.mapInArrow(_running(sums), rows.schema), "running")
    edges = {r["part"]: r for r in rows.groupBy("part").agg(F.min("conv_id").alias("first")).join(rows.filter("node is null").select("part", F.col("conv_id").alias("last"), *sums), "part").collect()}
    carried, conv, total = [], None, [0] * len(sums)
    for part in sorted(edges):
        r = edges[part]
        if r["first"] == conv:
            carried.append((part, conv, *total))
        here = [r[c] for c in sums]
        total = [a + b for a, b in zip(total, here, strict=True)] if r["first"] == r["last"] == conv else here
        conv = r["last"]
    schema = "part int, conv_id long, " + ", ".join(f"carried_{c} long" for c in sums)
    carried = F.broadcast(spark.createDataFrame(carried, schema))  # at most a row a part
    rows = rows.filter("node is not null").join(carried, ["part", "conv_id"], "left")
    added = {c: F.col(c) + F.coalesce(f"carried_{c}", F.lit(0)) for c in sums}
    return rows.withColumns(added).drop("part", *[f"carried_{c}" for c in sums])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of all rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role, text. Turns are ordered by ``turn`` (null first), equal ones by a digest of role and text; null role or text is empty.
    A conversation takes over the first ``taken(conv_id)`` turns of that at the multiple of ``GROUP`` towards zero, in place of as many of its own. Rows with a null
    conv_id belong to no conversation; repeated rows are turns like others; other columns are ignored; an empty table gives no node. Texts
    are digested where they are read, whatever their lengths, and are not shuffled. Jobs run while this is called.
    """
    spark = conversations.sparkSession
    turns = _turns(conversations)
    begins, goes_on = _begins(turns)
    n = shuffle_width(spark)
    rows = turns.filter("seq >= 0").repartitionByRange(n, "part").sortWithinPartitions("part", "seq")
    tables = staged(rows.mapInArrow(_partial_tries(begins, goes_on), _PARTIAL), "tries")
    nodes = staged(merged(tables, len(begins)), "nodes")

    kids = nodes.filter("above is not null").groupBy(F.col("above").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(kids, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    above = nodes.filter("n_children > 0").select(F.col("node").alias("above"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"), "n_children")
    nodes = with_matches(nodes, above, ["above", "depth"], "n_children", nodes.count(), ["node"])
    leaf = (F.col("n_children") == 0).cast("long")
    nodes = nodes.select("node", "depth", "conv_id", "n_convs", "n_children", F.col("match.parent").alias("parent_conv_id"), leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    nodes = staged(nodes, "nodes")

    # a path: the nodes of one smallest member
    sums = ["n_leaves", "saved_tokens"]
    is_first = F.col("parent_conv_id").isNull() | (F.col("parent_conv_id") != F.col("conv_id"))
    at_first: Column = F.when(is_first, F.struct(F.col("parent_conv_id").alias("up"), (F.col("depth") - 1).alias("at")))
    paths = staged(nodes.groupBy("conv_id").agg(F.max(at_first).alias("hangs"), *[F.sum(c).alias(c) for c in sums]), "paths")
    top = paths.agg(F.min("conv_id")).first()[0]
    totals = path_totals(paths.select("conv_id", F.col("hangs.up").alias("up"), *sums), top if top is not None else 0)
    hung = totals.join(paths.select("conv_id", "hangs"), "conv_id").filter("hangs.up is not null")
    hung = hung.groupBy(F.col("hangs.up").alias("conv_id"), F.col("hangs.at").alias("depth")).agg(*[F.sum(c).alias(f"hung_{c}") for c in sums])
    nodes = nodes.join(hung, ["conv_id", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"hung_{c}", F.lit(0)) for c in sums})
    nodes = running_sums(nodes.drop(*[f"hung_{c}" for c in sums]), sums)
    nothing = F.lit(hashlib.sha256().hexdigest())
    out = nodes.join(end_digests(tables), ["node", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
