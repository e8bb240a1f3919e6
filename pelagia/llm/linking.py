"""Links inside candidate groups, without a row for each pair.

Ids that share a band key are candidates. Each is first compared with two hubs of its groups; what these links
leave in several components is compared inside tasks. Groups are gathered under their hub, so ids that share several
keys meet once; a large gathering is dealt into blocks by hash, and a *cell* is a pair of blocks: its rows are the members of both,
with their sets. A task counts bits and common shingles of a cell with numpy and gives out only the links
that join components, so rows grow with members times blocks and never with pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..staging import staged
from .common import shuffle_width

#: Members of a block at most on average, and shingles of their sets together.
BLOCK_MEMBERS, BLOCK_SHINGLES = 2048, 1 << 19

#: Sets as task code holds them: numbers of all members' shingles in one array, distinct in each member, and where each one's begin.
Sets = tuple[np.ndarray, np.ndarray]


def numbered(values: np.ndarray) -> np.ndarray:
    """Small numbers in place of hashes, in their order."""
    # one sort of each value's high bits with its place behind them; values that differ in the low bits alone are rare
    low = np.uint64(len(values).bit_length())
    held = np.sort(values >> low << low | np.arange(len(values), dtype=np.uint64))
    place, high = (held & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), held >> low
    same, own = high[1:] == high[:-1], values[place]
    if (same & (own[1:] != own[:-1])).any():
        return np.unique(values, return_inverse=True)[1].astype(np.int32)
    out = np.zeros(len(values), np.int32)
    out[place[1:]] = np.cumsum(~same, dtype=np.int32)
    return out


def packed_sets(payloads: list[bytes]) -> Sets:
    """Sets that come as packed distinct 64-bit hashes."""
    sizes = np.array([len(x) // 8 for x in payloads], np.int64)
    return numbered(np.frombuffer(b"".join(payloads), np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def cell_links(side: np.ndarray, root: np.ndarray, codes: np.ndarray, starts: np.ndarray, seen: np.ndarray, percent: int, near: Callable[[int, np.ndarray], np.ndarray] | None) -> list[tuple[int, int]]:
    """Links (a, b) between the components of a cell's members whose sets reach the similarity, and that were still apart.

    Member k has the distinct shingle numbers ``codes[starts[k]:starts[k + 1]]``; ``seen`` is a cleared flag for each number. ``side``
    is 0 for the left block, 1 for the right one and 2 where both are the same. ``near(x, others)`` tells which others are
    worth the comparison of full sets.
    """
    sizes, known, root = np.diff(starts), root, root.copy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    base, out = starts[0], []
    for x in left.tolist():
        others = right[right > x] if side[x] == 2 else right
        n, m = sizes[x], sizes[others]
        others = others[(root[others] != root[x]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))]
        if near is not None and len(others):
            others = others[near(x, others)]
        if not len(others):
            continue
        own = codes[starts[x] : starts[x + 1]]
        seen[own] = True
        if len(others) > 8 and 4 * len(others) > len(sizes):
            both = np.add.reduceat(seen[codes[base : starts[-1]]], starts[:-1] - base, dtype=np.int64)[others]
        else:
            both = np.array([np.count_nonzero(seen[codes[starts[k] : starts[k + 1]]]) for k in others.tolist()])
        seen[own] = False
        for y in others[100 * both >= percent * (n + sizes[others] - both)].tolist():
            if root[x] != root[y]:
                out.append((int(known[x]), int(known[y])))
                root[root == root[y]] = root[x]
    return out


def pair_links(at: np.ndarray, side: np.ndarray, root: np.ndarray, codes: np.ndarray, starts: np.ndarray, percent: int, sketches: np.ndarray | None, least: float | None) -> list[tuple[int, int]]:
    """What :func:`cell_links` gives for cells of two members, at ``at`` and behind it, all at once."""
    sizes = np.diff(starts)
    n, m = sizes[at], sizes[at + 1]
    keep = (root[at] != root[at + 1]) & ((side[at] != side[at + 1]) | (side[at] == 2)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    at, n, m = at[keep], n[keep], m[keep]
    if sketches is not None and len(at):
        keep = share_of(sketches[at] ^ sketches[at + 1]) >= least
        at, n, m = at[keep], n[keep], m[keep]
    if not len(at):
        return []
    # both members' shingles stand side by side; numbered by pair and sorted, common ones are neighbours
    pair, ends = np.repeat(np.arange(len(at)), n + m), np.cumsum(n + m)
    place = np.arange(ends[-1]) + np.repeat(starts[at] - (ends - n - m), n + m)
    several = int(codes.max()) + 1
    key = np.sort(pair * several + codes[place])
    both = np.bincount(key[1:][key[1:] == key[:-1]] // several, minlength=len(at))
    good = at[100 * both >= percent * (n + m - both)]
    return list(zip(root[good].tolist(), root[good + 1].tolist(), strict=True))


def share_of(differing: np.ndarray) -> np.ndarray:
    """Share of the 4-bit pieces without a set bit, of rows of 64-bit words, less what agrees by chance."""
    d = differing | differing >> np.uint64(2)
    d |= d >> np.uint64(1)
    differ = np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=-1)
    return (1 - differ / (16 * differing.shape[-1]) - 1 / 16) / (15 / 16)


def agreement(sketches: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """The estimated similarity of one member and others by their packed sketches (a row a member)."""
    return lambda x, others: share_of(sketches[others] ^ sketches[x])


#: Pairs of a cell whose estimates are looked at before any set is read, at most.
BEFORE_READING = 1 << 12


def worth_reading(side: np.ndarray, root: np.ndarray, sketches: np.ndarray, cuts: np.ndarray, least: float) -> np.ndarray:
    """Which members of the cells between ``cuts`` may be linked with another one by their sketches; all members of large cells."""
    out = np.zeros(len(side), bool)
    at = cuts[:-1][np.diff(cuts) == 2]
    at = at[(root[at] != root[at + 1]) & (share_of(sketches[at] ^ sketches[at + 1]) >= least)]
    out[at] = out[at + 1] = True
    for k in np.flatnonzero(np.diff(cuts) > 2).tolist():
        a, b = int(cuts[k]), int(cuts[k + 1])
        left, right = a + np.flatnonzero(side[a:b] != 1), a + np.flatnonzero(side[a:b] != 0)
        if len(left) * len(right) > max(BEFORE_READING, b - a):
            out[a:b] = True
            continue
        near = (share_of(sketches[left, None] ^ sketches[right]) >= least) & (root[left, None] != root[right])
        out[left[near.any(axis=1)]] = True
        out[right[near.any(axis=0)]] = True
    return out


def _cells(read: Callable[[list], Sets], shingle_bytes: int, percent: int, least: float | None):
    """Rows (cell, side, component, payload[, sketch]) sorted by cell, as links (a, b) of components. A few cells are read at once."""

    def solve(rows: pa.Table, cuts: np.ndarray) -> list[tuple[int, int]]:
        side, component = (rows.column(c).to_numpy() for c in ("side", "component"))
        sketches = None
        if least is not None:
            sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(side), -1)
            good = worth_reading(side, component, sketches, cuts, least)
            cuts = np.unique(np.append(0, good.cumsum())[cuts])
            rows, side, component, sketches = rows.filter(pa.array(good)), side[good], component[good], sketches[good]
            if not len(side):
                return []
        codes, starts = read(rows.column("payload").to_pylist())
        seen = np.zeros(int(codes.max(initial=0)) + 1, bool)
        found = pair_links(cuts[:-1][np.diff(cuts) == 2], side, component, codes, starts, percent, sketches, least)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a > 2:
                near = None
                if sketches is not None:
                    share = agreement(sketches[a:b])
                    near = lambda x, others, share=share: share(x, others) >= least
                found += cell_links(side[a:b], component[a:b], codes, starts[a : b + 1], seen, percent, near)
        return found

    def runs(rows: pa.Table, cuts: np.ndarray) -> Iterator[list[tuple[int, int]]]:
        """Consecutive cells of about ``BLOCK_SHINGLES`` shingles together (one cell may have more)."""
        ends = np.cumsum(pc.binary_length(rows.column("payload")).to_numpy().astype(np.int64)) // shingle_bytes
        first = 0
        for k in range(1, len(cuts)):
            before = ends[cuts[first] - 1] if cuts[first] else 0
            if k + 1 == len(cuts) or ends[cuts[k + 1] - 1] - before > BLOCK_SHINGLES:
                yield solve(rows.slice(cuts[first], cuts[k] - cuts[first]), cuts[first : k + 1] - cuts[first])
                first = k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last cell, which the next batch may go on with
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            if not len(cell):
                continue
            cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            if held and held[0].column("cell")[0].as_py() != cell[0]:
                cuts = np.concatenate([[0], cuts])
            if len(cuts):
                rows = pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
                before = sum(x.num_rows for x in held)
                for found in runs(rows, np.unique(np.concatenate([[0], cuts + before]))):
                    yield _pairs(found)
                held = []
            held.append(batch.slice(int(cuts[-1]) if len(cuts) else 0))
        if held:
            rows = pa.Table.from_batches(held)
            yield _pairs(solve(rows, np.array([0, rows.num_rows])))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def compared(cells: DataFrame, known: DataFrame, read: Callable[[list], Sets], shingle_bytes: int, percent: int, least: float | None) -> DataFrame:
    """Links (u, v) of components found in cells (cell, side, id, component) of the sets ``known`` (id, payload[, sketch]), staged."""
    rows = cells.join(known, "id").drop("id").repartition(shuffle_width(cells.sparkSession), "cell").sortWithinPartitions("cell")
    return staged(rows.mapInArrow(_cells(read, shingle_bytes, percent, least), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")), "links")


def _blocks(weight: Column, members: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(members / BLOCK_MEMBERS), F.ceil(weight / BLOCK_SHINGLES)).cast("long")


def star_cells(stars: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cells that compare each ``id`` of (hub, id) with its hub: the hub stands once in each block of its ids."""
    sized = stars.join(sizes, "id")
    n = sized.groupBy("hub").agg(_blocks(F.sum("n"), F.count("*")).alias("blocks"))
    dealt = sized.join(n, "hub").select("hub", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    cell = F.xxhash64("hub", "block").alias("cell")
    heads = n.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    row = lambda df, side, key: df.select(cell, F.lit(side).alias("side"), F.col(key).alias("id"), F.col(key).alias("component"))
    return row(heads, 0, "hub").union(row(dealt, 1, "id"))


def group_cells(gathered: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cells that compare all members (hub, id, component) of each hub that lie in different components.

    Members of a hub's largest component are dealt apart from the others, since they needn't be compared with each other.
    """
    sized = gathered.join(sizes, "id")
    parts = staged(sized.groupBy("hub", "component").agg(F.sum("n").alias("n"), F.count("*").alias("members")), "parts")
    most = parts.groupBy("hub").agg(F.max(F.struct("members", "component")).alias("top"), F.sum("n").alias("n"), F.sum("members").alias("members"), F.count("*").alias("parts"))
    most = most.where("parts > 1").select("hub", F.col("top.component").alias("top"), _blocks(F.col("n"), F.col("members")).alias("whole"))
    split = parts.join(most, "hub").groupBy("hub", "top", "whole").agg(
        *[f(F.when(is_top, F.col(c)).otherwise(0)).alias(f"{c}_{name}") for is_top, name in ((F.col("component") == F.col("top"), "top"), (F.col("component") != F.col("top"), "rest")) for f, c in ((F.sum, "n"), (F.sum, "members"))]
    )
    count = lambda name: _blocks(F.col(f"n_{name}"), F.col(f"members_{name}"))
    hubs = split.select("hub", "top", "whole", count("rest").alias("rest"), count("top").alias("tops"))
    # blocks are numbered: those of the rest first, then those of the largest component; one block if all fits
    small = F.col("whole") == 1
    dealt = sized.join(hubs, "hub")
    deal = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks))
    block = F.when(small, F.lit(0)).when(F.col("component") == F.col("top"), F.col("rest") + deal("tops")).otherwise(deal("rest"))
    dealt = dealt.select("hub", "id", "component", block.cast("long").alias("block"), "rest", "tops", small.alias("small"))
    # the blocks that a block meets
    all_blocks = F.sequence(F.lit(0).cast("long"), F.col("rest") + F.col("tops") - 1)
    partners = F.when(F.col("small"), F.array(F.lit(0).cast("long"))).when(F.col("block") >= F.col("rest"), F.sequence(F.lit(0).cast("long"), F.col("rest") - 1)).otherwise(all_blocks)
    met = dealt.select("hub", "id", "component", "block", F.explode(partners).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return met.select(F.xxhash64("hub", low, high).alias("cell"), side.alias("side"), "id", "component")


def link_groups(member: DataFrame, sizes: DataFrame, known: Callable[[Callable[[], DataFrame]], DataFrame], read: Callable[[list], Sets], shingle_bytes: int, percent: int, least: float | None = None, found: list[DataFrame] | None = None) -> DataFrame:
    """Components (u, component) of the ids that reach the similarity and share a group: every such link is accounted for.

    ``member`` (key, id) and ``sizes`` (id, n: about the size of its set) are staged. ``known`` gives staged rows (id, payload[, sketch]) of the
    ids (id) that are asked for, or of more; ``read`` makes sets of payloads of about ``shingle_bytes`` for each shingle. Pairs whose sketches agree less than ``least`` are not compared in full.
    ``found`` are links (u, v) known before. Ids without a link have no row. The result is staged; jobs run while this is called.

    Work inside tasks grows with the product of a group's members and those of them that its hubs leave apart;
    rows with the members times the blocks (of ``BLOCK_MEMBERS``) that they meet.
    """
    found = list(found or [])
    groups = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    sized = staged(member.join(groups, "key"), "groups")
    # a hub shares groups with most others: the original, where there are edited copies of one
    reach = sized.groupBy("id").agg(F.sum("size").alias("reach"))
    hubs = sized.join(reach, "id").groupBy("key").agg(F.min("id").alias("low"), F.max(F.struct("reach", "id")).alias("hub"))
    named = staged(sized.select("key", "id").join(hubs, "key").select("key", "id", "low", F.col("hub.id").alias("hub"), F.col("hub.reach").alias("reach")), "named")
    ends = named.groupBy("id").agg(F.min("low").alias("low"), F.max(F.struct("reach", "hub")).alias("hub"))
    pair = lambda c: F.struct(F.col(c).alias("hub"), "id")
    stars = ends.select("id", "low", F.col("hub.hub").alias("hub")).select(F.explode(F.array_distinct(F.array(pair("low"), pair("hub")))).alias("s")).select("s.*").where("hub <> id")
    stars = staged(stars, "stars")
    sets = known(lambda: stars.select(F.col("hub").alias("id")).union(stars.select("id")).distinct())
    found.append(compared(star_cells(stars, sizes), sets, read, shingle_bytes, percent, least))
    labels = components(reduce(DataFrame.union, found))

    named = named.select("key", "id", "hub").join(labels.withColumnRenamed("u", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = staged(named, "labelled")
    mixed = named.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key")
    gathered = staged(named.join(mixed, "key").select("hub", "id", "component").distinct(), "gathered")
    more = compared(group_cells(gathered, sizes), sets, read, shingle_bytes, percent, least)
    if not more.take(1):
        return labels
    # links of components join them; components of one id have no label yet
    joined = components(more)
    moved = labels.join(joined.select(F.col("u").alias("component"), F.col("component").alias("to")), "component", "left").select("u", F.coalesce("to", "component").alias("component"))
    return staged(moved.union(joined.join(labels.select("u"), "u", "left_anti")), "labels")
