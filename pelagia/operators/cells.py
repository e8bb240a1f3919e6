"""Overlaps of convex cells of any shape, on the sphere or in the plane, and gradients for second-order remapping.

Points are kept as three numbers: unit vectors on the sphere, (x, y, 1) in the plane. An edge then is a plane through the origin, on the sphere a
great circle, so that one clipping serves both. The sphere is cut into the six faces of a cube, where great circles
are straight: no pole and no date line is special. Each piece of a cell has codes of the quadtree squares of its own size that it touches;
cells of different sizes meet in the squares of the larger one. Candidate pairs are clipped in whole arrays inside tasks. Areas and first
moments are sums over edges, so that second-order weights of a source cell add up to nothing and what it holds is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import _c
from ..staging import staged

#: Squares of a face are halved at most so often.
DEEPEST = 28
#: Distances from an edge that count as on it.
ON_EDGE = 1e-15
#: Faces of the cube: its axis and the two across.
_FACES = [(axis, sign) for axis in range(3) for sign in (1.0, -1.0)]


# ---- cells


def structured(df: DataFrame, nx: int, corners: str = "corners") -> DataFrame:
    """Cells (id, corners) of a grid (i, j, corners); ``id`` is j * nx + i. Cells without four corners raise an error when they are read."""
    four = F.when(F.size(corners) == 4, F.col(corners)).otherwise(F.raise_error("a structured cell has four corners"))
    return df.select((F.col("j").cast("long") * nx + F.col("i")).alias("id"), four.alias("corners"))


def of_corner_columns(df: DataFrame, key: str, xs: Sequence[str], ys: Sequence[str], radians: bool = False) -> DataFrame:
    """Cells (id, corners) of rows with a column for each corner's position; ``radians`` are made degrees."""
    turn = F.degrees if radians else (lambda c: F.col(c) if isinstance(c, str) else c)
    return df.select(F.col(key).alias("id"), F.array(*[F.struct(turn(x).cast("double").alias("x"), turn(y).cast("double").alias("y")) for x, y in zip(xs, ys, strict=True)]).alias("corners"))


def of_mesh(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Cells (id, corners) of a mesh: nodes (node, x, y), triangles (elem, n1, n2, n3)."""
    at = elements.select("elem", F.posexplode(F.array("n1", "n2", "n3")).alias("k", "node"))
    ends = at.join(nodes.select("node", "x", "y").hint("merge"), "node")  # nodes are many rows in few bytes: not broadcast
    corners = F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda s: F.struct(s.x.alias("x"), s.y.alias("y")))
    return ends.groupBy(F.col("elem").alias("id")).agg(corners.alias("corners"))


# ---- polygons in arrays: points (cell, corner, 3), counts (cell)


def _next(points: np.ndarray, count: np.ndarray) -> np.ndarray:
    at = np.arange(points.shape[1])[None] + 1
    return np.take_along_axis(points, np.where(at < count[:, None], at, 0)[:, :, None], axis=1)


def _tidy(points: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without corners that are the same as the next one, moved together."""
    gap = np.abs(_next(points, count) - points).max(axis=2)
    keep = (np.arange(points.shape[1]) < count[:, None]) & (gap > ON_EDGE)
    order = np.argsort(~keep, axis=1, kind="stable")
    return np.take_along_axis(points, order[:, :, None], axis=1), keep.sum(axis=1)


def clipped(points: np.ndarray, count: np.ndarray, planes: np.ndarray, sphere: bool) -> tuple[np.ndarray, np.ndarray]:
    """Convex polygons, each cut to the positive side of its plane through the origin."""
    n, most, _ = points.shape
    at = np.arange(most)[None]
    valid = at < count[:, None]
    d = np.einsum("nvk,nk->nv", points, planes)
    d[np.abs(d) <= ON_EDGE] = 0.0
    follow = np.where(at + 1 < count[:, None], at + 1, 0)
    d_next = np.take_along_axis(d, follow, axis=1)
    following = np.take_along_axis(points, follow[:, :, None], axis=1)
    stays, crosses = valid & (d >= 0), valid & (d * d_next < 0)
    share = np.where(crosses, d / np.where(crosses, d - d_next, 1.0), 0.0)[:, :, None]
    cut = points + share * (following - points)
    if sphere:
        cut /= np.maximum(np.linalg.norm(cut, axis=2, keepdims=True), 1e-300)
    flags = np.stack([stays, crosses], axis=2).reshape(n, 2 * most)
    both = np.stack([points, cut], axis=2).reshape(n, 2 * most, 3)
    new_count = flags.sum(axis=1)
    width = max(3, int(new_count.max(initial=0)))
    out = np.zeros((n, width, 3))
    row, slot = np.nonzero(flags)
    out[row, (np.cumsum(flags, axis=1) - 1)[row, slot]] = both[row, slot]
    return out, np.where(new_count >= 3, new_count, 0)


def measures(points: np.ndarray, count: np.ndarray, sphere: bool) -> tuple[np.ndarray, np.ndarray]:
    """Areas, positive for corners against the clock, and first moments (cell, 3): integrals of the position."""
    most = points.shape[1]
    area, moment = np.zeros(len(points)), np.zeros((len(points), 3))
    if sphere:
        for k in range(1, most - 1):  # a fan of triangles
            a, b, c = points[:, 0], points[:, k], points[:, k + 1]
            tall = np.einsum("nk,nk->n", a, np.cross(b - a, c - a))
            wide = 1 + (a * b).sum(axis=1) + (b * c).sum(axis=1) + (c * a).sum(axis=1)
            area += np.where(k + 1 < count, 2 * np.arctan2(tall, wide), 0.0)
        # the integral of the position is half the sum of edges' lengths times their unit normals
        normal = np.cross(points, _next(points, count) - points)
        size = np.linalg.norm(normal, axis=2)
        length = np.arctan2(size, (points * _next(points, count)).sum(axis=2))
        inside = (np.arange(most) < count[:, None]) & (size > 0)
        moment = 0.5 * np.where(inside[:, :, None], normal * (length / np.where(size > 0, size, 1.0))[:, :, None], 0.0).sum(axis=1)
    else:
        base = points[:, :1]
        for k in range(1, most - 1):
            b, c = points[:, k] - base[:, 0], points[:, k + 1] - base[:, 0]
            part = np.where(k + 1 < count, 0.5 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0]), 0.0)
            area += part
            moment += part[:, None] * (base[:, 0] + (b + c) / 3)
    return area, moment


def polygons(corners: pa.Array, sphere: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lists of corner structs (longitude and latitude in degrees, or x and y) as arrays against the clock, without repeated corners."""
    count = np.diff(corners.offsets.to_numpy())
    flat = corners.flatten()
    x, y = (flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1))
    if sphere:
        lon, lat = np.radians(x), np.radians(y)
        values = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
    else:
        values = np.stack([x, y, np.ones(len(x))], axis=1)
    most = max(3, int(count.max(initial=0)))
    points = np.zeros((len(count), most, 3))
    owner = np.repeat(np.arange(len(count)), count)
    points[owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)] = values
    points, count = _tidy(points, count)
    turned = measures(points, count, sphere)[0] < 0
    backwards = np.clip(count[:, None] - 1 - np.arange(most), 0, None)
    return np.where(turned[:, None, None], np.take_along_axis(points, backwards[:, :, None], axis=1), points), count


# ---- pieces with their squares

_PIECE = "id long, area double, mx double, my double, mz double, face int, level int, u1 double, u2 double, v1 double, v2 double, shape binary"
_PIECE_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


def _pieces(sphere: bool, box: tuple[float, float, float]):
    """Cells (id, corners) as pieces of faces, with ranges of face coordinates from 0 to 1 and the level of their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, count = polygons(batch.column(1).combine_chunks() if isinstance(batch.column(1), pa.ChunkedArray) else batch.column(1), sphere)
            ids = batch.column(0).to_numpy()
            area, moment = measures(points, count, sphere)
            for face, (axis, sign) in enumerate(_FACES if sphere else [(2, 1.0)]):
                part, n = points, count
                own = np.flatnonzero(count >= 3)
                if sphere:
                    own = np.flatnonzero((count >= 3) & ((points[:, :, axis] * sign).max(axis=1) > 0))
                    part, n = points[own], count[own]
                    for other in range(3):
                        for side in (1.0, -1.0):
                            if other != axis:
                                plane = np.zeros(3)
                                plane[axis], plane[other] = sign, side
                                part, n = clipped(part, n, np.broadcast_to(plane, (len(part), 3)), True)
                    part, n = _tidy(part, n)
                else:
                    part, n = points[own], count[own]
                good = n >= 3
                part, n, own = part[good], n[good], own[good]
                if not len(own):
                    continue
                across = [k for k in range(3) if k != axis]
                inside = np.arange(part.shape[1]) < n[:, None]
                spans = []
                for k, low in zip(across, box[:2], strict=True):
                    at = part[:, :, k] / np.where(inside, part[:, :, axis] * sign, 1.0) if sphere else part[:, :, k]
                    at = (at - low) / box[2]
                    spans += [np.where(inside, at, np.inf).min(axis=1), np.where(inside, at, -np.inf).max(axis=1)]
                spans = [np.clip(x, 0.0, np.nextafter(1.0, 0.0)) for x in spans]
                size = np.maximum(np.maximum(spans[1] - spans[0], spans[3] - spans[2]), 2.0**-DEEPEST)
                level = (np.clip(np.floor(-np.log2(size)), 0, DEEPEST).astype(np.int32) // 2 * 2).astype(np.int32)  # every second level serves
                shape = [p[:k].astype("<f8").tobytes() for p, k in zip(part, n.tolist(), strict=True)]
                columns = [ids[own], area[own], *moment[own].T, np.full(len(own), face, np.int32), level, *spans]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], pa.array(shape, pa.binary())], _PIECE_NAMES)

    return run


def _in_squares(pieces: DataFrame, other_levels: list[int], name: str) -> DataFrame:
    """Pieces once for each square that they touch, of their own level and of coarser ones that the other side has."""
    coarser = F.filter(F.array(*[F.lit(x) for x in other_levels]).cast("array<int>"), lambda x: x < F.col("level"))
    rows = pieces.withColumn("at", F.explode(F.concat(coarser, F.array("level"))))
    square = lambda c: F.floor(F.col(c) * F.pow(F.lit(2.0), F.col("at")))
    rows = rows.withColumn("qu", F.explode(F.sequence(square("u1"), square("u2")))).withColumn("qv", F.explode(F.sequence(square("v1"), square("v2"))))
    return rows.select("face", "at", "qu", "qv", *[F.col(c).alias(f"{name}_{c}") for c in _PIECE_NAMES if c != "face"])


def _bases(centre: np.ndarray, sphere: bool) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the two gradients: northward and eastward on the sphere, along x and y in the plane."""
    n = len(centre)
    if not sphere:
        return np.tile([1.0, 0.0, 0.0], (n, 1)), np.tile([0.0, 1.0, 0.0], (n, 1))
    unit = centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-300)
    east = np.stack([-unit[:, 1], unit[:, 0], np.zeros(n)], axis=1)
    length = np.linalg.norm(east, axis=1, keepdims=True)
    east = np.where(length > 1e-12, east / np.maximum(length, 1e-300), [0.0, 1.0, 0.0])
    return np.cross(unit, east), east


def _padded(shapes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    count = np.array([len(x) // 24 for x in shapes], np.int64)
    out = np.zeros((len(shapes), max(3, int(count.max(initial=0))), 3))
    owner = np.repeat(np.arange(len(shapes)), count)
    out[owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)] = np.frombuffer(b"".join(shapes), "<f8").reshape(-1, 3)
    return out, count


def _overlaps(sphere: bool):
    """Pairs of pieces as (src, dst, w1, w2, w3), shares of the destination's area."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = lambda c, batch=batch: batch.column(c).to_numpy()
            points, count = _padded(batch.column("s_shape").to_pylist())
            other, sides = _padded(batch.column("t_shape").to_pylist())
            planes = np.cross(other, _next(other, sides) - other)
            left = np.arange(len(count))
            for k in range(other.shape[1]):
                edge = np.where((k < sides)[:, None], planes[:, k], 0.0)[left]
                points, count = clipped(points, count, edge, sphere)
                keep = count >= 3
                points, count, left = points[keep], count[keep], left[keep]
            area, moment = measures(points, count, sphere)
            whole, target = value("s_area")[left], value("t_area")[left]
            centre = np.stack([value(f"s_{c}")[left] for c in ("mx", "my", "mz")], axis=1) / whole[:, None]
            moved = moment - area[:, None] * centre
            first, second = _bases(centre, sphere)
            w = [area / target, (moved * first).sum(axis=1) / target, (moved * second).sum(axis=1) / target]
            good = area > 1e-14 * np.minimum(whole, target)  # cells that only touch
            columns = [value("s_id")[left][good], value("t_id")[left][good], *[x[good] for x in w]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["src", "dst", "w1", "w2", "w3"])

    return run


def _bounds(cells: DataFrame) -> tuple[float | None, ...]:
    """Least and largest x and y of all corners in the plane."""
    corner = cells.select(F.explode("corners").alias("c")).select("c.*")
    x, y = corner.columns
    return tuple(corner.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first())


def _meeting(cells: DataFrame, bounds: tuple[float | None, ...], gap: float = 0.0) -> DataFrame:
    """Cells whose ranges of x and y come within ``gap`` of the bounds; none without bounds."""
    if any(x is None for x in bounds):
        return cells.where("false")
    x, y = (F.col("corners")[c] for c in cells.schema["corners"].dataType.elementType.names)  # arrays
    low_x, high_x, low_y, high_y = (F.lit(v) for v in bounds)
    return cells.where((F.array_min(x) <= high_x + gap) & (F.array_max(x) >= low_x - gap) & (F.array_min(y) <= high_y + gap) & (F.array_max(y) >= low_y - gap))


def overlap_links(source: DataFrame, target: DataFrame, sphere: bool = True, normalise: str = "dest") -> DataFrame:
    """Conservative links (src, dst, w1, w2, w3) of convex cells (id long, corners: array of structs of longitude and latitude in degrees, or of x and y).

    Edges are great circles, or straight in the plane; cells are smaller than half a sphere, corners in either sense, repeated ones allowed. w1 is the shared area
    over the destination's area (``dest``) or over what of it the source covers (``frac``). w2 and w3 go with the source's gradients
    (northward and eastward on the unit sphere, or along x and y) about its centre of mass. In the plane, source cells beyond the bounds of all targets are left out first. Cells of fewer than three different corners have no link, null ids or corners neither.
    """
    if normalise not in ("dest", "frac"):
        raise ValueError(f"no such normalisation: {normalise}")
    source, target = (x.select(F.col("id").cast("long").alias("id"), "corners").where("id is not null and corners is not null") for x in (source, target))
    box = (-1.0, -1.0, 2.0)
    if not sphere:
        bounds = _bounds(target)
        source = _meeting(source, bounds)
        low_x, high_x, low_y, high_y = (x or 0.0 for x in bounds)
        box = (low_x, low_y, max(high_x - low_x, high_y - low_y) * (1 + 1e-9) or 1.0)
    parts = [staged(x.mapInArrow(_pieces(sphere, box), _PIECE), "pieces") for x in (source, target)]
    levels = [sorted(r[0] for r in x.select("level").distinct().collect()) for x in parts]  # at most DEEPEST / 2 numbers
    s, t = _in_squares(parts[0], levels[1], "s"), _in_squares(parts[1], levels[0], "t")
    both = s.join(t, ["face", "at", "qu", "qv"]).where(F.col("at") == F.least("s_level", "t_level"))
    # a pair meets in the square of the lower left corner of what their ranges share
    square = lambda a, b: F.floor(F.greatest(a, b) * F.pow(F.lit(2.0), F.col("at")))
    both = both.where((square("s_u1", "t_u1") == F.col("qu")) & (square("s_v1", "t_v1") == F.col("qv")))
    both = both.where("s_u1 <= t_u2 and t_u1 <= s_u2 and s_v1 <= t_v2 and t_v1 <= s_v2")
    wanted = ["s_id", "s_area", "s_mx", "s_my", "s_mz", "s_shape", "t_id", "t_area", "t_shape"]
    links = both.select(*wanted).mapInArrow(_overlaps(sphere), "src long, dst long, w1 double, w2 double, w3 double")
    if normalise == "dest":
        return links.groupBy("src", "dst").agg(*[F.sum(c).alias(c) for c in ("w1", "w2", "w3")])
    links = links.repartition("dst").groupBy("dst", "src").agg(*[F.sum(c).alias(c) for c in ("w1", "w2", "w3")])
    whole = F.sum("w1").over(Window.partitionBy("dst"))
    return links.withColumn("whole", whole).select("src", "dst", *[(F.col(c) / F.col("whole")).alias(c) for c in ("w1", "w2", "w3")])


def areas(cells: DataFrame, sphere: bool = True) -> DataFrame:
    """Rows (id, area, cx, cy, cz): areas and centres of mass of cells (id, corners), which lie under the sphere's face; (cx, cy, 1) in the plane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            area, moment = measures(*polygons(batch.column(1), sphere), sphere)
            with np.errstate(invalid="ignore", divide="ignore"):
                centre = moment / area[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(area), *[pa.array(c) for c in centre.T]], ["id", "area", "cx", "cy", "cz"])

    cells = cells.select(F.col("id").cast("long").alias("id"), "corners").where("corners is not null")
    return cells.mapInArrow(run, "id long, area double, cx double, cy double, cz double")


# ---- gradients


def edge_neighbours(cells: DataFrame, digits: int = 9) -> DataFrame:
    """Pairs (id, other), both ways, of cells (id, corners) that share an edge; corners are equal when rounded to ``digits``. An edge is of two cells, else it is a rim."""
    x, y = cells.schema["corners"].dataType.elementType.names
    corners = F.transform("corners", lambda s: F.struct(F.round(s[x], digits).alias("x"), F.round(s[y], digits).alias("y")))
    rows = cells.select("id", corners.alias("c"))
    n = F.size("c")
    edge = F.transform("c", lambda p, k: F.array_sort(F.array(p, F.element_at("c", (k + 1) % n + 1))))
    rows = rows.select("id", F.explode(edge).alias("e")).where(F.col("e")[0] != F.col("e")[1])
    ends = rows.groupBy("e").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).where("n = 2 and a <> b")
    pair = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other"))))
    return ends.select(pair.alias("p")).select("p.*").distinct()


def gradients(values: DataFrame, neighbours: DataFrame, names: Sequence[str], limited: bool = True) -> DataFrame:
    """``values`` (id, x, y, names) with ``name_x`` and ``name_y``, by :func:`gradients_of` over ``neighbours`` (id, other)."""
    at = values.select("id", "x", "y")
    far = at.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    offsets = neighbours.join(at, "id").join(far, "other").select("id", "other", (F.col("ox") - F.col("x")).alias("dx"), (F.col("oy") - F.col("y")).alias("dy"))
    return gradients_of(values, offsets, names, limited)


def _fits(gx: Column, gy: Column):
    """What share of a gradient stays in the range from ``__low`` to ``__high`` half-way to a neighbour."""

    def share(p: Column) -> Column:
        step = (gx * p.dx + gy * p.dy) / 2
        return F.when(step > F.col("__high"), F.col("__high") / step).when(step < F.col("__low"), F.col("__low") / step).otherwise(1.0)

    return share


def gradients_of(values: DataFrame, offsets: DataFrame, names: Sequence[str], limited: bool = True) -> DataFrame:
    """``values`` (id, names) with ``name_x`` and ``name_y``: least-squares gradients over neighbours at ``offsets`` (id, other, dx, dy).

    They are exact for linear fields. Where neighbours lie on one line, or there are none, they are 0. ``limited`` ones are shrunk so that half-way to
    each neighbour the linear field stays in the range of the cell and its neighbours: no new extremes appear there. Null values take no part.
    """
    own = values.select("id", *names)
    far = own.select(F.col("id").alias("other"), *[F.col(n).alias(f"o_{n}") for n in names])
    rows = offsets.select("id", "other", "dx", "dy").join(own, "id").join(far, "other")
    found: list[Column] = []
    for n in names:
        dv = F.col(f"o_{n}") - F.col(n)
        known = F.when(dv.isNotNull(), F.struct("dx", "dy", dv.alias("dv")))
        found.append(F.collect_list(known).alias(f"__{n}"))  # as many as a cell has edges
    out = values.join(rows.groupBy("id").agg(*found), "id", "left")
    total = lambda n, f: F.aggregate(f"__{n}", F.lit(0.0), lambda s, p: s + f(p))
    for n in names:
        sums = {"xx": lambda p: p.dx * p.dx, "xy": lambda p: p.dx * p.dy, "yy": lambda p: p.dy * p.dy, "xv": lambda p: p.dx * p.dv, "yv": lambda p: p.dy * p.dv}
        out = out.withColumns({f"__{k}": F.coalesce(total(n, f), F.lit(0.0)) for k, f in sums.items()})
        xx, xy, yy, xv, yv = (F.col(f"__{k}") for k in sums)
        size = xx * yy - xy * xy
        gx, gy = (F.coalesce(F.when(size > 1e-12 * xx * yy, c / size), F.lit(0.0)) for c in (yy * xv - xy * yv, xx * yv - xy * xv))
        out = out.withColumns({f"{n}_x": gx, f"{n}_y": gy})
        if limited:
            ends = F.transform(f"__{n}", lambda p: p.dv)
            out = out.withColumns({"__high": F.greatest(F.lit(0.0), F.array_max(ends)), "__low": F.least(F.lit(0.0), F.array_min(ends))})
            fits = _fits(F.col(f"{n}_x"), F.col(f"{n}_y"))
            out = out.withColumn("__share", F.coalesce(F.array_min(F.transform(f"__{n}", fits)), F.lit(1.0)))
            out = out.withColumns({c: F.col(c) * F.col("__share") for c in (f"{n}_x", f"{n}_y")})
    return out.select(*values.columns, *[f"{n}_{c}" for n in names for c in ("x", "y")])


def tangent(centres: DataFrame) -> DataFrame:
    """Centres (id, cx, cy, cz) of the sphere as (id, lat, lon) in radians."""
    return centres.select("id", F.atan2("cz", F.sqrt(_c("cx") * _c("cx") + _c("cy") * _c("cy"))).alias("lat"), F.atan2("cy", "cx").alias("lon"))


def remap(source: DataFrame, values: DataFrame, target: DataFrame, names: Sequence[str], order: int = 1, sphere: bool = True, normalise: str = "dest", limited: bool = True) -> DataFrame:
    """Rows (dst, names) of ``target``'s cells: ``values`` (id, names) of ``source``'s cells, remapped by overlap; order 2 takes gradients from the values themselves.

    Cells are (id, corners). Gradients on the sphere are taken over edge neighbours in the plane that touches it at each cell, longitudes to the nearer side. Destination cells that nothing covers have 0.0.
    """
    from .remap import apply_links

    if order == 2 and not sphere:
        # only cells within the targets' bounds have links, and gradients there need only these and cells that touch them
        target = staged(target.select("id", "corners"), "targets")
        source = source.select("id", "corners")
        source = staged(_meeting(source, _bounds(_meeting(source, _bounds(target))), 1e-8), "sources")
    links = overlap_links(source, target, sphere, normalise)
    rows = values.select(F.col("id").alias("src"), *names)
    ends = target.select(F.col("id").alias("dst"))
    if order == 1:
        return apply_links(rows, links, ends, names)
    near = edge_neighbours(source)
    centres = areas(source, sphere)
    if sphere:
        # offsets from each cell to its neighbours, eastward and northward
        at = tangent(centres)
        other = at.select(F.col("id").alias("other"), F.col("lat").alias("olat"), F.col("lon").alias("olon"))
        offset = near.join(at, "id").join(other, "other")
        turn = F.col("olon") - F.col("lon")
        offset = offset.select("id", "other", (F.cos("olat") * F.sin(turn)).alias("dx"), (F.sin("olat") * F.cos("lat") - F.cos("olat") * F.sin("lat") * F.cos(turn)).alias("dy"))
        made = gradients_of(values.select("id", *names), offset, names, limited)
        pair = {n: (f"{n}_y", f"{n}_x") for n in names}
    else:
        at = values.select("id", *names).join(centres.select("id", F.col("cx").alias("x"), F.col("cy").alias("y")), "id")
        made = gradients(at, near, names, limited)
        pair = {n: (f"{n}_x", f"{n}_y") for n in names}
    return apply_links(made.withColumnRenamed("id", "src"), links, ends, names, pair)
