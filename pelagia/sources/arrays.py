"""Arrays inside large binary files as a data source: tasks read byte ranges of a few records each.

A layout says where the values of each variable lie: at which byte it begins, how long its dimensions are and how many bytes one step along each
takes. Classic NetCDF headers, plain grids and packed records all come down to it. The driver reads headers only and cuts the index space into
regions; a task reads the bytes of its region, for the wanted variables alone. Ranges of indices are given to the reader, or are
taken from filters where Spark pushes filters to Python sources (``spark.sql.python.filterPushdown.enabled``).

Files are opened where Spark's tasks run, by :mod:`pyarrow.fs`: local or mounted paths and the stores that it knows by their URIs.
"""

from __future__ import annotations

import fnmatch
import json
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .. import units

#: Bytes of values that a task reads at most (one record of the slowest dimension may have more), and rows of its batches.
TASK_BYTES, BATCH_ROWS = 32 << 20, 1 << 16
#: A region is read as one run of bytes if that is at most so many times what is wanted.
SPREAD = 4

# Types of classic NetCDF by number.
_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


# ---- files


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or of a plain path."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def found(path: str) -> list[tuple[str, int]]:
    """Files (path, size) of a file, a folder or a pattern in the last part of a path, in order of their names."""
    system, inner = opened(path)
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) and "://" in path else ""
    folder, _, name = inner.rpartition("/")
    if any(c in name for c in "*?["):
        infos = [x for x in system.get_file_info(pafs.FileSelector(folder)) if fnmatch.fnmatch(x.base_name, name)]
    else:
        own = system.get_file_info(inner)
        infos = system.get_file_info(pafs.FileSelector(inner)) if own.type == pafs.FileType.Directory else [own]
    files = sorted((f"{scheme}{x.path}", x.size) for x in infos if x.type == pafs.FileType.File and not x.base_name.startswith(("_", ".")))
    if not files:
        raise FileNotFoundError(path)
    return files


# ---- layouts


@dataclass
class Array:
    """Where a variable's values lie in a file."""

    name: str
    begin: int
    kind: str
    dims: list[str]
    lengths: list[int]
    steps: list[int]
    fills: list[float] = field(default_factory=list)
    scale: float = 1.0
    offset: float = 0.0
    unit: str | None = None

    def bounded(self, ranges: dict[str, tuple[int, int]]) -> list[tuple[int, int]]:
        return [ranges.get(d, (0, n)) for d, n in zip(self.dims, self.lengths, strict=True)]

    def read(self, read_at: Callable[[int, int], bytes], ranges: dict[str, tuple[int, int]]) -> np.ndarray:
        """Raw values of a region."""
        return self._region(read_at, self.begin, self.bounded(ranges), self.steps)

    def _region(self, read_at, begin: int, bounds: list[tuple[int, int]], steps: list[int]) -> np.ndarray:
        kind = np.dtype(self.kind)
        counts = [b - a for a, b in bounds]
        if 0 in counts:
            return np.empty(counts, kind)
        first = begin + sum(a * s for (a, _), s in zip(bounds, steps, strict=True))
        span = sum((n - 1) * s for n, s in zip(counts, steps, strict=True)) + kind.itemsize
        if span <= SPREAD * kind.itemsize * int(np.prod(counts)):
            return np.ndarray(counts, kind, read_at(span, first), strides=steps)
        # the first dimension has gaps: one run for each of its places
        a, b = bounds[0]
        return np.stack([self._region(read_at, begin + k * steps[0], bounds[1:], steps[1:]) for k in range(a, b)])


class _Cursor:
    """Numbers and names of a header, one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at, self.wide = data, 4, data[3] == 5

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError("the header goes on")
        self.at += n
        return self.data[self.at - n : self.at]

    def tag(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def count(self) -> int:
        """A number that the format's fifth version has in 64 bits."""
        return struct.unpack(">q", self.take(8))[0] if self.wide else self.tag()

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.count()).decode("utf-8", "replace")

    def attributes(self) -> dict[str, str | list]:
        out: dict[str, str | list] = {}
        self.tag()
        for _ in range(self.count()):
            name, kind = self.name(), np.dtype(_TYPES[self.tag()])
            raw = self.padded(self.count() * kind.itemsize)
            out[name] = raw.rstrip(b"\0").decode("utf-8", "replace") if kind.kind == "S" else np.frombuffer(raw, kind).tolist()
        return out


@dataclass
class Header:
    """A classic NetCDF file's dimensions, attributes and variables."""

    dims: dict[str, int]
    attributes: dict[str, str | list]
    variables: dict[str, dict]
    arrays: dict[str, Array]


def parsed_header(data: bytes, file_size: int) -> Header:
    """Header of format versions 1, 2 and 5; EOFError if it is longer than ``data``."""
    if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
        raise ValueError("not a classic NetCDF file")
    c = _Cursor(data)
    records = c.count()
    c.tag()
    dims = [(c.name(), c.count()) for _ in range(c.count())]
    attributes = c.attributes()
    c.tag()
    rows = []
    for _ in range(c.count()):
        name = c.name()
        own = [c.count() for _ in range(c.count())]
        attrs, kind = c.attributes(), _TYPES[c.tag()]
        c.count()  # the stored size overflows for large variables; it follows from the dimensions
        rows.append((name, own, attrs, kind, struct.unpack(">i", c.take(4))[0] if data[3] == 1 else struct.unpack(">q", c.take(8))[0]))
    recorded = [bool(own) and dims[own[0]][1] == 0 for _, own, *_ in rows]
    sizes = [int(np.prod([dims[d][1] for d in own[r:]], dtype=np.int64)) * np.dtype(kind).itemsize for r, (_, own, _, kind, _) in zip(recorded, rows, strict=True)]
    turn = sum(n + (-n % 4 if sum(recorded) > 1 else 0) for n, r in zip(sizes, recorded, strict=True) if r)
    if records < 0:  # a file that was being written: as many records as there are
        records = (file_size - min(begin for r, (*_, begin) in zip(recorded, rows, strict=True) if r)) // turn if any(recorded) else 0
    lengths = [n or records for _, n in dims]
    arrays = {}
    for r, (name, own, attrs, kind, begin) in zip(recorded, rows, strict=True):
        inner = np.cumprod([1, *[lengths[d] for d in reversed(own[r:])]])[:-1][::-1] * np.dtype(kind).itemsize
        fills = [x for key in ("_FillValue", "missing_value") for x in (attrs.get(key) or []) if not isinstance(x, str)]
        number = lambda key, other, attrs=attrs: float(attrs[key][0]) if key in attrs and not isinstance(attrs[key], str) else other
        unit = attrs.get("units")
        arrays[name] = Array(name, begin, kind, [dims[d][0] for d in own], [lengths[d] for d in own], [*([turn] if r else []), *map(int, inner)], fills, number("scale_factor", 1.0), number("add_offset", 0.0), unit if isinstance(unit, str) else None)
    return Header({d: lengths[k] for k, (d, _) in enumerate(dims)}, attributes, {name: attrs for name, _, attrs, *_ in rows}, arrays)


def netcdf_header(path: str) -> Header:
    """Header of one file; only its beginning is read."""
    system, inner = opened(path)
    size = system.get_file_info(inner).size
    with system.open_input_file(inner) as f:
        n = 1 << 16
        while True:
            try:
                return parsed_header(f.read_at(min(n, size), 0), size)
            except EOFError:
                if n >= size:
                    raise ValueError(f"the header of {path} ends early") from None
                n *= 4


def grid_layout(names: Sequence[str], lengths: dict[str, int], kind: str = ">f8") -> list[Array]:
    """Plain arrays, one after the other, of the same dimensions, the last of which is the fastest."""
    size = np.dtype(kind).itemsize
    steps = (np.cumprod([1, *reversed(lengths.values())])[:-1][::-1] * size).tolist()
    whole = int(np.prod(list(lengths.values()), dtype=np.int64)) * size
    return [Array(n, k * whole, kind, list(lengths), list(lengths.values()), steps) for k, n in enumerate(names)]


def record_layout(kind: np.dtype, file_size: int) -> list[Array]:
    """Packed records as variables along ``row``; a part of a record at the end is left out."""
    return [Array(n, kind.fields[n][1], kind.fields[n][0].str, ["row"], [file_size // kind.itemsize], [kind.itemsize]) for n in kind.names]


# ---- the data source


@dataclass
class Region(InputPartition):
    """Ranges of indices of one file."""

    file: str
    ranges: dict[str, tuple[int, int]]


def _columns(arrays: list[Array]) -> dict[str, str]:
    """Spark types: whole numbers without scale or fill stay whole."""
    kinds = {}
    for a in arrays:
        kind = np.dtype(a.kind)
        whole = kind.kind in "iu" and not a.fills and a.scale == 1.0 and a.offset == 0.0 and kind.str[1:] != "u8"
        kinds[a.name] = "string" if kind.kind == "S" else ("int" if kind.itemsize < 4 or kind.str[1:] == "i4" else "long") if whole else "double"
    return kinds


def _values(a: Array, raw: np.ndarray, kind: str) -> pa.Array:
    if kind == "string":
        return pa.array([x.decode("latin-1") for x in raw.ravel().tolist()], pa.string())
    if kind in ("int", "long"):
        return pa.array(raw.ravel().astype(np.int32 if kind == "int" else np.int64))
    values = raw.ravel().astype(float)
    gone = np.isin(raw.ravel(), np.array(a.fills).astype(raw.dtype)) if a.fills else np.zeros(values.shape, bool)
    return pa.array(values * a.scale + a.offset, mask=gone | np.isnan(values))


class ArrayReader(DataSourceReader):
    def __init__(self, layouts: list[tuple[str, list[Array]]], dims: list[str], kinds: dict[str, str], ranges: dict[str, tuple[int, int]], coordinates: list[str], task_bytes: int):
        self.layouts, self.dims, self.kinds, self.ranges, self.coordinates, self.task_bytes = layouts, dims, kinds, dict(ranges), coordinates, task_bytes

    def partitions(self) -> list[Region]:
        """Regions of about ``task_bytes``: ranges of the slowest dimension of the first variable, and of the next one where a single record has more."""
        out: list[Region] = []
        for file, arrays in self.layouts:
            lengths = {d: n for a in arrays for d, n in zip(a.dims, a.lengths, strict=True)}
            clip = {d: (max(0, self.ranges.get(d, (0, n))[0]), min(n, self.ranges.get(d, (0, n))[1])) for d, n in lengths.items()}
            clip = {d: (a, max(a, b)) for d, (a, b) in clip.items()}
            size = sum(np.dtype(a.kind).itemsize for a in arrays)
            order = [d for d, _ in sorted(zip(arrays[0].dims, arrays[0].steps, strict=True), key=lambda x: -x[1])]
            out += [Region(file, r) for r in self._cut(clip, order, size)]
        return out or [Region("", {})]

    def _cut(self, clip: dict[str, tuple[int, int]], order: list[str], size: int) -> Iterator[dict[str, tuple[int, int]]]:
        total = size * int(np.prod([b - a for a, b in clip.values()], dtype=np.int64))
        if not total:
            return
        if total <= self.task_bytes or not order:
            yield clip
            return
        first, (a, b) = order[0], clip[order[0]]
        step = max(1, self.task_bytes * (b - a) // total)
        for k in range(a, b, step):
            yield from self._cut(clip | {first: (k, min(b, k + step))}, order[1:] if step == 1 else [], size)

    def read(self, partition: Region) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        arrays = dict(self.layouts)[partition.file]
        system, inner = opened(partition.file)
        with system.open_input_file(inner) as f:
            read_at = lambda n, at: f.read_at(n, at)
            bounds = [partition.ranges[d] for d in self.dims]
            shape = [b - a for a, b in bounds]
            parts = []
            for a in arrays:
                raw = a.read(read_at, partition.ranges)
                parts.append(np.transpose(raw, [a.dims.index(d) for d in self.dims]) if a.name not in self.coordinates else raw)
        rows = int(np.prod(shape, dtype=np.int64))
        for k in range(0, rows, BATCH_ROWS):
            at = np.unravel_index(np.arange(k, min(rows, k + BATCH_ROWS)), shape)
            columns: dict[str, pa.Array] = {"file": pa.array([partition.file] * len(at[0]), pa.string())}
            for d, x, (a, _) in zip(self.dims, at, bounds, strict=True):
                columns[d] = pa.array((x + a).astype(np.int32))
            for a, raw in zip(arrays, parts, strict=True):
                here = raw[at[self.dims.index(a.dims[0])]] if a.name in self.coordinates else raw[at]
                columns[f"{a.name}_at" if a.name in self.coordinates else a.name] = _values(a, here, self.kinds[a.name])
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


class FilteringArrayReader(ArrayReader):
    """For sessions that push filters to Python sources."""

    def pushFilters(self, filters):  # noqa: N802
        """Comparisons of an index with a number narrow its range; all others are left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if name not in self.dims or not (isinstance(value, int) or (isinstance(f, In) and all(isinstance(x, int) for x in value))):
                yield f
                continue
            low, high = self.ranges.get(name, (0, 1 << 62))
            bounds = {EqualTo: lambda v: (v, v + 1), GreaterThan: lambda v: (v + 1, high), GreaterThanOrEqual: lambda v: (v, high), LessThan: lambda v: (low, v), LessThanOrEqual: lambda v: (low, v + 1), In: lambda v: (min(v), max(v) + 1)}
            if type(f) not in bounds or value == ():
                yield f
                continue
            a, b = bounds[type(f)](value)
            self.ranges[name] = max(low, a), min(high, b)
            if isinstance(f, In):
                yield f


class ArrayFiles(DataSource):
    """Format ``pelagia_arrays``; :func:`read_arrays` sets its options."""

    @classmethod
    def name(cls) -> str:
        return "pelagia_arrays"

    def _plan(self) -> dict:
        return json.loads(self.options["plan"])

    def schema(self) -> str:
        plan = self._plan()
        kinds = [(f"{n}_at" if n in plan["coordinates"] else n, k) for n, k in plan["kinds"].items()]
        return ", ".join(["file string", *(f"`{d}` int" for d in plan["dims"]), *(f"`{n}` {k}" for n, k in kinds)])

    def reader(self, schema) -> ArrayReader:
        plan = self._plan()
        layouts = [(file, [Array(**a) for a in arrays]) for file, arrays in plan["layouts"]]
        ranges = {d: tuple(r) for d, r in plan["ranges"].items()}
        kind = FilteringArrayReader if plan["pushes"] else ArrayReader
        return kind(layouts, plan["dims"], plan["kinds"], ranges, plan["coordinates"], plan["task_bytes"])


def read_arrays(spark: SparkSession, layouts: list[tuple[str, list[Array]]], dims: Sequence[str], ranges: dict[str, tuple[int, int]] | None = None, coordinates: Sequence[str] = (), task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows (file, an index per dimension, variables) of files with their layouts; variables lie on ``dims`` in any order.

    ``ranges`` are half-open ranges of indices by dimension. ``coordinates`` are variables on one of the dimensions, given as ``name_at``.
    """
    first = layouts[0][1]
    for file, arrays in layouts:
        for a in arrays:
            if (a.name in coordinates and not (len(a.dims) == 1 and a.dims[0] in dims)) or (a.name not in coordinates and sorted(a.dims) != sorted(dims)):
                raise ValueError(f"{a.name} of {file} lies on {', '.join(a.dims) or 'no dimension'}")
    plan = {"layouts": [(f, [asdict(a) for a in arrays]) for f, arrays in layouts], "dims": list(dims), "kinds": _columns(first), "ranges": ranges or {}, "coordinates": list(coordinates), "task_bytes": task_bytes}
    plan["pushes"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true"
    spark.dataSource.register(ArrayFiles)
    df = spark.read.format("pelagia_arrays").option("plan", json.dumps(plan)).load()
    for a in first:
        column = f"{a.name}_at" if a.name in coordinates else a.name
        if a.unit is not None:
            df = df.withMetadata(column, {**df.schema[column].metadata, "source_unit": a.unit})
            if a.unit.strip() in units.NAMED:
                df = units.with_unit(df, column, units.named(a.unit))
    return df


def read_netcdf(spark: SparkSession, path: str, names: Sequence[str], dims: Sequence[str], ranges: dict[str, tuple[int, int]] | None = None, coordinates: Sequence[str] = (), task_bytes: int = TASK_BYTES) -> DataFrame:
    """Variables ``names`` of classic NetCDF files (a path, folder or pattern), with fill values as null, scaled, and units in the columns' metadata.

    Files of other sizes, layouts and numbers of records may stand side by side. A name that a file lacks raises KeyError. See :func:`read_arrays`.
    """
    layouts = []
    for file, _ in found(path):
        arrays = netcdf_header(file).arrays
        layouts.append((file, [arrays[n] for n in (*names, *coordinates)]))
    return read_arrays(spark, layouts, dims, ranges, coordinates, task_bytes)


def read_grid(spark: SparkSession, path: str, names: Sequence[str], lengths: dict[str, int], wanted: Sequence[str] | None = None, ranges: dict[str, tuple[int, int]] | None = None, kind: str = ">f8", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Plain grids: files of arrays ``names`` of dimensions ``lengths`` (slowest first), of which ``wanted`` ones are read."""
    layout = [a for a in grid_layout(names, lengths, kind) if wanted is None or a.name in wanted]
    whole = len(names) * int(np.prod(list(lengths.values()), dtype=np.int64)) * np.dtype(kind).itemsize
    files = found(path)
    for file, size in files:
        if size != whole:
            raise ValueError(f"{file} has {size} bytes, not {whole}")
    return read_arrays(spark, [(f, layout) for f, _ in files], list(lengths), ranges, (), task_bytes)


def read_records(spark: SparkSession, path: str, kind: np.dtype, rows: tuple[int, int] | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Files of packed records as rows (file, row, fields)."""
    return read_arrays(spark, [(f, record_layout(kind, size)) for f, size in found(path)], ["row"], {"row": rows} if rows else None, (), task_bytes)
