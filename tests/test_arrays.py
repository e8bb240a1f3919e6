"""Arrays in files read by byte ranges: slices, large sparse files, record variables, newer header versions, units, filters."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia import units
from pelagia.sources import arrays, fields


def netcdf(path, dims, variables, records=0, version=2, attributes=(), values=True):
    """Writes a classic file: dims {name: length, 0 for records}, variables [(name, dims, kind, attributes, array)]. Attributes are texts or floats."""
    wide = version == 5
    number = lambda n: struct.pack(">q" if wide else ">i", n)
    tag = lambda n: struct.pack(">i", n)
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: number(len(s)) + pad(s.encode())
    code = {"S1": 2, ">i2": 3, ">i4": 4, ">f4": 5, ">f8": 6, ">i8": 10}

    def attrs(rows):
        out = tag(12 if rows else 0) + number(len(rows))
        for name, x in rows:
            out += text(name) + (tag(2) + number(len(x)) + pad(x.encode()) if isinstance(x, str) else tag(6) + number(1) + struct.pack(">d", x))
        return out

    names = list(dims)
    recorded = [bool(own) and dims[own[0]] == 0 for _, own, *_ in variables]
    sizes = [int(np.prod([dims[d] for d in own[r:]])) * np.dtype(kind).itemsize for r, (_, own, kind, *_) in zip(recorded, variables, strict=True)]
    sizes = [n + (-n % 4) for n in sizes]

    def head(begins):
        out = b"CDF" + bytes([version]) + number(records) + tag(10) + number(len(dims)) + b"".join(text(d) + number(n) for d, n in dims.items())
        out += attrs(list(attributes)) + tag(11) + number(len(variables))
        for (name, own, kind, rows, _), size, begin in zip(variables, sizes, begins, strict=True):
            out += text(name) + number(len(own)) + b"".join(number(names.index(d)) for d in own) + attrs(rows) + tag(code[kind]) + number(min(size, 2**31 - 1)) + struct.pack(">i" if version == 1 else ">q", begin)
        return out

    at, begins = len(head([0] * len(variables))), [0] * len(variables)
    for fixed in (True, False):  # record variables stand behind all others, in turns
        for k, (r, n) in enumerate(zip(recorded, sizes, strict=True)):
            if r != fixed:
                begins[k], at = at, at + n
    turn = sum(n for n, r in zip(sizes, recorded, strict=True) if r)
    with open(path, "wb") as f:
        f.write(head(begins))
        f.truncate(at + turn * max(0, records - 1))
        for (_, _, kind, _, a), begin, r in zip(variables, begins, recorded, strict=True):
            for k, part in enumerate(a if r else [a]) if a is not None else ():
                f.seek(begin + k * turn)
                f.write(np.ascontiguousarray(part, kind).tobytes())
    return turn


@pytest.fixture(scope="module")
def sample(tmp_path_factory):
    path = tmp_path_factory.mktemp("nc")
    rng = np.random.default_rng(0)
    h, z, t = rng.normal(size=(5, 4, 3)), np.arange(12).reshape(3, 4), np.arange(5) * 3600
    h[1, 2, 0] = -9.0
    flags = np.arange(5 * 3, dtype=np.int16).reshape(5, 3)
    for k, version in enumerate((1, 2, 5)):
        netcdf(
            path / f"f{k}.nc", {"time": 0, "y": 4, "x": 3},
            [("h", ["time", "y", "x"], ">f8", [("_FillValue", -9.0), ("units", "m")], h), ("z", ["x", "y"], ">i4", [("scale_factor", 0.5), ("units", "furlong")], z), ("time", ["time"], ">i4", [("units", "s")], t), ("flag", ["time", "x"], ">i2", [], flags)],
            records=5, version=version, attributes=[("title", "a sample"), ("number", 2.5)],
        )
    return path, h, z, flags


def test_records_slices_and_units(spark, sample):
    path, h, z, flags = sample
    df = fields.read_netcdf(spark, str(path), ["h"], ["x", "time", "y"], {"time": (1, 4), "x": (1, 3)}, ["time"])
    assert df.columns == ["file", "x", "time", "y", "h", "time_at"] and units.unit_of(df, "h") == units.m and units.unit_of(df, "time_at") == units.s
    got = {(r["file"][-4], r["time"], r["y"], r["x"]): (r["h"], r["time_at"]) for r in df.collect()}
    assert got == {(str(k), t, y, x): (h[t, y, x], t * 3600) for k in range(3) for t in (1, 2, 3) for y in range(4) for x in (1, 2)}
    assert fields.read_netcdf(spark, str(path / "f*.nc"), ["h"], ["time", "y", "x"]).where("h is null").select("time", "y", "x").distinct().collect() == [(1, 2, 0)]
    both = fields.read_netcdf(spark, str(path / "f1.nc"), ["z"], ["y", "x"])
    assert both.schema["z"].metadata == {"source_unit": "furlong"} and {(r["y"], r["x"]): r["z"] for r in both.collect()} == {(y, x): z[x, y] / 2 for y in range(4) for x in range(3)}
    flag = fields.read_netcdf(spark, str(path / "f2.nc"), ["flag"], ["time", "x"])
    assert dict(flag.dtypes)["flag"] == "int" and {(r["time"], r["x"]): r["flag"] for r in flag.collect()} == {(t, x): flags[t, x] for t in range(5) for x in range(3)}
    assert fields.netcdf_attributes(str(path / "f0.nc")) == {"title": "a sample", "number": [2.5]}
    assert fields.netcdf_attributes(str(path / "f0.nc"), "h") == {"_FillValue": [-9.0], "units": "m"}
    with pytest.raises(KeyError):
        fields.read_netcdf(spark, str(path), ["none"], ["x"])
    with pytest.raises(ValueError, match="lies on"):
        fields.read_netcdf(spark, str(path), ["z"], ["x"])
    with pytest.raises(FileNotFoundError):
        fields.read_netcdf(spark, str(path / "none*.nc"), ["z"], ["x"])


def test_many_tasks_read_only_their_bytes(spark, sample):
    path, h, _, _ = sample
    df = arrays.read_netcdf(spark, f"file://{path}", ["h"], ["time", "y", "x"], task_bytes=8 * 12)
    assert df.rdd.getNumPartitions() == 15
    assert {(r["time"], r["y"], r["x"]) for r in df.where("file like '%f0.nc'").collect()} == {(t, y, x) for t in range(5) for y in range(4) for x in range(3)}
    reader = arrays.FilteringArrayReader([(str(path / "f0.nc"), [arrays.netcdf_header(str(path / "f0.nc")).arrays["h"]])], ["time", "y", "x"], {"h": "double"}, {}, [], 1 << 20)
    left = list(reader.pushFilters([arrays.GreaterThan(("time",), 1), arrays.LessThanOrEqual(("y",), 1), arrays.EqualTo(("h",), 2), arrays.EqualTo(("x",), 2), arrays.In(("time",), (2, 9))]))
    assert [type(f).__name__ for f in left] == ["EqualTo", "In"] and reader.ranges == {"time": (2, 10), "y": (0, 2), "x": (2, 3)}
    (part,) = reader.partitions()
    assert part.ranges == {"time": (2, 5), "y": (0, 2), "x": (2, 3)}
    assert sum(b.num_rows for b in reader.read(part)) == 6
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        few = arrays.read_netcdf(spark, str(path / "f0.nc"), ["h"], ["time", "y", "x"]).where("time = 3 and y < 2")
        assert sorted(r["h"] for r in few.collect()) == sorted(h[3, :2].ravel().tolist())
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_a_file_of_more_than_two_gigabytes(spark, tmp_path):
    """Sparse: 3 GB of zeros with a few numbers; a slice at the end is read in no time, and a sum over a column of it too."""
    n = 3 << 27  # doubles
    turn = netcdf(tmp_path / "big.nc", {"t": 0, "y": 4096, "x": 1024}, [("h", ["t", "y", "x"], ">f8", [], None)], records=n // (4096 * 1024))
    assert turn == 8 * 4096 * 1024
    head = arrays.netcdf_header(str(tmp_path / "big.nc"))
    a = head.arrays["h"]
    with open(tmp_path / "big.nc", "r+b") as f:
        f.seek(a.begin + 8 * (n - 1))
        f.write(struct.pack(">d", 7.0))
    last = a.lengths[0] - 1
    df = arrays.read_netcdf(spark, str(tmp_path / "big.nc"), ["h"], ["t", "y", "x"], {"t": (last, last + 1), "y": (4090, 4096)})
    assert df.count() == 6 * 1024 and df.agg(F.sum("h")).first()[0] == 7.0
    column = arrays.read_netcdf(spark, str(tmp_path / "big.nc"), ["h"], ["t", "y", "x"], {"x": (1023, 1024)}, task_bytes=1 << 18)
    assert column.rdd.getNumPartitions() > 8 and column.agg(F.count("*"), F.sum("h")).first() == (4096 * (last + 1), 7.0)
    whole = arrays.read_netcdf(spark, str(tmp_path / "big.nc"), ["h"], ["t", "y", "x"])
    assert whole.rdd.getNumPartitions() >= 90


def test_grids_and_records(spark, tmp_path):
    a = np.random.default_rng(1).normal(size=(3, 5, 4))
    (tmp_path / "g.bin").write_bytes(a.astype(">f8").tobytes())
    df = arrays.read_grid(spark, str(tmp_path / "g.bin"), ["lat", "lon", "angle"], {"j": 5, "i": 4}, ["angle"], {"j": (2, 4)}, task_bytes=64)
    assert {(r["j"], r["i"]): r["angle"] for r in df.collect()} == {(j, i): a[2, j, i] for j in (2, 3) for i in range(4)}
    with pytest.raises(ValueError, match="bytes"):
        arrays.read_grid(spark, str(tmp_path / "g.bin"), ["lat", "lon"], {"j": 5, "i": 4})
    links = np.zeros(1000, fields._LINK)
    links["src"], links["w1"] = np.arange(1000), np.linspace(0, 1, 1000)
    for k in range(2):
        (tmp_path / f"l{k}").write_bytes(links.tobytes() + b"rest")
    assert fields.read_packed_links(spark, str(tmp_path / "l*")).agg(F.sum("src"), F.count("*")).first() == (999_000, 2000)
    assert [r["src"] for r in arrays.read_records(spark, str(tmp_path / "l0"), fields._LINK, rows=(998, 5000)).collect()] == [998, 999]


def test_remapping_weights(spark, tmp_path):
    """A file of remapping weights as the usual tool writes it: 1-based addresses, a matrix of weights, masks and sizes."""
    src, dst = np.array([1, 2, 2, 3]), np.array([1, 1, 2, 2])
    w = np.array([[0.25, 0.1, 0.0], [0.75, 0.0, 0.2], [0.5, 0.0, 0.0], [0.5, -0.1, 0.0]])
    netcdf(
        tmp_path / "w.nc", {"src_grid_size": 3, "dst_grid_size": 2, "num_links": 4, "num_wgts": 3},
        [("src_address", ["num_links"], ">i4", [], src), ("dst_address", ["num_links"], ">i4", [], dst), ("remap_matrix", ["num_links", "num_wgts"], ">f8", [], w), ("src_grid_imask", ["src_grid_size"], ">i4", [], np.array([1, 0, 1]))],
        attributes=[("title", "a map"), ("normalization", "fracarea")],
    )
    links, about = fields.read_link_variables(spark, str(tmp_path / "w.nc"))
    assert about == {"n_src": 3, "n_dst": 2, "title": "a map", "normalization": "fracarea"}
    assert sorted(tuple(r) for r in links.select("src", "dst", "w1", "w2", "w3").collect()) == sorted(zip(src - 1, dst - 1, *w.T, strict=True))
    assert [r["open"] for r in fields.read_grid_masks(spark, str(tmp_path / "w.nc")).orderBy("id").collect()] == [True, False, True]


def test_ocean_model_history(spark, tmp_path):
    rng = np.random.default_rng(4)
    zeta, temp, salt = rng.normal(size=(2, 3, 4)), rng.normal(size=(2, 2, 3, 4)), rng.normal(size=(2, 2, 3, 4))
    u, v = rng.normal(size=(2, 2, 3, 3)), rng.normal(size=(2, 2, 2, 4))
    dims = {"ocean_time": 0, "s_rho": 2, "eta_rho": 3, "xi_rho": 4, "eta_u": 3, "xi_u": 3, "eta_v": 2, "xi_v": 4}
    three = lambda n, g, a: (n, ["ocean_time", "s_rho", f"eta_{g}", f"xi_{g}"], ">f8", [], a)
    netcdf(tmp_path / "r.nc", dims, [("zeta", ["ocean_time", "eta_rho", "xi_rho"], ">f8", [], zeta), three("temp", "rho", temp), three("salt", "rho", salt), three("u", "u", u), three("v", "v", v)], records=2)
    got = {(r["j"], r["i"]): r["zeta"] for r in fields.read_ocean_model(spark, str(tmp_path / "r.nc"), 1).collect()}
    assert got == {(j, i): zeta[1, j, i] for j in range(3) for i in range(4)}
    at = {(r["j"], r["i"]): r for r in fields.read_ocean_model(spark, str(tmp_path / "r.nc"), 1, level=0).collect()}
    assert len(at) == 12 and at[1, 2]["temp"] == temp[1, 0, 1, 2] and at[1, 2]["salt"] == salt[1, 0, 1, 2]
    assert abs(at[1, 2]["u"] - u[1, 0, 1, 1:3].mean()) < 1e-12 and at[1, 0]["u"] == u[1, 0, 1, 0] and abs(at[1, 3]["v"] - v[1, 0, :2, 3].mean()) < 1e-12
