"""Run parameters: a fort.15 reader and writer driven by one table, and namelists. Such files are a few kB; the driver reads them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Parameters = dict[str, object]


@dataclass(frozen=True)
class Line:
    """One line of the file: names of its values, their types, and when it is there. A line of text is one value."""

    names: tuple[str, ...]
    kinds: tuple[type, ...]
    when: Callable[[Parameters], bool] = lambda p: True

    def read(self, p: Parameters, take: Callable[[], str]) -> None:
        p.update(zip(self.names, [_text(take())] if self.kinds == (str,) else _numbers(take(), self.kinds), strict=True))

    def write(self, p: Parameters) -> list[str]:
        values = " ".join(str(p[n]) for n in self.names)
        return [values if self.kinds == (str,) else f"{values} ! {' '.join(self.names)}"]


@dataclass(frozen=True)
class Many:
    """As many items as ``count`` says, a line each, with a line for the name before it if ``tagged``: lists of tuples, or dictionaries by name.

    With ``inner`` an item is that many lines. ``counted``: the number is on a line of its own before. Without ``kinds`` items are the lines' texts.
    """

    name: str
    count: str
    kinds: tuple[type, ...] = ()
    tagged: bool = False
    inner: str = ""
    counted: bool = False
    when: Callable[[Parameters], bool] = lambda p: True

    def read(self, p: Parameters, take: Callable[[], str]) -> None:
        if self.counted:
            (p[self.count],) = _numbers(take(), (int,))
        out: list = []
        for _ in range(int(p[self.count])):
            tag = _text(take()) if self.tagged else None
            lines = [take() for _ in range(int(p[self.inner]) if self.inner else 1)]
            items = [_numbers(x, self.kinds) if self.kinds else _text(x) for x in lines]
            out.append((tag, items if self.inner else items[0]))
        p[self.name] = dict(out) if self.tagged else [x for _, x in out]

    def write(self, p: Parameters) -> list[str]:
        held = p.get(self.name, {} if self.tagged else [])
        out = [f"{len(held)} ! {self.count}"] if self.counted else []
        for tag, item in held.items() if self.tagged else ((None, x) for x in held):
            out += [tag] if self.tagged else []
            out += [" ".join(map(str, x)) if self.kinds else str(x) for x in (item if self.inner else [item])]
        return out


@dataclass(frozen=True)
class Row:
    """``count`` numbers over as many lines as they take."""

    name: str
    count: str
    when: Callable[[Parameters], bool] = lambda p: True

    def read(self, p: Parameters, take: Callable[[], str]) -> None:
        found: list[float] = []
        while len(found) < int(p[self.count]):
            found += [float(x) for x in _plain(take()).split()]
        p[self.name] = found

    def write(self, p: Parameters) -> list[str]:
        return [" ".join(map(str, p[self.name][k : k + 8])) for k in range(0, len(p[self.name]), 8)]


def _text(line: str) -> str:
    return line.split("!")[0].strip()


def _plain(line: str) -> str:
    return line.split("!")[0].replace("d", "e").replace("D", "e").replace(",", " ")


def _numbers(line: str, kinds: tuple[type, ...]) -> tuple:
    return tuple(kind(float(x)) if kind is int and not x.lstrip("+-").isdigit() else kind(x) for kind, x in zip(kinds, _plain(line).split()[: len(kinds)], strict=True))


def _line(names: str, kinds: type | tuple[type, ...], when=lambda p: True) -> Line:
    names = tuple(names.split())
    return Line(names, kinds if isinstance(kinds, tuple) else (kinds,) * len(names), when)


def _output(prefix: str, when=lambda p: True) -> tuple:
    """When to write a kind of output, and at which stations: (prefix)_AT and (prefix)_STATIONS."""
    own = _line(" ".join(f"{prefix}_{n}" for n in ("FORMAT", "FROM", "TO", "EVERY")), (int, float, float, int), when)
    return own, Many(f"{prefix}_STATIONS", f"{prefix}_N", counted=True, when=when)


def _whole(prefix: str, when=lambda p: True) -> Line:
    return _line(" ".join(f"{prefix}_{n}" for n in ("FORMAT", "FROM", "TO", "EVERY")), (int, float, float, int), when)


_DEEP = lambda p: p["IM"] in (1, 2, 11, 21, 31)
_DENSE = lambda p: _DEEP(p) and p["IDEN"] != 0
_FLUX = lambda p: p["NFLUX"] > 0
_WIND = lambda p: p["NWS"] != 0
_OPEN = lambda *flags: lambda p: _DENSE(p) and p["RES_BC_FLAG"] in flags and p["NETA"] > 0
_HEATED = lambda p: _OPEN(3, 4)(p) and p["BCFLAG_TEMP"] != 0

# The order of the lines of a fort.15 file, as its public description gives it. NETA and NFLUX are the mesh's numbers of boundary nodes.
LINES = (
    _line("RUNDES", str), _line("RUNID", str), *(_line(n, int) for n in "NFOVER NABOUT NSCREEN IHOT ICS IM".split()),
    _line("IDEN", int, lambda p: p["IM"] in (20, 21, 30, 31)),
    *(_line(n, int) for n in "NOLIBF NOLIFA NOLICA NOLICAT NWP".split()),
    Many("AttrName", "NWP"),
    *(_line(n, int) for n in "NCOR NTIP NWS NRAMP".split()),
    _line("G", float), _line("TAU0", float), _line("Tau0FullDomainMin Tau0FullDomainMax", float, lambda p: p["TAU0"] == -5.0),
    _line("DTDP", float), _line("STATIM", float), _line("REFTIM", float),
    _line("WTIMINC", float, lambda p: p["NWS"] in (4, 5, 6, 7, 10, 12, 15)),
    _line("RNDAY", float), _line("DRAMP", float, lambda p: p["NRAMP"] in (0, 1)), _line("A00 B00 C00", float),
    _line("H0", float, lambda p: p["NOLIFA"] in (0, 1)), _line("H0 INTEGER1 INTEGER2 VELMIN", float, lambda p: p["NOLIFA"] in (2, 3)),
    _line("SLAM0 SFEA0", float),
    _line("TAU", float, lambda p: p["NOLIBF"] == 0), _line("CF", float, lambda p: p["NOLIBF"] == 1), _line("CF HBREAK FTHETA FGAMMA", float, lambda p: p["NOLIBF"] == 2),
    _line("ESLM", float, lambda p: p["IM"] != 10), _line("ESLM ESLC", float, lambda p: p["IM"] == 10),
    _line("CORI", float), _line("NTIF", int),
    Many("TIDES", "NTIF", (float,) * 5, tagged=True),
    Many("BOUNDARY", "NBFR", (float,) * 3, tagged=True, counted=True), Many("FORCING", "NBFR", (float,) * 2, tagged=True, inner="NETA"),
    _line("ANGINN", float),
)
#: The part behind the boundary forcing, which shorter files lack.
MORE_LINES = (
    Many("FLUXES", "NFFR", (float,) * 3, tagged=True, counted=True, when=_FLUX), Many("FLUX_FORCING", "NFFR", (float,) * 2, tagged=True, inner="NFLUX", when=_FLUX),
    *_output("ELEVATION"), *_output("VELOCITY"), *_output("CONCENTRATION", lambda p: p["IM"] == 10), *_output("WEATHER", _WIND),
    _whole("ALL_ELEVATION"), _whole("ALL_VELOCITY"), _whole("ALL_CONCENTRATION", lambda p: p["IM"] == 10), _whole("ALL_WEATHER", _WIND),
    Many("HARMONICS", "NHARF", (float,) * 3, tagged=True, counted=True),
    _line("THAS THAF NHAINC FMV", (float, float, int, float)), _line("NHASE NHASV NHAGE NHAGV", int), _line("NHSTAR NHSINC", int),
    _line("ITITER ISLDIA CONVCR ITMAX", (int, int, float, int)),
    _line("IDEN", int, _DEEP), _line("ISLIP KP", (int, float), _DEEP), _line("Z0S Z0B", float, _DEEP), _line("ALP1 ALP2 ALP3", float, _DEEP), _line("IGC NFEN", int, _DEEP),
    Row("SIGMA", "NFEN", lambda p: _DEEP(p) and p["IGC"] == 0),
    _line("IEVC EVMIN EVCON", (int, float, float), _DEEP), _line("THETA1 THETA2", float, lambda p: _DEEP(p) and p["IEVC"] in (50, 51)), Row("EVTOT", "NFEN", lambda p: _DEEP(p) and p["IEVC"] == 0),
    *_output("DEEP_DENSITY", _DEEP), *_output("DEEP_VELOCITY", _DEEP), *_output("DEEP_TURBULENCE", _DEEP),
    _whole("ALL_DEEP_DENSITY", _DEEP), _whole("ALL_DEEP_VELOCITY", _DEEP), _whole("ALL_DEEP_TURBULENCE", _DEEP),
    _line("RES_BC_FLAG BCFLAG_LNM BCFLAG_TEMP", int, _DENSE),
    _line("RBCTIMEINC", float, _OPEN(-4, -3, -2, -1, 1)), _line("BCSTATIM", float, _OPEN(-4, -3, -2, -1, 1)),
    _line("RBCTIMEINC SBCTIMEINC", float, _OPEN(2)), _line("BCSTATIM SBCSTATIM", float, _OPEN(2)),
    _line("RBCTIMEINC TBCTIMEINC", float, _OPEN(3)), _line("BCSTATIM TBCSTATIM", float, _OPEN(3)),
    _line("RBCTIMEINC SBCTIMEINC TBCTIMEINC", float, _OPEN(4)), _line("BCSTATIM SBCSTATIM TBCSTATIM", float, _OPEN(4)),
    _line("TTBCTIMEINC TTBCSTATIM", float, _HEATED),
    _line("SPONGEDIST", float, _DENSE), _line("EQNSTATE", float, _DENSE),
    _line("NLSD NVSD", float, lambda p: _DEEP(p) and p["IDEN"] > 0), _line("NLTD NVTD", float, lambda p: _DEEP(p) and p["IDEN"] > 0), _line("ALP4", float, lambda p: _DEEP(p) and p["IDEN"] > 0),
)


def read_parameters(spark: SparkSession, path: str, boundary_nodes: int = 0, flux_nodes: int = 0) -> Parameters:
    """Parameters of a fort.15 file; those of absent lines are missing from the result, and all behind ANGINN if the file ends there.

    Repeated parts: TIDES {tag: (TPK, AMIGT, ETRF, FFT, FACET)}, BOUNDARY {tag: (AMIG, FF, FACE)}, FORCING {tag: [(EMO, EFA)] * boundary_nodes}, FLUXES and
    FLUX_FORCING likewise, stations as their lines' texts. A density switch that differs between its two places raises ValueError.
    """
    from .lines import numbered_lines

    rows = [r["value"] for r in numbered_lines(spark, path).orderBy("line").collect()]  # a few hundred lines
    at = 0

    def take() -> str:
        nonlocal at
        if at >= len(rows):
            raise ValueError(f"{path} ends after {len(rows)} lines")
        at += 1
        return rows[at - 1]

    out: Parameters = {"NETA": boundary_nodes, "NFLUX": flux_nodes}
    for part in (LINES, MORE_LINES):
        if part is LINES or any(x.strip() for x in rows[at:]):
            for x in part:
                known = out.get("IDEN") if "IDEN" in getattr(x, "names", ()) else None
                if x.when(out):
                    x.read(out, take)
                    if known is not None and out["IDEN"] != known:
                        raise ValueError(f"density switch {known} above and {out['IDEN']} below")
    return {k: v for k, v in out.items() if k not in ("NETA", "NFLUX")}


def parameter_lines(p: Parameters) -> list[str]:
    """The text of :func:`read_parameters`'s result: the second part is written if the solver's line (ITITER ...) is known."""
    sizes = {n: max((len(x) for x in p.get(name, {}).values()), default=0) for n, name in (("NETA", "FORCING"), ("NFLUX", "FLUX_FORCING"))}
    full = sizes | p | {x.name: p.get(x.name, {} if x.tagged else []) for x in LINES + MORE_LINES if isinstance(x, Many)}
    return [line for x in (*LINES, *(MORE_LINES if "ITITER" in p else ())) if x.when(full) for line in x.write(full)]


def update_parameters(spark: SparkSession, path: str, out: str, boundary_nodes: int = 0, flux_nodes: int = 0, **changes) -> Parameters:
    """A file's parameters with some changed, written to ``out``; unknown names raise KeyError."""
    p = read_parameters(spark, path, boundary_nodes, flux_nodes)
    names = {n for x in LINES + MORE_LINES for n in (x.names if isinstance(x, Line) else (x.name,))}
    if unknown := sorted(set(changes) - names):
        raise KeyError(f"no such parameter: {', '.join(unknown)}")
    p |= changes
    write_parameters(spark, p, out)
    return p


def write_parameters(spark: SparkSession, p: Parameters, path: str) -> None:
    spark.createDataFrame(list(enumerate(parameter_lines(p))), "n long, value string").coalesce(1).sortWithinPartitions("n").select("value").write.text(path)


def read_namelist(spark: SparkSession, path: str) -> DataFrame:
    """Rows (section, name, value) of a namelist file; values are text as written."""
    from .lines import numbered_lines

    section, out = "", []
    for r in numbered_lines(spark, path).orderBy("line").collect():  # a few hundred lines
        text = r["value"].split("!")[0].strip().rstrip(",")
        if m := re.match(r"&(\w+)", text):
            section = m[1].lower()
        for name, value in re.findall(r"(\w[\w%()]*)\s*=\s*([^=]+?)(?=,\s*\w+\s*=|$)", text):
            out.append((section, name.lower(), value.strip()))
    return spark.createDataFrame(out, "section string, name string, value string")


def with_defaults(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Missing columns added with a default value, nulls in the others filled with it."""
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(v)) if n in df.columns else F.lit(v) for n, v in defaults.items()})
