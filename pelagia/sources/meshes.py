"""Mesh files: fort.14 grids and Triangle .node/.ele pairs, as tables with indices from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from .lines import fields, followed, numbered_lines

# Boundary types whose normal flux is specified.
FLUX_TYPES = (2, 12, 22, 52)


def read_grid(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A fort.14 file: nodes (node, x, y, depth), elements (elem, n1, n2, n3), boundaries (kind, segment, seq, node, type).

    The two size lines go to the driver; nodes and elements are cut out by line number and placed by their own numbers.
    Raises ValueError if an element isn't a triangle or a boundary's total is wrong.
    """
    lines = numbered_lines(spark, path).select("line", fields().alias("f"))
    head = lines.where("line = 1").first()
    if head is None:
        raise ValueError(f"{path} has no size line")
    n_elem, n_node = int(head["f"][0]), int(head["f"][1])
    get = lambda k, kind: F.get("f", F.lit(k)).cast(kind)
    nodes = lines.where(F.col("line").between(2, n_node + 1))
    nodes = nodes.select((get(0, "int") - 1).alias("node"), get(1, "double").alias("x"), get(2, "double").alias("y"), get(3, "double").alias("depth"))
    elements = lines.where(F.col("line").between(n_node + 2, n_node + 1 + n_elem))
    triangle = F.when(get(1, "int") == 3, get(0, "int") - 1).otherwise(F.raise_error(F.lit("only triangles are read")))
    elements = elements.select(triangle.cast("int").alias("elem"), *[(get(k + 1, "int") - 1).alias(f"n{k}") for k in (1, 2, 3)])
    rest = lines.where(F.col("line") > n_node + 1 + n_elem)
    return {"nodes": nodes, "elements": elements, "boundaries": _boundaries(rest)}


def _boundaries(rest: DataFrame) -> DataFrame:
    """Boundary segments are blocks of lines whose lengths stand in their first lines: each line is read as if it were one, and those that are follow from the first."""
    spark = rest.sparkSession
    number = lambda k: F.get("f", F.lit(k)).try_cast("long")
    lines = staged(rest.select("line", number(0).alias("n"), number(1).alias("code")), "outline")
    at = lines.agg(F.min("line")).first()[0]
    nexts = lines.where("n is not null").select(F.col("line").alias("at"), (F.col("line") + 1 + F.col("n")).alias("next"))
    empty = spark.createDataFrame([], "kind string, segment int, seq int, node int, type int")
    out = empty
    for kind in ("elevation", "flow"):
        heads = {r["line"]: r["n"] for r in lines.where(F.col("line").isin([at, (at or 0) + 1])).collect()} if at is not None else {}
        if at not in heads:
            break
        n_segments, total = heads[at], heads[at + 1]
        ranks = staged(followed(nexts, at + 2, n_segments + 1), "segments")
        head = ranks.where(F.col("rank") < n_segments).join(lines.withColumnRenamed("line", "at"), "at")
        seen = head.agg(F.sum("n")).first()[0] or 0
        if seen != total:
            raise ValueError(f"{kind} boundaries have {seen} nodes, not {total}")
        code = F.coalesce("code", F.lit(0)) if kind == "flow" else F.lit(0)
        inside = head.where("n > 0").select(F.col("rank").alias("segment"), code.alias("type"), "at", F.explode(F.sequence(F.col("at") + 1, F.col("at") + F.col("n"))).alias("line"))
        rows = inside.join(lines.select("line", F.col("n").alias("node")), "line")
        out = out.union(rows.select(F.lit(kind), F.col("segment").cast("int"), (F.col("line") - F.col("at") - 1).cast("int"), (F.col("node") - 1).cast("int"), F.col("type").cast("int")))
        end = ranks.where(F.col("rank") == n_segments).first()
        if end is None:
            raise ValueError(f"{kind} boundaries end early")
        at = end["at"]
    return out


def boundary_totals(boundaries: DataFrame) -> DataFrame:
    """One row: numbers of elevation nodes, flow nodes, and flow nodes of specified flux."""
    kind, flux = F.col("kind"), F.col("type").isin(*FLUX_TYPES)
    return boundaries.agg(F.count_if(kind == "elevation").alias("neta"), F.count_if(kind == "flow").alias("nvel"), F.count_if((kind == "flow") & flux).alias("nflux"))


def read_triangle(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Triangle's ``base.node`` (node, x, y, vmark) and ``base.ele`` (elem, n1, n2, n3); numbering may start at 0 or 1."""

    def rows(path: str) -> DataFrame:
        lines = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"#.*$", "")), r"\s+").alias("f")).where("f[0] <> ''")
        return lines

    node_lines = numbered_lines(spark, f"{base}.node").select("line", F.split(F.trim(F.regexp_replace("value", r"#.*$", "")), r"\s+").alias("f")).where("f[0] <> ''")
    start = int(node_lines.orderBy("line").limit(2).collect()[-1]["f"][0])
    first = node_lines.agg(F.min("line")).first()[0]
    get = lambda k, kind: F.get("f", F.lit(k)).cast(kind)
    nodes = node_lines.where(F.col("line") > first).select((get(0, "int") - start).alias("node"), get(1, "double").alias("x"), get(2, "double").alias("y"), F.element_at("f", -1).cast("int").alias("vmark"))
    # an element line has more words than the file's size line
    elements = rows(f"{base}.ele").where(F.size("f") >= 4).select((get(0, "int") - start).alias("elem"), *[(get(k, "int") - start).alias(f"n{k}") for k in (1, 2, 3)])
    return nodes, elements


def write_text(lines: DataFrame, path: str) -> None:
    """Writes rows (part, n, value) as text in that order: part files are ranges, so that their names' order is the text's."""
    lines.orderBy("part", "n").select("value").write.text(path)


def write_grid(nodes: DataFrame, elements: DataFrame, boundaries: DataFrame, path: str, title: str = "grid") -> None:
    """A fort.14 text of the tables of :func:`read_grid`, numbers from 1. Part files are in order."""
    spark = nodes.sparkSession
    n_nodes, n_elements = nodes.count(), elements.count()
    line = lambda df, part, n, value: df.select(F.lit(part).alias("part"), n.cast("double").alias("n"), value.alias("value"))
    one = lambda part, n, text: spark.range(1).select(F.lit(part).alias("part"), F.lit(float(n)).alias("n"), F.lit(text).alias("value"))
    out = one(0, 0, title).union(one(0, 1, f"{n_elements} {n_nodes}"))
    text = lambda *cols: F.concat_ws(" ", *[c.cast("string") for c in cols])
    out = out.union(line(nodes, 1, F.col("node"), text(F.col("node") + 1, F.col("x"), F.col("y"), F.col("depth"))))
    out = out.union(line(elements, 2, F.col("elem"), text(F.col("elem") + 1, F.lit(3), *[F.col(c) + 1 for c in ("n1", "n2", "n3")])))
    for part, kind in ((3, "elevation"), (4, "flow")):
        b = boundaries.where(F.col("kind") == kind)
        sizes = b.groupBy("segment", "type").agg(F.count("*").alias("size"))
        total = sizes.agg(F.count("*").alias("segments"), F.coalesce(F.sum("size"), F.lit(0)).alias("nodes"))
        # lines of a segment: its size line, then its nodes; segment * 1e9 keeps them in order
        at = lambda k: F.col("segment").cast("double") * 1e9 + k
        heads = line(total, part, F.lit(-2.0), text(F.col("segments"))).union(line(total, part, F.lit(-1.0), text(F.col("nodes"))))
        out = out.union(heads).union(line(sizes, part, at(0), text(F.col("size"), *([F.col("type")] if kind == "flow" else []))))
        out = out.union(line(b, part, at(1 + F.col("seq")), text(F.col("node") + 1)))
    write_text(out, path)


def write_density(nodes: DataFrame, levels: list[float], value: float, path: str, title: str = "density") -> None:
    """A fort.11 text: one value at all nodes and levels."""
    spark = nodes.sparkSession
    one = lambda n, text: spark.range(1).select(F.lit(0).alias("part"), F.lit(float(n)).alias("n"), F.lit(text).alias("value"))
    size = nodes.agg(F.concat_ws(" ", F.lit(str(len(levels))), F.count("*").cast("string")).alias("value")).select(F.lit(0).alias("part"), F.lit(2.0).alias("n"), "value")
    body = nodes.select("node", F.posexplode(F.array(*[F.lit(float(z)) for z in levels])).alias("k", "z"))
    body = body.select(F.lit(1).alias("part"), (F.col("node") * float(len(levels)) + F.col("k")).alias("n"), F.concat_ws(" ", (F.col("node") + 1).cast("string"), (F.col("k") + 1).cast("string"), F.lit(str(float(value)))).alias("value"))
    write_text(one(0, title).union(one(1, "")).union(size).union(body), path)
