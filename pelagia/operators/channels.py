"""Copies between tables by index: attribute channels, transforms and upserts as equi-joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def copy(source: DataFrame, target: DataFrame, index: Sequence[str], names: Sequence[str], source_names: Sequence[str] | None = None) -> DataFrame:
    """``target`` with attributes of ``source`` where it has the index (one row an index); the others keep theirs.

    A null in ``source`` overwrites; new attributes are null in cells that ``source`` lacks.
    """
    taken = [F.col(s).alias(f"__{n}") for s, n in zip(source_names or names, names, strict=True)]
    joined = target.join(source.select(*index, F.lit(True).alias("__there"), *taken), list(index), "left")
    have = set(target.columns)
    old = lambda n: F.col(n) if n in have else F.lit(None)
    made = {n: F.when(F.col("__there"), F.col(f"__{n}")).otherwise(old(n)) for n in names}
    out = joined.withColumns(made).drop("__there", *[f"__{n}" for n in names])
    for s, n in zip(source_names or names, names, strict=True):
        if source.schema[s].metadata:
            out = out.withMetadata(n, source.schema[s].metadata)
    return out


def transform(source: DataFrame, target: DataFrame, index: Sequence[str], targets: Sequence[str], function: Callable[..., Sequence[Column]], sources: Sequence[str]) -> DataFrame:
    """``target`` with columns that ``function`` makes from columns of ``source``; it returns one Column per target."""
    made = function(*[F.col(x) for x in sources])
    if len(made) != len(targets):
        raise ValueError("the function gives another number of columns than there are targets")
    return copy(source.select(*index, *[c.alias(t) for c, t in zip(made, targets, strict=True)]), target, index, targets)


def upsert(target: DataFrame, changes: DataFrame, index: Sequence[str]) -> DataFrame:
    """Rows of ``target`` changed by ``changes`` and rows that only ``changes`` has; null changes leave a value as it is."""
    names = [c for c in target.columns if c not in index]
    new = changes.select(*index, *[F.col(c).alias(f"__{c}") for c in names if c in changes.columns])
    joined = target.join(new, list(index), "full")
    return joined.select(*index, *[F.coalesce(f"__{c}", c).alias(c) if c in changes.columns else F.col(c) for c in names])


def at_levels(df: DataFrame, levels: Sequence[float], name: str = "level") -> DataFrame:
    """Each row once for each of a fixed list of levels (an array that is exploded, no join)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(x) for x in levels])))


Interpolator = Callable[[str, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def on_levels(profiles: DataFrame, levels: Sequence[float], names: Sequence[str], key: str = "column", height: str = "height", interpolator: Interpolator | None = None) -> DataFrame:
    """Rows (key, height, names) of profiles (key, height, names) at new heights, which must rise.

    They are linear between the known heights and held beyond them. Another rule is given as ``interpolator(name, new heights, heights, values)``, which sees one profile at a time.
    """
    if any(b <= a for a, b in zip(levels, levels[1:], strict=False)):
        raise ValueError("heights must rise")
    wanted = F.explode(F.array(*[F.lit(float(z)) for z in levels]))
    if interpolator is None:
        from .tracks import interpolate

        return interpolate(profiles, profiles.select(key).distinct().withColumn(height, wanted), names, key, height)

    def each(df: pd.DataFrame) -> pd.DataFrame:
        df = df.dropna(subset=[height]).sort_values(height)
        new = np.array(levels, float)
        return pd.DataFrame({key: df[key].iloc[0] if len(df) else None, height: new, **{n: interpolator(n, new, df[height].to_numpy(), df[n].to_numpy(float)) for n in names}})

    kind = profiles.schema[key].dataType.simpleString()
    return profiles.select(key, height, *names).groupBy(key).applyInPandas(each, f"`{key}` {kind}, `{height}` double, " + ", ".join(f"`{n}` double" for n in names))


def update_sides(boundary: DataFrame, kinds: dict[str, str], updaters: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``boundary`` (side, ...) with the rows of sides of kind ``interface`` made anew by their updater; sides without one raise KeyError."""
    wanted = [side for side, kind in kinds.items() if kind == "interface"]
    if missing := [side for side in wanted if side not in updaters]:
        raise KeyError(f"no update of the boundaries: {', '.join(missing)}")
    out = boundary.where(~F.col("side").isin(wanted) | F.col("side").isNull()) if wanted else boundary
    for side in wanted:
        out = out.unionByName(updaters[side](boundary.where(F.col("side") == side)).select(*boundary.columns))
    return out
