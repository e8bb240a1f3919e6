"""Schemas of the tables that ocean and atmosphere codes exchange: names, indices and units, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import units

# Per model and table the index columns, and the attributes with their units.
TABLES = {
    "adcirc": {
        "nodes": ("node", "x:m y:m lon:deg lat:deg depth:m eta:m vx:m/s vy:m/s deta_dt:m/s status:text"),
        "grid3d": ("node level", "sigma:1 z:m wx:m/s wy:m/s wz:m/s temperature:Celsius"),
        "forcings": ("node", "coriolis_f:1/s tau_x:Pa tau_y:Pa wave_tau_x:Pa wave_tau_y:Pa pressure:Pa tidal_potential:m surface_heat_flux:1"),
        "elements": ("elem", "n1:index n2:index n3:index x:m y:m lon:deg lat:deg status:text"),
        "boundaries": ("segment seq", "kind:text node:index type:index eta:m flux:m**2/s"),
    },
    "remapper": {"links": ("src dst", "w1:1 w2:1 w3:1"), "cells": ("cell", "lon:rad lat:rad corners:corners value:1")},
    "dales": {
        "fields": ("i j k", "U:m/s V:m/s W:m/s THL:K QT:kg/kg QL:kg/kg QL_ice:kg/kg QR:kg/kg E12:m/s T:K pi:m**2/s**2 rswd:1 rswu:1 rlwd:1 rlwu:1"),
        "profiles": ("k", "U:m/s V:m/s W:m/s THL:K QT:kg/kg QL:kg/kg QL_ice:kg/kg QR:kg/kg E12:m/s T:K P:Pa rho:kg/m**3 A:1"),
        "surface_fields": ("i j", "LWP:kg/m**2 RWP:kg/m**2 TWP:kg/m**2 ustar:m/s z0m:m z0h:m tskin:K qskin:kg/kg LE:1 H:1 obl:m"),
    },
    "iemic": {
        "v_grid": ("i j k", "lon:rad lat:rad z:m u:1 v:1 w:1 u_forcing:1 v_forcing:1 mask:1"),
        "t_grid": ("i j k", "lon:rad lat:rad z:m temperature:1 salinity:1 pressure:1 temperature_forcing:1 salinity_forcing:1 mask:1"),
        "surface_v_grid": ("i j", "tau_x:1 tau_y:1"), "surface_t_grid": ("i j", "tatm:1 emip:1"),
    },
    "openifs": {
        "grid": ("column", "lat:deg lon:deg"),
        "levels": ("column level", "Pfull:Pa U:m/s V:m/s T:K QL:kg/kg QI:kg/kg SH:kg/kg A:1 O3:kg/kg"),
        "half_levels": ("column level", "Phalf:Pa"),
        "forcings": ("column level", "tendency_U:m/s**2 tendency_V:m/s**2 tendency_T:1 tendency_SH:1 tendency_QL:1 tendency_QI:1 tendency_A:1 tendency_O3:1"),
    },
    "pop": {
        "nodes": ("i j", "lat:deg lon:deg uvel_barotropic:cm/s vvel_barotropic:cm/s gradx:cm/s grady:cm/s depth:cm"),
        "nodes3d": ("i j k", "lat:deg lon:deg z:cm xvel:cm/s yvel:cm/s zvel:cm/s"), "forcings": ("i j", "tau_x:dyne/cm**2 tau_y:dyne/cm**2 coriolis_f:1/s"),
        "elements": ("i j", "lat:deg lon:deg ssh:cm depth:cm"), "elements3d": ("i j k", "lat:deg lon:deg z:cm temperature:Celsius salinity:psu rho:1"),
        "element_forcings": ("i j", "restoring_temperature:Celsius restoring_salinity:psu"),
    },
    "qgcm": {
        "ocean_p_grid": ("i j k", "x:m y:m pressure:m**2/s**2 dpressure_dt:1 vorticity:1/s"),
        "ocean_t_grid": ("i j", "x:m y:m surface_temperature_anomaly:K surface_heat_flux:1"), "forcings": ("i j", "tau_x:m**2/s**2 tau_y:m**2/s**2"),
        "atmosphere_t_grid": ("i j", "x:m y:m surface_temperature_anomaly:K mixed_layer_depth:m"),
    },
    "qgmodel": {
        "grid": ("i j k", "x:m y:m psi:m**2/s psi_prev:m**2/s dpsi_dt:m**2/s**2"), "wind_field": ("i j", "x:m y:m tau_x:1"),
        "boundary": ("side i j k", "psi:m**2/s dpsi_dt:m**2/s**2"),
    },
    "swan": {
        "nodes": ("node", "x:m y:m lon:deg lat:deg depth:m wave_tau_x:Pa wave_tau_y:Pa vmark:index"),
        "spectra": ("node direction frequency", "ac2:1"), "elements": ("elem", "n1:index n2:index n3:index"),
        "forcings": ("node", "depth:m water_level:m vx:m/s vy:m/s wind_vx:m/s wind_vy:m/s visc:m**2/s"),
    },
    "reanalysis": {"grid": ("ts lat lon", "u10:m/s v10:m/s t2m:K msl:Pa sst:K swh:m")},
}

_KINDS = {"text": T.StringType(), "index": T.IntegerType(), "corners": T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))}
_INDEX_KINDS = {"ts": T.TimestampNTZType(), "lat": T.DoubleType(), "lon": T.DoubleType(), "side": T.StringType()}


def table_names(model: str) -> list[str]:
    return list(TABLES[model])


def schema(model: str, table: str) -> T.StructType:
    """Fields with units in their metadata; index columns can't be null."""
    index, attributes = TABLES[model][table]
    out = T.StructType()
    for name in index.split():
        out = out.add(name, _INDEX_KINDS.get(name, T.IntegerType()), False)
    for text in attributes.split():
        name, _, unit = text.partition(":")
        if unit in _KINDS:
            out = out.add(name, _KINDS[unit])
        else:
            out = out.add(name, T.DoubleType(), True, {"unit": str(units.named(unit))})
    return out


def read_table(spark: SparkSession, path: str, model: str, table: str) -> DataFrame:
    """A stored table with the schema's types and units."""
    wanted = schema(model, table)
    df = spark.read.schema(wanted).parquet(path)
    return df.select(*[df[f.name].alias(f.name, metadata=f.metadata) for f in wanted])


def get(df: DataFrame, names: list[str], **where) -> DataFrame:
    """A getter: attributes at an index point, range or list (see ``operators.projections.block``)."""
    from .operators.projections import block

    out = block(df, where)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no such attribute: {', '.join(missing)}")
    return out.select(*[c for c in where if c in df.columns and c not in names], *names)


def put(df: DataFrame, changes: DataFrame, index: list[str]) -> DataFrame:
    """A setter: attributes written by index. Indices that the table lacks change nothing; :func:`outside` gives them."""
    from .operators.channels import copy

    return copy(changes, df, index, [c for c in changes.columns if c not in index])


def outside(df: DataFrame, changes: DataFrame, index: list[str]) -> DataFrame:
    """Rows of ``changes`` whose index the table lacks."""
    return changes.join(df.select(*index), index, "left_anti")
