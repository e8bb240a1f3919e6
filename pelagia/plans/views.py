"""Grids, links, meshes and tracks over the star-schema tables, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Views of the oracle: name -> SQL. The functions below are the same as DataFrames.
SQL_VIEWS = {
    "nodes": "SELECT c_custkey AS id, CAST((c_custkey * 37) % 360 - 180 AS DOUBLE) AS lon, CAST((c_custkey * 17) % 161 - 80 AS DOUBLE) AS lat, c_acctbal AS v FROM customer",
    "stations": "SELECT s_suppkey AS id, CAST((s_suppkey * 37) % 360 - 180 AS DOUBLE) AS lon, CAST((s_suppkey * 17) % 161 - 80 AS DOUBLE) AS lat, s_acctbal AS v FROM supplier",
    "links": "SELECT l_partkey AS src, l_suppkey AS dst, l_quantity / 50 AS w1, l_discount AS w2, l_tax AS w3 FROM lineitem",
    "cells": "SELECT CAST(l_partkey % 20 AS INT) AS i, CAST(l_suppkey % 10 AS INT) AS j, l_linenumber AS k, l_quantity AS q, l_extendedprice AS price FROM lineitem",
    "field": "SELECT CAST(l_partkey % 40 AS INT) AS i, CAST(l_suppkey % 25 AS INT) AS j, sum(l_quantity) / count(*) AS v FROM lineitem GROUP BY ALL",
    "events_by_user": "SELECT user_id AS track, ts, event_id, event_type, value FROM events",
    "elements": """SELECT e AS elem, sw AS n1, CASE WHEN e % 2 = 0 THEN sw + 1 ELSE sw + 102 END AS n2, CASE WHEN e % 2 = 0 THEN sw + 102 ELSE sw + 101 END AS n3, v, area
        FROM (SELECT o_orderkey AS e, (o_orderkey // 200) * 101 + (o_orderkey // 2) % 100 AS sw, o_totalprice AS v, CAST(1 + o_orderkey % 5 AS DOUBLE) AS area FROM orders)""",
    "mesh_nodes": "SELECT node, CAST(node % 101 AS DOUBLE) AS x, CAST(node // 101 AS DOUBLE) AS y, CAST((node * 7) % 1000 AS DOUBLE) AS v FROM (SELECT DISTINCT unnest([n1, n2, n3]) AS node FROM elements)",
    "eddies": """SELECT CAST(p_partkey % 5 AS INT) AS snapshot, CAST(CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END AS INT) AS sign, p_partkey AS eddy,
        CAST((p_partkey * 37) % 600 AS DOUBLE) / 10 - 30 AS lon, CAST((p_partkey * 17) % 400 AS DOUBLE) / 10 + 10 AS lat, CAST(p_size AS DOUBLE) AS amplitude, 30000 + 500.0 * p_size AS radius_e FROM part""",
    "sea": "SELECT CAST(p_partkey AS BIGINT) AS id, 30 + p_size / 10.0 AS s, CAST(p_partkey % 30 AS DOUBLE) AS t, CAST((p_partkey % 10) * 500 AS DOUBLE) AS p FROM part",
}


def with_views(sql: str, *names: str) -> str:
    """SQL with the views it names in front; views that these need come first."""
    return "WITH " + ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names) + "\n" + sql


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the oracle's SQL over ``views``."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            if not views:
                ORACLE_SQL[f.__name__] = sql
            elif sql.lstrip().upper().startswith("WITH "):
                ORACLE_SQL[f.__name__] = with_views("", *views).rstrip() + ", " + sql.lstrip()[5:]
            else:
                ORACLE_SQL[f.__name__] = with_views(sql, *views)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _points(df: DataFrame, key: str, value: str) -> DataFrame:
    k = F.col(key)
    return df.select(k.alias("id"), ((k * 37) % 360 - 180).cast("double").alias("lon"), ((k * 17) % 161 - 80).cast("double").alias("lat"), F.col(value).alias("v"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_quantity") / 50).alias("w1"), F.col("l_discount").alias("w2"), F.col("l_tax").alias("w3"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j = (F.col("l_partkey") % 20).cast("int"), (F.col("l_suppkey") % 10).cast("int")
    return table(spark, sf_dir, "lineitem").select(i.alias("i"), j.alias("j"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"))


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j = (F.col("l_partkey") % 40).cast("int"), (F.col("l_suppkey") % 25).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(i.alias("i"), j.alias("j")).agg((F.sum("l_quantity") / F.count("*")).alias("v"))


def user_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), "ts", "event_id", "event_type", "value")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("o_orderkey")
    sw = F.floor(e / 200) * 101 + F.floor(e / 2) % 100
    even = e % 2 == 0
    return table(spark, sf_dir, "orders").select(
        e.alias("elem"), sw.alias("n1"), F.when(even, sw + 1).otherwise(sw + 102).alias("n2"), F.when(even, sw + 102).otherwise(sw + 101).alias("n3"),
        F.col("o_totalprice").alias("v"), (1 + e % 5).cast("double").alias("area"),
    )


def mesh_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("node")
    found = elements(spark, sf_dir).select(F.explode(F.array("n1", "n2", "n3")).alias("node")).distinct()
    return found.select("node", (n % 101).cast("double").alias("x"), F.floor(n / 101).cast("double").alias("y"), ((n * 7) % 1000).cast("double").alias("v"))


def eddies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (k % 5).cast("int").alias("snapshot"), F.when(k % 3 == 0, -1).otherwise(1).alias("sign"), k.alias("eddy"), (((k * 37) % 600) / 10 - 30).alias("lon"),
        (((k * 17) % 400) / 10 + 10).alias("lat"), F.col("p_size").cast("double").alias("amplitude"), (30000 + 500.0 * F.col("p_size")).alias("radius_e"),
    )


def sea(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), (30 + F.col("p_size") / 10.0).alias("s"), (k % 30).cast("double").alias("t"), ((k % 10) * 500).cast("double").alias("p"))


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})
