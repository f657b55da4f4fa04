"""Voxel clouds derived from the star-schema tables, and small shapes; each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (table, x, y, z, value); integer expressions that Spark and DuckDB evaluate alike. c40 is dense, c97 is sparse.
CLOUDS = {
    "c40": ("lineitem", "l_partkey % 40 - 20", "l_suppkey % 40 - 20", "CAST(l_quantity AS BIGINT) % 40 - 20", "CAST(round(l_extendedprice * 100) AS BIGINT)"),
    "o40": ("orders", "o_custkey % 40 - 20", "o_orderkey % 40 - 20", "CAST(floor(o_totalprice) AS BIGINT) % 40 - 20", "CAST(round(o_totalprice * 100) AS BIGINT)"),
    "c97": ("lineitem", "l_partkey % 97 - 48", "l_suppkey % 89 - 44", "CAST(l_quantity AS BIGINT)", "CAST(round(l_extendedprice * 100) AS BIGINT)"),
}
ROW_ID = {"lineitem": "l_orderkey * 8 + l_linenumber", "orders": "o_orderkey"}


def sql(name: str) -> str:
    table, x, y, z, value = CLOUDS[name]
    return f"SELECT CAST({x} AS BIGINT) AS x, CAST({y} AS BIGINT) AS y, CAST({z} AS BIGINT) AS z, {value} AS value, CAST({ROW_ID[table]} AS BIGINT) AS row_id FROM {table}"


def cloud(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """x, y, z, value, row_id: one row for each row of the table."""
    table, x, y, z, value = CLOUDS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cols = {"x": x, "y": y, "z": z, "value": value, "row_id": ROW_ID[table]}
    return df.selectExpr(*(f"CAST({e} AS BIGINT) AS {n}" for n, e in cols.items()))


def solid_cube(spark: SparkSession, k: int) -> DataFrame:
    return spark.range(k**3).selectExpr(f"id div {k * k} AS x", f"id div {k} % {k} AS y", f"id % {k} AS z")


def hollow_box(spark: SparkSession, outer: int = 7, void: int = 3) -> DataFrame:
    lo = (outer - void) // 2
    return solid_cube(spark, outer).where(f"NOT (x BETWEEN {lo} AND {lo + void - 1} AND y BETWEEN {lo} AND {lo + void - 1} AND z BETWEEN {lo} AND {lo + void - 1})")


def solid_cylinder(spark: SparkSession, r: int = 4, length: int = 20) -> DataFrame:
    n = 2 * r + 1
    return spark.range(n * n * length).selectExpr(f"id div {n * length} AS x", f"id div {length} % {n} AS y", f"id % {length} AS z").where(f"(x - {r}) * (x - {r}) + (y - {r}) * (y - {r}) <= {r * r}")


def box_mesh(spark: SparkSession, lo: float, hi: float) -> tuple[DataFrame, DataFrame]:
    """An aligned box of 12 triangles with outward normals."""
    corners = [(i, *((hi if i >> k & 1 else lo) for k in range(3))) for i in range(8)]
    quads = [(0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6)]
    tris = [t for q in quads for t in ((q[0], q[1], q[2]), (q[0], q[2], q[3]))]
    return spark.createDataFrame(corners, "vid long, x double, y double, z double"), spark.createDataFrame([(i, *t) for i, t in enumerate(tris)], "fid long, a long, b long, c long")
