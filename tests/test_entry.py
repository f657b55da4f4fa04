import importlib
import sys

import pytest

SF = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    import __spark_entry__ as e

    row = e.entry(spark).first()
    assert (row.surface_area, row.volume) == (20160, 4897)


def test_entry_without_llm(monkeypatch):
    """The entry imports and registers the engine's own queries when the corpus modules are gone."""
    for name in [m for m in sys.modules if m.startswith(("voxmill.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "voxmill.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    e = importlib.import_module("__spark_entry__")
    assert "pipeline" not in e.queries() and "dedup" in e.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


QUICK = ["union", "intersection", "isin", "index_of", "dilate6", "erode6", "mask26", "contact_fixes", "surface_area", "downsample_sum", "correlate_dense", "maximum", "squared_distance", "edges26", "greedy_rectangles", "surface_net_vertices", "unpack", "sparse_voxels", "sparse_closing", "distance_transform", "components26", "culled_triangles", "greedy_triangles", "surface_net_triangles", "voxelize_surface", "voxelize_winding"]


@pytest.mark.parametrize("name", QUICK)
def test_queries_give_their_sql(spark, name):
    import duckdb

    from voxmill.plans import registry

    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    number = lambda v: round(float(v), 6) if type(v).__name__ in ("float", "Decimal") else v
    assert sorted(tuple(map(number, r)) for r in df.collect()) == sorted(tuple(number(r[i]) for i in at) for r in rel.fetchall())
