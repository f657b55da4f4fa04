"""Named queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators import distance, filters, graph, measure, mesh, morph, pool, sets, skeleton, sparse, stencil, voxelize
from voxmill.operators.frame import pack, unpack, voxels
from voxmill.sources.clouds import cloud, sql

FACES = stencil.FACES
OFFSETS = {c: stencil.neighbor_offsets(c) for c in (6, 18, 26)}
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface area and volume of the c40 cloud."""
    own = cloud(spark, sf_dir, "c40")
    return measure.surface_area(own).crossJoin(measure.volume(own))  # one row each


def add(name: str, query, oracle: str | None = None) -> None:
    _QUERIES[name] = query
    if oracle:
        _SQL[name] = oracle


def on(name: str, op, *more: str):
    """The operator on clouds."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(*(cloud(spark, sf_dir, n) for n in (name, *more)))

    return query


def values(offsets, weights=None) -> str:
    """A FROM item o(dx, dy, dz, k, w)."""
    rows = ", ".join(f"({a}, {b}, {c}, {k}, {weights[k] if weights is not None else 1})" for k, (a, b, c) in enumerate(offsets))
    return f"(VALUES {rows}) o(dx, dy, dz, k, w)"


def distinct(name: str) -> str:
    return f"SELECT DISTINCT x, y, z FROM ({sql(name)})"


def dilated(source: str, c: int) -> str:
    return f"SELECT DISTINCT x + dx AS x, y + dy AS y, z + dz AS z FROM ({source}), {values([*OFFSETS[c], (0, 0, 0)])}"


def eroded(source: str, c: int) -> str:
    n = c + 1
    return f"SELECT x, y, z FROM (SELECT x + dx AS x, y + dy AS y, z + dz AS z FROM ({source}), {values([*OFFSETS[c], (0, 0, 0)])}) GROUP BY ALL HAVING count(*) = {n}"


FACES_SQL = f"""WITH v AS ({{v}}), f AS (SELECT x, y, z, k // 2 AS axis, CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END AS side FROM v, {values(FACES)}
WHERE NOT EXISTS (SELECT 1 FROM v AS n WHERE n.x = v.x + dx AND n.y = v.y + dy AND n.z = v.z + dz))"""
C40_FACES = FACES_SQL.format(v=distinct("c40"))


def _register() -> None:
    A, B = distinct("c40"), distinct("o40")
    add("flagship", flagship, f"{C40_FACES} SELECT CAST(count(*) AS DOUBLE) AS surface_area, (SELECT CAST(count(*) AS DOUBLE) FROM v) AS volume FROM f")
    # sets
    add("dedup", on("c40", voxels), A)
    add("first_appearance", on("c40", partial(sets.unique_rows, first=True)), f"SELECT x, y, z, min(row_id) AS row_id FROM ({sql('c40')}) GROUP BY x, y, z")
    for name, op, word in (("union", sets.union, "UNION"), ("intersection", sets.intersection, "INTERSECT"), ("difference", sets.difference, "EXCEPT")):
        add(name, on("c40", op, "o40"), f"{A} {word} {B}")
    add("symmetric_difference", on("c40", sets.symmetric_difference, "o40"), f"({A} EXCEPT {B}) UNION ({B} EXCEPT {A})")
    add("majority", on("c40", sets.majority, "o40", "c97"), f"SELECT x, y, z FROM ({A} UNION ALL {B} UNION ALL {distinct('c97')}) GROUP BY ALL HAVING count(*) >= 2")
    add("isin", on("c40", lambda a, b: sets.isin(a.select("row_id", "x", "y", "z"), b), "o40"), f"SELECT row_id, x, y, z, EXISTS (SELECT 1 FROM ({B}) b WHERE b.x = a.x AND b.y = a.y AND b.z = a.z) AS is_in FROM ({sql('c40')}) a")
    add("index_of", on("c40", lambda a, b: sets.index_of(a.select("x", "y", "z"), b), "o40"), f'SELECT a.x, a.y, a.z, coalesce(i, -1) AS "index" FROM ({sql("c40")}) a LEFT JOIN (SELECT x, y, z, min(row_id) AS i FROM ({sql("o40")}) GROUP BY x, y, z) b USING (x, y, z)')
    up = lambda a: voxels(a).selectExpr(*(f"{c} + 1048576 AS {c}" for c in "xyz"))
    packed = f"SELECT x + 1048576 AS x, y + 1048576 AS y, z + 1048576 AS z, ((x + 1048576) << 42) | ((y + 1048576) << 21) | (z + 1048576) AS packed FROM ({A})"
    add("pack", on("c40", lambda a: pack(up(a))), packed)
    add("unpack", on("c40", lambda a: unpack(pack(up(a)).select("packed"))), packed)
    array = lambda a: sparse.SparseArray(a.selectExpr("x + 20 AS x", "y + 20 AS y", "z + 20 AS z", "value % 3 AS value"), (40, 40, 40))
    stored = f"SELECT DISTINCT x + 20 AS x, y + 20 AS y, z + 20 AS z FROM ({sql('c40')}) WHERE value % 3 <> 0"
    add("sparse_voxels", on("c40", lambda a: sparse.to_voxels(array(a)).distinct()), stored)
    closing = sparse.sparse_aware(mirror=True)(morph.closing)
    add("sparse_closing", on("c40", lambda a: closing(array(a)).cells), f"SELECT x, y, z, 1::BIGINT AS value FROM ({eroded(dilated(stored, 6), 6)})")
    # morphology
    for c in (6, 18, 26):
        add(f"dilate{c}", on("c97", partial(morph.dilate, connectivity=c)), dilated(distinct("c97"), c))
        add(f"erode{c}", on("c40", partial(morph.erode, connectivity=c)), eroded(A, c))
    add("dilate_twice", on("o40", partial(morph.dilate, iterations=2)), dilated(dilated(B, 6), 6))
    add("opening", on("c40", morph.opening), dilated(eroded(A, 6), 6))
    add("closing", on("o40", morph.closing), eroded(dilated(B, 6), 6))
    add("boundary_shell", on("c97", stencil.boundary_shell), f"SELECT DISTINCT x + dx AS x, y + dy AS y, z + dz AS z FROM ({distinct('c97')}), {values(FACES)} EXCEPT {distinct('c97')}")
    add("mask26", on("c97", stencil.neighbor_mask), f"WITH v AS ({distinct('c97')}) SELECT v.x, v.y, v.z, CAST(coalesce(bit_or(CASE WHEN n.x IS NOT NULL THEN 1 << k ELSE 0 END), 0) AS INTEGER) AS mask FROM v CROSS JOIN {values(OFFSETS[26])} LEFT JOIN v n ON n.x = v.x + dx AND n.y = v.y + dy AND n.z = v.z + dz GROUP BY ALL")
    add("exposed_faces", on("c40", stencil.exposed_faces), f"{C40_FACES} SELECT x, y, z, CAST(axis AS INTEGER) AS axis, CAST(side AS INTEGER) AS side FROM f")
    add("surface_voxels", on("c40", stencil.surface_voxels), f"{C40_FACES} SELECT DISTINCT x, y, z FROM f")
    add("contact_fixes", on("c97", morph.contact_fixes), _contact_sql())
    add("make_manifold", on("c97", morph.make_manifold), _manifold_sql(8))
    add("make_manifold_whole", on("c97", partial(morph.make_manifold, max_iter=None)))
    # measures
    add("volume", on("c40", partial(measure.volume, spacing=(4, 4, 40))), f"SELECT count(*) * 640.0::DOUBLE AS volume FROM ({A})")
    add("surface_area", on("c40", partial(measure.surface_area, spacing=(4, 4, 40))), f"{C40_FACES} SELECT sum(CASE axis WHEN 0 THEN 160 WHEN 1 THEN 160 ELSE 16 END)::DOUBLE AS surface_area FROM f")
    add("bounding_box", on("c97", measure.bounding_box), f"SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM ({sql('c97')})")
    add("centroid", on("c40", lambda a: measure.centroid(a).select(*(F.round(c, 9).alias(c) for c in ("cx", "cy", "cz")))), f"SELECT round(avg(x), 9) AS cx, round(avg(y), 9) AS cy, round(avg(z), 9) AS cz FROM ({A})")
    both = f"(SELECT count(*) FROM ({A} INTERSECT {B}))"
    add("iou", on("c40", lambda a, b: measure.iou(a, b).select(F.round("iou", 9).alias("iou")), "o40"), f"SELECT round({both} / (SELECT count(*) FROM ({A} UNION {B})), 9) AS iou")
    add("dice", on("c40", lambda a, b: measure.dice(a, b).select(F.round("dice", 9).alias("dice")), "o40"), f"SELECT round(2 * {both} / ((SELECT count(*) FROM ({A})) + (SELECT count(*) FROM ({B}))), 9) AS dice")
    # pooling; c40 has negative coordinates
    fl = lambda k: ", ".join(f"({a} - (({a} % {k}) + {k}) % {k}) // {k} AS {a}" for a in "xyz")
    add("downsample", on("c97", partial(pool.downsample, factor=2)), f"SELECT DISTINCT {fl(2)} FROM ({sql('c97')})")
    for agg, cast in (("max", "{}"), ("min", "{}"), ("sum", "CAST({} AS BIGINT)")):
        add(f"downsample_{agg}", on("c40", partial(pool.downsample, factor=3, values=["value"], agg=agg)), f"SELECT x, y, z, {cast.format(f'{agg}(value)')} AS value FROM (SELECT {fl(3)}, value FROM ({sql('c40')})) GROUP BY x, y, z")
    add("downsample_mean", on("c40", lambda a: pool.downsample(a, 3, ["value"], "mean").withColumn("value", F.round("value", 4))), f"SELECT x, y, z, round(avg(value), 4) AS value FROM (SELECT {fl(3)}, value FROM ({sql('c40')})) GROUP BY x, y, z")
    # filters
    field = f"SELECT x, y, z, CAST(sum(value) AS DOUBLE) AS value FROM ({sql('c97')}) GROUP BY x, y, z HAVING sum(value) <> 0"
    taps = lambda src, axis, w, eps=0: f"SELECT x, y, z, sum(value * w) AS value FROM (SELECT x - dx AS x, y - dy AS y, z - dz AS z, value, w FROM ({src}), {values([tuple(j if a == axis else 0 for a in range(3)) for j in range(-(len(w) // 2), len(w) // 2 + 1)], w)}) GROUP BY x, y, z HAVING abs(sum(value * w)) > {eps}"
    sep = lambda w, eps=0: taps(taps(taps(field, 0, w[0], eps), 1, w[1], eps), 2, w[2], eps)
    add("correlate_separable", on("c97", lambda a: filters.correlate(a, [[1, 2, 0], [1, 2, 1], [3, 1, 1]], ["value"])), sep([[1, 2, 0], [1, 2, 1], [3, 1, 1]]))
    dense = [[[1, 0, 0], [0, 2, 0], [0, 0, 0]], [[0, 1, 0], [1, 4, 1], [0, 1, 0]], [[0, 0, 0], [0, 2, 0], [0, 0, 3]]]
    at = [(i - 1, j - 1, k - 1) for i in range(3) for j in range(3) for k in range(3) if dense[i][j][k]]
    w = [dense[i + 1][j + 1][k + 1] for i, j, k in at]
    add("correlate_dense", on("c97", lambda a: filters.correlate(a, dense, ["value"])), f"SELECT x, y, z, sum(value * w) AS value FROM (SELECT x - dx AS x, y - dy AS y, z - dz AS z, value, w FROM ({field}), {values(at, w)}) GROUP BY x, y, z HAVING sum(value * w) <> 0")
    g = [repr(float(v)) + "::DOUBLE" for v in filters.gaussian_kernel1d(0.5, 2)]
    rounded = lambda df: df.withColumn("value", F.round("value", 2))
    add("smooth", on("c97", lambda a: rounded(filters.smooth(a, ["value"], 0.5))), f"SELECT x, y, z, round(value, 2) AS value FROM ({sep([g, g, g])})")
    add("smooth_epsilon", on("c97", lambda a: rounded(filters.smooth(a, ["value"], 0.5, epsilon=1000.0))), f"SELECT x, y, z, round(value, 2) AS value FROM ({sep([g, g, g], 1000)})")
    for name, low in (("maximum", "greatest"), ("minimum", "least")):
        f = "max" if name == "maximum" else "min"
        rank = lambda src, axis, f=f, low=low: f"SELECT x, y, z, CASE WHEN count(*) < 3 THEN {low}({f}(value), 0) ELSE {f}(value) END AS value FROM (SELECT x - dx AS x, y - dy AS y, z - dz AS z, value FROM ({src}), {values([tuple(j if a == axis else 0 for a in range(3)) for j in (-1, 0, 1)])}) GROUP BY x, y, z HAVING CASE WHEN count(*) < 3 THEN {low}({f}(value), 0) ELSE {f}(value) END <> 0"
        src = field if name == "maximum" else f"SELECT x, y, z, CAST(sum(value) AS DOUBLE) AS value FROM ({sql('c40')}) GROUP BY x, y, z HAVING sum(value) <> 0"
        add(name, on("c97" if name == "maximum" else "c40", lambda a, op=getattr(filters, name): op(a, ["value"])), rank(rank(rank(src, 0), 1), 2))
    # distance: squared, so that it is a whole number
    add("squared_distance", on("c97", lambda a: distance.squared_distance(a, (3, 1, 2)).withColumn("g", F.col("g").cast("long"))), _distance_sql("c97", (3, 1, 2)))
    add("distance_transform", on("c40", lambda a: distance.distance_transform(a.select("x", "y", "z")).withColumn("distance", F.round("distance", 9))), f"SELECT x, y, z, round(sqrt(g), 9) AS distance FROM ({sql('c40')}) r JOIN ({_distance_sql('c40', (1, 1, 1))}) d USING (x, y, z)")
    # graphs
    for c in (6, 18, 26):
        add(f"adjacent{c}", on("c97", lambda a, c=c: graph.adjacent(a, c).selectExpr("a.x AS ax", "a.y AS ay", "a.z AS az", "b.x AS bx", "b.y AS by_", "b.z AS bz")), f"WITH v AS ({distinct('c97')}) SELECT v.x AS ax, v.y AS ay, v.z AS az, n.x AS bx, n.y AS by_, n.z AS bz FROM v CROSS JOIN {values([o for o in OFFSETS[c] if o > (0, 0, 0)])} JOIN v n ON n.x = v.x + dx AND n.y = v.y + dy AND n.z = v.z + dz")
    ids = "SELECT x, y, z, row_number() OVER (ORDER BY x, y, z) - 1 AS id FROM ({})"
    add("edges26", on("c97", lambda a: graph.edges(a)[1]), f"WITH v AS ({ids.format(distinct('c97'))}) SELECT v.id AS src, n.id AS dst FROM v CROSS JOIN {values([o for o in OFFSETS[26] if o > (0, 0, 0)])} JOIN v n ON n.x = v.x + dx AND n.y = v.y + dy AND n.z = v.z + dz")
    add("graph_nodes", on("c97", graph.nodes), f"SELECT x, y, z, row_number() OVER (ORDER BY x, y, z) - 1 AS node_id FROM ({distinct('c97')})")
    add("downsample_graph", on("c97", lambda a: graph.downsample_graph(a, 2)[1]), f"WITH v AS MATERIALIZED ({distinct('c97')}), c AS MATERIALIZED ({ids.format(f'SELECT DISTINCT {fl(2)} FROM v')}), p AS (SELECT x AS px, y AS py, z AS pz, {fl(2)} FROM v), w AS MATERIALIZED (SELECT px, py, pz, id FROM p JOIN c USING (x, y, z)), s AS MATERIALIZED (SELECT id AS a, px + dx AS px, py + dy AS py, pz + dz AS pz FROM w, {values([o for o in OFFSETS[26] if o > (0, 0, 0)])}) SELECT DISTINCT least(a, id) AS src, greatest(a, id) AS dst FROM s JOIN w USING (px, py, pz) WHERE a <> id")
    six = f"""WITH RECURSIVE v AS MATERIALIZED ({ids.format(distinct('c97'))}), e AS MATERIALIZED (SELECT v.id AS a, n.id AS b FROM v CROSS JOIN {values(OFFSETS[6])} JOIN v n ON n.x = v.x + dx AND n.y = v.y + dy AND n.z = v.z + dz),
r AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), root AS (SELECT a AS id, min(b) AS m FROM r GROUP BY a)"""
    add("components6", on("c97", lambda a: graph.connected_components(voxels(a), 6)), f"{six} SELECT x, y, z, dense_rank() OVER (ORDER BY m) - 1 AS label FROM v JOIN root USING (id)")
    add("components26", on("c97", lambda a: graph.connected_components(voxels(a), 26)), f"{_rooted_sql(distinct('c97'), 26)} SELECT x, y, z, dense_rank() OVER (ORDER BY m) - 1 AS label FROM v JOIN root USING (id)")
    labelled = f"{six}, rows AS (SELECT s.x, s.y, s.z, s.row_id, m FROM ({sql('c97')}) s JOIN v USING (x, y, z) JOIN root USING (id)), n AS (SELECT m, count(*) AS n FROM rows GROUP BY m)"
    add("largest_component", on("c97", lambda a: graph.largest_component(a.select("x", "y", "z", "row_id"), 6)), f"{labelled} SELECT x, y, z, row_id FROM rows WHERE m = (SELECT m FROM n ORDER BY n DESC, m LIMIT 1)")
    add("remove_small_objects", on("c97", lambda a: graph.remove_small_objects(a.select("x", "y", "z", "row_id"), 4, 6)), f"{labelled} SELECT x, y, z, row_id FROM rows JOIN n USING (m) WHERE n >= 4")
    add("fill_cavities", on("c40", graph.fill_cavities), _cavity_sql(A, 8))
    add("fill_cavities_closing", on("o40", partial(graph.fill_cavities, mode="closing")), eroded(dilated(B, 6), 6))
    # meshes, as geometry
    add("culled_vertices", on("c40", lambda a: mesh.culled_faces(a)[0].select("x", "y", "z")), f"{C40_FACES}, t(s, t) AS (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) SELECT DISTINCT x + CASE axis WHEN 0 THEN (side + 1) // 2 WHEN 1 THEN t ELSE s END AS x, y + CASE axis WHEN 1 THEN (side + 1) // 2 WHEN 2 THEN t ELSE s END AS y, z + CASE axis WHEN 2 THEN (side + 1) // 2 WHEN 0 THEN t ELSE s END AS z FROM f, t")
    add("culled_face_count", on("c40", lambda a: mesh.culled_faces(a)[1].agg(F.count("*").alias("faces"))), f"{C40_FACES} SELECT 2 * count(*) AS faces FROM f")
    add("greedy_rectangles", on("c40", mesh.greedy_rectangles), f"""{C40_FACES}, p AS (SELECT axis, side, CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS plane, CASE axis WHEN 0 THEN y WHEN 1 THEN z ELSE x END AS u, CASE axis WHEN 0 THEN z WHEN 1 THEN x ELSE y END AS v FROM f),
s AS (SELECT axis, side, plane, v, min(u) AS u0, max(u) AS u1 FROM (SELECT *, u - row_number() OVER (PARTITION BY axis, side, plane, v ORDER BY u) AS i FROM p) GROUP BY axis, side, plane, v, i)
SELECT CAST(axis AS INTEGER) AS axis, CAST(side AS INTEGER) AS side, plane, u0, u1, min(v) AS v0, max(v) AS v1 FROM (SELECT *, v - row_number() OVER (PARTITION BY axis, side, plane, u0, u1 ORDER BY v) AS i FROM s) GROUP BY axis, side, plane, u0, u1, i""")
    add("surface_net_vertices", on("c97", lambda a: mesh.surface_net_vertices(a).selectExpr(*(f"v.{c} AS c{c}" for c in "xyz"), *(f"round({c}, 9) AS {c}" for c in "xyz"))), f"""{FACES_SQL.format(v=distinct('c97'))}, t(s, t) AS (VALUES (0, 0), (1, 0), (0, 1), (1, 1)), c AS (SELECT
x + CASE axis WHEN 0 THEN (side - 1) // 2 WHEN 1 THEN t - 1 ELSE s - 1 END AS cx, y + CASE axis WHEN 1 THEN (side - 1) // 2 WHEN 2 THEN t - 1 ELSE s - 1 END AS cy, z + CASE axis WHEN 2 THEN (side - 1) // 2 WHEN 0 THEN t - 1 ELSE s - 1 END AS cz,
2 * x + CASE axis WHEN 0 THEN side ELSE 0 END AS mx, 2 * y + CASE axis WHEN 1 THEN side ELSE 0 END AS my, 2 * z + CASE axis WHEN 2 THEN side ELSE 0 END AS mz FROM f, t)
SELECT cx, cy, cz, round(sum(mx) / (2 * count(*)), 9) AS x, round(sum(my) / (2 * count(*)), 9) AS y, round(sum(mz) / (2 * count(*)), 9) AS z FROM c GROUP BY cx, cy, cz""")
    add("surface_nets_faces", on("c40", lambda a: mesh.mesh(a)[1].agg(F.count("*").alias("faces"))), f"{C40_FACES} SELECT 2 * count(*) AS faces FROM f")
    # faces with their winding, corner by corner
    add("culled_triangles", on("c40", lambda a: corners(*mesh.culled_faces(a))), f"{C40_FACES}, {TURNS}, t AS (SELECT x AS i, y AS j, z AS k, axis, side, tri, corner, {_place(['x', 'y', 'z'], '(side + 1) // 2', 's', 't')} FROM f JOIN turns USING (side)) {_corners_sql('i, j, k, axis, side, tri')}")
    rects = _SQL["greedy_rectangles"]
    add("greedy_triangles", on("c40", lambda a: corners(*mesh.greedy_faces(a))), f"WITH r AS ({rects}), {TURNS}, t AS (SELECT axis, side, plane, u0, u1, v0, v1, tri, corner, {_place(['0', '0', '0'], 'plane + (side + 1) // 2', 'CASE s WHEN 1 THEN u1 + 1 ELSE u0 END', 'CASE t WHEN 1 THEN v1 + 1 ELSE v0 END')} FROM r JOIN turns USING (side)) {_corners_sql('axis, side, plane, u0, u1, v0, v1, tri')}")
    rounded_net = lambda a: (lambda v, f: corners(v.select("vid", *(F.round(c, 6).alias(c) for c in "xyz")), f))(*mesh.surface_nets(a))
    net = _SQL["surface_net_vertices"].replace(distinct("c97"), distinct("c40"))
    add("surface_net_triangles", on("c40", rounded_net), f"{C40_FACES}, {TURNS}, n AS ({net}), q AS (SELECT x AS i, y AS j, z AS k, axis, side, tri, corner, {_place(['x', 'y', 'z'], '(side - 1) // 2', 's - 1', 't - 1')} FROM f JOIN turns USING (side)), t AS (SELECT i, j, k, axis, side, tri, corner, round(n.x, 6) AS px, round(n.y, 6) AS py, round(n.z, 6) AS pz FROM q JOIN n ON n.cx = px AND n.cy = py AND n.cz = pz) {_corners_sql('i, j, k, axis, side, tri')}")
    # voxelization of a cloud's own mesh, moved by a quarter of a cell so that no face lies between cells
    touched = f"SELECT DISTINCT {_place(['x', 'y', 'z'], '(side + 1) // 2', 's', 't')} FROM f, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) c(s, t)"
    for name in ("c40", "o40"):
        surface = f"SELECT px AS x, py AS y, pz AS z FROM ({FACES_SQL.format(v=distinct(name))} {touched})"
        whole = f"{distinct(name)} UNION {surface}"
        if name == "c40":
            add("voxelize_surface", on(name, lambda a: voxelize.voxelize(*moved(a), solid=False)), surface)
            add("voxelize_parity", on(name, lambda a: voxelize.voxelize(*moved(a), rule="parity")), whole)
        else:
            add("voxelize_winding", on(name, lambda a: voxelize.voxelize(*moved(a), rule="winding")), whole)
            add("voxelize_axes3", on(name, lambda a: voxelize.voxelize(*moved(a), axes=3)), whole)
    add("diagnose", on("o40", lambda a: voxelize.diagnose(voxelize.triangles(*moved(a))).select("open", "odd")), "SELECT 0::BIGINT AS open, 0::BIGINT AS odd")

    # sequential by nature: no SQL; tests hold them against invariants
    add("thin", on("o40", skeleton.thin))
    add("thin_skeleton", on("o40", lambda a: skeleton.thin_skeletonize(a)[0].select("node_id", "x", "y", "z", "radius")))
    add("centerline_edges", on("o40", lambda a: skeleton.thin_skeletonize(a, min_branch_length=2.0)[1]))
    add("teasar_nodes", on("o40", lambda a: skeleton.teasar_skeletonize(a)[0]))
    add("teasar_tree_edges", on("o40", lambda a: skeleton.teasar_skeletonize(a, branching="tree", downsample=2)[1]))
    add("wavefront_nodes", on("o40", lambda a: skeleton.wavefront_skeletonize(a)[0]))
    add("wavefront_edges", on("o40", lambda a: skeleton.wavefront_skeletonize(a, tree=False)[1]))
    add("swc", on("o40", lambda a: skeleton.to_swc(*skeleton.wavefront_skeletonize(a))))
    add("node_degrees", on("o40", lambda a: skeleton.node_degrees(*skeleton.wavefront_skeletonize(a))))
    tube = lambda a: skeleton.tube_coefficients(a, "wavefront")[0]
    add("tube_coefficients", on("o40", tube))
    add("tube_evaluate", on("o40", lambda a: skeleton.evaluate(tube(a))))
    add("tube_normals", on("o40", lambda a: skeleton.normals(tube(a))))
    add("tube_series", on("o40", lambda a: skeleton.coefficients(tube(a))))
    add("node_volumes", on("o40", lambda a: skeleton.node_volumes(skeleton.wavefront_skeletonize(a)[0], (4, 4, 40))))
    add("nearest_radii", on("o40", lambda a: skeleton.nearest_radii(skeleton.wavefront_skeletonize(a)[0], a)))
    add("tube_gpu_buffer", on("o40", lambda a: skeleton.to_gpu_buffer(tube(a))))


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """ax to cz of each face, in the order of its corners."""
    out = faces.select("a", "b", "c")
    for c in "abc":
        out = out.join(vertices.select(F.col("vid").alias(c), *(F.col(x).alias(c + x) for x in "xyz")), c)
    return out.select(*(F.col(c + x).cast("double").alias({"by": "by_"}.get(c + x, c + x)) for c in "abc" for x in "xyz"))


def moved(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The culled mesh of a cloud, voxel i from i + 0.25 to i + 1.25 in units in which cells begin at whole numbers."""
    vertices, faces = mesh.culled_faces(voxels(a))
    return vertices.select("vid", *((F.col(c) - 0.25).alias(c) for c in "xyz")), faces


#: The corners (s, t) of the two triangles of a quad, counter-clockwise seen from outside.
TURNS = "turns(side, tri, corner, s, t) AS (VALUES " + ", ".join(f"({side}, {tri}, {k}, {ring[n][0]}, {ring[n][1]})" for side, ring in ((1, [(0, 0), (1, 0), (1, 1), (0, 1)]), (-1, [(0, 1), (1, 1), (1, 0), (0, 0)])) for tri, order in enumerate(((0, 1, 2), (0, 2, 3))) for k, n in enumerate(order)) + ")"


def _place(base: list[str], plane: str, first: str, second: str) -> str:
    """px, py, pz: base plus the offset along a face's axis and along its two others (the next axis first)."""
    cases = (f"CASE axis WHEN 0 THEN {plane} WHEN 1 THEN {second} ELSE {first} END", f"CASE axis WHEN 0 THEN {first} WHEN 1 THEN {plane} ELSE {second} END", f"CASE axis WHEN 0 THEN {second} WHEN 1 THEN {first} ELSE {plane} END")
    return ", ".join(f"{b} + {c} AS p{a}" for b, c, a in zip(base, cases, "xyz", strict=True))


def _corners_sql(by: str) -> str:
    """One row for each triangle from t(by, corner, px, py, pz)."""
    pick = ", ".join(f"CAST(max(p{x}) FILTER (WHERE corner = {k}) AS DOUBLE) AS {c}{x}{'_' if c + x == 'by' else ''}" for k, c in enumerate("abc") for x in "xyz")
    return f"SELECT {', '.join(c + x + ('_' if c + x == 'by' else '') for c in 'abc' for x in 'xyz')} FROM (SELECT {pick} FROM t GROUP BY {by})"


def _rooted_sql(source: str, connectivity: int, name: str = "") -> str:
    """CTEs v (x, y, z, id) and root (id, m: the least id of the component), by labels that go down along edges until none changes."""
    v, e, r, root = (n + name for n in ("v", "e", "r", "root"))
    return f"""WITH RECURSIVE {v} AS MATERIALIZED (SELECT x, y, z, row_number() OVER (ORDER BY x, y, z) - 1 AS id FROM ({source})),
{e} AS MATERIALIZED (SELECT p.id AS a, n.id AS b FROM {v} p CROSS JOIN {values(OFFSETS[connectivity])} JOIN {v} n ON n.x = p.x + dx AND n.y = p.y + dy AND n.z = p.z + dz),
{r}(id, m) USING KEY (id) AS (SELECT id, id FROM {v} UNION (SELECT {e}.b, min({r}.m) FROM {r} JOIN {e} ON {e}.a = {r}.id JOIN recurring.{r} AS o ON o.id = {e}.b GROUP BY {e}.b, o.m HAVING min({r}.m) < o.m)),
{root} AS MATERIALIZED (SELECT id, m FROM {r})"""


def _cavity_sql(own: str, depth: int) -> str:
    """The background of the padded bounds by 6-components: those that stay inside, are nowhere `depth` steps from the voxels and are lined by one 26-component are filled."""
    b = f"(SELECT min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1, min(z) - 1 AS z0, max(z) + 1 AS z1 FROM ({own}))"
    cells = f"SELECT x, y, z FROM {b} b, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS x), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y), LATERAL (SELECT unnest(range(z0, z1 + 1)) AS z) EXCEPT {own}"
    object_ = _rooted_sql(own, 26, "o")
    void = _rooted_sql(cells, 6, "c").removeprefix("WITH RECURSIVE ")
    return f"""{object_}, {void},
edge AS (SELECT DISTINCT m FROM vc JOIN rootc USING (id), {b} b WHERE x IN (x0, x1) OR y IN (y0, y1) OR z IN (z0, z1)),
inner_ AS MATERIALIZED (SELECT x, y, z, id, m FROM vc JOIN rootc USING (id) WHERE m NOT IN (SELECT m FROM edge)),
lining AS (SELECT i.m, i.id, ro.m AS owner FROM inner_ i CROSS JOIN {values(FACES)} JOIN vo n ON n.x = i.x + dx AND n.y = i.y + dy AND n.z = i.z + dz JOIN rooto ro ON ro.id = n.id),
near(id, d) USING KEY (id) AS (SELECT DISTINCT id, 0 FROM lining UNION (SELECT ec.b, near.d + 1 FROM near JOIN ec ON ec.a = near.id JOIN inner_ ON inner_.id = ec.b WHERE NOT EXISTS (SELECT 1 FROM recurring.near o WHERE o.id = ec.b) GROUP BY ALL)),
good AS (SELECT m FROM lining GROUP BY m HAVING count(DISTINCT owner) = 1 EXCEPT SELECT m FROM near JOIN inner_ USING (id) WHERE d >= {depth})
SELECT x, y, z FROM vo UNION ALL SELECT x, y, z FROM inner_ WHERE m IN (SELECT m FROM good)"""


def _manifold_sql(rounds: int) -> str:
    steps = [f"v0 AS MATERIALIZED ({distinct('c97')})"]
    for k in range(rounds):
        steps.append(f"v{k + 1} AS MATERIALIZED (SELECT x, y, z FROM v{k} UNION {_fixes_sql(f'v{k}')})")
    return f"WITH {', '.join(steps)} SELECT x, y, z FROM v{rounds}"


def _fixes_sql(v: str) -> str:
    parts = []
    for far, first, between in morph.CONTACTS:
        there = lambda o: f"SELECT 1 FROM {v} n WHERE n.x = v.x + {o[0]} AND n.y = v.y + {o[1]} AND n.z = v.z + {o[2]}"
        tests = [f"EXISTS ({there(far)})", *(f"NOT EXISTS ({there(b)})" for b in between)]
        parts.append(f"SELECT x + {first[0]} AS x, y + {first[1]} AS y, z + {first[2]} AS z FROM {v} v WHERE {' AND '.join(tests)}")
    return " UNION ".join(parts)


def _contact_sql() -> str:
    return f"WITH w AS ({distinct('c97')}) {_fixes_sql('w')}"


def _distance_sql(name: str, s: tuple[int, int, int]) -> str:
    """Nearest background cell by axis, each pass over whole lines of the padded bounds."""
    return f"""WITH v AS ({distinct(name)}), b AS (SELECT min(x) - 1 AS x0, max(x) + 1 AS x1, min(y) - 1 AS y0, max(y) + 1 AS y1, min(z) - 1 AS z0, max(z) + 1 AS z1 FROM v),
cells AS (SELECT x, y, z FROM (SELECT unnest(range(x0, x1 + 1)) AS x FROM b), (SELECT unnest(range(y0, y1 + 1)) AS y FROM b), (SELECT unnest(range(z0, z1 + 1)) AS z FROM b)),
bg AS (SELECT * FROM cells EXCEPT SELECT * FROM v),
fx AS (SELECT c.x, c.y, c.z, min({s[0] ** 2} * (c.x - g.x) * (c.x - g.x)) AS g FROM cells c JOIN bg g ON c.y = g.y AND c.z = g.z GROUP BY ALL),
fy AS (SELECT c.x, c.y, c.z, min(f.g + {s[1] ** 2} * (c.y - f.y) * (c.y - f.y)) AS g FROM cells c JOIN fx f ON c.x = f.x AND c.z = f.z GROUP BY ALL)
SELECT v.x, v.y, v.z, CAST(min(f.g + {s[2] ** 2} * (v.z - f.z) * (v.z - f.z)) AS BIGINT) AS g FROM v JOIN fy f ON v.x = f.x AND v.y = f.y GROUP BY ALL"""


_register()


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
