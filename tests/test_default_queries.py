from voxmill.operators import skeleton
from voxmill.plans import registry
from voxmill.sources.clouds import cloud

SF = "/root/testdata/sf0."


def test_queries_use_the_operators_defaults(spark):
    own = registry.queries()
    out = own["tube_evaluate"](spark, SF + "001").groupBy("node_id").count()
    assert {r["count"] for r in out.select("count").distinct().collect()} == {64}
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(own["teasar_nodes"](spark, SF + "01")) == rows(skeleton.teasar_skeletonize(cloud(spark, SF + "01", "o40"))[0])
