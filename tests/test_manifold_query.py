from tests.test_sets import contacts, got
from voxmill.operators import morph
from voxmill.operators.frame import voxels
from voxmill.plans import registry
from voxmill.sources.clouds import cloud

SF = "/root/testdata/sf0.001"


def test_query_leaves_no_contact(spark):
    out = registry.queries()["make_manifold_whole"](spark, SF)
    now = set(got(voxels(cloud(spark, SF, "c97"))))
    while fixes := contacts(now):
        now |= fixes
    assert got(out) == sorted(now) and morph.contact_fixes(out).isEmpty()
