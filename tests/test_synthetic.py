"""Generated families: the same everywhere, and their defects found again."""

from paperloom import plans
from paperloom.sources import synthetic
from paperloom.sources.tables import Tables


def test_the_same_rows_at_any_partitioning(spark, folder):
    orders = Tables(spark, folder).orders.limit(60)
    one, many = (sorted(map(tuple, synthetic.families(spark, orders.repartition(n), 5).collect()), key=str) for n in (1, 7))
    assert one == many and len(one) > 300
    assert one != sorted(map(tuple, synthetic.families(spark, orders, 6).collect()), key=str)
    keys = [r.o_orderkey for r in orders.collect()]
    assert [r[1:] for r in one] == sorted((r for k in keys for r in map(lambda r: (r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7].quantize(r[7].__class__("0.0001")), r[8].quantize(r[8].__class__("0.0001"))), synthetic.family(5, k))), key=lambda r: str((next(k for k in keys if k in (r[1], -r[1] - 1)), *r)))


def test_defects_are_found_by_comparing(spark, folder):
    rows = plans.QUERIES["s19_generated_defects"](spark, folder).collect()
    assert sum(r.n for r in rows) >= 1000 and {r.scenario for r in rows} == set(synthetic.SCENARIOS)
    assert {(r.scenario, r.found) for r in rows} == {(s, s) for s in synthetic.SCENARIOS}
