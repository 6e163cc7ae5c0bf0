"""Names resolved to nodes."""

from opslens.operators import graph


def test_names_resolve_by_containment_last(spark):
    nodes = spark.createDataFrame(
        [("n1", "orders-api", []), ("n2", "pay", []), ("n3", "Cache", ["redis-main"]), ("n4", "orders", []), ("n5", "stock-keeping-and-warehouse", []), ("n6", None, None)], "id string, name string, aliases array<string>"
    )
    want = {"orders": "n4", "ORDERS-API": "n1", "orders-ap": "n1", "the-payments": "n2", "redis_main": "n3", "n3": "n3", "keeping-and-ware": "n5", "nowhere": None, "": None, "pay service": "n2", None: None}
    found = graph.resolve_entities(spark.createDataFrame([(n,) for n in want] * 2, "name string"), nodes).collect()
    assert {r.name: r.id for r in found} == want and len(found) == len(want)
    found = graph.resolve_entities(spark.createDataFrame([("orders",)], "name string"), nodes.filter("id = 'n1'").drop("aliases")).collect()
    assert [r.id for r in found] == ["n1"]
