"""How often the rows of edge profiles are sorted and moved."""

from linkloom.operators import crawl_links as cl

KINDS = "source_id long, target_id long, block_type string, base_weight float, anchor_text string, to_path string, target_label string, instances long"


def test_rows_are_sorted_behind_the_shuffle_only(spark):
    rows = [(1, 2, "content", 1.0, text, "/a", "a", n) for text, n in (("a", 1), ("a b", 2), ("b", 3), ("c", 3), ("ici", 5))]
    rows += [(1, 3, "head", 0.25, None, "/b", "b", 2), (None, 3, "head", 0.25, "b", "/b", "b", 1), (1, 2, "head", 0.25, "a", "/a", "a", 4)]
    profiles = cl.edge_profiles(spark.createDataFrame(rows, KINDS).repartition(3))
    plan = profiles._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(source_id") == 1
    _, below = plan.split("Exchange hashpartitioning(source_id")
    assert "Aggregate" not in below and "Sort" not in below
    got = {(r.source_id, r.target_id, r.block_type): (round(r.rule_weight, 3), r.exact, r.partial, r.contextual, r.generic) for r in profiles.collect()}
    assert got[1, 2, "content"] == (14.0, "a", None, "b", "ici")
    assert got[1, 2, "head"] == (1.0, "a", None, None, None)
    assert got[None, 3, "head"] == (0.25, "b", None, None, None)
    assert len(got) == 4 and got[1, 3, "head"][0] == 0.5
