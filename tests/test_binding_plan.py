"""Binding entries: rules meet one entry of their prefix, not all."""

from skylark.operators import reads


def test_rules_meet_the_first_entry_of_a_prefix_only(spark):
    rules = spark.createDataFrame([(i, p) for i in range(40) for p in ("app", "app.a", "none")] + [(99, "other"), (100, None)], "rule_id long, prefix string")
    config = spark.createDataFrame([(500 - i, f"app.{'ab'[i % 2]}.{i}") for i in range(300)] + [(1, "other"), (2, "apples.x"), (None, "other.y"), (0, None)], "ord long, key string")
    got = reads.binding_entries(rules, config)
    assert {r.rule_id: r.key for r in got.collect()} == {i: "app.b.299" for i in range(40)} | {99: "other"}
    # entries are grouped before the join as well as after it
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert "Aggregate [rule_id" in plan[:join] and "Aggregate [prefix" in plan[join:]
