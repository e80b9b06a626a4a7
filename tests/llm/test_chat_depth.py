"""Orders longer than any fixed number of rounds."""

from skylark.llm import chat


def test_order_settles_a_chain_of_more_than_100_steps(spark, request):
    for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"):
        before = spark.conf.get(key)
        spark.conf.set(key, "1" if key.endswith("partitions") else "false")
        request.addfinalizer(lambda key=key, before=before: spark.conf.set(key, before))
    n = 104
    needs = spark.createDataFrame([(i + 1, i) for i in range(n)], "row long, before long").coalesce(1)
    turns = spark.createDataFrame([(i, n - i) for i in range(n + 1)], "row long, turn long").coalesce(1)
    assert sorted((r.row, r["at"], r.depth) for r in chat.order(needs, turns).collect()) == [(i, n, i) for i in range(n + 1)]
