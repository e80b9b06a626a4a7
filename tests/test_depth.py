"""Traversals and orders longer than any fixed number of rounds."""

from skylark.operators import graph


def test_closure_reaches_the_end_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(25)], "src long, dst long")
    roots = spark.createDataFrame([(0,)], "root long")
    assert sorted((r.node, r.level) for r in graph.closure(edges, roots).collect()) == [(i, i) for i in range(26)]
    assert graph.witness_paths(edges, roots).where("node = 25").first().level == 25
    assert {r.node for r in graph.call_tree(edges, roots).collect()} == set(range(26))
