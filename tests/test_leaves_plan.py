"""Leaves of a closure come from one join, however many levels it has, and edges are made distinct once."""

from skylark.operators import graph


def test_leaves_join_once(spark, monkeypatch):
    labels, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: labels.append(label) or written(df, label))
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)] + [(2, 7), (7, 2), (3, 8), (3, 8)], "src long, dst long")
    reached = graph.closure(edges, spark.createDataFrame([(0,), (4,), (9,)], "root long"))
    out = graph.leaves(edges, reached)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted((r.root, r.node, r.level) for r in out.collect()) == [(0, 5, 5), (0, 8, 4), (4, 5, 1), (9, 9, 0)]
    assert labels.count("edges") == 1


def test_tree_edges_are_made_distinct_once(spark, monkeypatch):
    labels, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: labels.append(label) or written(df, label))
    tree = graph.call_tree(spark.createDataFrame([(1, 2), (1, 2), (2, 1), (2, 3)], "src long, dst long"), spark.createDataFrame([(1,)], "root long"))
    assert sorted((r.path, r.size) for r in graph.subtree_sizes(tree).collect()) == [("1", 4), ("1>2", 3), ("1>2>1", 1), ("1>2>3", 1)]
    assert labels.count("edges") == 1
