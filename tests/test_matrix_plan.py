"""The entity matrix counts without a copy of the rows for each operation."""

from skylark.operators import access


def test_matrix_expands_no_rows(spark):
    rows = [(1, "A", "read"), (1, "A", "read"), (2, "A", "read"), (2, "A", "delete"), (None, "B", "create"), (3, None, "read"), (4, "A", None)]
    out = access.matrix(spark.createDataFrame(rows, "endpoint_id long, entity string, operation string"))
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.entity: (r.create, r.create_or_update, r.read, r.update, r.delete, r.unknown) for r in out.collect()} == {"A": (0, 0, 2, 0, 1, 0), "B": (0, 0, 0, 0, 0, 0)}
