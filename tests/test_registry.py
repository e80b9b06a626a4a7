"""Registered queries against their SQL on the smallest data folder."""

import os

import duckdb
import pytest

from skylark.plans import registry

FOLDER = "/root/testdata/sf0.001"
#: One or two of each family; the driver compares all of them.
NAMES = (
    "f01_simplify_uri", "f02_repositories", "f05_url_parts", "f06_expanded_keys", "f19_access_effects", "f27_merged_claims", "f38_blanked_source", "j13_stitch", "j21_system_graph", "j26_binding_entries",
    "j27_ant_matches", "j34_tables_to_entities", "j36_sites_in_methods", "s11_merged_settings", "s14_flattened_settings", "g12_witness_paths", "g13_governing_conditions", "y18_reaching_definitions", "y24_nearest_declarations", "w14_folded_copies", "f35_query_accesses", "x31_statement_flow", "g05_assembled_flow", "g14_canvas_edges", "x23_generic_bindings", "x20_sliced_urls", "z12_rule_evidence",
)


def _text(x):
    return "NULL" if x is None or str(x) in ("nan", "<NA>", "NaT", "None") else f"{float(x):.6f}" if isinstance(x, int | float) or getattr(getattr(x, "dtype", None), "kind", "") in ("i", "u", "f") else str(x)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the data folders are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    got, want = registry.QUERIES[name](spark, FOLDER).toPandas(), con.sql(registry.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(tuple, df[columns].map(_text).values.tolist()))
    assert rows(got) == rows(want)
