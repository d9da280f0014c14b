"""Catalog fallback and resolution of names on literal rows."""

from tracewell.operators import resolve

ROWS = "transformation_type string, current_node string, parent_input_object string, source_object string, source_column string, target_column string, formula string"
COLUMNS = "schema_name string, view_name string, column_name string, position int"
N = "<NULL>"


def rows(spark):
    return spark.createDataFrame([
        ("Node_Mapping", "S.V", N, N, "A", "T1", N), ("Node_Mapping", "S.V", N, N, N, "T2", N), ("Node_Mapping", "s.v", N, N, "", "T3", N),
        ("Node_Mapping", "V", N, N, N, "T4", N), ("Node_Mapping", None, None, None, None, "T5", None), ("Node_Mapping", "S.NONE", N, N, N, "T6", N), ("Node_Mapping", "S.V", N, N, N, N, N),
        ("Calculated_Measure", "S.V", "#S.W", N, N, "M1", '"A" + "B"'), ("Calculated_Measure", "S.V", N, N, N, "M2", "1 + 2"), ("Calculated_Measure", "S.V", N, "S.W", N, "M3", '"b" * "K" - "ID" + "ZZ"'),
        ("Mapping", "S.V", N, N, N, "T7", N), ("Calculated_Measure", "S.V", N, N, N, "M4", None), ("Node_Mapping", "S.V", N, N, "A", "T1", N),
    ], ROWS)


def catalog(spark):
    return spark.createDataFrame([("S", "V", "A", 2), ("S", "V", "C", 1), ("S", "W", "B", 1), ("S", "X", "K", 1), ("S", "X", "ID", 2), ("S", "Y", "ID", 1), ("S", "Y", None, 2), (None, "Z", "Q", 1)], COLUMNS)


def test_targets_without_a_source_depend_on_the_view_of_the_node(spark):
    got = sorted(tuple(r) for r in resolve.registered_dependencies(rows(spark), catalog(spark)).select("target", "source", "origin").collect())
    assert got == [("M1", "A", "FORMULA"), ("M1", "B", "FORMULA"), ("M2", "A", "CATALOG"), ("M2", "C", "CATALOG"), *sorted(("M3", x, "FORMULA") for x in ("b", "K", "ID", "ZZ")),
                   ("M4", "A", "CATALOG"), ("M4", "C", "CATALOG"), ("T1", "A", "MAPPING"), ("T2", "A", "CATALOG"), ("T2", "C", "CATALOG"), ("T3", "A", "CATALOG"), ("T3", "C", "CATALOG")]


def test_identifiers_find_their_object(spark):
    got = {(r["target_column"], r["identifier"]): (r["object"], r["how"]) for r in resolve.resolved_identifiers(rows(spark), catalog(spark)).collect()}
    assert got == {("M1", "A"): ("S.V", "OWN"), ("M1", "B"): ("S.W", "INPUT"), ("M3", "b"): ("S.W", "INPUT"), ("M3", "K"): ("S.X", "UNIQUE"), ("M3", "ID"): (None, "AMBIGUOUS"), ("M3", "ZZ"): (None, "UNKNOWN")}


def test_nothing_in_nothing_out(spark):
    assert resolve.registered_dependencies(rows(spark).limit(0), catalog(spark)).count() == 0
    assert resolve.resolved_identifiers(rows(spark), catalog(spark).limit(0)).filter("object IS NOT NULL").count() == 0
