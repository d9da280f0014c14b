"""Scalar expressions on values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import scalars as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, bool) else 'boolean'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [('"S.T.C"', "C"), (" a.b ", "b"), ("<NULL>", ""), ("", ""), (None, ""), ('"A"', "A")])
def test_base_name(spark, text, want):
    assert one(spark, S.base_name("t"), t=text) == want


@pytest.mark.parametrize(("text", "want"), [('"A" + 1', 0.5), ('TRIM("A")', 1.0), ('SUM("A")', 0.5), ("A = 'x' AND B >= 1.5", 2 / 7), ("<NULL>", 0.0), ("", 0.0), (None, 0.0)])
def test_weight(spark, text, want):
    assert one(spark, S.weight("t"), t=text) == pytest.approx(want)


def test_identifiers_skip_literals_and_keywords(spark):
    assert one(spark, S.identifiers("t"), t="CASE WHEN \"S.T.C\" IN ('Q') THEN x.y END") == ["C", "y"]


@pytest.mark.parametrize(("op", "inc", "value", "want"), [("GE", "true", "5", "A >= '5'"), ("", "", "5", "A = '5'"), ("ZZ", "false", "5", "A <> '5'"), ("EQ", "true", "", ""), ("NL", None, "x%", "A NOT LIKE 'x%'")])
def test_predicate(spark, op, inc, value, want):
    assert one(spark, S.predicate(F.lit("A"), "o", "i", "v"), o=op, i=inc, v=value) == want


@pytest.mark.parametrize(("text", "want"), [('#//"S".T', "S.T"), ('"X"."S"."T"', "S.T"), ("T", "T"), ("<NULL>", None), (None, None)])
def test_entity(spark, text, want):
    assert one(spark, S.entity_object("t"), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("CUST_NAME", ""), ("CustName", "Customer Name"), ("tmp_amt_total", "Amount Total"), (None, ""), ("a1_b2", "")])
def test_concept(spark, text, want):
    assert one(spark, S.concept("t"), t=text) == want


def test_names_and_labels(spark):
    assert one(spark, S.view_of_uri("t"), t="/pkg/views/ATV_X") == "ATV_X"
    assert one(spark, S.safe_name("t"), t="A B/C") == "A_B_C"
    assert one(spark, S.sheet_name("t", "_Tbl"), t="A.B" * 20).endswith("_Tbl")
    assert one(spark, S.elapsed(F.lit(125)), t="") == "2m 5s"
    assert one(spark, S.unescaped("t"), t="a &amp; b") == "a & b"
    assert one(spark, S.path_text("s", "t", "d", "j"), s="S", t="T", d="D1; D2", j="") == "S  -->  T  (via D1 | ?)"
    assert one(spark, S.short_label("t", 5), t="A.LONGNAME") == "LONG…"
    assert one(spark, S.column_label("s", "t", "e", 5), s="a", t="b", e="123456789").asDict() == {"label": "a → b", "expression": "1234…"}


def test_formula_semantics(spark):
    got = one(spark, S.formula_semantics("t"), t="SUM(NVL(a, b)) + 'x('").asDict()
    assert got == {"functions_used": "NVL,SUM", "nesting_depth": 2, "has_aggregation": True, "has_conditional": True, "complexity": 3, "category": "AGGREGATION", "risk": "MEDIUM"}


def test_badges(spark):
    kinds = [("SCD_TYPE2", False, "x", "Scd"), ("X", True, "a+b", "direct"), ("X", False, "'c'", "const"), ("X", False, "a+b", "formula"), (None, False, None, "direct")]
    for kind, direct, formula, want in kinds:
        assert one(spark, S.mapping_badge("k", "d", "f"), k=kind, d=direct, f=formula) == want


def test_output_list_is_capped(spark):
    df = spark.createDataFrame([(["c", "a", "b"],)], "c array<string>")
    assert df.select(S.outputs_text("c").alias("x")).first()["x"] == "a,b,c"
    assert df.select(S.outputs_text("c", most=2).alias("x")).first()["x"] == "a,b,...(+1)"
    assert df.select(S.outputs_text("c", "count").alias("x")).first()["x"] == "3"
