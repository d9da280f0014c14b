"""Tokens that stand for missing values, and the fixed vocabularies of the lineage model."""

from __future__ import annotations

# They are part of the data that the engine reads and writes.
NULL = "<NULL>"
NULL_XML, NULL_INFERRED = "<NULL_XML>", "<NULL_INFERRED>"
NULL_DERIVED, NULL_UNKNOWN = "<NULL_DERIVED>", "<NULL_UNKNOWN>"
CONST, MISSING, FILTER_WITHOUT_ATTRIBUTES = "<CONST>", "<MISSING>", "<FILTER_PRESENT_NO_ATTRS>"
PULLTHROUGH_FILE, RUNTIME_FILE = "<GLOBAL_PULLTHROUGH>", "<RUNTIME_OFFLINE>"

#: Words that are no identifiers in an expression. Fixed values.
KEYWORDS = (
    "AND", "OR", "NOT", "NULL", "CASE", "WHEN", "THEN", "ELSE", "END", "IN", "IS", "ON", "AS",
    "SUM", "COUNT", "MAX", "MIN", "AVG", "UPPER", "LOWER", "TRIM", "CAST", "LIKE", "WHERE",
    "GROUP", "BY", "ORDER", "HAVING", "DISTINCT", "INNER", "LEFT", "RIGHT", "FULL", "JOIN",
)

#: Functions that leave a value what it is, so that they don't count against a weight. Fixed values.
NEUTRAL_FUNCTIONS = ("CAST", "ROUND", "COALESCE", "NVL", "TRIM", "LTRIM", "RTRIM", "UPPER", "LOWER", "SUBSTR", "REPLACE")

#: Identity of a lineage row. Fixed values.
ROW_KEY = (
    "source_file", "xpath", "transformation_type", "current_node", "parent_input_object", "target_column",
    "source_column", "formula", "filter_expression", "join_expression", "join_left_column", "join_right_column",
)

#: Record types of job lineage that describe a column. Fixed values.
COLUMN_RECORDS = (
    "COLUMN_MAPPING", "UNION_COLUMN_MAPPING", "SCRIPT_COLUMN_MAPPING", "TABLE_COMPARISON", "SQL_TRANSFORM",
    "REVERSE_PIVOT", "PIVOT", "HISTORY_PRESERVING", "KEY_GENERATION", "CASE_OPERATION",
)

#: Technical name -> word, and names without meaning. Fixed values.
ACRONYMS = {
    "acct": "account", "agrmnt": "agreement", "nbr": "number", "cd": "code", "amt": "amount", "dt": "date",
    "mat": "material", "prd": "product", "qty": "quantity", "cust": "customer", "ven": "vendor",
    "uom": "unit of measure", "yr": "year", "mnth": "month",
}
DROPPED_TERMS = ("tbl", "vw", "tmp", "stg")
