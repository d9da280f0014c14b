"""Scalar expressions of the lineage model (PRJ1-25), all inside the JVM.

Every function takes columns (or names) and returns a column. Missing values are null, blank or the null token unless a
function says otherwise; identifiers come out as '' when missing.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .. import tokens

_NUMBER_OR_LITERAL = r"('[^']*'|\b\d+(?:\.\d+)?\b)"
_CALL = r"\b[A-Za-z_][A-Za-z0-9_]*\s*\("
_PREDICATE = r"(?i)(=|<>|>=|<=|\bIN\b|\bLIKE\b|\bAND\b|\bOR\b)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.trim(_c(x), F.lit(" \t\n\x0b\f\r"))


def present(x) -> Column:
    """The trimmed value, or null where it is missing (PRJ23)."""
    value = trimmed(x)
    return F.when((value != "") & (value != tokens.NULL), value)


def is_missing(x) -> Column:
    """Null, blank or the null token."""
    return present(x).isNull()


def or_token(x, default: str = tokens.NULL) -> Column:
    """The value, or a token where it is missing."""
    return F.coalesce(present(x), F.lit(default))


def first_present(*xs) -> Column:
    """The first value that isn't missing (PRJ24)."""
    return F.coalesce(*map(present, xs))


def unquoted(x) -> Column:
    """Without one pair of double quotes, trimmed; '' when missing."""
    return F.coalesce(trimmed(F.regexp_replace(present(x), r'^"(.*)"$', "$1")), F.lit(""))


def base_name(x) -> Column:
    """The last segment of an identifier (PRJ1)."""
    return trimmed(F.element_at(F.split(unquoted(x), r"\."), -1))


def identifiers(x, keywords=tokens.KEYWORDS) -> Column:
    """Sorted different identifiers of an expression: quoted ones, and bare ones that aren't keywords (PRJ2)."""
    text = F.regexp_replace(F.coalesce(present(x), F.lit("")), "'[^']*'", " ")
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), 1)
    bare = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_][A-Za-z0-9_.]*)\b"), 1), lambda t: ~F.upper(t).isin(*keywords))
    names = F.transform(F.concat(quoted, bare), base_name)
    return F.array_sort(F.array_distinct(F.filter(names, lambda t: t != "")))


def references(x, keywords=tokens.KEYWORDS) -> Column:
    """Like `identifiers`, but with their qualifiers."""
    text = F.regexp_replace(F.coalesce(present(x), F.lit("")), "'[^']*'", " ")
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), 1)
    bare = F.filter(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)"), 1), lambda t: ~F.upper(t).isin(*keywords))
    return F.array_distinct(F.filter(F.transform(F.concat(quoted, bare), unquoted), lambda t: t != ""))


#: Operator code -> template of a predicate. Fixed values.
PREDICATES = {"EQ": "%s = '%s'", "NE": "%s <> '%s'", "NL": "%s NOT LIKE '%s'", "LE": "%s <= '%s'", "GE": "%s >= '%s'", "LT": "%s < '%s'", "GT": "%s > '%s'"}


def predicate(attribute, operator, including, value) -> Column:
    """A readable predicate: the operator's template, else = or <> by the including flag; '' without a value (PRJ3)."""
    attribute, value = _c(attribute), present(value)
    flag = F.lower(F.coalesce(present(including), F.lit("")))
    out = F.when(value.isNull() | is_missing(attribute), "")
    for code, template in PREDICATES.items():
        out = out.when(F.upper(F.coalesce(trimmed(operator), F.lit(""))) == code, F.format_string(template, attribute, value))
    return out.when(flag.isin("", "true", "1", "yes"), F.format_string("%s = '%s'", attribute, value)).otherwise(F.format_string("%s <> '%s'", attribute, value))


def entity_object(x) -> Column:
    """The object that an entity reference names: its last two segments, unquoted (PRJ4); null when missing."""
    parts = F.transform(F.split(F.regexp_replace(present(x), r"^#*/*", ""), r"\."), lambda p: F.regexp_replace(trimmed(p), '^"+|"+$', ""))
    parts = F.filter(parts, lambda p: p != "")
    return F.nullif(F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)), F.lit(""))


def view_of_uri(x) -> Column:
    """The last segment of a repository address (PRJ5)."""
    value = present(x)
    return F.coalesce(F.nullif(F.substring_index(value, "/", -1), F.lit("")), value)


def qualified(*parts) -> Column:
    """Names joined by dots, missing ones skipped (PRJ6)."""
    return F.concat_ws(".", *map(present, parts))


def qualified_column(objects: list, column) -> Column:
    """`object.column` by the first object that isn't missing; '' without a column (PRJ7)."""
    name = present(column)
    return F.coalesce(F.concat(first_present(*objects), F.lit("."), name), name, F.lit(""))


def intent(kind, level=None) -> Column:
    """What a row's type says about the column (PRJ8)."""
    kind = F.upper(F.coalesce(_c(kind), F.lit("")))
    out = F.when(_c(level) == "NODE", "STRUCTURAL_DEPENDENCY") if level is not None else F
    for word, meaning in (("CALCULATED", "DERIVED"), ("AGGREGATION", "AGGREGATED"), ("FILTER", "FILTERED"), ("JOIN", "JOIN_DERIVED"), ("MAPPING", "DIRECT_SOURCE"), ("ROLLUP", "INHERITED_FROM_VIEW")):
        out = out.when(F.contains(kind, F.lit(word)), meaning)
    return out.otherwise("UNKNOWN")


def outputs_text(columns, mode: str = "list", most: int = 2000, most_chars: int = 500_000) -> Column:
    """A node's output columns as text: none, their count, or a sorted list that is capped with a note (PRJ9, SRT2)."""
    columns = _c(columns)
    if mode == "none":
        return F.lit("")
    if mode == "count":
        return F.size(columns).cast("string")
    names = F.array_sort(columns)
    text = F.array_join(F.slice(names, 1, most), ",")
    text = F.when(F.size(names) > most, F.concat(text, F.format_string(",...(+%d)", F.size(names) - most))).otherwise(text)
    return F.when(F.length(text) > most_chars, F.concat(F.substring(text, 1, most_chars), F.lit("..."))).otherwise(text)


def expression_counts(x) -> Column:
    """cols, consts, funcs, preds of an expression (PRJ15)."""
    text = F.coalesce(_c(x), F.lit(""))
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("int")
    return F.struct(F.size(identifiers(x)).alias("cols"), count(_NUMBER_OR_LITERAL).alias("consts"), count(_CALL).alias("funcs"), count(_PREDICATE).alias("preds"))


def weight(x, neutral=tokens.NEUTRAL_FUNCTIONS, low: float = 0.0, high: float = 1.0) -> Column:
    """Share of columns among an expression's parts, neutral calls left out; 0 for no parts (PRJ16)."""
    parts, text = expression_counts(x), F.coalesce(_c(x), F.lit(""))
    calls = parts["funcs"]
    if neutral:
        calls = F.greatest(calls - F.regexp_count(text, F.lit(rf"(?i)\b({'|'.join(neutral)})\b\s*\(")), F.lit(0))
    total = parts["cols"] + parts["consts"] + calls + parts["preds"]
    share = F.when(total > 0, parts["cols"].cast("double") / total).otherwise(F.lit(0.0))
    return F.greatest(F.lit(low), F.least(F.lit(high), share))


def concept(x, least: int = 3, acronyms=tokens.ACRONYMS, dropped=tokens.DROPPED_TERMS) -> Column:
    """A readable business term for a technical name (PRJ17)."""
    spaced = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?<!^)(?=[A-Z])", " ")
    words = F.split(F.regexp_replace(spaced, "[^A-Za-z0-9]+", " "), r"\s+")
    words = F.filter(F.transform(F.filter(words, lambda w: F.length(w) >= least), F.lower), lambda w: ~w.isin(*dropped))
    known = F.create_map(*[F.lit(s) for pair in acronyms.items() for s in pair])
    words = F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


@pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Character references replaced (PRJ18); the one scalar that the JVM has no function for."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def safe_name(x) -> Column:
    """Fit for a file or a sheet (PRJ19)."""
    return F.regexp_replace(_c(x), "[^A-Za-z0-9_.-]", "_")


def sheet_name(x, suffix: str = "") -> Column:
    """A sheet's name: 28 characters and a suffix."""
    return F.concat(F.substring(F.regexp_replace(_c(x), "[^A-Za-z0-9_]", "_"), 1, 28), F.lit(suffix))


def elapsed(seconds) -> Column:
    """`Xm Ys` (PRJ20)."""
    whole = F.floor(_c(seconds)).cast("long")
    return F.format_string("%dm %ds", F.floor(whole / 60).cast("long"), whole % 60)


def path_text(source, target, dataflow, job) -> Column:
    """One step of a path with the first dataflow and job (PRJ11)."""
    first = lambda x: F.coalesce(F.nullif(trimmed(F.substring_index(_c(x), ";", 1)), F.lit("")), F.lit("?"))
    return F.format_string("%s  -->  %s  (via %s | %s)", _c(source), _c(target), first(dataflow), first(job))


def node_type(name, is_target, is_source) -> Column:
    """target, sap, file, excel, sql, source or transform, in this order of precedence (PRJ12)."""
    upper = F.upper(_c(name))
    out = F.when(_c(is_target), "tgt")
    for prefix, kind in (("SAP.", "sap"), ("FILE:", "file"), ("EXCEL:", "excel"), ("SQL:", "sql")):
        out = out.when(upper.startswith(prefix), kind)
    return out.when(_c(is_source), "src").otherwise("xfm")


def short_label(name, most: int = 22) -> Column:
    """The last segment of a name, with an ellipsis where it is long (PRJ13)."""
    last = F.element_at(F.split(_c(name), r"[.|/]"), -1)
    return F.when(F.length(last) > most, F.concat(F.substring(last, 1, most - 1), F.lit("…"))).otherwise(last)


#: Beginning of a transformation type -> badge. Fixed values.
BADGES = {"TABLE_COMPARISON": "Ck", "SQL": "SQL", "PIVOT": "Pv", "REVERSE_PIVOT": "Rp", "SCD": "Scd", "HISTORY": "Scd", "SURROGATE": "Key", "KEY_GENERATION": "Key", "ROW_ROUTING": "Case", "CASE": "Case"}


def mapping_badge(kind, is_direct, formula) -> Column:
    """The badge of a mapping: by its type, else direct, constant or formula (PRJ14)."""
    upper, text = F.upper(F.coalesce(_c(kind), F.lit(""))), F.coalesce(trimmed(formula), F.lit(""))
    out = None
    for begin, badge in BADGES.items():
        out = (F if out is None else out).when(upper.startswith(begin), badge)
    return out.when(_c(is_direct) | (text == ""), "direct").when(text.rlike(r"^('[^']*'|[0-9.]+)$"), "const").otherwise("formula")


def column_label(source, target, expression, most: int = 58) -> Column:
    """`source → target` and the expression cut to a display width (PRJ21)."""
    text = F.coalesce(_c(expression), F.lit(""))
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)
    return F.struct(F.concat(F.coalesce(_c(source), F.lit("")), F.lit(" → "), F.coalesce(_c(target), F.lit(""))).alias("label"), cut.alias("expression"))


#: Calls that aggregate and words that branch. Fixed values.
AGGREGATES, BRANCHES = ("SUM", "COUNT", "MIN", "MAX", "AVG"), ("CASE", "DECODE", "IFTHENELSE", "NVL", "IF")


def formula_semantics(x) -> Column:
    """Functions, nesting depth, flags, complexity, category and risk of a formula (PRJ25; the thresholds are ours).

    Complexity is the number of calls and operators; risk is HIGH from a complexity of 8 or a nesting of 4, MEDIUM from 3
    or 2, else LOW.
    """
    text = F.regexp_replace(F.coalesce(present(x), F.lit("")), "'[^']*'", "''")
    calls = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1), F.upper)))
    steps = F.transform(F.split(F.regexp_replace(text, r"[^()]", ""), ""), lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0))
    nesting = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["top"], a["now"] + s).alias("top")), lambda a: a["top"])
    has = lambda words: F.regexp_like(text, F.lit(rf"(?i)\b({'|'.join(words)})\b"))
    size = (F.regexp_count(text, F.lit(_CALL)) + F.regexp_count(text, F.lit(r"[-+*/]|\|\||<>|[<>=]"))).cast("int")
    risk = F.when((size >= 8) | (nesting >= 4), "HIGH").when((size >= 3) | (nesting >= 2), "MEDIUM").otherwise("LOW")
    kind = F.when(text == "", "PASS_THROUGH").when(has(AGGREGATES), "AGGREGATION").when(has(BRANCHES), "CONDITIONAL").when(F.size(calls) > 0, "FUNCTION").when(size > 0, "ARITHMETIC").otherwise("PASS_THROUGH")
    return F.struct(F.array_join(calls, ",").alias("functions_used"), nesting.alias("nesting_depth"), has(AGGREGATES).alias("has_aggregation"), has(BRANCHES).alias("has_conditional"), size.alias("complexity"), kind.alias("category"), risk.alias("risk"))


def is_complex(complexity, nesting, has_aggregation, has_conditional, risk) -> Column:
    """Formulas that need a reader's attention (FLT12)."""
    return (_c(complexity) >= 3) | (_c(nesting) >= 2) | _c(has_aggregation) | _c(has_conditional) | _c(risk).isin("HIGH", "CRITICAL")
