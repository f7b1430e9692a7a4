"""SQL-text expressions: extraction from responses, normalization, feature flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusql.functions.text import WS, _c, collapse_ws, py_strip

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# Statement keywords that mark a response line as SQL (prefix test on the
# upper-cased text):
SQL_START_KEYWORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "WITH", "CREATE")
# Substrings tested per query by the per-example feature flags, in output order:
#   JOINS: JOIN | SUBQUERY: SELECT after the first FROM | AGGREGATION: COUNT( SUM(
#   AVG( MAX( MIN( | GROUP BY | HAVING | ORDER BY | SET OPS: INTERSECT UNION EXCEPT
#   | LIKE | NESTED: more than one SELECT
AGGREGATE_CALLS = ("COUNT(", "SUM(", "AVG(", "MAX(", "MIN(")
SET_OP_WORDS = ("INTERSECT", "UNION", "EXCEPT")
# Bucket names of the corpus-level feature distribution (no SUBQUERY bucket):
DISTRIBUTION_FEATURES = ("JOIN", "Aggregation", "GROUP BY", "HAVING", "ORDER BY",
                         "Nested/Subquery", "Set Operations", "LIKE")
# Names of the per-example flags, in output order:
FLAG_NAMES = ("JOINS", "SUBQUERY", "AGGREGATION", "GROUP BY", "HAVING", "ORDER BY", "SET OPS", "LIKE", "NESTED")
# A fenced block (only the tag "sql" is part of the fence) and a leading statement:
FENCE_PATTERN = r"(?isU)```(?:sql)?\s*\n?(.*?)```"
LEADING_PATTERN = r"(?s)^(.*?)(?:;|\n\n|$)"
# ---------------------------------------------------------------------------

# Tokenizer for normalization: quoted text of three kinds, both comment kinds,
# runs of plain characters, any other single character.
SQL_TOKEN_PATTERN = (
    r"""(?s)'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[^'"`\-/]+|."""
)

_KW_ALT = "|".join(SQL_START_KEYWORDS)


def starts_with_sql_keyword(c) -> Column:
    return F.upper(_c(c)).rlike(f"^(?:{_KW_ALT})")


def extract_sql(response) -> Column:
    """Struct ``(sql, strategy)``: SQL text pulled out of a free-text response.

    1 fenced block (language tag ``sql`` only) -> its body, stripped
    2 text starts with a statement keyword -> up to the first ';', blank line or end
    3 first line starting with a keyword -> that line without trailing ';'
    4 otherwise the whole (stripped) text
    """
    r = py_strip(response)
    fenced = py_strip(F.regexp_extract(r, FENCE_PATTERN, 1))
    leading = py_strip(F.regexp_extract(r, LEADING_PATTERN, 1))
    lines = F.transform(F.split(r, "\n"), lambda ln: py_strip(ln))
    sql_lines = F.filter(lines, lambda ln: starts_with_sql_keyword(ln))
    first_line = py_strip(F.regexp_replace(F.element_at(sql_lines, 1), ";+$", ""))
    return (
        F.when(r.rlike(FENCE_PATTERN), F.struct(fenced.alias("sql"), F.lit("fenced_block").alias("strategy")))
        .when(starts_with_sql_keyword(r),
              F.struct(leading.alias("sql"), F.lit("leading_keyword").alias("strategy")))
        .when(F.size(sql_lines) > 0,
              F.struct(first_line.alias("sql"), F.lit("keyword_line").alias("strategy")))
        .otherwise(F.struct(r.alias("sql"), F.lit("whole_text").alias("strategy")))
    )


def normalize_sql(sql) -> Column:
    """Canonical text for exact match.

    Comments become one space, letters outside quoted text are lower-cased,
    trailing white space and ';' are removed, white-space runs collapse to one
    space. Quoted text keeps its case; the collapse also runs inside it.
    """
    tokens = F.regexp_extract_all(_c(sql), F.lit(SQL_TOKEN_PATTERN), 0)
    mapped = F.transform(
        tokens,
        lambda t: F.when(t.rlike(r"^['\"`]"), t)
        .when(t.startswith("--") | t.startswith("/*"), F.lit(" "))
        .otherwise(F.lower(t)),
    )
    joined = F.array_join(mapped, "")
    stripped = F.regexp_replace(joined, rf"(?U)[{WS[1:-1]};]+$", "")
    return F.trim(collapse_ws(stripped))


def execution_text(sql) -> Column:
    """Query text as submitted for execution: stripped, trailing ';' removed."""
    return py_strip(F.regexp_replace(py_strip(sql), r"(?U)[\s;]+$", ""))


def feature_flags(sql) -> Column:
    """``array<string>`` of per-query feature flags, by raw substring tests."""
    q = F.upper(_c(sql))

    def has_any(words):
        cond = F.lit(False)
        for w in words:
            cond = cond | q.contains(w)
        return cond

    conditions = (q.contains("JOIN"), q.rlike(r"(?s)FROM.*SELECT"), has_any(AGGREGATE_CALLS), q.contains("GROUP BY"),
                  q.contains("HAVING"), q.contains("ORDER BY"), has_any(SET_OP_WORDS), q.contains("LIKE"),
                  q.rlike(r"(?s)SELECT.*SELECT"))
    arr = F.array(*[F.when(cond, F.lit(name)) for name, cond in zip(FLAG_NAMES, conditions)])
    return F.filter(arr, lambda x: x.isNotNull())


def distribution_indicators(sql) -> list[Column]:
    """One 0/1 column per distribution bucket (names in DISTRIBUTION_FEATURES)."""
    q = F.upper(_c(sql))
    aggs = F.lit(False)
    for w in AGGREGATE_CALLS:
        aggs = aggs | q.contains(w)
    sets = F.lit(False)
    for w in SET_OP_WORDS:
        sets = sets | q.contains(w)
    conds = [
        q.contains("JOIN"),
        aggs,
        q.contains("GROUP BY"),
        q.contains("HAVING"),
        q.contains("ORDER BY"),
        q.rlike(r"(?s)SELECT.*SELECT"),
        sets,
        q.contains("LIKE"),
    ]
    return [c.cast("int") for c in conds]
