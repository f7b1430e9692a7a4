"""Prompt-text expressions built with ``concat``; templates are parsed once on the driver."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusql.functions.text import _c

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's text exactly.
INSTRUCTION_TEXT = "Given the database schema, write a SQL query that answers the question."
SYSTEM_PROMPT = (
    "You are a SQL expert. Given a database schema and a natural language question, "
    "generate the correct SQL query. Output ONLY the SQL query, nothing else."
)
ZERO_SHOT_HEADER = "Given the following database schema, write a SQL query that answers the question."
# Default template of the shared prompt formatter (no trailing newline) and the
# training config's block-scalar template (ends with a newline).
DEFAULT_PROMPT_TEMPLATE = (
    "Given the following database schema, write a SQL query that answers the question.\n"
    "\n"
    "Schema:\n"
    "{schema}\n"
    "\n"
    "Question: {question}\n"
    "\n"
    "SQL:"
)
CONFIG_PROMPT_TEMPLATE = DEFAULT_PROMPT_TEMPLATE + "\n"
# Few-shot wording of the evaluator ...
FEW_SHOT_HEADER = (
    "Given a database schema and a question, write the SQL query that answers the "
    "question. Here are some examples:\n"
)
# ... and of the shared formatter.
SHARED_FEW_SHOT_HEADER = (
    "Given the following database schema, write a SQL query that answers the "
    "question. Here are some examples:\n"
)
# Parts of a few-shot text, around number, schema, question and SQL:
EXAMPLE_MARK, TURN_MARK = "### Example ", "### Your Turn"
SCHEMA_MARK, QUESTION_MARK, SQL_MARK = "Schema:\n", "\n\nQuestion: ", "\n\nSQL:"
# ---------------------------------------------------------------------------


def zero_shot_prompt(schema, question) -> Column:
    return F.concat(
        F.lit(ZERO_SHOT_HEADER + "\n\nSchema:\n"), _c(schema),
        F.lit("\n\nQuestion: "), _c(question), F.lit("\n\nSQL:"),
    )


def template_prompt(template: str | None, schema, question) -> Column:
    """``template.format(schema=..., question=...)`` as a ``concat``.

    Values are inserted once, so braces inside a schema are never re-expanded.
    Unknown fields raise ``KeyError`` like ``str.format``.
    """
    template = DEFAULT_PROMPT_TEMPLATE if template is None else template
    values = {"schema": _c(schema), "question": _c(question)}
    parts: list[Column] = []
    for literal, field, spec, conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if field not in values:
                raise KeyError(field)
            if spec or conv:
                raise ValueError(f"format spec/conversion not supported for {{{field}}}")
            parts.append(values[field])
    return F.concat(*parts) if parts else F.lit("")


def few_shot_prompt(schema, question, examples) -> Column:
    """Evaluator few-shot text; ``examples`` is ``array<struct<schema, question, output>>``
    already in slot order."""
    blocks = F.transform(
        _c(examples),
        lambda ex, i: F.concat(
            F.lit("\n" + EXAMPLE_MARK), (i + 1).cast("string"),
            F.lit("\n" + SCHEMA_MARK), ex["schema"],
            F.lit(QUESTION_MARK), ex["question"],
            F.lit(SQL_MARK + " "), ex["output"], F.lit("\n"),
        ),
    )
    tail = F.concat(F.lit("\n" + TURN_MARK + "\n" + SCHEMA_MARK), _c(schema),
                    F.lit(QUESTION_MARK), _c(question), F.lit(SQL_MARK))
    return F.array_join(F.concat(F.array(F.lit(FEW_SHOT_HEADER)), blocks, F.array(tail)), "\n")


def shared_few_shot_prompt(schema, question, examples) -> Column:
    """Shared-formatter few-shot text; examples carry the SQL under ``sql``."""
    blocks = F.transform(
        _c(examples),
        lambda ex, i: F.concat(
            F.lit(EXAMPLE_MARK), (i + 1).cast("string"),
            F.lit("\n\n" + SCHEMA_MARK), ex["schema"],
            F.lit(QUESTION_MARK), ex["question"],
            F.lit(SQL_MARK + " "), ex["sql"], F.lit("\n"),
        ),
    )
    tail = F.concat(F.lit(TURN_MARK + "\n\n" + SCHEMA_MARK), _c(schema),
                    F.lit(QUESTION_MARK), _c(question), F.lit(SQL_MARK))
    return F.array_join(F.concat(F.array(F.lit(SHARED_FEW_SHOT_HEADER)), blocks, F.array(tail)), "\n")


def chat_messages(prompt) -> Column:
    """``array<struct<role, content>>``: system message then the user prompt."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), _c(prompt).alias("content")),
    )
