"""Prompt texts for generation and review."""

from __future__ import annotations

from pyspark.sql import Column

from .text import fill

# The prompt for generating SQL and the one for reviewing it.
GENERATION_PROMPT = """You are a {dialect} expert. Generate a {dialect} query for this question using ONLY the schema below.

SCHEMA:
{schema}

QUESTION: {question}

Generate result in JSON format
result={
    "sql_query": "sql query",
    "summary": "summary of the query"
}
RULES:
1. Return ONLY the JSON result
2. Do NOT include explanations
3. Use correct table/column names from schema
4. Query must be syntactically valid
5. If question is ambiguous, make reasonable assumptions

JSON RESULT:"""

REVIEW_PROMPT = """
Please review this SQL query for correctness.

Database Schema:
{schema}

User Question:
{question}

Generated SQL Query:
{sql}

Please respond with exactly one of these options:
- VALID (if the query is correct)
- FIXED: [corrected SQL query] (if you can fix it)
- INVALID (if it cannot be fixed)

Do not include any other text or explanations.
"""

# What stands between two schema documents in each prompt.
GENERATION_SEPARATOR = "\n\n"
REVIEW_SEPARATOR = "\n"


def build_prompt(schema: Column, question: Column, dialect: str = "SQL") -> Column:
    """The generation prompt; null where the schema text is null."""
    template = GENERATION_PROMPT.replace("{dialect}", dialect)
    return fill(template, schema=schema, question=question)


def build_review_prompt(schema: Column, question: Column, sql: Column) -> Column:
    return fill(REVIEW_PROMPT, schema=schema, question=question, sql=sql)
