"""Rewrites of dump DDL and the kind of each statement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE, strip

# The dialect rewrites for schema documents, in order, as
# (pattern, replacement). Flags: i = any case, s = dot matches line ends,
# m = $ at each line end, d = only \n ends a line, U = Unicode classes.
NORMALIZE_RULES = [
    # version comments of dump tools, line comments, backticks
    (r"(?s)/\*!.*?\*/", ""),
    (r"(?dm)--.*?(\n|$)", "\n"),
    (r"`([^`]+)`", "$1"),
    # auto-increment
    (r"(?iU)\bAUTO_INCREMENT\b", "AUTOINCREMENT"),
    (r"(?iU)(\b\w+\b\s+(?!INT|INTEGER)[^,]+)\s+AUTOINCREMENT", "$1"),
    # referential actions
    (r"(?iU)\bON\s+(UPDATE|DELETE)\s+\w+(\s+\w+)*", ""),
    # column types
    (r"(?iU)\bVARCHA[R]?\b(\(\d+\))?", "TEXT"),
    (r"(?iU)\bTIMESTAMP\b", "TEXT"),
    (r"(?iU)\bDATETIME\b", "TEXT"),
    (r"(?iU)\bTINYINT\b", "INTEGER"),
    (r"(?iU)\bBIGINT\b", "INTEGER"),
    (r"(?iU)\bDECIMAL\(\d+,\d+\)\b", "REAL"),
    # table options
    (r"(?iU)\bENGINE\s*=\s*\w+\b", ""),
    (r"(?iU)\bDEFAULT\s+CHARSET\s*=\s*\w+\b", ""),
    (r"(?iU)\bCOLLATE\s*=\s*\w+\b", ""),
    (r"(?iU)\bCHARACTER\s+SET\s+\w+\b", ""),
    (r"(?dU)\)\s*=[\d\w\s]+$", ")"),
    # keys and the commas they leave behind
    (r"(?iU),\s*UNIQUE\s+KEY\s+\w+\s*\((\w+)\)", ", UNIQUE ($1)"),
    (r"(?iU),\s*KEY\s+\w+\s*\((\w+)\)\s*(?=(,|\)))", ""),
    (r"(?U),(\s*\))", "$1"),
]

# The further rewrites of a CREATE TABLE before it is loaded, in order.
CLEAN_RULES = [
    (r"(?iU)ENGINE=\w+", ""),
    (r"(?iU)AUTO_INCREMENT=\d+", ""),
    (r"(?i)DEFAULT CURRENT_TIMESTAMP ON UPDATE CURRENT_TIMESTAMP", ""),
    (r"(?i)ON UPDATE [^,\n]+", ""),
    (r"(?iU)\bint\b", "INTEGER"),
    (r"(?i)decimal\([^\)]*\)", "REAL"),
    (r"(?i)COLLATE [^ ]+", ""),
    (r"(?i)CHARACTER SET [^ ]+", ""),
    (r"(?i)COMMENT '[^']*'", ""),
    (r"(?U),?\s*KEY `[^`]+` \([^\)]+\)", ""),
    (r"(?U),?\s*UNIQUE KEY `[^`]+` \([^\)]+\)", ""),
    (r"(?U),\s*\)", ")"),
]

# A text in single quotes, or in double ones, which dumps also use.
LITERAL = r"(?:'(?:[^']++|'')*+'|\"(?:[^\"]++|\"\")*+\")"
LEADING_COMMENTS = r"(?s)^(?:\s++|(?:--|#)[^\n]*+(?:\n|\z)|/\*.*?\*/)++"
COMMENTS = r"(?s)(" + LITERAL + r"|`[^`]*+`)|(?:--|#)[^\n]*+|/\*.*?\*/"
# The start of a routine, whose statements are its own and not the dump's.
ROUTINE = (
    r"(?is)^create\s+(?:or\s+replace\s+)?(?:temp\s+|temporary\s+)?(?:definer\s*=\s*\S+\s+)?"
    r"(?:trigger|procedure|function|event)\b"
)


def _apply(rules: list[tuple[str, str]], c: Column) -> Column:
    return reduce(lambda text, rule: F.regexp_replace(text, *rule), rules, c)


def _one_line(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_ddl(stmt: Column) -> Column:
    """A CREATE TABLE in the form kept as a schema document."""
    return _one_line(_apply(NORMALIZE_RULES, stmt))


def clean_ddl(stmt: Column) -> Column:
    """A normalised CREATE TABLE in the form used to declare the table."""
    return _one_line(_apply(CLEAN_RULES, stmt))


def strip_leading_comments(stmt: Column) -> Column:
    """A statement without the comments before it; most begin and end with neither comment nor white
    space, and are told by two characters instead of by all."""
    bare = F.regexp_replace(stmt, LEADING_COMMENTS, "")
    stripped = strip(F.when(stmt.rlike(r"^(?:\s|--|#|/\*)"), bare).otherwise(stmt))
    may_begin = F.contains(F.lit(WHITESPACE + "-#/"), F.substring(stmt, 1, 1))
    may_end = F.contains(F.lit(WHITESPACE), F.substring(stmt, -1, 1))
    return F.when(may_begin | may_end, stripped).otherwise(stmt)


def strip_comments(stmt: Column) -> Column:
    """Drop comments, but nothing that stands inside a literal."""
    return strip(F.regexp_replace(stmt, COMMENTS, "$1"))


def statement_kind(stmt: Column) -> Column:
    """``create_table``, ``insert`` or ``other``, told by how the statement starts."""
    word = F.lower(F.substring(stmt, 1, 6))  # a pattern that fails is tried at every character
    return (
        F.when((word == "create") & stmt.rlike(r"(?i)^create\s+table\b"), "create_table")
        .when((word == "insert") & stmt.rlike(r"(?i)^insert\s+into\b"), "insert")
        .otherwise("other")
    )


def table_name(stmt: Column) -> Column:
    """The table that a CREATE TABLE or INSERT INTO names, else the empty string."""
    return F.regexp_extract(
        stmt,
        r"(?iU)^(?:create\s+table(?:\s+if\s+not\s+exists)?|insert\s+into)\s+"
        r"(?:[`\"]?\w+[`\"]?\.)?[`\"]?(\w+)",
        1,
    )
