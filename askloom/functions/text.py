"""Small text helpers shared by the other column modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Drop white space of every kind at both ends (``trim`` drops blanks only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def shorten(c: Column, limit: int) -> Column:
    """The first ``limit`` characters, with ``...`` where something was cut."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def file_path(c: Column) -> Column:
    """A path as the file system knows it; in file metadata it is percent-encoded."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def fill(template: str, **values: Column) -> Column:
    """Put columns into the ``{name}`` slots of a template."""
    parts, rest = [], template
    while rest:
        slots = [(rest.find("{%s}" % name), name) for name in values]
        found = sorted((at, name) for at, name in slots if at >= 0)
        if not found:
            break
        at, name = found[0]
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[name])
        rest = rest[at + len(name) + 2 :]
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)
