"""Whitespace, lines and case in the way the rules expect them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters that count as blank, and those that end a line besides LF.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def strip(c: Column) -> Column:
    """Remove blanks of every kind at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def unify_lines(c: Column) -> Column:
    """Make LF the only line end (the regex runs only on rows that hold another one)."""
    odd = f"[{LINE_ENDS}]"
    return F.when(c.rlike(odd), F.regexp_replace(c, f"\r\n|{odd}", "\n")).otherwise(c)


def chomp(c: Column) -> Column:
    """Drop one final LF."""
    return F.when(F.endswith(c, F.lit("\n")), F.left(c, F.length(c) - 1)).otherwise(c)
