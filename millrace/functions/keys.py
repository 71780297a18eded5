"""Reading keys that were written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that may surround a key; a fixed value.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def stripped(c: Column | str) -> Column:
    """Text without surrounding white space, Unicode spaces included; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(BLANKS))


def blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(stripped(c), F.lit("")) == ""


def whole_number(c: Column | str) -> Column:
    """The value of a whole number in text (' 0501', '501.0', '+501' are all 501); null if it is none.

    Numbers beyond BIGINT and those with a fraction give null.
    """
    d = stripped(c).try_cast("decimal(38,6)")
    return F.when(d == F.floor(d), d).try_cast("bigint")
