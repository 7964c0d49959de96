"""Column builders that decode keys, codes, years and dates written in several ways.

All are built-in expressions (whole-stage codegen); an entry that denotes
nothing gives NULL, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BETWEEN = r"[\s\u00a0\u200b-\u200d\ufeff\"'`\u00b4\u2018\u2019\u201c\u201d_:\-\u2010-\u2015()\[\]{}#]+"


def hex_number(c: Column, digits: int = 16) -> Column:
    """The hexadecimal number of at most ``digits`` (<= 16) digits in ``c``, as signed 64-bit BIGINT.

    Case, blanks, quotes, brackets and separators between digits do not matter;
    leading zeros do not count.  Anything else is NULL.
    """
    s = F.regexp_replace(c, _BETWEEN, "")
    s = F.regexp_extract(s, rf"^(?:0[xX])?0*([0-9A-Fa-f]{{1,{digits}}})$", 1)
    return F.conv(F.nullif(s, F.lit("")), 16, -10).cast("bigint")


def hex_text(c: Column, digits: int = 16) -> Column:
    """The zero-filled upper-case text of a number from :func:`hex_number`."""
    return F.lpad(F.hex(c), digits, "0")


def code_number(c: Column, digits: int = 3, prefix: str = "[A-Za-z]*") -> Column:
    """A decimal code of at most ``digits`` digits as INT: blanks, quotes, a prefix, leading zeros and ``.0`` do not count."""
    s = F.regexp_replace(c, r"[\s\u00a0\ufeff\"'#:_\-]+", "")
    s = F.regexp_extract(s, rf"^(?:{prefix})0*([0-9]{{1,{digits}}})(?:\.0*)?$", 1)
    return F.nullif(s, F.lit("")).cast("int")


def code_text(c: Column, digits: int = 3) -> Column:
    return F.lpad(c.cast("string"), digits, "0")


def calendar_year(c: Column) -> Column:
    """The four-digit year (1900-2099) in a year or date written in any usual way, as INT; NULL if there is none."""
    s = c.cast("string")
    y = F.regexp_extract(s, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:$|[^0-9]|[0-9]{4}(?:$|[^0-9]))", 1)
    late = F.regexp_extract(s, r"(?:^|[^0-9])[0-9]{4}((?:19|20)[0-9]{2})(?:$|[^0-9])", 1)
    return F.coalesce(F.nullif(y, F.lit("")), F.nullif(late, F.lit(""))).cast("int")


def int_date(c: Column) -> Column:
    """A yyyyMMdd integer as DATE; NULL if it is no date."""
    return F.try_to_date(c.cast("string"), "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd")))


def name_key(c: Column) -> Column:
    """A name for comparison: lower case, each run of blanks, hyphens and underscores one underscore; empty is NULL."""
    s = F.regexp_replace(F.lower(c), r"[\s\u00a0\ufeff_\-\u2010-\u2015]+", "_")
    return F.nullif(F.regexp_replace(s, r"^_+|_+$", ""), F.lit(""))


def odd_flag(c: Column) -> Column:
    """1 for an odd code, 0 for an even one, NULL for NULL."""
    return F.pmod(c, F.lit(2)).cast("int")
