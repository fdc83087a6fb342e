r"""Text primitives.

Character classes are spelled out so that results do not depend on the regex engine's idea of \s, \d and \b:
blanks are all Unicode separators and the ASCII controls that act as such, digits are all decimal digits, and a word
character is a letter, a number or an underscore.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"\p{Z}\t-\r\x1c-\x1f\x85"
#: The same one by one, for functions that take characters in place of a class.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Word edges: nothing of a word before, nothing of a word behind.
EDGE_L, EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bound(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of c with c worked out once; inside lambdas Catalyst shares no common parts.

    element_at keeps the type that it gives; get works it out for every row, down through all that is bound within.
    """
    return F.element_at(F.transform(F.array(c), fn), 1)


def strip(c: Column) -> Column:
    """Without blanks at either end."""
    return F.btrim(c, F.lit(BLANKS))


def lower_ascii(c: Column) -> Column:
    """Lower-cases A to Z only, whatever the locale."""
    return F.translate(c, _UPPER, _LOWER)


def lines(c: Column) -> Column:
    """Lines of a text, at every kind of line break; a break at the end opens no further line."""
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    # the usual break by itself, as a pattern of more is compiled for every text
    odd = c.rlike(r"[\x0b-\r\x1c-\x1e\x85\u2028\u2029]")
    return bound(F.when(odd, F.split(c, "\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]")).otherwise(F.split(c, "\n")), whole)


def fields(c: Column) -> Column:
    """Blank-separated pieces, none empty."""
    return F.regexp_extract_all(c, F.lit(f"[^{BLANK}]+"), F.lit(0))


def first_filled(*cs: Column) -> Column:
    """The first of the given texts that is not blank, stripped; empty if all are."""
    filled = [F.nullif(strip(c), F.lit("")) for c in cs]
    return F.coalesce(*filled, F.lit(""))


def float_repr(c: Column) -> Column:
    """Shortest decimal form of a double: plain from 1e-4 up to 1e16, with a two-digit exponent beyond."""
    s = c.cast("string")
    sign = F.when(s.startswith("-"), "-").otherwise("")
    bare = F.regexp_replace(s, "^-", "")
    mantissa, power = F.substring_index(bare, "E", 1), F.substring_index(bare, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    whole = F.rpad(F.substr(digits, F.lit(1), power + 1), power + 1, F.lit("0"))
    rest = F.when(F.length(digits) > power + 1, F.substr(digits, power + 2)).otherwise("0")
    plain = F.when(power >= 0, F.concat(whole, F.lit("."), rest)).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    short = F.when(F.length(digits) > 1, F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))).otherwise(digits)
    far = F.concat(short, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    far = F.when(F.abs(power) >= 100, F.concat(short, F.when(power < 0, "e-").otherwise("e+"), F.abs(power).cast("string"))).otherwise(far)
    special = F.when(F.isnan(c), "nan").when(bare == "Infinity", F.concat(sign, F.lit("inf")))
    shown = F.when(~bare.contains("E"), bare).when((power >= -4) & (power < 16), plain).otherwise(far)
    return F.coalesce(special, F.concat(sign, shown))
