"""Typed replacement: values of high cardinality become symbols.

The rules are ordered, for a later one must not see what an earlier one consumed. Each rule starts with a cheap
one-character test, so that the word-edge test runs only where a match can begin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.text import BLANK, EDGE_L, EDGE_R

_X = "[0-9A-Fa-f]"
_N = r"\p{Nd}"
_OCTET = rf"(?:25[0-5]|2[0-4]{_N}|1?{_N}{{1,2}})"
_HEX_START = rf"(?={_X})"
_NUM_START = rf"(?={_N})"


def _run(least: int, most: int | None = None) -> str:
    return rf"{_HEX_START}(?<!{_X}){_X}{{{least},{most or ''}}}(?!{_X})"


UUID = rf"{_HEX_START}{EDGE_L}{_X}{{8}}(?:-{_X}{{4}})(?:-[1-5]{_X}{{3}})(?:-[89ABab]{_X}{{3}})-{_X}{{12}}{EDGE_R}"
IPV6 = rf"{_HEX_START}{EDGE_L}{_X}{{1,4}}:(?:{_X}{{1,4}}:){{1,6}}{_X}{{1,4}}{EDGE_R}"
IPV4 = rf"{_NUM_START}{EDGE_L}{_OCTET}(?:\.{_OCTET}){{3}}{EDGE_R}"
_CLOCK = rf"[T{BLANK}]{_N}{{2}}(?::{_N}{{2}}){{2}}(?:\.{_N}+)?"
_ZONE = rf"(?:[+-]{_N}{{2}}:?{_N}{{2}}|Z)"
ISO_TIME = rf"{_NUM_START}{EDGE_L}{_N}{{4}}(?:-{_N}{{2}}){{2}}(?:{_CLOCK})?{_ZONE}?{EDGE_R}"
EPOCH = rf"{_NUM_START}{EDGE_L}{_N}{{10,13}}{EDGE_R}"
HASH, HEX = _run(32, 64), _run(16)
#: 24 or more of the base-64 alphabet with its padding, unless only capitals and + / make it up,
#: or a percent sign that starts no triplet stands within three characters of it.
_PCT = rf"%(?!{_X}{{2}})"
BASE64 = (
    r"(?=[A-Za-z0-9+/])(?<![A-Za-z0-9+/])(?<!%[\s\S])(?<!%[\s\S]{2})"
    rf"(?!(?<=%)(?!{_X}{{2}}))"
    r"(?=[A-Z+/]*[a-z0-9]|[+/]+(?![A-Za-z0-9+/]))"
    r"(?>[A-Za-z0-9+/]{24,}={0,2}(?![A-Za-z0-9+/]))"
    rf"(?!{_PCT})(?![\s\S]%)(?![\s\S]{{2}}%)"
)
PORT = rf":(?<!{_N}:)[0-9]{{1,5}}(?!{_N})"
VERSION = rf"{_NUM_START}(?<!{_N}){_N}+\.(?:{_N}+\.){{0,2}}{_N}+(?!{_N})"
#: The four odd letters are those that fold to ASCII letters when case is ignored.
#: A match begins where a run of them does, and the run goes up to the colon, so nothing is tried again from within it.
_NAME = r"[.\-A-Za-z0-9\u017f\u212a\u0130\u0131]"
AUTHORITY_PORT = rf"((?<!{_NAME}){_NAME}++:)[0-9]{{1,5}}(?=[/{BLANK}])"
HOST_PORT = rf"(?dm)^([Hh][Oo][Ss\u017f][Tt]:[{BLANK}]*[^:{BLANK}]+:)[0-9]{{1,5}}[{BLANK}]*$"

Rule = tuple[str, str]
GENERIC_RULES: list[Rule] = [
    (UUID, "<UUID>"),
    (IPV6, "<IPV6>"),
    (IPV4, "<IPV4>"),
    (ISO_TIME, "<TS>"),
    (EPOCH, "<TS>"),
    (HASH, "<HASH>"),
    (HEX, "<HEX>"),
    (BASE64, "<B64>"),
]


def replaced(c: Column, *rules: Rule) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, *rule), rules, c)


def bucketed(c: Column, min_digits: int = 6) -> Column:
    """Stand-alone digit runs of at least min_digits become <NUM_POW10_k>, k one less than their length, 12 at most."""
    exact = [(rf"{_NUM_START}{EDGE_L}{_N}{{{n}}}{EDGE_R}", f"<NUM_POW10_{max(0, n - 1)}>") for n in range(max(min_digits, 1), 13)]
    rest = (rf"{_NUM_START}{EDGE_L}{_N}{{{max(13, min_digits)},}}{EDGE_R}", "<NUM_POW10_12>")
    return F.when(c.rlike(rf"{_N}{{{max(min_digits, 1)}}}"), replaced(c, *exact, rest)).otherwise(c)


def percent_normalized(c: Column) -> Column:
    """%hh in capitals, and a space between it and a letter or digit that follows."""
    pieces = F.regexp_extract_all(c, F.lit(rf"%{_X}{{2}}|[^%]+|%"), F.lit(0))
    raised = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(rf"^%{_X}{{2}}\z"), F.upper(p)).otherwise(p)), "")
    spaced = F.regexp_replace(raised, "(%[0-9A-F]{2})(?=[0-9A-Za-z])", "$1 ")
    return F.when(c.contains("%"), spaced).otherwise(c)


def generic(c: Column, buckets: bool = True, min_digits: int = 6) -> Column:
    typed = replaced(c, *GENERIC_RULES, (PORT, ":<PORT>"))
    return bucketed(typed, min_digits) if buckets else typed


def http(c: Column, buckets: bool = True, min_digits: int = 6, versions: bool = True) -> Column:
    """As generic, for requests: triplets normalised first, versions typed, ports only in authorities and Host lines."""
    typed = replaced(percent_normalized(c), *GENERIC_RULES)
    if versions:
        typed = replaced(typed, (VERSION, "<VER>"))
    typed = replaced(typed, (AUTHORITY_PORT, "$1<PORT>"), (HOST_PORT, "$1<PORT>"))
    return bucketed(typed, min_digits) if buckets else typed
