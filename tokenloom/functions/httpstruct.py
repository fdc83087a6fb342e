"""HTTP requests as tagged token strings.

A request, given as tagged sections, as raw text or as columns, becomes one line of tokens: method, path segments,
query keys with value placeholders, protocol, headers and body, each behind its tag. Everything is one Column
expression; no row leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.noise import is_base64, unprintable
from tokenloom.functions.text import BLANK, bound, fields, lines, lower_ascii, strip

TAGS = [f"<{name}>" for name in "METHOD URL PROT HDR BODY JSON FORM RAW TRUNC BYTES URLENC STR NUM QK QVAL COOKIE_K COOKIE_V AUTH_BEARER AUTH_BASIC LIST".split()]
_X = "[0-9A-Fa-f]"
_PCT = f"%{_X}{{2}}"
_UUID = rf"{_X}{{8}}(?:-{_X}{{4}})(?:-[1-5]{_X}{{3}})(?:-[89ABab]{_X}{{3}})-{_X}{{12}}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d{1,2})"
_CLOCK = r"[T \t\n\r]\d\d:\d\d:\d\d(?:\.\d+)?"


@dataclass(frozen=True)
class Marks:
    sep: str = "<SEP>"
    eol: str = "<EOL>"
    empty: str = "<EMPTY>"
    key_prefix: str = "<K:"
    key_suffix: str = ">"


def _whole(pattern: str) -> str:
    return rf"^(?:{pattern})\z"


def _end_to_end(*arrays: Column) -> Column:
    """Arrays one after another; concat takes several times as long where it is not compiled."""
    return F.flatten(F.array(*arrays))


def number_tag(digits: Column, min_digits: int) -> Column:
    n = F.length(digits)
    bucket = F.concat(F.lit("<NUM_POW10_"), F.least(F.lit(12), F.greatest(F.lit(0), n - 1)).cast("string"), F.lit(">"))
    return F.when(n < min_digits, "<NUM>").otherwise(bucket)


def hash_tag(c: Column) -> Column:
    """<HASH_32>, <HASH_40>, <HASH_64>, or <HASH> for other hex of 32 digits or more; else null."""
    n = F.length(c)
    sized = F.concat(F.lit("<HASH_"), n.cast("string"), F.lit(">"))
    return F.when(c.rlike(_whole(f"{_X}{{32,}}")), F.when(n.isin(32, 40, 64), sized).otherwise("<HASH>"))


def hex_tag(c: Column) -> Column:
    """<HEX_n> for hex of 16, 24, 32 or 64 digits, <HEX> for other hex of 16 digits or more; else null."""
    n = F.length(c)
    sized = F.concat(F.lit("<HEX_"), n.cast("string"), F.lit(">"))
    return F.when(c.rlike(_whole(f"{_X}{{16,}}")), F.when(n.isin(16, 24, 32, 64), sized).otherwise("<HEX>"))


def value_placeholder(c: Column, min_digits: int = 6) -> Column:
    """What kind of value a text is."""
    return bound(strip(c), lambda s: _stripped_placeholder(s, min_digits))


def _stripped_placeholder(s: Column, min_digits: int) -> Column:
    return (
        # most values are short words or numbers, which none of the other patterns takes
        F.when(s.rlike(r"^[A-Za-z_.\-]{1,15}\z"), "<STR>")
        .when(s.rlike(r"^[0-9]{1,9}\z"), number_tag(s, min_digits))
        .when(s == "", "<EMPTY>")
        .when(unprintable(s), "<BYTES>")
        .when(s.rlike(_PCT), "<URLENC>")
        .when(s.rlike(_whole(_UUID)), "<UUID>")
        .when(s.rlike(_whole(rf"{_OCTET}(?:\.{_OCTET}){{3}}")), "<IPV4>")
        .when(s.rlike(_whole(f"(?:{_X}{{1,4}}:){{2,7}}{_X}{{1,4}}")), "<IPV6>")
        .when(s.rlike(_whole(rf"\d{{4}}-\d\d-\d\d(?:{_CLOCK})?(?:[+-]\d\d:?\d\d|Z)?|\d{{10,13}}")), "<TS>")
        .when(s.rlike(_whole(f"{_X}{{32,}}")), hash_tag(s))
        .when(s.rlike(_whole(f"{_X}{{16,}}")), hex_tag(s))
        .when(is_base64(s), "<B64>")
        .when(s.rlike(_whole("[0-9]+")), number_tag(s, min_digits))
        .otherwise("<STR>")
    )


def _cut(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.array(F.substring(c, 1, most), F.lit("<TRUNC>"))).otherwise(F.array(c))


def key_tokens(c: Column, most: int = 64) -> Column:
    odd = lambda s: F.when(s == "", "<EMPTY>").when(unprintable(s), "<BYTES>").when(s.rlike(_PCT), "<URLENC>")
    return bound(strip(c), lambda s: bound(odd(s), lambda o: F.when(o.isNotNull(), F.array(o)).otherwise(_cut(s, most))))


def cookie_key_tokens(c: Column, most: int = 64) -> Column:
    return bound(strip(c), lambda s: _stripped_cookie_key(s, most))


def _stripped_cookie_key(s: Column, most: int) -> Column:
    edged = rf"(?<![0-9A-Za-z_]){_UUID}(?![0-9A-Za-z_])"
    typed = F.regexp_replace(F.regexp_replace(s, _PCT, "<URLENC>"), edged, "<UUID>")
    for n in (16, 24, 32, 64):
        typed = F.regexp_replace(typed, f"(?<!{_X}){_X}{{{n}}}(?!{_X})", f"<HEX_{n}>")
    typed = F.regexp_replace(typed, f"(?<!<HEX_)(?<!{_X}){_X}{{16,}}", "<HEX>")
    typed = F.regexp_replace(typed, "[0-9A-Za-z+/_-]{24,}={0,2}", "<B64>")
    odd = F.when(s == "", "<EMPTY>").when(unprintable(s), "<BYTES>")
    return F.when(odd.isNotNull(), F.array(odd)).otherwise(bound(typed, lambda t: _cut(t, most)))


def raw_value_tokens(c: Column, min_digits: int, most: int) -> Column:
    """The value itself if it is a word or a short number, else its placeholder."""
    shown = lambda tag: F.when(~tag.isin("<STR>", "<NUM>"), F.array(tag)).when(unprintable(c), F.array(F.lit("<BYTES>"))).otherwise(_cut(c, most))
    return bound(value_placeholder(c, min_digits), shown)


def pairs(c: Column, sep: str) -> Column:
    """Array of structs (k, v) from k=v pieces; no = gives an empty value, empty pieces are skipped."""
    parts = F.filter(F.split(c, sep), lambda p: p != "")
    at = lambda p: F.instr(p, "=")
    return F.transform(
        parts,
        lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(at(p) > 0, F.substr(p, at(p) + 1)).otherwise("").alias("v")),
    )


def query_tokens(c: Column, min_digits: int = 6) -> Column:
    return F.flatten(
        F.transform(
            pairs(c, "&"),
            lambda p: _end_to_end(F.array(F.lit("<QK>")), key_tokens(p["k"]), F.array(F.lit("<QVAL>"), value_placeholder(p["v"], min_digits))),
        )
    )


def cookie_tokens(c: Column, min_digits: int = 6) -> Column:
    return F.flatten(
        F.transform(
            pairs(c, ";"),
            lambda p: _end_to_end(F.array(F.lit("<COOKIE_K>")), cookie_key_tokens(p["k"]), F.array(F.lit("<COOKIE_V>"), value_placeholder(p["v"], min_digits))),
        )
    )


def _bare_url(c: Column) -> Column:
    return F.when(c.rlike(r"[\x00-\x20]"), F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+", ""), r"[\t\n\r]", "")).otherwise(c)


def _url_part(bare: Column, group: int) -> Column:
    """Path (1) or query (2) by the generic syntax of RFC 3986, whatever the scheme."""
    return F.regexp_extract(bare, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)(?:\?([^#]*))?", group)


def url_tokens(c: Column, min_digits: int = 6) -> Column:
    filled = lambda path, url: F.when(path == "", url).otherwise(path)

    def shown(url: Column, bare: Column) -> Column:
        return bound(_url_part(bare, 1), lambda path: bound(filled(path, url), lambda p: _path_tokens(url, bare, p, min_digits)))

    return bound(strip(c), lambda url: bound(_bare_url(url), lambda bare: shown(url, bare)))


def _path_tokens(url: Column, bare: Column, path: Column, min_digits: int) -> Column:
    none = F.array().cast("array<string>")

    def steps(segments: Column) -> Column:
        last = F.size(segments) - 1
        step = lambda seg, i: F.when(seg == "", none).otherwise(_end_to_end(raw_value_tokens(seg, min_digits, 64), F.when(i < last, F.array(F.lit("/"))).otherwise(none)))
        return F.flatten(F.transform(segments, step))

    rooted = F.when(path.startswith("/"), F.array(F.lit("/"))).otherwise(none)
    full = _end_to_end(rooted, bound(F.split(F.regexp_replace(path, "^/", ""), "/"), steps), query_tokens(_url_part(bare, 2), min_digits))
    return _end_to_end(F.array(F.lit("<URL>")), F.when(url == "", F.array(F.lit("<EMPTY>"))).otherwise(full))


def header_tokens(headers: Column, marks: Marks, min_digits: int) -> Column:
    def one(line: Column) -> Column:
        name = lower_ascii(strip(F.substring_index(line, ":", 1)))
        return bound(name, lambda n: bound(strip(F.substr(line, F.instr(line, ":") + 1)), lambda v: named(n, v)))

    def named(name: Column, value: Column) -> Column:
        typed = (
            F.when(name == "cookie", cookie_tokens(value, min_digits))
            .when((name == "authorization") & value.rlike("^[Bb][Ee][Aa][Rr][Ee][Rr] "), F.array(F.lit("<AUTH_BEARER>"), value_placeholder(F.substr(value, F.lit(8)), min_digits)))
            .when((name == "authorization") & value.rlike("^[Bb][Aa][Ss][Ii][Cc] "), F.array(F.lit("<AUTH_BASIC>"), value_placeholder(F.substr(value, F.lit(7)), min_digits)))
            .when(name == "authorization", F.array(value_placeholder(value, min_digits)))
            .otherwise(raw_value_tokens(value, min_digits, 256))
        )
        head = F.array(F.lit("<HDR>"), F.when(name == "", "<EMPTY>").otherwise(name), F.lit(marks.sep))
        return _end_to_end(head, typed, F.array(F.lit(marks.eol)))

    # a name of one character or more stands before the first colon
    return F.flatten(F.transform(F.filter(headers, lambda h: F.instr(h, ":") > 1), one))


def json_object_tokens(variant: Column, marks: Marks, min_digits: int) -> Column:
    """Keys in order, one level deep: kinds of values in place of values."""
    none = F.array().cast("array<string>")

    def shown(kind: Column, text: Column) -> Column:
        whole = (kind == "BIGINT") | kind.rlike(r"^DECIMAL\((?:19|[23]\d),0\)$")
        return (
            F.when(kind.isNull() | (kind == "VOID"), F.lit(marks.empty))
            .when(kind == "BOOLEAN", text)
            .when(whole, number_tag(text, min_digits))
            .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "<NUM>")
            .when(kind == "STRING", value_placeholder(text, min_digits))
            .otherwise("<JSON>")
        )

    def one(key: Column, value: Column) -> Column:
        tag = bound(F.schema_of_variant(value), lambda kind: bound(F.variant_get(value, "$", "string"), lambda text: shown(kind, text)))
        return F.array(F.concat(F.lit(marks.key_prefix), key, F.lit(marks.key_suffix)), F.lit(marks.sep), tag, F.lit(marks.eol))

    def all_of(members: Column) -> Column:
        return F.flatten(F.transform(F.array_sort(F.map_keys(members)), lambda key: bound(F.element_at(members, key), lambda value: one(key, value))))

    return F.coalesce(bound(F.variant_get(variant, "$", "map<string,variant>"), all_of), none)


def body_tokens(body: Column, marks: Marks, min_digits: int, max_len: int) -> Column:
    none = F.array().cast("array<string>")

    def typed(s: Column, value: Column, kind: Column) -> Column:
        raw = _end_to_end(F.array(F.lit("<RAW>")), _cut(s, max_len))
        return (
            F.when(kind.startswith("OBJECT"), _end_to_end(F.array(F.lit("<JSON>")), json_object_tokens(value, marks, min_digits)))
            .when(kind.startswith("ARRAY"), F.array(F.lit("<JSON>"), F.lit("<LIST>")))
            .when(s.startswith("{") | s.startswith("["), raw)
            .when(s.contains("&") & s.contains("="), _end_to_end(F.array(F.lit("<FORM>")), query_tokens(s, min_digits)))
            .otherwise(raw)
        )

    def parsed(s: Column) -> Column:
        value = F.when(s.startswith("{") | s.startswith("["), F.try_parse_json(s))
        whole = bound(value, lambda v: bound(F.schema_of_variant(v), lambda kind: typed(s, v, kind)))
        return F.when(s != "", _end_to_end(F.array(F.lit("<BODY>")), whole))

    return F.coalesce(bound(strip(body), parsed), none)


def from_parts(method: Column, url: Column, proto: Column, headers: Column, body: Column, marks: Marks = Marks(), min_digits: int = 6, max_len: int = 4096) -> Column:
    """Token string of a request given by its parts; headers is an array of lines. Nulls count as absent."""
    text = lambda c: F.coalesce(strip(c), F.lit(""))
    filled = lambda c: F.when(c == "", "<EMPTY>").otherwise(c)
    none = F.array().cast("array<string>")

    def request(r: Column) -> Column:
        method, url, proto = r["method"], r["url"], r["proto"]
        line = _end_to_end(F.array(F.lit("<METHOD>"), filled(method)), url_tokens(url, min_digits), F.array(F.lit("<PROT>"), filled(proto), F.lit(marks.eol)))
        return F.when((method != "") | (url != "") | (proto != ""), line).otherwise(none)

    first = bound(F.struct(text(method).alias("method"), text(url).alias("url"), text(proto).alias("proto")), request)
    tokens = _end_to_end(first, F.coalesce(header_tokens(headers, marks, min_digits), none), body_tokens(body, marks, min_digits, max_len))
    return F.array_join(F.array_remove(tokens, ""), " ")


_PARTS = ("method", "url", "proto")
#: A text without any of these has no tagged section.
_TAGGED = "<(?:METHOD|URL|PROT|HDR|BODY)>"


def _sections(ls: Column) -> Column:
    """Struct of the tagged sections in the lines; `seen` tells whether there was a tag."""
    none = F.array().cast("array<string>")
    start = F.struct(*(F.lit("").alias(p) for p in _PARTS), none.alias("headers"), none.alias("body"), F.lit("").alias("mode"), F.lit(False).alias("seen"))
    tag = {"method": "<METHOD>", "url": "<URL>", "proto": "<PROT>"}

    def step(acc: Column, line: Column) -> Column:
        hdr, bod = line.startswith("<HDR>"), line.startswith("<BODY>")
        named = F.lit(False)
        for t in tag.values():
            named = named | line.startswith(t)
        plain = ~(named | hdr | bod)
        grown = lambda name, mode: F.when(plain & (acc["mode"] == mode), F.concat(acc[name], F.array(line))).otherwise(acc[name]).alias(name)
        return F.struct(
            *(F.when(line.startswith(t), strip(F.substr(line, F.lit(len(t) + 1)))).otherwise(acc[p]).alias(p) for p, t in tag.items()),
            grown("headers", "hdr"),
            grown("body", "body"),
            F.when(hdr, "hdr").when(bod, "body").when(named, "").otherwise(acc["mode"]).alias("mode"),
            (acc["seen"] | ~plain).alias("seen"),
        )

    return F.aggregate(ls, start, step)


def structured(c: Column, marks: Marks = Marks(), min_digits: int = 6, max_len: int = 4096) -> Column:
    """Token string of a request given as tagged sections or as raw text; null gives an empty text.

    A text that is a single tag stays as it is. Longer texts than max_len are cut and end in <TRUNC>. Text that is
    neither loses its prose, as a raw request without a blank line has no body.
    """
    parted = lambda text: bound(_parts(text), lambda p: from_parts(*(p[k] for k in (*_PARTS, "headers", "body")), marks, min_digits, max_len))

    def shown(text: Column) -> Column:
        cut = lambda out: F.when(F.length(text) > max_len, F.trim(F.concat(out, F.lit(" <TRUNC>")))).otherwise(out)
        return bound(bound(F.substring(text, 1, max_len), parted), cut)

    def whole(c: Column) -> Column:
        out = bound(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), shown)
        return F.when(c.isNull(), "").otherwise(bound(strip(c), lambda bare: F.when(bare.rlike(r"^<[^>]+>\z"), bare).otherwise(out)))

    return bound(c, whole)


def _parts(text: Column) -> Column:
    """Struct of method, url, proto, headers and body. What is used more than once is bound, so that a row's lines are cut and read once."""
    none = F.array().cast("array<string>")
    word = lambda first, k: F.when(F.size(first) >= 2, F.coalesce(F.get(first, F.lit(k)), F.lit(""))).otherwise("")

    def raw(cut: Column) -> Column:
        head = F.when(cut > 0, F.substr(text, F.lit(1), cut - 1)).otherwise(text)
        body = strip(F.when(cut > 0, F.substr(text, cut + 2)).otherwise(""))

        def request(solid: Column) -> Column:
            rest = F.when(F.size(solid) > 1, F.slice(solid, F.lit(2), F.size(solid))).otherwise(none)
            named = lambda first: F.struct(*(word(first, k).alias(p) for k, p in enumerate(_PARTS)), rest.alias("headers"), body.alias("body"))
            return bound(fields(F.coalesce(F.get(solid, F.lit(0)), F.lit(""))), named)

        return bound(F.filter(lines(head), lambda x: x.rlike(f"[^{BLANK}]")), request)

    raw_parts = bound(F.instr(text, "\n\n"), raw)

    def tagged(s: Column) -> Column:
        body = strip(F.array_join(s["body"], "\n"))
        return F.when(s["seen"], F.struct(*(s[p].alias(p) for p in _PARTS), s["headers"].alias("headers"), body.alias("body")))

    return F.coalesce(F.when(text.rlike(_TAGGED), bound(_sections(lines(text)), tagged)), raw_parts)


def is_request(df: DataFrame) -> bool:
    """Whether df has a column that is a part of a request."""
    return bool({c.lower() for c in df.columns} & {"method", "url", "protocol", "proto", "headers", "body"})


def structured_row(df: DataFrame, marks: Marks = Marks(), min_digits: int = 6, max_len: int = 4096) -> Column:
    """Token string of a request whose parts are columns: method, url, protocol or proto, headers (lines, or a map by name) and body."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")
    headers = F.array().cast("array<string>")
    if "headers" in df.columns:
        if isinstance(df.schema["headers"].dataType, T.MapType):
            headers = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"].cast("string"), F.lit(": "), F.coalesce(e["value"].cast("string"), F.lit("None"))))
        else:
            headers = lines(part("headers"))
    proto = part("protocol") if "protocol" in df.columns else part("proto")
    return from_parts(part("method"), part("url"), proto, headers, part("body"), marks, min_digits, max_len)
