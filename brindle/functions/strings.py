"""Strings. Positions count from 1; negative or zero starts lie before the string."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def initcap(s: Column) -> Column:
    """Words are runs of letters and digits, whatever stands between them."""
    pieces = F.regexp_extract_all(s, F.lit("[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def substr(s: Column, start, length=None) -> Column:
    start = F.lit(start) if not isinstance(start, Column) else start
    if length is None:
        return F.substr(s, F.greatest(start, F.lit(1)))
    length = F.lit(length) if not isinstance(length, Column) else length
    end = start + length
    return F.when(length < 0, F.raise_error(F.lit("negative substring length not allowed"))).otherwise(
        F.substr(s, F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)), F.lit(0))))


def left(s: Column, n: int) -> Column:
    """A negative n leaves out the last characters."""
    return F.substring(s, 1, n) if n >= 0 else F.substr(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    """A negative n leaves out the first characters."""
    return F.substr(s, F.greatest(F.length(s) - n + 1, F.lit(1))) if n >= 0 else F.substr(s, F.lit(1 - n))


def concat(*parts: Column) -> Column:
    """Nulls count as empty."""
    return F.concat_ws("", *parts)


def chr_(code: Column) -> Column:
    """The character of a code point up to 65535, beyond 255 too."""
    return F.when(code < 256, F.char(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE"))


def btrim(s: Column, chars: str = " ") -> Column:
    return F.btrim(s, F.lit(chars))


def overlay(s: Column, by: Column, start: int, length: int | None = None) -> Column:
    return F.overlay(s, by, F.lit(start), F.lit(-1 if length is None else length))


def quote_literal(s: Column) -> Column:
    """In single quotes, with quotes doubled; a text with backslashes becomes an E'' literal."""
    doubled = F.replace(s, F.lit("'"), F.lit("''"))
    return F.when(F.contains(s, F.lit("\\")), F.concat(F.lit("E'"), F.replace(doubled, F.lit("\\"), F.lit("\\\\")), F.lit("'"))).otherwise(F.concat(F.lit("'"), doubled, F.lit("'")))


def quote_nullable(s: Column) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def quote_ident(s: Column, reserved: tuple[str, ...] = ("select", "from", "where", "table", "order", "group", "user")) -> Column:
    plain = s.rlike("^[a-z_][a-z0-9_]*$") & ~s.isin(*reserved)
    return F.when(plain, s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def regexp_replace(s: Column, pattern: str, by: str, flags: str = "") -> Column:
    """Only the first match, unless flags have g; i ignores case. ``by`` uses \\1 for groups."""
    java = by.replace("$", "\\$")
    for k in range(1, 10):
        java = java.replace(f"\\{k}", f"${k}")
    p = ("(?i)" if "i" in flags else "") + pattern
    if "g" in flags:
        return F.regexp_replace(s, p, java)
    inline, body = ("(?i)", p[4:]) if p.startswith("(?i)") else ("", p)
    shift = java
    for k in range(8, 0, -1):
        shift = shift.replace(f"${k}", f"${k + 1}")
    rest = f"{inline}(?s)^(.*?)(?:{body})(.*)$"
    groups = count_groups(body)
    return F.regexp_replace(s, rest, f"$1{shift}${groups + 2}")


def count_groups(pattern: str) -> int:
    """Capturing groups of a pattern: brackets outside of classes, without escapes and without (?, but for named ones."""
    n, at, inside = 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            at += pattern[at + 1 : at + 2] == "^"
            at += pattern[at + 1 : at + 2] == "]"
        elif c == "(" and (pattern[at + 1 : at + 2] != "?" or re.match(r"\(\?P?<[A-Za-z]", pattern[at:])):
            n += 1
        at += 1
    return n


def _groups(pattern: str) -> list[int]:
    """The groups that a match yields: its own, or the whole match without groups."""
    return list(range(1, count_groups(pattern) + 1)) or [0]


def regexp_match(s: Column, pattern: str) -> Column:
    """Groups of the first match (the whole match without groups); null if there is none."""
    found = [F.regexp_extract(s, pattern, k) for k in _groups(pattern)]
    return F.when(s.rlike(pattern), F.array(*found))


def regexp_matches(s: Column, pattern: str, flags: str = "") -> Column:
    """The groups (the whole match without groups) of the first match, or with g of all: an array of arrays."""
    p = ("(?i)" if "i" in flags else "") + pattern
    every = [F.regexp_extract_all(s, F.lit(p), F.lit(k)) for k in _groups(pattern)]
    rows = F.transform(F.arrays_zip(*[e.alias(f"g{k}") for k, e in enumerate(every)]), lambda r: F.array(*[r[f"g{k}"] for k in range(len(every))]))
    return rows if "g" in flags else F.slice(rows, 1, 1)


def regexp_split(s: Column, pattern: str) -> Column:
    return F.split(s, pattern)


def split_part(s: Column, delimiter: str, n: int) -> Column:
    return F.split_part(s, F.lit(delimiter), F.lit(n))


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n))


def encode(b: Column, form: str) -> Column:
    return {"hex": lambda: F.lower(F.hex(b)), "base64": lambda: F.base64(b)}[form]()


def decode(s: Column, form: str) -> Column:
    return {"hex": lambda: F.unhex(s), "base64": lambda: F.unbase64(s)}[form]()


def similar_to(s: Column, pattern: str, escape: str = "\\") -> Column:
    """SIMILAR TO: % and _ as in LIKE, the rest as in a regular expression over the whole text; what follows ``escape`` stands for itself."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if escape and c == escape and at + 1 < len(pattern):
            at += 1
            out += re.escape(pattern[at])
        else:
            out += {"%": ".*", "_": ".", ".": "\\.", "^": "\\^", "$": "\\$", "\\": "\\\\"}.get(c, c)
        at += 1
    return s.rlike(f"(?s)^(?:{out})$")


def parse_ident(s: Column) -> Column:
    """Parts of a dotted name: quoted ones as they are, others lower-cased."""
    parts = F.regexp_extract_all(s, F.lit('"(?:[^"]|"")*"|[^."]+'), F.lit(0))
    inner = lambda p: F.replace(F.substr(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))
    return F.transform(parts, lambda p: F.when(p.startswith('"'), inner(p)).otherwise(F.lower(F.trim(p))))


def get_bit(b: Column, n: int) -> Column:
    """Bit n of a byte string, counted from the least bit of its first byte."""
    byte = F.conv(F.hex(F.substring(b, n // 8 + 1, 1)), 16, 10).cast("int")
    return F.shiftright(byte, n % 8).bitwiseAND(F.lit(1))


def set_bit(b: Column, n: int, to: int) -> Column:
    at, mask = n // 8, 1 << n % 8
    byte = F.conv(F.hex(F.substring(b, at + 1, 1)), 16, 10).cast("int")
    new = byte.bitwiseOR(F.lit(mask)) if to else byte.bitwiseAND(F.lit(255 - mask))
    return F.concat(F.substring(b, 1, at), F.unhex(F.lpad(F.hex(new.cast("bigint")), 2, "0")), F.substr(b, F.lit(at + 2)))


def format_(template: str, *values: Column) -> Column:
    """format() with %s, %I, %L and %%, by position or as n$."""
    parts, at, nth = [], 0, 0
    while at < len(template):
        if template[at] != "%":
            end = template.find("%", at)
            end = len(template) if end < 0 else end
            parts.append(F.lit(template[at:end]))
            at = end
            continue
        at += 1
        if template[at] == "%":
            parts.append(F.lit("%"))
            at += 1
            continue
        digits = ""
        while template[at].isdigit():
            digits += template[at]
            at += 1
        if digits:
            nth, at = int(digits) - 1, at + 1
        value = values[nth].cast("string")
        parts.append({"s": lambda v: F.coalesce(v, F.lit("")), "I": quote_ident, "L": quote_nullable}[template[at]](value))
        nth, at = nth + 1, at + 1
    return F.concat(*parts) if parts else F.lit("")
