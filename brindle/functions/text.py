"""Full-text search, similarity, hierarchies, networks and places."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full text: a vector is map<term, array<position>>


def to_vector(s: Column, stop: tuple[str, ...] = ()) -> Column:
    """Lower-cased words with their positions; stop words take up a position but are left out."""
    words = F.regexp_extract_all(F.lower(s), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    pairs = F.transform(words, lambda w, i: F.struct(w.alias("w"), (i + 1).alias("p")))
    pairs = F.filter(pairs, lambda x: ~x["w"].isin(*stop)) if stop else pairs
    grouped = lambda ps: F.map_from_entries(F.transform(F.array_distinct(F.transform(ps, lambda x: x["w"])), lambda w: F.struct(w, F.transform(F.filter(ps, lambda x: x["w"] == w), lambda x: x["p"]))))
    return F.transform(F.array(pairs), grouped)[0]


def strip(v: Column) -> Column:
    return F.array_sort(F.map_keys(v))


class Query:
    """A text query as a tree; matches(vector) is the Column that says whether it holds."""

    def __init__(self, op: str, *parts) -> None:
        self.op, self.parts = op, parts

    def __and__(self, other: Query) -> Query:
        return Query("&", self, other)

    def __or__(self, other: Query) -> Query:
        return Query("|", self, other)

    def __invert__(self) -> Query:
        return Query("!", self)

    def then(self, other: Query, distance: int = 1) -> Query:
        """Phrase: ``other`` that many words after this."""
        return Query("<->", self, other, distance)

    def rewritten(self, target: Query, by: Query) -> Query:
        """Every part that is ``target`` replaced (ts_rewrite)."""
        if self == target:
            return by
        return Query(self.op, *[p.rewritten(target, by) if isinstance(p, Query) else p for p in self.parts])

    def __eq__(self, other) -> bool:
        return isinstance(other, Query) and (self.op, self.parts) == (other.op, other.parts)

    def __hash__(self) -> int:
        return hash((self.op, self.parts))

    def numnode(self) -> int:
        return 1 + sum(p.numnode() for p in self.parts if isinstance(p, Query))

    def _positions(self, v: Column) -> Column:
        none = F.array().cast("array<int>")
        if self.op == "term":
            return F.coalesce(F.try_element_at(v, F.lit(self.parts[0])), none)
        if self.op == "<->":
            a, b = self.parts[0]._positions(v), self.parts[1]._positions(v)
            return F.array_intersect(F.transform(a, lambda p: p + self.parts[2]), b)
        raise ValueError("a phrase is made of words and phrases")

    def matches(self, v: Column) -> Column:
        if self.op == "term":
            return F.map_contains_key(v, self.parts[0])
        if self.op == "prefix":
            return F.exists(F.map_keys(v), lambda k: k.startswith(self.parts[0]))
        if self.op == "<->":
            return F.size(self._positions(v)) > 0
        if self.op == "!":
            return ~self.parts[0].matches(v)
        a, b = (p.matches(v) for p in self.parts)
        return a & b if self.op == "&" else a | b


def parse(query: str) -> Query:
    """to_tsquery: words, :* prefixes, & | ! <-> <n> and parentheses."""
    tokens = re.findall(r"<->|<\d+>|[&|!()]|[^\s&|!()<>]+", query.lower())
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def unit() -> Query:
        t = take()
        if t == "!":
            return ~unit()
        if t == "(":
            q = either()
            take()
            return q
        return Query("prefix", t[:-2]) if t.endswith(":*") else Query("term", t)

    def phrase() -> Query:
        q = unit()
        while (t := peek()) and t.startswith("<"):
            take()
            q = q.then(unit(), 1 if t == "<->" else int(t[1:-1]))
        return q

    def both() -> Query:
        q = phrase()
        while peek() == "&":
            take()
            q = q & phrase()
        return q

    def either() -> Query:
        q = both()
        while peek() == "|":
            take()
            q = q | both()
        return q

    return either()


def plain(text: str) -> Query:
    """plainto_tsquery: all the words."""
    words = text.lower().split()
    q = Query("term", words[0])
    for w in words[1:]:
        q = q & Query("term", w)
    return q


def rank(v: Column, terms: list[str], weight: float = 0.1) -> Column:
    """Rank of an OR of terms: each adds weight * (sum of 1 / n^2 over its n occurrences), scaled by 6 / pi^2 and the number of terms."""
    one = lambda t: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(F.coalesce(F.try_element_at(v, F.lit(t)), F.array().cast("array<int>"))), F.lit(1))), F.lit(0.0), lambda acc, n: acc + 1.0 / (n * n))
    total = sum((F.when(F.map_contains_key(v, t), one(t) * weight).otherwise(0.0) for t in terms), F.lit(0.0))
    return total / 1.64493406685 / len(terms)


# Similarity


def trigrams(s: Column) -> Column:
    """Distinct three-letter parts of the words, each padded with two blanks before and one behind."""
    words = F.regexp_extract_all(F.lower(s), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(words, of))))


def similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(F.size(F.array_union(x, y)) == 0, 0.0).otherwise(both / F.size(F.array_union(x, y)))


def word_similarity(a: Column, b: Column) -> Column:
    """The best similarity of a's trigrams to those of any run of b's, in their order.

    Each run is walked once from a shared trigram on; a trigram counts where none
    like it lies between the run's start and it. Trigrams are made once a row.
    """
    words = F.regexp_extract_all(F.lower(b), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  a lambda's argument is evaluated once
    before = lambda run, t, i: F.array_position(F.reverse(F.slice(run, 1, i)), t)  # noqa: E731  steps back to the same trigram, or 0
    marked = lambda x: F.transform(x["run"], lambda t, i: F.struct(F.array_contains(x["mine"], t).alias("hit"), bound(before(x["run"], t, i), lambda k: F.when(k == 0, -1).otherwise((i - k).cast("int"))).alias("last"), i.alias("at")))

    def step(acc: Column, t: Column, start: Column, most: Column) -> Column:
        new = t["last"] < start
        hits, others = acc["hits"] + (new & t["hit"]).cast("int"), acc["others"] + (new & ~t["hit"]).cast("int")
        return F.struct(hits.alias("hits"), others.alias("others"), F.greatest(acc["best"], hits / (most + others)).alias("best"))

    none = F.struct(F.lit(0).alias("hits"), F.lit(0).alias("others"), F.lit(0.0).alias("best"))
    walk = lambda m, s, n: F.aggregate(F.slice(m, s["at"] + 1, F.size(m)), none, lambda acc, t: step(acc, t, s["at"], n), lambda acc: acc["best"])
    best = lambda x: bound(marked(x), lambda m: F.array_max(F.transform(F.filter(m, lambda t: t["hit"]), lambda s: walk(m, s, F.size(x["mine"])))))
    whole = lambda x: F.when((F.size(x["run"]) == 0) | (F.size(x["mine"]) == 0), 0.0).when(x["run"].isNotNull() & x["mine"].isNotNull(), F.coalesce(best(x), F.lit(0.0)))
    return bound(F.struct(F.flatten(F.transform(words, of)).alias("run"), trigrams(a).alias("mine")), whole)


def levenshtein_within(a: Column, b: Column, most: int) -> Column:
    """The distance, or most + 1 if it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def difference(a: Column, b: Column) -> Column:
    """How many of the four characters of the sound codes agree."""
    x, y = F.soundex(a), F.soundex(b)
    return sum(((F.substring(x, k, 1) == F.substring(y, k, 1)).cast("int") for k in range(1, 5)), F.lit(0))


def unaccent(s: Column) -> Column:
    """Latin letters without their marks."""
    pairs = {"àáâãäå": "a", "èéêë": "e", "ìíîï": "i", "òóôõö": "o", "ùúûü": "u", "ç": "c", "ñ": "n", "ýÿ": "y"}
    pairs |= {k.upper(): v.upper() for k, v in pairs.items() if k != "ýÿ"} | {"Ý": "Y"}
    return F.translate(s, "".join(pairs), "".join(v * len(k) for k, v in pairs.items()))


# Hierarchies: labels joined by dots


def labels(p: Column) -> Column:
    return F.split(p, "\\.")


def nlevel(p: Column) -> Column:
    return F.when(p == "", 0).otherwise(F.size(labels(p)))


def subpath(p: Column, offset: int, length: int | None = None) -> Column:
    parts = labels(p)
    start = F.lit(offset) if offset >= 0 else F.size(parts) + offset
    count = F.size(parts) - start if length is None else (F.lit(length) if length >= 0 else F.size(parts) - start + length)
    return F.array_join(F.slice(parts, start + 1, count), ".")


def is_ancestor(a: Column, b: Column) -> Column:
    """a @> b: a is b or above it."""
    return (a == b) | F.startswith(b, F.concat(a, F.lit(".")))


def path_pattern(query: str) -> str:
    """A regular expression for a path query, over a path with a dot behind it.

    ``*`` any labels, ``*{n,m}`` so many; a label may end in * (a beginning) or @
    (any case); | separates choices, ! in front takes all others.
    """
    out = "^"
    for item in query.split("."):
        if m := re.fullmatch(r"\*(?:\{(\d*)(,?)(\d*)\})?", item):
            low, comma, high = m.groups() if "{" in item else ("", ",", "")
            out += "(?:[^.]+\\.){" + f"{low or 0}{',' + high if comma else ''}" + "}"
            continue
        parts = []
        for label in item.removeprefix("!").split("|"):
            body = re.escape(label.rstrip("*@%"))
            tail = label[len(label.rstrip("*@%")) :]
            parts.append(("(?i:" + body + ")" if "@" in tail else body) + ("[^.]*" if "*" in tail else ""))
        any_of = "(?:" + "|".join(parts) + ")\\."
        out += f"(?!{any_of})[^.]+\\." if item.startswith("!") else any_of
    return out + "$"


def path_matches(p: Column, query: str) -> Column:
    return F.concat(p, F.lit(".")).rlike(path_pattern(query))


def lca(*paths: Column) -> Column:
    """The longest path above all of them."""
    parts = [labels(p) for p in paths]
    most = F.least(*[F.size(x) for x in parts]) - 1 if len(parts) > 1 else F.size(parts[0]) - 1
    same = lambda i: F.forall(F.array(*[F.slice(x, 1, i) == F.slice(parts[0], 1, i) for x in parts]), lambda b: b)
    best = F.aggregate(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), F.lit(0), lambda acc, i: F.when(same(i), F.greatest(acc, i)).otherwise(acc))
    return F.array_join(F.slice(parts[0], 1, best), ".")


def headline(s: Column, terms: list[str], start: str = "<b>", end: str = "</b>") -> Column:
    """The text with the words of a query marked."""
    words = "|".join(re.escape(t) for t in terms)
    return F.regexp_replace(s, f"(?iu)(?<![\\p{{L}}\\p{{N}}])({words})(?![\\p{{L}}\\p{{N}}])", f"{start}$1{end}")


# Ids and digests


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC with SHA-256, in hexadecimal: two rounds of the digest over padded keys."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pads = [bytes(b ^ x for b in key.ljust(64, b"\0")) for x in (0x36, 0x5C)]
    inner = F.unhex(F.sha2(F.concat(F.lit(pads[0]), message), 256))
    return F.sha2(F.concat(F.lit(pads[1]), inner), 256)


#: Fixed value: the namespace of names that are URLs.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The id that a namespace and a name always have (version 5)."""
    h = F.substring(F.sha1(F.concat(F.lit(bytes.fromhex(namespace)), name.cast("binary"))), 1, 32)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8).cast("bigint")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


# Networks: IPv4 as text a.b.c.d/n


def host(ip: Column) -> Column:
    return F.split_part(ip, F.lit("/"), F.lit(1))


def masklen(ip: Column) -> Column:
    return F.coalesce(F.nullif(F.split_part(ip, F.lit("/"), F.lit(2)), F.lit("")).cast("int"), F.lit(32))


def ip_number(ip: Column) -> Column:
    return F.aggregate(F.transform(F.split(host(ip), "\\."), lambda x: x.cast("bigint")), F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x)


def ip_text(n: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(n, k).bitwiseAND(F.lit(255))).cast("string") for k in (24, 16, 8, 0)])


def network(ip: Column) -> Column:
    size = F.pow(F.lit(2.0), 32 - masklen(ip)).cast("bigint")
    return F.concat(ip_text(ip_number(ip) - F.pmod(ip_number(ip), size)), F.lit("/"), masklen(ip).cast("string"))


def broadcast(ip: Column) -> Column:
    size = F.pow(F.lit(2.0), 32 - masklen(ip)).cast("bigint")
    return F.concat(ip_text(ip_number(ip) - F.pmod(ip_number(ip), size) + size - 1), F.lit("/"), masklen(ip).cast("string"))


def in_network(ip: Column, net: Column) -> Column:
    """ip << net: strictly inside."""
    size = F.pow(F.lit(2.0), 32 - masklen(net)).cast("bigint")
    start = ip_number(net) - F.pmod(ip_number(net), size)
    return (masklen(ip) > masklen(net)) & (ip_number(ip) >= start) & (ip_number(ip) < start + size)


def merged_network(a: Column, b: Column) -> Column:
    """The smallest network that holds both addresses (inet_merge)."""
    apart = ip_number(a).bitwiseXOR(ip_number(b))
    bits = F.least(F.lit(32) - F.length(F.nullif(F.bin(apart), F.lit("0"))), masklen(a), masklen(b))
    bits = F.coalesce(bits, F.least(masklen(a), masklen(b)))
    return network(F.concat(host(a), F.lit("/"), bits.cast("string")))


# Places and boxes


def box_area(box: Column) -> Column:
    """Of struct<x1, y1, x2, y2>."""
    return F.abs(box["x2"] - box["x1"]) * F.abs(box["y2"] - box["y1"])


def box_center(box: Column) -> Column:
    return F.struct(((box["x1"] + box["x2"]) / 2).alias("x"), ((box["y1"] + box["y2"]) / 2).alias("y"))


def circle_area(radius: Column) -> Column:
    return F.pi() * radius * radius


def segments_overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Closed intervals with a point in common."""
    return (lo1 <= hi2) & (lo2 <= hi1)


#: Radius of the earth in metres (cube based) and in statute miles (point based).
EARTH_METRES, EARTH_MILES = 6378168.0, 3958.747716


def ll_to_earth(lat: Column, lon: Column) -> Column:
    a, b = F.radians(lat), F.radians(lon)
    return F.array(F.lit(EARTH_METRES) * F.cos(a) * F.cos(b), F.lit(EARTH_METRES) * F.cos(a) * F.sin(b), F.lit(EARTH_METRES) * F.sin(a))


def cube_distance(p: Column, q: Column, kind: str = "euclid") -> Column:
    gaps = F.zip_with(p, q, lambda x, y: F.abs(x - y))
    if kind == "euclid":
        return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x) if kind == "taxicab" else F.array_max(gaps)


def earth_distance(p: Column, q: Column) -> Column:
    """Along the surface."""
    return 2 * EARTH_METRES * F.asin(F.least(cube_distance(p, q) / (2 * EARTH_METRES), F.lit(1.0)))


def geo_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Miles between two points, by the haversine."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((a1 - a2) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(lon1 - lon2) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.least(F.sqrt(h), F.lit(1.0)))
