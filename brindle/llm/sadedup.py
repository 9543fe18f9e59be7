"""Removal of byte strings that repeat anywhere, by suffix arrays built with induced sorting.

Every byte covered by a ``length``-byte string that also starts somewhere else
goes. Strings are sharded by content: a window's anchor is the place of its
smallest 32-byte hash, so equal windows have anchors at equal offsets; windows
are grouped by anchor and offset (in blocks of 128), and a group's key is the
hash of the bytes that all its windows share. Keys found once cannot hold a
repeat. A key whose stretches are all equal is a repeat as it stands. The other
keys' distinct stretches meet in shards, and each shard's suffix array and
permuted longest common prefixes say which windows are equal.

Induced sorting here is vectorised: one step handles all entries that a bucket
holds at the time. The reduced string of named leftmost-smaller substrings is
put in order by rank doubling; suffix_array(recursive=True) does so by induction
again, which takes forty times as long, as its buckets are nearly as many as its
symbols.

Keys with very many distinct stretches (a passage in many surroundings) are cut
finer, in blocks of 16, before they meet. Texts equal as a whole are one text
that occurs twice (by length, 64-bit hash and SHA-256). Stretches are equal if both
their key and their own hash agree (64 bits each). Null and shorter texts have no
window and stay whole; an empty table gives an empty result. Ids may repeat or be
null. Extra columns are ignored, whatever they are called. Long texts are looked
at in parts of a megabyte, overlapping by a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import chunks, discard, gather, materialize, mix64, ranges, ready, scatter, scattered, shuffle_partitions, span_hash, tidy, utf8

GRAM, BLOCK, FINE, MANY = 32, 128, 16, 2048
#: What is known of a stretch when it leaves its chunk.
ONCE, TWICE, COVERED = 1, 2, 3
#: Bytes of text hashes that may be broadcast; beyond that, texts are joined by a shuffle.
BROADCAST = 32 << 20


# Suffix arrays ---------------------------------------------------------------


def _stable(key: np.ndarray) -> np.ndarray:
    return np.argsort(key, kind="stable")


class _Induced:
    def __init__(self, t: np.ndarray) -> None:
        """t: uint16, its last entry 0 and the only 0."""
        n = len(t)
        self.t, self.n = t, n
        differs = np.flatnonzero(t[:-1] != t[1:])
        at = np.searchsorted(differs, np.arange(n - 1))
        up = t[differs] < t[differs + 1]
        self.small = np.append(up[at], True)  # suffix smaller than the next one
        self.lms = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        self.count = np.bincount(t, minlength=int(t.max()) + 1)
        self.end = np.cumsum(self.count)
        self.start = self.end - self.count

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes, given the leftmost-smaller ones in order (or in any order, to sort their substrings)."""
        t, small, start, end = self.t, self.small, self.start, self.end
        sa = np.full(self.n, -1, np.int32)
        ch = t[lms]
        order = _stable(ch)
        lms, ch = lms[order], ch[order]
        own = np.bincount(ch, minlength=len(start))
        sa[(end - own)[ch] + np.arange(len(ch)) - (np.cumsum(own) - own)[ch]] = lms
        head = start.copy()
        present = np.flatnonzero(self.count)

        def push(batch: np.ndarray, large: bool) -> None:
            j = batch[batch > 0] - 1
            j = j[small[j] != large]
            if not len(j):
                return
            ch = t[j]
            order = _stable(ch)
            j, ch = j[order], ch[order]
            first = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
            size = np.diff(np.append(first, len(ch)))
            nth = np.arange(len(ch)) - np.repeat(first, size)
            if large:
                sa[head[ch] + nth] = j
                head[ch[first]] += size
            else:
                sa[tail[ch] - 1 - nth] = j
                tail[ch[first]] -= size

        for c in present:  # larger suffixes, from the front
            a = start[c]
            while a < head[c]:
                batch, a = sa[a : head[c]].copy(), head[c]
                push(batch, True)
            if own[c]:
                push(sa[end[c] - own[c] : end[c]], True)
        tail = end.copy()
        tail[0] = 0
        sa[0] = self.n - 1
        for c in present[::-1]:  # smaller suffixes, from the back
            b = end[c]
            while b > tail[c]:
                batch, b = sa[tail[c] : b][::-1].copy(), tail[c]
                if c:
                    push(batch, False)
            push(sa[start[c] : head[c]][::-1].copy(), False)
        return sa


def suffix_array(t: np.ndarray, depth: int | None = None, recursive: bool = False) -> np.ndarray:
    """Suffixes of t in order (of their first ``depth`` symbols at least); t's last entry is the only 0.

    recursive: put the reduced string in order by this function again (to the
    full depth) instead of by rank doubling.
    """
    if len(t) < 2:
        return np.zeros(len(t), np.int32)
    s = _Induced(t)
    sa = s.induce(s.lms)
    place = np.full(s.n, -1, np.int64)
    place[s.lms] = np.arange(len(s.lms))
    found = sa[place[sa] >= 0]  # leftmost-smaller suffixes by their substrings
    until = np.append(s.lms[1:], s.n - 1)[place[found]] + 1
    until = np.minimum(until, s.n)
    h = span_hash(mix64(t.astype(np.uint64) + np.uint64(1)), found, until)
    same = np.zeros(len(found), bool)
    same[1:] = (h[1:] == h[:-1]) & ((until - found)[1:] == (until - found)[:-1])
    rank = np.zeros(len(found), np.int64)
    rank[place[found]] = np.cumsum(~same) - 1
    if not same.any():
        order = np.argsort(rank, kind="stable")
    elif recursive:
        order = suffix_array(np.append(rank + 1, 0), None, True)[1:]  # without the end, which comes first
    else:
        order = np.argsort(_doubled(rank, None if depth is None else depth // 2 + 2), kind="stable")
    return s.induce(s.lms[order])


def _doubled(rank: np.ndarray, depth: int | None) -> np.ndarray:
    """Order of all suffixes of a string of names, by doubling; places that are settled are left alone."""
    m = len(rank)
    first = np.argsort(rank, kind="stable")
    r = rank[first]
    heads = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    size = np.diff(np.append(heads, m))
    out = np.zeros(m, np.int64)
    out[first] = np.repeat(heads, size)  # rank: where its group begins
    open_ = first[np.repeat(size, size) > 1]
    step = 1
    while len(open_) and (depth is None or step < depth):
        after = np.where(open_ + step < m, out[np.minimum(open_ + step, m - 1)] + 1, 0)
        order = np.lexsort((after, out[open_]))
        at, group, after = open_[order], out[open_][order], after[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(at)))
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        within = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        out[at] = np.repeat((group + within)[heads], size)
        open_ = at[np.repeat(size, size) > 1]
        step *= 2
    return out


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By position: length that its suffix shares with the one before it in the array.

    Where position and partner both follow the last position's, which were equal
    there, the length is one less; only the others are compared, all in step.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    own[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (t[:-1] != t[np.maximum(before[:-1], 0)])
    own |= before < 0
    at = np.flatnonzero(own)
    length = np.zeros(len(at), np.int64)
    wide = np.concatenate([t, np.zeros(8, t.dtype)]).astype(np.uint64)
    word = wide[:n] | wide[1 : n + 1] << np.uint64(16) | wide[2 : n + 2] << np.uint64(32) | wide[3 : n + 3] << np.uint64(48)
    live = np.flatnonzero(before[at] >= 0)
    a, b = at[live], before[at[live]]
    while len(live):
        same = (word[a] == word[b]) & (np.maximum(a, b) + 4 <= n)
        stop = ~same
        for k in range(4):
            x, y = a[stop] + k, b[stop] + k
            ok = (np.maximum(x, y) < n) & (length[live[stop]] % 4 == k)
            ok[ok] = t[x[ok]] == t[y[ok]]
            length[live[stop]] += ok
        live, a, b = live[same], a[same], b[same]
        length[live] += 4
        a, b = a + 4, b + 4
    last = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    index = np.cumsum(own) - 1
    return np.maximum(length[index] - (np.arange(n) - last), 0)


def repeats(stretches: list[np.ndarray], own: np.ndarray, length: int) -> list[np.ndarray]:
    """For each stretch, which of its first ``own`` starts begin a window that another start (of any stretch) begins too."""
    sizes = np.array([len(x) for x in stretches])
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    t = np.ones(int(sizes.sum()) + len(sizes) + 1, np.uint16)
    t[-1] = 0
    t[ranges(begins, sizes)] = np.concatenate(stretches).astype(np.uint16) + 2
    sa = suffix_array(t, length)
    shared = common_prefixes(t, sa)[sa]
    group = np.cumsum(shared < length)
    mine = np.zeros(len(t), bool)
    mine[ranges(begins, own)] = True
    mine = mine[sa]
    often = np.bincount(group[mine], minlength=int(group[-1]) + 1) > 1
    flag = np.zeros(len(t), bool)
    flag[sa[mine]] = often[group[mine]]
    return [flag[b : b + o] for b, o in zip(begins, own)]


# Sharding --------------------------------------------------------------------


def stretches_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(key, content hash, text, start, windows, shift) of each stretch of consecutive windows with one anchor and block of offsets."""
    n, wide = len(data), length - GRAM + 1
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4)
    m = n - GRAM + 1
    if m < wide:
        return none
    step, unstep = common._power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(common._BYTE[data] * step[:n], out=sums[1:])
    p = mix64((sums[GRAM:] - sums[:m]) * unstep[:m])
    p = (p & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    q = np.concatenate([p, np.full(-m % wide, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, wide)
    low = np.minimum.accumulate(q, 1).ravel()[wide - 1 : m]
    high = np.minimum.accumulate(q[:, ::-1], 1)[:, ::-1].ravel()[: m - wide + 1]
    anchor = (np.minimum(low, high) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    s = ranges(offsets[:-1], np.maximum(np.diff(offsets) - length + 1, 0))  # windows inside one text
    if not len(s):
        return none
    a = anchor[s]
    block = (a - s) // BLOCK
    new = np.ones(len(s), bool)
    new[1:] = (a[1:] != a[:-1]) | (block[1:] != block[:-1])
    head = np.flatnonzero(new)
    windows = np.diff(np.append(head, len(s)))
    lo, a, block = s[head], a[head], block[head]
    core = a - BLOCK * block
    key = mix64(_span(sums, unstep, core, core + length - BLOCK + 1) ^ block.astype(np.uint64))
    content = mix64(_span(sums, unstep, lo, lo + windows + length - 1) ^ mix64(((core - lo) << 10 | windows).astype(np.uint64)))
    text = np.searchsorted(offsets, lo, "right") - 1
    return key, content, text, lo - offsets[text], windows, core - lo


def _span(sums, unstep, a, b):
    return mix64((sums[b] - sums[a]) * unstep[a])


def _pieces(column: pa.Array, length: int, most: int = 1 << 20, long: int = 1 << 22):
    """chunks(), but a text above ``long`` bytes comes in parts of ``most`` window starts, each with its place in the text."""
    for a, data, offsets in chunks(column, most):
        if len(data) <= long:
            yield a, data, offsets, 0
            continue
        for begin in range(0, len(data) - length + 1, most):
            part = data[begin : begin + most + length - 1]
            yield a, part, np.array([0, len(part)]), begin


def _by_text(text: np.ndarray, columns: dict[str, np.ndarray], kind: int, names: list[str]) -> pa.RecordBatch:
    """One row for each text: its hash and its entries of each column; columns of other kinds are null."""
    found, of = np.unique(text, return_inverse=True)
    b = scatter(of, columns)
    cols = [pa.array(np.full(len(found), kind, np.int32)), pa.array(found, pa.int64())]
    return pa.RecordBatch.from_arrays(cols + [b.column(c) if c in columns else pa.nulls(len(found), pa.binary()) for c in names], ["kind", "text_hash", *names])


NAMES = ["lo", "size", "key", "flags"]
SCHEMA = "kind int, text_hash bigint, lo binary, size binary, key binary, flags binary"


def candidates(docs: DataFrame, length: int) -> DataFrame:
    """Kind 0: covered bytes (lo, size) of texts, known already. Kind 1: stretches (lo, windows | shift << 16, key, flags) that have to be compared."""
    parts = shuffle_partitions(docs, 1.0)

    @tidy
    def cut(batches):
        for batch in batches:
            hashes = batch.column("text_hash").to_numpy()
            _, once = np.unique(hashes, return_index=True)  # equal texts of a batch are cut once
            batch = batch.take(pa.array(np.sort(once)))
            hashes = batch.column("text_hash").to_numpy()
            for a, data, offsets, begin in _pieces(batch.column("text"), length):
                key, content, text, lo, windows, shift = stretches_of(data, offsets, length)
                lo += begin
                own, size = hashes[a + text], (windows | shift << 16).astype(np.int32)
                # a stretch that a chunk has twice is covered wherever it is: one goes on to its key, and all to their texts
                order = np.lexsort((content, key))
                k, c = key[order], content[order]
                first = np.ones(len(k), bool)
                first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
                times = np.diff(np.append(np.flatnonzero(first), len(k)))
                often = order[np.repeat(times, times) > 1]
                on = order[first]
                state = np.concatenate([np.where(times > 1, TWICE, ONCE), np.full(len(often), COVERED)]).astype(np.int8)
                to = np.concatenate([key[on], mix64(own[often].view(np.uint64))])
                at = np.concatenate([on, often])
                yield scatter((to % np.uint64(parts)).astype(np.int64), {"key": key[at], "content": content[at], "text": own[at], "lo": lo[at], "windows": size[at], "state": state})

    @tidy
    def meet(batches):
        g = gather(batches, {"key": "u8", "content": "u8", "text": "i8", "lo": "i8", "windows": "i4", "state": "i1"})
        known = g["state"] == COVERED
        if known.any():
            yield _by_text(g["text"][known], {"lo": g["lo"][known], "size": (g["windows"][known] & 0xFFFF).astype(np.int64) + length - 1}, 0, NAMES)
            g = {c: v[~known] for c, v in g.items()}
        order = np.lexsort((-g["state"], g["lo"], g["text"], g["content"], g["key"]))
        key, content, text, lo, windows, state = (g[c][order] for c in ("key", "content", "text", "lo", "windows", "state"))
        del g, order
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (text[1:] != text[:-1]) | (lo[1:] != lo[:-1])
        key, content, text, lo, windows, state = (v[new] for v in (key, content, text, lo, windows, state))
        if not len(key):
            return
        kind = np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])])
        kinds = np.flatnonzero(kind)  # where each distinct stretch of a key begins
        copies = np.diff(np.append(kinds, len(key)))
        twice = (copies > 1) | (np.maximum.reduceat(state, kinds) == TWICE)
        heads = np.flatnonzero(np.concatenate([[True], key[kinds][1:] != key[kinds][:-1]]))
        distinct = np.repeat(np.diff(np.append(heads, len(kinds))), np.diff(np.append(heads, len(kinds))))
        often = np.repeat(twice, copies)
        yield _by_text(text[often], {"lo": lo[often], "size": (windows[often] & 0xFFFF).astype(np.int64) + length - 1}, 0, NAMES)
        ask = kinds[distinct > 1]
        flags = twice[distinct > 1] | (distinct[distinct > 1] > MANY) * 2
        yield _by_text(text[ask], {"lo": lo[ask], "size": windows[ask].astype(np.int64), "key": key[ask], "flags": flags.astype(np.uint8)}, 1, NAMES)

    return docs.mapInArrow(cut, scattered(["key", "content", "text", "lo", "windows", "state"])).repartition(parts, "bucket").mapInArrow(meet, SCHEMA)


def _texts_with(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """(text_hash, text, and the lists of entries) of texts that have entries, each once."""
    lists = entries.groupBy("text_hash").agg(*[F.collect_list(c).alias(c) for c in NAMES])
    wanted = entries.select("text_hash").distinct()
    small = wanted.count() * 8 <= BROADCAST
    texts = docs.join(F.broadcast(wanted) if small else wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    return texts.join(lists.hint("merge"), "text_hash")


def _entries(batch, i: int, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name)[i].as_py()), kind)


def compared(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """Covered bytes that the shards' suffix arrays find, in the form of kind 0."""
    total = asked.agg(F.sum(F.length("lo") / 8)).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total * (length + BLOCK) // (8 << 20)) + 1)

    @tidy
    def fetch(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column("text")[i].as_py().encode(), np.uint8)
                lo, windows, key, flags = (_entries(batch, i, c, k) for c, k in zip(NAMES, ("i8", "i8", "u8", "u1")))
                shift, windows = windows >> 16, windows & 0xFFFF
                fine = np.flatnonzero(flags & 2)
                if len(fine):  # cut by offset from the anchor in blocks of FINE, and keyed by the bytes that a block's windows share
                    low, high = (shift - windows + 1)[fine] // FINE, shift[fine] // FINE
                    block, of = ranges(low, high - low + 1), np.repeat(fine, high - low + 1)
                    first = np.maximum(0, shift[of] - (FINE * block + FINE - 1))
                    size = np.minimum(windows[of] - 1, shift[of] - FINE * block) - first + 1
                    core = lo[of] + shift[of] - FINE * block
                    wide = np.full(len(core), length - FINE + 1)
                    at = np.arange(len(core)) * (length - FINE + 1)
                    own = mix64(span_hash(data[ranges(core, wide)], at, at + wide) ^ mix64(key[of] ^ block.astype(np.uint64)))
                    rest = np.flatnonzero((flags & 2) == 0)
                    lo, windows = np.concatenate([lo[rest], lo[of] + first]), np.concatenate([windows[rest], size])
                    key, flags = np.concatenate([key[rest], own]), np.concatenate([flags[rest], flags[of]])
                stretch = [data[a : a + w + length - 1].tobytes() for a, w in zip(lo.tolist(), windows.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key % np.uint64(parts)).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(np.full(len(lo), batch.column("text_hash")[i].as_py())), pa.array(lo), pa.array(windows), pa.array((flags & 1).astype(np.int32)), pa.array(stretch, pa.binary())],
                    ["bucket", "key", "text_hash", "lo", "windows", "known", "data"])

    @tidy
    def compare(batches):
        key, text, lo, windows, known, held = [], [], [], [], [], []
        for batch in batches:
            key.append(batch.column("key").to_numpy())
            text.append(batch.column("text_hash").to_numpy())
            lo.append(batch.column("lo").to_numpy())
            windows.append(batch.column("windows").to_numpy())
            known.append(batch.column("known").to_numpy())
            held += batch.column("data").to_pylist()
        if not held:
            return
        key, text, lo, windows, known = (np.concatenate(v) for v in (key, text, lo, windows, known))
        order = np.argsort(key, kind="stable")
        ends = np.flatnonzero(np.append(key[order][1:] != key[order][:-1], True)) + 1
        sizes = np.cumsum([len(held[i]) for i in order])
        begin = 0
        while begin < len(order):  # whole keys, about a megabyte at a time
            far = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + (1 << 20)))
            end = int(ends[min(np.searchsorted(ends, max(far, begin + 1)), len(ends) - 1)])
            some = order[begin:end]
            begin = end
            flags = repeats([np.frombuffer(held[i], np.uint8) for i in some], windows[some], length)
            out_text, out_lo, out_size = [], [], []
            for i, f in zip(some.tolist(), flags):
                if known[i] or not f.any():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[False], f, [False]])))
                a, b = edge[::2], edge[1::2]
                out_lo.append(lo[i] + a)
                out_size.append(b - a + length - 1)
                out_text.append(np.full(len(a), text[i]))
            if out_text:
                yield _by_text(np.concatenate(out_text), {"lo": np.concatenate(out_lo), "size": np.concatenate(out_size)}, 0, NAMES)

    fetched = _texts_with(docs, asked).mapInArrow(fetch, "bucket int, key bigint, text_hash bigint, lo bigint, windows bigint, known int, data binary")
    return fetched.repartition(parts, "bucket").mapInArrow(compare, SCHEMA)


def removed(docs: DataFrame, length: int = 400, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept has the bytes that stay."""
    ready(docs.sparkSession)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), t.alias("text"), F.xxhash64(t).alias("text_hash"), F.octet_length(t).cast("bigint").alias("n_bytes"))
    texts = rows.where(F.col("n_bytes") >= length).select("text_hash", "text")
    twice = materialize(texts.groupBy("text_hash", F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("copies")).where("copies > 1").select("text_hash").distinct(), "equal-texts")
    found = materialize(candidates(texts, length), "stretches")
    covered = materialize(compared(texts, found.where("kind = 1"), length).union(found.where("kind = 0")).join(twice, "text_hash", "left_anti"), "covered")
    discard(found)

    @tidy
    def cut(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                data = batch.column("text")[i].as_py().encode()
                lo, size = (_entries(batch, i, c, "i8") for c in ("lo", "size"))
                order = np.argsort(lo, kind="stable")
                lo, end = lo[order], np.maximum.accumulate((lo + size)[order])
                head = np.flatnonzero(np.concatenate([[True], lo[1:] > end[:-1]]))  # of each run that is removed
                begin, end = lo[head], end[np.append(head[1:], len(lo)) - 1]
                kept = b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(data)]))
                out.append((int((end - begin).sum()), len(begin), kept))
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("text_hash"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary())))], ["text_hash", "n_removed", "n_spans", "kept"])

    done = _texts_with(texts, covered).mapInArrow(cut, "text_hash bigint, n_removed bigint, n_spans bigint, kept binary")
    whole = twice.select("text_hash", F.lit(None).cast("bigint").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(b"").alias("kept"))
    verdict = materialize(done.union(whole), "verdicts")
    discard(covered, twice)
    # both sides are tables: a text that many rows have is split when they meet
    out = rows.join(verdict.hint("merge").withColumn("cut", F.lit(True)), "text_hash", "left")
    out = out.withColumn("kept", F.when(F.col("cut"), F.col("kept")).otherwise(F.col("text").cast("binary")))
    gone = F.when(F.col("cut"), F.coalesce("n_removed", "n_bytes")).otherwise(0)
    return out.select(F.col("id").alias(id), "n_bytes", gone.cast("bigint").alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept")
