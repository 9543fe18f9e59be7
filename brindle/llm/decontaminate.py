"""Benchmark decontamination with suffix arrays over the training text.

Training documents are taken in shards of some megabytes. A shard's suffix
array holds its word suffixes, sorted by prefix doubling as far as a window
reaches or until a suffix differs from all others (``pruned``: only those whose first ``q`` words occur in a row in the
benchmark; no other suffix can match one for as long). Every benchmark suffix is
then found by binary search: the suffixes that share its window are one interval,
each entry of which is a verbatim match with its location and, extended, its full
length.

Words are runs of digits, letters and code points beyond ASCII, A-Z lower-cased.
A benchmark larger than ``block_bytes`` is broadcast in blocks, one after the
other, each no larger than that (or one item). Null and empty texts have no
words. Items without words never match; equal items are all reported, and those
without an id as null. Ids may
repeat: each row is judged alone. An empty benchmark hits nothing. Very long
texts are shards of their own. Extra columns pass through ``clean`` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_class, chunks, lower_ascii, materialize, mix64, per_row, ranges, ready, span_hash, tidy, trim, utf8, word_spans

#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text.
WORDS = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


class Benchmark:
    """Suffixes of a block of items, as numbers of their first q words; 0 ends a suffix."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = 10, pruned: bool = False) -> None:
        self.pruned = pruned
        self.names = [i for i, _ in items]
        data, offsets = utf8(pa.array([t or "" for _, t in items], pa.string()))
        low = lower_ascii(data)
        starts, ends, first = word_spans(low, offsets, WORDS)
        words = span_hash(low, starts, ends)
        sizes = np.diff(first)
        self.window = window
        self.full = np.minimum(sizes, window)  # words of an item's windows
        self.q = int(min(3, self.full[self.full > 0].min())) if (sizes > 0).any() else 1
        self.vocab, ids = np.unique(words, return_inverse=True)
        grams, inside = self._grams(ids, np.repeat(np.arange(len(sizes)), sizes))
        self.grams = np.unique(grams[inside])
        symbols = np.zeros(len(ids) + window + 1, np.int64)
        symbols[: len(ids)][inside] = np.searchsorted(self.grams, grams[inside]) + 1
        self.symbols = symbols
        item = np.repeat(np.arange(len(sizes)), sizes)
        left = first[1:][item] - np.arange(len(ids)) if len(ids) else np.zeros(0, np.int64)
        at = np.flatnonzero(left >= self.full[item]) if len(ids) else np.zeros(0, np.int64)
        self.suffix, self.item = at, item[at]  # suffixes that hold a whole window
        self.need = self.full[self.item] - self.q + 1  # symbols of a window
        self.left = left[at]  # words from there to the item's end

    def _grams(self, ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key of the q words from each position, and whether they are known and of one text."""
        n, q = len(ids), self.q
        key = np.zeros(n, np.uint64)
        inside = np.zeros(n, bool)
        if n >= q:
            part = ids[: n - q + 1].astype(np.uint64)
            ok = ids[: n - q + 1] >= 0
            for k in range(1, q):
                nxt = ids[k : n - q + 1 + k]
                part = mix64(part) ^ nxt.astype(np.uint64) if len(self.vocab) > 1 << 20 else part * np.uint64(1 << 21) + nxt.astype(np.uint64)
                ok = ok & (nxt >= 0)
            key[: n - q + 1] = part & np.uint64((1 << 63) - 1)
            inside[: n - q + 1] = ok & (row[: n - q + 1] == row[q - 1 :])
        return key, inside

    def _all_grams(self, gram: np.ndarray, inside: np.ndarray, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _grams(), and a key for those with words that the benchmark lacks too: by the words' hashes, above all keys of the benchmark's."""
        n, q = len(h), self.q
        own, whole = np.zeros(n, np.uint64), np.zeros(n, bool)
        if n >= q:
            part = h[: n - q + 1]
            for k in range(1, q):
                part = mix64(part) ^ h[k : n - q + 1 + k]
            own[: n - q + 1] = part
            whole[: n - q + 1] = row[: n - q + 1] == row[q - 1 :]
        return np.where(inside, gram, own | np.uint64(1 << 63)), whole

    def shard(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray | list]:
        """Matches of one shard: by text n_words, n_hit, longest; and pairs (text, item)."""
        rows = len(offsets) - 1
        low = lower_ascii(data)
        starts, ends, first = word_spans(low, offsets, WORDS)
        n_words = np.diff(first)
        nothing = {"n_words": n_words, "n_hit": np.zeros(rows, np.int64), "longest": np.zeros(rows, np.int64), "pairs": (np.zeros(0, np.int64),) * 2, "spans": (np.zeros(0, np.int64),) * 3}
        if not len(self.suffix) or not len(starts):
            return nothing
        h = span_hash(low, starts, ends)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        ids = np.where(self.vocab[at] == h, at, -1)
        row = np.repeat(np.arange(rows), n_words)
        gram, inside = self._grams(ids, row)
        known = np.flatnonzero(inside)
        known = known[self.grams[np.minimum(np.searchsorted(self.grams, gram[known]), len(self.grams) - 1)] == gram[known]]
        if self.pruned:
            here = known
        else:
            inside = np.zeros(len(ids), bool)
            inside[known] = True
            gram, inside = self._all_grams(gram, inside, h, row)
            here = np.flatnonzero(inside)
        if not len(here):
            return nothing
        depth = int(self.need.max())
        spread = np.arange(len(ids)) + row  # a place for a 0 behind every text
        array, ordered, begins = self._sorted(gram[here], spread[here], len(ids) + rows + depth + 1, depth)
        symbols = np.zeros(len(ids) + rows + depth + 1, np.int64)
        symbols[spread[here[ordered]]] = 2 * begins + 2  # even; an item's symbols that the shard lacks are odd
        first_gram = gram[here[ordered]]
        at = np.searchsorted(first_gram, self.grams)
        lacks = first_gram[np.minimum(at, len(here) - 1)] != self.grams
        test_symbols = np.where(self.symbols > 0, (2 * at + 2 - lacks)[np.maximum(self.symbols, 1) - 1], 0)
        low_at, high_at = (self._search(symbols, array, right, test_symbols) for right in (False, True))
        count = high_at - low_at
        found = np.flatnonzero(count)
        if not len(found):
            return nothing
        test = np.repeat(found, count[found])
        spot = array[ranges(low_at[found], count[found])]
        pos = np.searchsorted(spread, spot)
        size = self.full[self.item[test]]
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, pos, 1)
        np.add.at(edge, pos + size, -1)
        hit = np.cumsum(edge[:-1]) > 0
        length = size.copy()  # extended word by word, all matches at once
        live, t = np.arange(len(test)), self.suffix[test]
        while len(live):
            k = length[live] - self.q + 1
            live, k = (v[length[live] < self.left[test[live]]] for v in (live, k))
            same = test_symbols[t[live] + k] == symbols[spot[live] + k]
            live = live[same]
            length[live] += 1
        longest = np.zeros(rows, np.int64)
        np.maximum.at(longest, row[pos], length)
        pairs = np.unique(row[pos] * (len(self.names) + 1) + self.item[test])
        return {"n_words": n_words, "n_hit": per_row(hit, first), "longest": longest, "pairs": np.divmod(pairs, len(self.names) + 1), "spans": _spans(hit, row, first)}

    def _sorted(self, gram: np.ndarray, here: np.ndarray, size: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffix array: positions ``here`` by their next ``depth`` grams (0 ends them); the order by one gram, and for each of that order where its equals begin.

        Prefix doubling; a suffix that differs from all others already is not sorted again.
        """
        ordered = np.argsort(gram)
        by, array = gram[ordered], here[ordered]
        new = np.ones(len(by) + 1, bool)  # where a group of equal suffixes begins; the end counts as one
        np.not_equal(by[1:], by[:-1], out=new[1:-1])
        heads = np.flatnonzero(new[:-1])
        begins = np.repeat(heads, np.diff(heads, append=len(by)))
        rank, step = np.zeros(size, np.int64), 1
        rank[array] = begins + 1
        while step < depth and len(open_ := np.flatnonzero(~(new[:-1] & new[1:]))):
            at = array[open_]
            key = rank[at] * (len(by) + 2) + rank[np.minimum(at + step, size - 1)]
            to = np.argsort(key)
            key, at = key[to], at[to]
            array[open_] = at
            new[open_[1:]] = key[1:] != key[:-1]
            heads = np.flatnonzero(new[open_])
            rank[at] = np.repeat(open_[heads], np.diff(heads, append=len(open_))) + 1
            step *= 2
        return array, ordered, begins

    def _search(self, symbols: np.ndarray, array: np.ndarray, right: bool, test_symbols: np.ndarray) -> np.ndarray:
        """Binary search of every test suffix's window in the suffix array, all in step: first entry not below (or above)."""
        lo, hi = np.zeros(len(self.suffix), np.int64), np.full(len(self.suffix), len(array))
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            p, t, need = array[mid], self.suffix[open_], self.need[open_]
            order = np.zeros(len(open_), np.int8)  # of the training suffix against the test window
            for k in range(int(need.max())):
                tie = (order == 0) & (k < need)
                if not tie.any():
                    break
                a, b = symbols[p + k], test_symbols[t + k]
                order = np.where(tie, np.sign(a - b), order).astype(np.int8)
            up = order <= 0 if right else order < 0
            lo[open_[up]] = mid[up] + 1
            hi[open_[~up]] = mid[~up]
        return lo


def _spans(hit: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, from, to) of the runs of hit words; a run ends with its text."""
    at = np.flatnonzero(hit)
    begins = np.ones(len(at), bool)
    begins[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    heads = np.flatnonzero(begins)
    tails = np.append(heads[1:], len(at)) - 1
    text = row[at[heads]]
    return text, at[heads] - first[text], at[tails] + 1 - first[text]


def blocks_of(benchmark: DataFrame, window: int, block_bytes: int, id: str, text: str, pruned: bool = False):
    """The benchmark in blocks of at most about ``block_bytes``, each checked in size before it comes to the driver."""
    rows = benchmark.select(F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        yield Benchmark([(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()], window, pruned)


def _scan(column, bench: Benchmark):
    """(first row, rows, matches) of each shard of an Arrow column."""
    for a, data, offsets in chunks(column, 4 << 20):
        yield a, len(offsets) - 1, bench.shard(data, offsets)


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20, text: str = "text", id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", pruned: bool = False) -> DataFrame:
    """Per row: id, n_words, n_hit, items (array<string>), longest, spans (array<struct<from,to>> of words hit).

    pruned: leave suffixes out of the arrays whose first words do not occur in a row in the benchmark (the same result).
    """
    spark = ready(docs.sparkSession)
    out = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("longest"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<from:bigint,to:bigint>>").alias("spans"))
    kind = out.schema
    for k, bench in enumerate(blocks_of(benchmark, window, block_bytes, item_id, item_text, pruned)):
        if k:  # one block, and one worker, at a time
            out = materialize(out, "benchmark-block")
        shared = spark.sparkContext.broadcast(bench)

        @tidy
        def run(batches, shared=shared):
            trim()
            b = shared.value
            for batch in batches:
                items, spans = batch.column("items").to_pylist(), batch.column("spans").to_pylist()
                words, longest = np.zeros(batch.num_rows, np.int64), batch.column("longest").to_numpy().copy()
                for a, n, m in _scan(batch.column("text"), b):
                    words[a : a + n] = m["n_words"]
                    longest[a : a + n] = np.maximum(longest[a : a + n], m["longest"])
                    for d, i in zip(*(x.tolist() for x in m["pairs"])):
                        items[a + d].append(b.names[i])
                    for d, x, y in zip(*(v.tolist() for v in m["spans"])):
                        spans[a + d].append({"from": x, "to": y})
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(words), pa.array(longest), pa.array(items, pa.list_(pa.string())), pa.array(spans, batch.schema.field("spans").type)], batch.schema.names)

        out = out.mapInArrow(run, kind)
    merged = F.aggregate(F.sort_array("spans"), F.array().cast(kind["spans"].dataType), lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["to"] >= x["from"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["from"].alias("from"), F.greatest(F.element_at(acc, -1)["to"], x["to"]).alias("to"))))).otherwise(F.concat(acc, F.array(x))))
    out = out.select("id", "n_words", F.array_sort("items").alias("items"), "longest", merged.alias("spans"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["to"] - x["from"])
    return out.select(F.col("id").alias(id), "n_words", hit.alias("n_hit"), "items", "longest", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20, text: str = "text", item_id: str = "item_id", item_text: str = "text", pruned: bool = False) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    spark = ready(docs.sparkSession)
    at = docs.columns.index(text)
    out = docs
    for k, bench in enumerate(blocks_of(benchmark, window, block_bytes, item_id, item_text, pruned)):
        if k:  # one block, and one worker, at a time
            out = materialize(out, "benchmark-block")
        shared = spark.sparkContext.broadcast(bench)

        @tidy
        def run(batches, shared=shared):
            trim()
            for batch in batches:
                parts = [m["n_hit"] == 0 for _, _, m in _scan(batch.column(at), shared.value)]
                yield batch.filter(pa.array(np.concatenate(parts))) if parts else batch

        out = out.mapInArrow(run, docs.schema)
    return out
