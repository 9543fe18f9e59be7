"""Language-model scores by prediction by partial matching over bytes.

A model of order 5 holds, for every context of up to five bytes, how often each
byte (or the end of the text, symbol 256) followed it. A symbol is predicted in
the longest context that was seen; unseen ones escape to the next shorter one
with chance d / 2n (d distinct of n symbols seen; a symbol seen c times has
(2c - 1) / 2n), where symbols already offered are excluded, down to equal chances
for what is left. A text's score is the sum of the log10 chances of its bytes
and its end.

Counts of all training texts are summed map-side, then by key. The trie becomes
hashed arrays, one level for each order. What a level excludes depends on the
context escaped from alone, so escape costs are stored with contexts and a
position needs one lookup where its longest gram was seen. A model of more than
``max_grams`` grams is dealt into tables by the third and second last byte; they
are broadcast one after the other, each as large as that (or one such pair of
bytes), and the scores add up: the result does not depend on their number.

The unigram baseline needs counts of all words. Words that are frequent in a
small sample of documents (at most ``hot_words``) are counted by map-side sums
and broadcast; the rest meet in buckets by hash. Which words are in the sample
changes where they are counted, not the counts.

A-Z is lower-cased. Null texts count as empty: they have the end only. Without
training texts every symbol has equal chances; an empty table gives an empty
result. Texts of any length are read whole, in one piece each. Rows may repeat,
ids be null: each row counts as a training text of its own and gets its own row.
Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UNKNOWN, chunks, crc_mod, discard, gather, input_bytes, lower_ascii, materialize, mix64, per_row, ready, scatter, scattered, shuffle_partitions, span_hash, tidy, trim, word_spans

END, SYMBOLS, ORDER = 256, 257, 5


class Adaptive:
    """A trie of byte contexts that grows with the text it reads; also the plain form of the model."""

    def __init__(self, order: int = ORDER) -> None:
        self.order, self.counts = order, {}

    def contexts(self, before: bytes) -> list[bytes]:
        return [before[len(before) - k :] for k in range(min(self.order, len(before)), -1, -1)]

    def chance(self, before: bytes, symbol: int) -> float:
        mass, out = 1.0, set()
        for c in self.contexts(before):
            seen = {s: n for s, n in self.counts.get(c, {}).items() if s not in out}
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if symbol in seen:
                return mass * (2 * seen[symbol] - 1) / (2 * n)
            mass *= d / (2 * n)
            out |= set(seen)
        return mass / (SYMBOLS - len(out))

    def learn(self, text: bytes) -> None:
        for i, s in enumerate([*text, END]):
            self.add(text[max(0, i - self.order) : i], s)

    def add(self, before: bytes, symbol: int) -> None:
        for c in self.contexts(before):
            own = self.counts.setdefault(c, {})
            own[symbol] = own.get(symbol, 0) + 1

    def score(self, text: bytes, adapt: bool) -> float:
        total = 0.0
        for i, s in enumerate([*text, END]):
            before = text[max(0, i - self.order) : i]
            total += math.log10(self.chance(before, s))
            if adapt:
                self.add(before, s)
        return total


class Probed:
    """Sorted unique uint64 keys in an open-addressing table; find() gives positions in the sorted order, -1 if absent."""

    def __init__(self, keys: np.ndarray) -> None:
        n = len(keys)
        self.bits = max(4, int(1.4 * n).bit_length())
        home = self._home(keys)
        order = np.argsort(home, kind="stable")
        spot = np.maximum.accumulate(home[order] - np.arange(n)) + np.arange(n) if n else home  # each at its place or behind the last
        self.keys = np.full((1 << self.bits) + n + 2, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
        self.place = np.full(len(self.keys), -1, np.int32)
        self.keys[spot] = keys[order]
        self.place[spot] = order

    def _home(self, keys: np.ndarray) -> np.ndarray:
        k = keys * np.uint64(0x9E3779B97F4A7C15)
        return ((k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        spot = self._home(keys)
        got = self.keys[spot]
        out = np.where(got == keys, self.place[spot], -1)
        open_ = np.flatnonzero((got != keys) & (self.place[spot] >= 0))
        while len(open_):
            spot[open_] += 1
            got = self.keys[spot[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.place[spot[open_[hit]]]
            open_ = open_[~hit & (self.place[spot[open_]] >= 0)]
        return out


class Level:
    """All grams of one order: finished log10 chances where their context is the longest seen, and what escaping from it costs."""

    def __init__(self, key: np.ndarray, count: np.ndarray, shorter: Level | None) -> None:
        """key: context << 9 | symbol, sorted and unique."""
        context = key >> 9
        heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(key) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(key))))
        n, d = (np.add.reduceat(v, heads).astype(float) if len(key) else np.zeros(0) for v in (count, np.ones_like(count)))
        log = np.log10(2.0 * count - 1)
        self.key, self.log, self.kinds = key, log.astype(np.float32), d
        self.count = count
        self.grams, self.contexts = Probed(key.astype(np.uint64)), Probed(context[heads].astype(np.uint64))
        self.top = (log - np.log10(2 * n)[of]).astype(np.float32)  # exact to the last bits also near 0
        self.top_escape = np.log10(d / (2 * n))
        self.total = n
        if shorter is not None:  # escaped from a context here, the next order offers what this context has not seen
            low = context[heads] & shorter.mask
            up = shorter.contexts.find(low.astype(np.uint64))
            same = shorter.grams.find(((context & shorter.mask) << 9 | key & 511).astype(np.uint64))
            left_n = shorter.total[up] - (np.bincount(of, shorter.count[same], len(heads)) if len(key) else 0)
            left_d = shorter.kinds[up] - d
            rest = np.where(left_n > 0, 2 * left_n, 1)
            self.rest = np.log10(rest)
            self.rest_escape = np.where(left_n > 0, np.log10(np.maximum(left_d, 1) / rest), 0.0)

    def set_order(self, order: int) -> Level:
        self.mask = np.int64((1 << 8 * order) - 1)
        return self

    def slim(self, longest: bool) -> None:
        """Leave what scoring needs; nothing escapes into the longest order."""
        del self.key, self.count, self.total, self.kinds
        if longest:
            del self.log


class Tables:
    """The model for positions whose third to second last bytes lie in a range, and, in the first, for those with fewer bytes before them."""

    def __init__(self, grams: tuple[np.ndarray, ...], low: tuple[np.ndarray, ...], span: tuple[int, int], first: bool, order: int = ORDER) -> None:
        """grams: (order, context, symbol, count) from order 3 on, of the range; low: those of orders 0 to 2, of everything."""
        self.span, self.first, self.order = span, first, order
        self.levels: list[Level] = []
        for k in range(order + 1):
            o, c, s, n = grams if k > 2 else low
            own = o >= k if k > 2 else o == k
            mask = np.int64((1 << 8 * k) - 1)
            key, count = summed([(c[own] & mask) << 9 | s[own]], [n[own]])
            self.levels.append(Level(key, count, self.levels[-1] if k else None).set_order(k))
        self.uniform = -math.log10(max(1, SYMBOLS - len(self.levels[0].key))) if len(self.levels[0].key) < SYMBOLS else -300.0
        for k, x in enumerate(self.levels):
            x.slim(k == order)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sum of log10 chances of each text's bytes and end, over the positions that are this table's."""
        rows, K = len(offsets) - 1, self.order
        n = len(data) + rows
        begins = offsets[:-1] + np.arange(rows)
        symbol = np.full(n, END, np.int64)
        body = np.ones(n, bool)
        body[offsets[1:] + np.arange(rows)] = False
        symbol[body] = data
        age = np.minimum(np.arange(n) - np.repeat(begins, np.diff(offsets) + 1), K)
        context = np.zeros(n, np.int64)
        for k in range(min(K, n - 1), 0, -1):
            context[k:] = context[k:] << 8 | symbol[:-k] & 255
        third = (context >> 8) & 0xFFFF
        own = np.where(age >= 3, (third >= self.span[0]) & (third < self.span[1]), self.first)
        lp = np.zeros(n)
        live = np.flatnonzero(own)
        above = np.full(len(live), -1)  # the context escaped from, one order up
        for k in range(K, -1, -1):
            level = self.levels[k]
            can = age[live] >= k
            wait, wait_above = live[~can], above[~can]
            live, above = live[can], above[can]
            c = context[live] & ((1 << 8 * k) - 1)
            gram = level.grams.find((c << 9 | symbol[live]).astype(np.uint64))
            hit, fresh = gram >= 0, above < 0
            at = live[hit & fresh]
            lp[at] = level.top[gram[hit & fresh]]
            old = hit & ~fresh
            if k < K:
                lp[live[old]] += level.log[gram[old]] - self.levels[k + 1].rest[above[old]]
            miss = ~hit
            live, above, c = live[miss], above[miss], c[miss]
            here = level.contexts.find(c.astype(np.uint64))
            fresh = above < 0
            enter = fresh & (here >= 0)
            lp[live[enter]] = level.top_escape[here[enter]]
            if k < K:
                lp[live[~fresh]] += self.levels[k + 1].rest_escape[above[~fresh]]
            live, above = np.concatenate([wait, live]), np.concatenate([wait_above, here])
        lp[live] += self.uniform
        return per_row(lp, np.append(begins, n))


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of every context of full length (shorter at a text's start) and its symbol: order << 57 | context << 9 | symbol."""
    rows = len(offsets) - 1
    n = len(data) + rows
    begins = offsets[:-1] + np.arange(rows)
    symbol = np.full(n, END, np.int64)
    body = np.ones(n, bool)
    body[offsets[1:] + np.arange(rows)] = False
    symbol[body] = data
    key = symbol.copy()
    age = np.minimum(np.arange(n) - np.repeat(begins, np.diff(offsets) + 1), order)
    context = np.zeros(n, np.int64)
    for k in range(min(order, n - 1), 0, -1):
        context[k:] = context[k:] << 8 | symbol[:-k] & 255
    context &= (np.int64(1) << 8 * age) - 1
    key |= context << 9 | age << 57
    key.sort()
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    return key[heads], np.diff(np.append(heads, n))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[heads], np.add.reduceat(c, heads) if len(k) else c


def _text(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(text).cast("string").alias("text"))


def gram_counts(train: DataFrame, hot: np.ndarray, text: str = "text") -> DataFrame:
    """(kind, key, count) over all training texts: kind 0 grams, kind 1 the hot words (hash as a signed number)."""
    shared = ready(train.sparkSession).sparkContext.broadcast(hot)

    @tidy
    def run(batches):
        hot, held = shared.value, {0: ([], []), 1: ([], [])}
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text"), 1 << 20):
                low = lower_ascii(data)
                for kind, (k, c) in ((0, grams(low, offsets)), (1, _hot_counts(low, offsets, hot))):
                    held[kind][0].append(k)
                    held[kind][1].append(c)
                    if sum(map(len, held[kind][0])) > 1_000_000:
                        k, c = summed(*held[kind])
                        held[kind] = ([k], [c])
        for kind, (k, c) in held.items():
            if k:
                k, c = summed(k, c)
                for i in range(0, len(k), 100_000):
                    part, times = k[i : i + 100_000], c[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(times.astype(np.int64))], ["kind", "key", "count"])
        held.clear()
        trim()

    return _text(train, text).mapInArrow(run, "kind int, key bigint, count bigint").groupBy("kind", "key").agg(F.sum("count").alias("count"))


def _hot_counts(low: np.ndarray, offsets: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, _ = word_spans(low, offsets)
    if not len(hot) or not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = span_hash(low, s, e)
    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
    n = np.bincount(at[hot[at] == h], minlength=len(hot))
    return hot[n > 0].view(np.int64), n[n > 0]


def tables_of(counts: DataFrame, max_grams: int = 1_000_000, order: int = ORDER):
    """The model in tables, made one at a time, each after its size is known."""
    key = F.col("key")
    c = counts.where("kind = 0").select(F.shiftright(key, 57).alias("o"), F.shiftright(key, 9).bitwiseAND(F.lit((1 << 48) - 1)).alias("c"), key.bitwiseAND(F.lit(511)).alias("s"), "count")
    arrays = lambda got: tuple(got.column(x).to_numpy().astype(np.int64) for x in ("o", "c", "s", "count"))
    each = F.explode(F.sequence(F.lit(0), F.least(F.col("o").cast("int"), F.lit(2)))).alias("k")
    low = c.select(each, "c", "s", "count").withColumn("c", F.expr("c & ((1L << (8 * k)) - 1)")).groupBy(F.col("k").cast("bigint").alias("o"), "c", "s").agg(F.sum("count").alias("count"))
    low = arrays(low.toArrow())  # at most 2^16 * 257 rows and those of shorter contexts
    third = F.shiftright("c", 8).bitwiseAND(F.lit(0xFFFF))
    sizes = c.where("o >= 3").groupBy(third.alias("g")).agg(F.count("*").alias("n")).orderBy("g").toArrow()  # at most 65,536 rows
    group, size = sizes.column("g").to_numpy(), sizes.column("n").to_numpy()
    table = (np.cumsum(size) - 1) // max_grams if len(size) else np.zeros(0, np.int64)
    starts = [0, *(int(group[np.searchsorted(table, k)]) for k in np.unique(table)[1:]), 1 << 16]
    for k, span in enumerate(zip(starts, starts[1:])):
        own = c.where((F.col("o") >= 3) & (third >= span[0]) & (third < span[1]))
        held = arrays(own.toArrow())
        made = Tables(held, low, span, k == 0, order)
        del held
        yield made
        del made


def model_scores(docs: DataFrame, counts: DataFrame, max_grams: int = 1_000_000) -> DataFrame:
    """(key, score) of each key of ``docs`` (key, text); rows of one key have the same text. A table costs a look at all texts, and a number for each that is written."""
    spark = ready(docs.sparkSession)
    texts, parts = docs.select("key", "text"), []
    for tables in tables_of(counts, max_grams):
        shared = spark.sparkContext.broadcast(tables)
        del tables
        trim()

        @tidy
        def run(batches, shared=shared):
            tables = shared.value
            for batch in batches:
                some = [tables.score(lower_ascii(d), o) for _, d, o in chunks(batch.column("text"), 1 << 19)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.concatenate(some) if some else np.zeros(0))], ["key", "score"])

        parts.append(materialize(texts.mapInArrow(run, "key bigint, score double"), "ppm-partial"))  # one table, and one worker, at a time
        shared.unpersist()
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    out = materialize(every.groupBy("key").agg((F.sum("score") / (F.count("*") / F.lit(len(parts)))).alias("score")), "ppm-scores")
    discard(*parts)
    return out


def adaptive_scores(docs: DataFrame, order: int = ORDER, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, score): log10 chance of each text under a model that starts empty and learns as it reads. A byte costs some microseconds times the order."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))

    @tidy
    def run(batches):
        for batch in batches:
            scores = [Adaptive(order).score(lower_ascii(np.frombuffer((t or "").encode(), np.uint8)).tobytes(), True) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id)


# Baseline ------------------------------------------------------------------


def hot_words(docs: DataFrame, most: int = 50_000, text: str = "text", sample_bytes: int = 8 << 20) -> np.ndarray:
    """Sorted hashes of at most ``most`` words seen three times or more in a sample of about ``sample_bytes`` of the input."""
    size = input_bytes(docs)
    m = max(1, size // sample_bytes) if size < UNKNOWN else 1
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(m)) == 0)

    @tidy
    def run(batches):
        held = ([], [])
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                low = lower_ascii(data)
                s, e, _ = word_spans(low, offsets)
                k, c = np.unique(span_hash(low, s, e), return_counts=True)
                held[0].append(k)
                held[1].append(c)
        if held[0]:
            k, c = summed(*held)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["key", "count"])

    got = _text(sample, text).mapInArrow(run, "key bigint, count bigint").groupBy("key").agg(F.sum("count").alias("n")).where("n >= 3").orderBy(F.desc("n"), "key").limit(most).toArrow()
    return np.sort(got.column("key").to_numpy().astype(np.int64).view(np.uint64))


def rare_words(docs: DataFrame, hot: np.ndarray, hot_counts: np.ndarray, parts: int) -> DataFrame:
    """Buckets of (word hash, document key, count, whether it trains) of the words that are not hot.

    The hot words' share of a document's sum travels as entries of hash 0: their
    value is known already. ``docs`` has text, key and train.
    """
    shared = ready(docs.sparkSession).sparkContext.broadcast((hot, hot_counts))

    @tidy
    def run(batches):
        hot, hot_counts = shared.value
        value = np.log10(hot_counts + 1.0)
        for batch in batches:
            key, train = batch.column("key").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            for a, data, offsets in chunks(batch.column("text"), 1 << 20):
                low = lower_ascii(data)
                s, e, first = word_spans(low, offsets)
                h = span_hash(low, s, e)
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                at = np.minimum(np.searchsorted(hot, h), len(hot) - 1) if len(hot) else np.zeros(len(h), int)
                is_hot = hot[at] == h if len(hot) else np.zeros(len(h), bool)
                sums = np.bincount(doc[is_hot], value[at[is_hot]], len(offsets) - 1) if len(hot) else np.zeros(len(offsets) - 1)
                known = np.bincount(doc[is_hot], hot_counts[at[is_hot]] > 0, len(offsets) - 1) if len(hot) else np.zeros(len(offsets) - 1)
                h, doc = h[~is_hot], doc[~is_hot]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                heads = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, int)
                times = np.diff(np.append(heads, len(h)))
                rows = np.flatnonzero((sums > 0) | (known > 0))
                yield scatter(
                    np.concatenate([(h[heads] % np.uint64(parts)).astype(np.int64), (mix64(key[a + rows].view(np.uint64)) % np.uint64(parts)).astype(np.int64)]),
                    {"h": np.concatenate([h[heads], np.zeros(len(rows), np.uint64)]), "key": np.concatenate([key[a + doc[heads]], key[a + rows]]),
                     "n": np.concatenate([times, known[rows]]).astype(np.int32), "extra": np.concatenate([np.where(train[a + doc[heads]], 1.0, 0.0), sums[rows]])},
                )
        trim()

    return docs.select("text", "key", "train").mapInArrow(run, scattered(["h", "key", "n", "extra"])).repartition(parts, "bucket")


def rare_sums(buckets: DataFrame, parts: int) -> DataFrame:
    """(key, total, known): by document the sum of log10(c + 1) and its known tokens; key 0 has the number of known words.

    A document has entries in many buckets of words; they travel to its own
    bucket packed, as many entries as there were, not a row for each.
    """
    @tidy
    def count(batches):
        trim()
        g = gather(batches, {"h": "u8", "key": "i8", "n": "i4", "extra": "f8"})
        ready_made = g["h"] == 0
        h, key, n, train = (g[c][~ready_made] for c in ("h", "key", "n", "extra"))
        kinds, of = np.unique(h, return_inverse=True)
        c = np.bincount(of, n * train, len(kinds)).astype(float)
        keys = np.concatenate([key, g["key"][ready_made]])
        total = np.concatenate([np.log10(c + 1)[of] * n, g["extra"][ready_made].astype(float)])
        known = np.concatenate([np.where(c[of] > 0, n, 0), g["n"][ready_made]])
        docs, at = np.unique(keys, return_inverse=True)
        docs = np.append(docs, 0)
        total = np.append(np.bincount(at, total, len(docs) - 1).astype(float), 0.0)
        known = np.append(np.bincount(at, known, len(docs) - 1).astype(np.int64), int((c > 0).sum()))
        yield scatter((mix64(docs.view(np.uint64)) % np.uint64(parts)).astype(np.int64), {"key": docs, "total": total, "known": known})
        del g, h, key, n, train, kinds, of, keys, docs, at, total, known
        trim()

    @tidy
    def add(batches):
        g = gather(batches, {"key": "i8", "total": "f8", "known": "i8"})
        docs, at = np.unique(g["key"], return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.bincount(at, g["total"], len(docs)).astype(float)), pa.array(np.bincount(at, g["known"], len(docs)).astype(np.int64))], ["key", "total", "known"])

    packed = buckets.mapInArrow(count, scattered(["key", "total", "known"])).repartition(parts, "bucket")
    return packed.mapInArrow(add, "key bigint, total double, known bigint")


def lm_scores(docs: DataFrame, mod: int = 7, held: int = 2, max_grams: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), (crc_mod("doc_id", mod) != held).alias("train"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    hot = hot_words(rows)
    counts = materialize(gram_counts(rows.where("train"), hot), "ppm-counts")
    words = counts.where("kind = 1").toArrow()  # no more than the hot words
    hot_counts = np.zeros(len(hot), np.int64)
    hot_counts[np.searchsorted(hot, words.column("key").to_numpy().astype(np.int64).view(np.uint64))] = words.column("count").to_numpy()
    parts = shuffle_partitions(rows, 1.5)
    sums = materialize(rare_sums(rare_words(rows, hot, hot_counts, parts), parts), "word-sums")
    scores = model_scores(rows, counts, max_grams)
    facts = materialize(rows.select("doc_id", "key", "train", (F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")) + 1).cast("bigint").alias("n_tokens")), "ppm-rows")
    n, ends = facts.where("train").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    v = sums.where("key = 0").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0] + int((hot_counts > 0).sum()) + (ends > 0)
    copies = facts.groupBy("key").agg(F.count("*").alias("copies"))  # equal rows pool their sums
    own = sums.where("key != 0").join(copies, "key").select("key", (F.col("total") / F.col("copies")).alias("total"), (F.col("known") / F.col("copies")).cast("bigint").alias("known"))
    by_key = materialize(scores.join(own, "key", "left"), "ppm-keys")
    discard(counts, sums, scores)
    out = facts.join(by_key, "key", "left")
    base = F.coalesce("total", F.lit(0.0)) + math.log10(ends + 1) - F.col("n_tokens") * math.log10(n + v + 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.coalesce("known", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(int(n)).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")
