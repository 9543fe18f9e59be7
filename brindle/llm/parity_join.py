"""N-gram Jaccard join by parity sketches: which documents share 75 % of their 5-word shingles.

A set's sketch has one bit for each hash position, turned over by every shingle
that falls on it, so the Hamming distance of two sketches is at most the size of
the sets' symmetric difference. Links of Jaccard j >= 3/4 differ in at most
d = (|A| + |B|) / 7 shingles. Sizes are put into overlapping bands, such that
any two sets that may link share one; a band's sketches are cut into K sparse
pieces, at most d of which differ. So of a set's pieces, put in an order that is
the same for all sets (those with more bits first, as they are rarer), the first
d + 1 include one that the other set has among its own first ones: these are the
join keys.

Sets that are equal are one node from the start. Within a key's group, small
groups give all pairs, large ones first a star around one member; pairs pass a
test of short dense sketches (again a lower bound) before the sets themselves
are compared. Groups that still hold more than one component then compare the
rest, in blocks, without pairs inside a component. Nothing is capped or sampled.

Nodes are 64-bit fingerprints of whole sets, shingles 64-bit hashes. A-Z is
lower-cased. Fewer than five words: the whole sequence is the one shingle; no
words or a null text: the empty set, linked with nothing. Ids may repeat or be
null: each row gets the smallest id of its component (null if all are null).
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UNKNOWN, chunks, discard, drop_rows, gather, input_bytes, lower_ascii, materialize, mix64, ranges, ready, scatter, scattered, shuffle_partitions, span_hash, tidy, word_spans

WIDTH, SMALL, LEAST_BITS = 5, 12, 256
#: Members of a key's group that are held at once when they are compared with one another.
BLOCK = 2048
#: Bytes of id hashes that may be broadcast; beyond that, texts are joined by a shuffle.
BROADCAST = 32 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of text d are hashes[first[d]:first[d+1]], sorted."""
    rows = len(offsets) - 1
    low = lower_ascii(data)
    s, e, at = word_spans(low, offsets)
    h = span_hash(low, s, e)
    words = np.diff(at)
    doc = np.repeat(np.arange(rows), words)
    parts, of = [], []
    n = len(h)
    if n >= width:
        key = h[: n - width + 1].copy()
        for k in range(1, width):
            key = mix64(key) ^ h[k : n - width + 1 + k]
        ok = doc[: n - width + 1] == doc[width - 1 :]
        parts.append(mix64(key[ok]))
        of.append(doc[: n - width + 1][ok])
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        key = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = words[short] > k
            key[has] = mix64(key[has]) ^ h[at[short[has]] + k]
        parts.append(mix64(key ^ (words[short].astype(np.uint64) << np.uint64(56))))
        of.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    key, doc = np.concatenate(parts), np.concatenate(of)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    return key, np.searchsorted(doc, np.arange(rows + 1))


def fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for each set, whatever its order: int64, 0 for the empty set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ np.uint64(0x5851F42D4C957F2D)))])
    xors = np.zeros(len(first) - 1, np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        xors[full] = np.bitwise_xor.reduceat(h, first[:-1][full])
    out = mix64((sums[first[1:]] - sums[first[:-1]]) ^ mix64(xors ^ np.diff(first).astype(np.uint64)))
    out[np.diff(first) == 0] = 0
    return out.view(np.int64)


def _bands(most: int = 1 << 40) -> np.ndarray:
    """Lower ends of the bands: sets of sizes a <= b <= 4a/3 are both in [ends[j], ends[j+2]) for the j that a is in the lower half of."""
    ends = [1, 2]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, 4 * (ends[-1] - 1) // 3 + 1))
    return np.array(ends, np.int64)


BANDS = _bands()


def keys_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): the join keys of every set, of the two bands that it is in."""
    size = np.diff(first)
    rows = np.flatnonzero(size)
    out_key, out_row = [], []
    own = np.searchsorted(BANDS, size, "right") - 1
    for half in (0, 1):  # in the lower half of its own band, and the upper half of the band before
        pick = rows[own[rows] - half >= 0]
        if not len(pick):
            continue
        band, n = own[pick] - half, size[pick]
        top = BANDS[band + 1] - 1  # largest size in the lower half
        most = (n + (4 * n // 3 if half == 0 else np.minimum(top, n))) // 7  # largest difference of a link
        pieces = np.maximum(16, (BANDS[band + 1] + 1) // 2)
        which = np.repeat(np.arange(len(pick)), n)
        tokens = h[np.repeat(first[:-1][pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        piece = ((mix64(tokens ^ np.uint64(0x9FB21C651E98DF25)) >> np.uint64(33)) % pieces[which].astype(np.uint64)).astype(np.int64)
        start = np.cumsum(pieces) - pieces
        slot = start[which] + piece
        order = np.argsort(slot, kind="stable")
        slot, tokens = slot[order], mix64(tokens[order])
        heads = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        total = int(pieces.sum())
        bits, value = np.zeros(total, np.int64), np.zeros(total, np.uint64)
        bits[slot[heads]] = np.diff(np.append(heads, len(slot)))
        value[slot[heads]] = np.bitwise_xor.reduceat(tokens, heads)
        row = np.repeat(np.arange(len(pick)), pieces)
        number = np.arange(total) - start[row]
        key = mix64(value ^ mix64((band[row].astype(np.uint64) << np.uint64(40)) ^ number.astype(np.uint64) ^ (bits.astype(np.uint64) << np.uint64(52))))
        rank = np.lexsort((key, -bits, row))
        place = np.arange(total) - start[row[rank]]
        chosen = rank[place <= most[row[rank]]]
        out_key.append(key[chosen])
        out_row.append(pick[row[chosen]])
    if not out_key:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_key), np.concatenate(out_row)


def dense(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the sets' parity sketches: a power of two of bits, twice to four times the set's size."""
    size = np.diff(first)
    bits = np.maximum(LEAST_BITS, np.int64(1) << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    row = np.repeat(np.arange(len(size)), size)
    spot = (mix64(h ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)).astype(np.int64) & (bits - 1)[row]
    at, times = np.unique(spot + (ends - bits)[row], return_counts=True)
    odd = np.zeros(int(bits.sum()), np.uint8)
    odd[at[times % 2 == 1]] = 1
    return np.packbits(odd), np.append(0, ends) // 8


class Sketches:
    """Parity sketches of different lengths; a longer one is folded (its halves joined by XOR) to meet a shorter one."""

    def __init__(self, blobs: list[bytes]) -> None:
        self.size = np.fromiter(map(len, blobs), np.int64, len(blobs))
        self.place = np.zeros(len(blobs), np.int64)
        self.held: dict[tuple[int, int], np.ndarray] = {}
        for s in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == s)
            self.place[own] = np.arange(len(own))
            self.held[s, s] = np.frombuffer(b"".join([blobs[i] for i in own]), np.uint64).reshape(-1, s // 8)

    def _folded(self, own: int, to: int) -> np.ndarray:
        if (own, to) not in self.held:
            x = self._folded(own, 2 * to)
            self.held[own, to] = x[:, : to // 8] ^ x[:, to // 8 :]
        return self.held[own, to]

    def apart(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Bits in which sketches p[i] and q[i] differ."""
        out = np.zeros(len(p), np.int64)
        sp, sq = self.size[p], self.size[q]
        for x, y in np.unique(np.stack([sp, sq], 1), axis=0).tolist() if len(p) else []:
            own, to = np.flatnonzero((sp == x) & (sq == y)), min(x, y)
            a, b = self._folded(x, to), self._folded(y, to)
            step = max(1, (4 << 20) // to)
            for k in range(0, len(own), step):
                i = own[k : k + step]
                out[i] = np.bitwise_count(a[self.place[p[i]]] ^ b[self.place[q[i]]]).sum(-1, dtype=np.int64)
        return out


def _texts(docs: DataFrame, text: str, id: str) -> DataFrame:
    ready(docs.sparkSession)
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))


def sets_of(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n, node, row_key) of every row."""
    rows = _texts(docs, text, id).withColumn("row_key", F.xxhash64("id", "text"))

    @tidy
    def run(batches):
        for batch in batches:
            for a, data, offsets in chunks(batch.column("text"), 1 << 20):
                h, first = shingles(data, offsets)
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, n), pa.array(np.diff(first)), pa.array(fingerprints(h, first)), batch.column("row_key").slice(a, n)], ["id", "n", "node", "row_key"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n bigint, node bigint, row_key bigint")


def _keyed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, node, size) of the sets of consecutive texts; equal sets send their keys once."""
    h, first = shingles(data, offsets)
    node = fingerprints(h, first)
    _, at = np.unique(node, return_index=True)
    once = np.zeros(len(node), bool)
    once[at] = True
    once &= np.diff(first) > 0
    sizes = np.where(once, np.diff(first), 0)
    key, row = keys_of(h[np.repeat(once, np.diff(first))], np.concatenate([[0], np.cumsum(sizes)]))
    return key, node[row], sizes[row].astype(np.int32)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs (a, b), in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def hot_keys(rows: DataFrame, sample_bytes: int = 16 << 20, least: int = 8) -> np.ndarray:
    """Sorted join keys that ``least`` or more different sets of a sample of about ``sample_bytes`` have.

    Their groups are dealt over all buckets. Which keys are found changes where
    sets meet, not what is found.
    """
    size = input_bytes(rows)
    m = max(1, size // sample_bytes) if size < UNKNOWN else 1

    @tidy
    def run(batches):
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text"), 1 << 20):
                key, node, _ = _keyed(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], ["key", "node"])

    got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(m)) == 0).select("text").mapInArrow(run, "key bigint, node bigint").distinct().groupBy("key").count().where(F.col("count") >= least).select("key").toArrow()
    return np.sort(got.column("key").to_numpy().astype(np.int64).view(np.uint64))


def candidate_groups(docs: DataFrame, text: str = "text", id: str = "doc_id", hot: np.ndarray | None = None) -> DataFrame:
    """(kind, key, a, b): kind 0 pairs to compare; kind 1 members (a) of large groups (key)."""
    rows = _texts(docs, text, id)
    parts = shuffle_partitions(rows, 18.0)
    shared = rows.sparkSession.sparkContext.broadcast(hot_keys(rows) if hot is None else hot)

    def among(hot: np.ndarray, key: np.ndarray) -> np.ndarray:
        return hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key if len(hot) else np.zeros(len(key), bool)

    @tidy
    def keyed(batches):
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text"), 1 << 20):
                key, node, n = _keyed(data, offsets)
                dealt = np.where(among(shared.value, key), key ^ mix64(node.view(np.uint64)), key)
                yield scatter((dealt % np.uint64(parts)).astype(np.int64), {"key": key, "node": node, "n": n})

    @tidy
    def grouped(batches):
        g = gather(batches, {"key": "u8", "node": "i8", "n": "i4"})
        order = np.lexsort((g["node"], g["key"]))
        key, node, n = (g[c][order] for c in ("key", "node", "n"))
        del g, order
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, n = key[new], node[new], n[new]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        size = np.diff(np.append(head, len(key)))
        at = np.repeat(head, size)
        many = np.where(np.repeat(among(shared.value, key[head]), size), 1 << 40, np.repeat(size, size))  # of hot keys, the others may be elsewhere
        fits = lambda x, y: (4 * np.minimum(n[x], n[y]).astype(np.int64) >= 3 * np.maximum(n[x], n[y]).astype(np.int64)) & (node[x] != node[y])
        pairs = []
        for step in range(1, SMALL):  # all pairs of small groups
            x = np.flatnonzero((many > 1) & (many <= SMALL) & (np.arange(len(key)) + step < at + many))
            x = x[fits(x, x + step)]
            pairs.append(distinct_pairs(node[x], node[x + step]))  # texts that share much meet under many keys
        x = np.flatnonzero((many > SMALL) & (np.arange(len(key)) > at))  # stars of the large ones
        x = x[fits(at[x], x)]
        pairs.append(distinct_pairs(node[at[x]], node[x]))
        pairs = distinct_pairs(*(np.concatenate(v) for v in zip(*pairs)))
        large = np.flatnonzero(many > SMALL)
        for kind, k, a, b in ((0, np.zeros(len(pairs[0]), np.int64), *pairs), (1, key[large].view(np.int64), node[large], n[large].astype(np.int64))):
            for i in range(0, len(a), 200_000):
                j = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[j]), kind, np.int32)), pa.array(k[j]), pa.array(a[j]), pa.array(b[j])], ["kind", "key", "a", "b"])

    return rows.select("text").mapInArrow(keyed, scattered(["key", "node", "n"])).repartition(parts, "bucket").mapInArrow(grouped, "kind int, key bigint, a bigint, b bigint")


def node_data(docs: DataFrame, first: DataFrame, wanted: DataFrame, whole: bool, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(node, n, data): the dense sketch, or the whole set (int64 bytes), of each node wanted, from one document that has it.

    first: (node, first), a table of each node's smallest id.
    """
    ready(docs.sparkSession)
    ids = materialize(first.join(wanted, "node", "left_semi").select(F.xxhash64("first").alias("h")).distinct(), "wanted")
    small = ids.count() * 8 <= BROADCAST
    texts = docs.select(F.xxhash64(F.col(id)).alias("h"), F.col(text).cast("string").alias("text"))
    texts = texts.join(F.broadcast(ids) if small else ids.hint("merge"), "h", "left_semi").select("text")

    @tidy
    def run(batches):
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text"), 1 << 20):
                h, first = shingles(data, offsets)
                node, n = fingerprints(h, first), np.diff(first)
                _, at = np.unique(node, return_index=True)
                held, bounds = (h, first * 8) if whole else dense(h, first)
                blob = pa.Array.from_buffers(pa.large_binary(), len(node), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(held.tobytes())]).cast(pa.binary())
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(node).take(take), pa.array(n).take(take), blob.take(take)], ["node", "n", "data"])

    out = texts.mapInArrow(run, "node bigint, n bigint, data binary")
    out = materialize(out.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "whole-sets" if whole else "sketches")
    discard(ids)
    return out


def _joined(pairs: DataFrame, data: DataFrame) -> DataFrame:
    left = data.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("data").alias("da"))
    right = data.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("data").alias("db"))
    return pairs.hint("merge").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "na", "nb", "da", "db")


def near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose sketches differ in no more bits than a link's sets may differ in shingles."""

    @tidy
    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            both = Sketches(batch.column("da").to_pylist() + batch.column("db").to_pylist())
            at = np.arange(batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(7 * both.apart(at, at + batch.num_rows) <= na + nb))

    return _joined(pairs, sketches).mapInArrow(run, "a bigint, b bigint")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sets are within the bound, compared in full."""

    @tidy
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("da"), batch.column("db")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                ok.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return _joined(pairs, sets).mapInArrow(run, "a bigint, b bigint")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the nodes of edges (a, b) that are not the smallest themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        p, q = low[x], low[y]
        open_ = p != q
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(low, np.maximum(p, q)[open_], np.minimum(p, q)[open_])
        while not np.array_equal(low, deeper := low[low]):
            low = deeper
    below = np.flatnonzero(low < np.arange(len(nodes)))
    return nodes[below], nodes[low[below]]


def components(edges: DataFrame, one_task: int = 1 << 20) -> DataFrame:
    """(node, root) of every node of an edge (a, b).

    Each partition reduces its edges to stars. If no more than ``one_task`` edges
    are left, one task ends the work; else large and small stars alternate, each
    round written out.
    """

    @tidy
    def local(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        node, root = stars(*(np.concatenate(v) for v in zip(*held))) if held else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["a", "b"])

    kind = "a bigint, b bigint"
    ready(edges.sparkSession)
    now = materialize(edges.select("a", "b").mapInArrow(local, kind).distinct(), "edges")  # a > b throughout
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] <= one_task:
            break
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        last, now = now, materialize(small, "edges")
        discard(last)
    if state[0] <= one_task:
        now, last = now.coalesce(1).mapInArrow(local, kind), now
    else:
        last = None
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = materialize(out.union(out.select("root", "root").distinct()), "roots")
    discard(last if last is not None else now)
    return out


def rest_pairs(groups: DataFrame, roots: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of large groups that lie in different components and pass the sketch test; compared in blocks within a group."""
    members = groups.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").select("key", F.col("a").alias("node"), F.col("b").alias("n"), F.coalesce("root", "a").alias("root"))
    by_root = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    big = by_root.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("big"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    left = materialize(members.join(big, "key").where("root != big"), "left")
    # members outside their group's largest component, against each other; groups of the same such members need one look
    seen = left.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("x"), F.max("root").alias("y"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where("x != y")
    seen = materialize(seen.dropDuplicates(["c", "who"]).select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "rest-groups")
    # every two blocks of a group's members meet under a key of their own
    dealt = left.join(seen, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    inner = dealt.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "node", "n", "root", F.lit(None).cast("bigint").alias("big"))
    # and against the largest component: once for each component, whatever the number of keys, its members dealt over salts
    whole = members.select("node", "n", "root").distinct().join(left.select(F.col("big").alias("root")).distinct(), "root", "left_semi")
    sizes = materialize(whole.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts")), "rest-salts")
    ys = whole.join(sizes, "root").select(F.xxhash64("root", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).alias("key"), "node", "n", "root", F.col("root").alias("big"))
    xs = left.select("node", "n", "root", "big").distinct().join(sizes.withColumnRenamed("root", "big"), "big")
    xs = xs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(F.xxhash64("big", "salt").alias("key"), "node", "n", "root", "big")
    rows = inner.unionByName(xs).unionByName(ys).join(sketches.select("node", "data").hint("merge"), "node")
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(xs: list[tuple], ys: list[tuple], big: int | None):
        """Pairs of two blocks (which may be the same) in different components, or with ``big`` given, with one in it."""
        node, n, root = (np.array([r[k] for r in xs + ys], np.int64) for k in range(3))
        held = Sketches([r[3] for r in xs + ys])
        order = len(xs) + np.argsort(n[len(xs) :], kind="stable")
        sizes = n[order]
        low = np.searchsorted(sizes, 3 * n[: len(xs)] / 4, "left")
        each = np.searchsorted(sizes, 4 * n[: len(xs)] / 3, "right") - low
        ends = np.cumsum(each)
        x = 0
        while x < len(xs):  # some 2^18 pairs at a time
            to = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + (1 << 18), "right")))
            i, j = np.repeat(np.arange(x, to), each[x:to]), order[ranges(low[x:to], each[x:to])]
            ok = (root[i] != root[j]) & (node[i] < node[j]) if big is None else root[j] == big
            i, j = i[ok], j[ok]
            ok = 7 * held.apart(i, j) <= n[i] + n[j]
            i, j = node[i[ok]], node[j[ok]]
            yield np.minimum(i, j), np.maximum(i, j)
            x = to

    @tidy
    def run(batches):
        """A key's rows come in order: for ``big``, its members first. They are held; the others pass by in blocks."""
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def emit(least: int):
            if sum(len(a) for a, _ in out) > least:
                p = np.unique(np.stack([np.concatenate(v) for v in zip(*out)], 1), axis=0)
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

        def rows_of():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("key", "big", "own", "node", "n", "root", "data")))

        for (_, big), group in groupby(rows_of(), key=lambda r: r[:2]):
            if big is None:
                whole = [r[3:] for r in group]
                out.extend(compare(whole, whole, None))
            else:
                held, wait = [], []
                for r in group:
                    (held if r[2] else wait).append(r[3:])
                    if len(wait) >= BLOCK:
                        out.extend(compare(wait, held, big))
                        wait = []
                        yield from emit(1 << 18)
                if wait:
                    out.extend(compare(wait, held, big))
            yield from emit(1 << 18)
        yield from emit(0)

    rows = rows.select("key", "big", F.coalesce(F.col("root") == F.col("big"), F.lit(False)).alias("own"), "node", "n", "root", "data")
    found = rows.repartition(parts, "key").sortWithinPartitions("key", "big", F.desc("own")).mapInArrow(run, "a bigint, b bigint").distinct()
    found = materialize(found, "rest")
    discard(left, seen, sizes)
    return found


def _cross(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _linked(docs: DataFrame, first: DataFrame, pairs: DataFrame, links: DataFrame | None, text: str, id: str) -> tuple[DataFrame, DataFrame]:
    """(links, roots) after the near ``pairs`` (a < b) are taken in: pairs that other links join already are not compared.

    First each node meets its smallest neighbour; then all pairs that are still
    between components are compared.
    """
    roots = None if links is None else components(links)
    cross = None
    for last in (False, True):
        if roots is not None:
            pairs = cross = materialize(_cross(pairs, roots), "cross")
            if pairs.isEmpty():
                break
        ask = materialize(pairs if last else pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "asked")
        nodes = ask.select(F.col("a").alias("node")).union(ask.select(F.col("b").alias("node"))).distinct()
        sets = node_data(docs, first, nodes, True, text, id)
        found = linked(ask, sets)
        before, links = links, materialize(found if links is None else found.union(links), "links")
        discard(ask, sets, before, roots)
        roots = components(links)
    discard(cross)
    return links, roots


def _rooted(docs: DataFrame, text: str, id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((id, n, node, row_key) of every row of ``docs``, (node, first) the smallest id of each set, (node, root) of every node with links)."""
    rows = materialize(sets_of(docs, text, id), "sets")
    first = materialize(rows.where("n > 0").groupBy("node").agg(F.min("id").alias("first")), "node-ids")
    found = materialize(candidate_groups(docs, text, id), "candidates")
    pairs = materialize(found.where("kind = 0").select("a", "b").distinct(), "pairs")
    groups = found.where("kind = 1")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(groups.select(F.col("a").alias("node"))).distinct()
    sketches = node_data(docs, first, nodes, False, text, id)
    close = materialize(near(pairs, sketches), "near")
    discard(pairs)
    links, roots = _linked(docs, first, close, None, text, id)
    discard(close)
    more = rest_pairs(groups, roots, sketches)
    discard(found, sketches)
    if not more.isEmpty():
        links, roots = _linked(docs, first, more, links, text, id)
    discard(more, links)
    return rows, first, roots


def jaccard_components(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``."""
    rows, first, roots = _rooted(docs, text, id)
    full = rows.where("n > 0")
    lowest = materialize(first.join(roots, "node").groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    linked_ids = materialize(roots.join(lowest, "root").select("node", "component_id"), "linked-ids")
    of_node = materialize(first.join(linked_ids, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id")), "node-components")
    discard(first, lowest, linked_ids, roots)
    # both sides are tables: a node that many rows have is split when they meet
    out = full.join(of_node, "node", "left").select("id", "n", "component_id").union(rows.where("n = 0").select("id", "n", "id"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row of each component of ``docs``: that of the smallest id (nulls last). Of rows without words that agree in id and text, one stays."""
    rows, first, roots = _rooted(docs, text, id)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key"))
    by_node = materialize(rows.where("n > 0").groupBy("node").agg(best.alias("x")), "node-rows")
    linked_to = by_node.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("x").alias("x"))
    stay = materialize(linked_to.select("x.row_key").union(rows.where("n = 0").select("row_key")).distinct(), "kept-rows")
    copies = rows.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    kept = drop_rows(docs, rows.select("row_key").distinct().join(stay, "row_key", "left_anti"), id, text)
    discard(rows, first, roots, by_node, stay)
    if copies:
        return kept
    return kept.withColumn("__key", F.xxhash64(id, text)).dropDuplicates(["__key"]).drop("__key")
