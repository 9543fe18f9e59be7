"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics are computed with numpy over whole texts, trees are grown on the
driver from a bounded, documented sample of labelled rows, and scoring walks
flattened tree arrays, all rows of a batch at once.

Null and empty texts have statistics of 0 and get a score like any other row; an
empty table gives an empty result, and texts of any length are read whole. Without labels of both kinds the score is constant. Labels that are null or
neither 0 nor 1 are left out; of several labels of one id the smallest counts.
Repeated documents get equal scores. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_mod, lower_ascii, materialize, mix64, per_row, ready, span_hash, tidy, word_spans

FEATURES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "upper", "digit", "punct", "symbol", "bang", "pipe", "high", "space", "lines_per_word",
    "caps_words", "title_words", "symbol_words", "one_char_words", "long_words", "distinct_words", "top_word", "repeat_pairs", "repeat_triples",
    "dup_lines", "dot_words", "entropy", "vowels", "same_as_before",
)


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(chars)] = 1
    return t


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(b"0123456789")
_SYMBOL = _class(b"#*$%&|<>")
_PUNCT = _class(b"!\"'(),-./:;?@[\\]^_`{}~+=")
_HIGH = _class(bytes(range(128, 256)))
_VOWEL = _class(b"aeiouAEIOU")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """float32 [rows, FEATURES] for consecutive UTF-8 texts."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    s, e, first = word_spans(data, offsets)
    words = np.diff(first).astype(float)
    per_byte, per_word = np.maximum(size, 1), np.maximum(words, 1)
    total = lambda table: per_row(table[data], offsets) / per_byte
    length = (e - s).astype(float)
    mean = per_row(length, first) / per_word
    h = span_hash(lower_ascii(data), s, e)
    doc = np.repeat(np.arange(rows), np.diff(first))
    inner = np.concatenate([[0], np.cumsum(_UPPER[data])])
    caps, marks = inner[e] - inner[s], np.concatenate([[0], np.cumsum(_SYMBOL[data])])

    def groups(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By row: number of distinct keys, and the largest count of one."""
        order = np.lexsort((key, of))
        k, d = key[order], of[order]
        edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])) if len(k) else np.zeros(0, int)
        counts = np.diff(np.append(edge, len(k)))
        top = np.zeros(rows)
        np.maximum.at(top, d[edge], counts)
        return np.bincount(d[edge], minlength=rows).astype(float), top

    distinct, top = groups(h, doc)
    out = np.zeros((rows, len(FEATURES)), np.float32)
    values = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(words), "mean_word": mean,
        "sd_word": np.sqrt(np.maximum(per_row(length * length, first) / per_word - mean**2, 0)),
        "upper": total(_UPPER), "digit": total(_DIGIT), "punct": total(_PUNCT), "symbol": total(_SYMBOL), "bang": total(_class(b"!")), "pipe": total(_class(b"|")),
        "high": total(_HIGH), "space": total(_class(b" \t\n\r")), "lines_per_word": per_row(_class(b"\n")[data], offsets) / per_word,
        "caps_words": per_row((caps >= 2) & (caps * 2 > length), first) / per_word,
        "title_words": per_row(caps == 1, first) / per_word, "symbol_words": per_row(marks[e] > marks[s], first) / per_word,
        "one_char_words": per_row(length == 1, first) / per_word, "long_words": per_row(length > 14, first) / per_word,
        "distinct_words": distinct / per_word, "top_word": top / per_word, "vowels": total(_VOWEL),
        "dot_words": per_row(data[e - 1] == 46, first) / per_word if len(e) else np.zeros(rows),
    }
    for name, n in (("repeat_pairs", 2), ("repeat_triples", 3)):
        if len(h) >= n:
            key, at, same = h[: len(h) - n + 1].copy(), doc[: len(h) - n + 1], doc[n - 1 :]
            for k in range(1, n):
                key = mix64(key) ^ h[k : len(h) - n + 1 + k]
            ok = at == same
            found, _ = groups(key[ok], at[ok])
            values[name] = 1 - found / np.maximum(words - n + 1, 1)
            values[name][words < n] = 0
    if len(h):
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        values["same_as_before"] = per_row(again, first) / per_word
    newline = np.ones(256, bool)
    newline[10] = False
    ls, le, lf = word_spans(data, offsets, newline)
    if len(ls):
        lines, _ = groups(span_hash(data, ls, le), np.repeat(np.arange(rows), np.diff(lf)))
        values["dup_lines"] = np.where(np.diff(lf) > 0, 1 - lines / np.maximum(np.diff(lf), 1), 0)
    counts = np.bincount(np.repeat(np.arange(rows), np.diff(offsets)) * 32 + (data >> 3), minlength=rows * 32).reshape(rows, 32) / per_byte[:, None]
    values["entropy"] = -(counts * np.log2(np.maximum(counts, 1e-12))).sum(1)
    for k, name in enumerate(FEATURES):
        if name in values:
            out[:, k] = values[name]
    return out


class Trees:
    """Boosted trees on logistic loss. Nodes of a tree of depth D are numbered 0 .. 2^(D+1)-2 from the root."""

    def __init__(self, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 1.0) -> None:
        self.rounds, self.depth, self.bins, self.rate, self.l2, self.least = rounds, depth, bins, rate, l2, least
        self.base = 0.0
        nodes = (1 << depth + 1) - 1
        self.feature, self.cut, self.value = np.zeros((0, nodes), np.int16), np.zeros((0, nodes), np.float32), np.zeros((0, nodes), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape if x.size else (0, 0)
        if not n:
            return self
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        if y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1]).astype(np.float32)) for f in range(width)]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], 1)  # bin b: value <= cuts[b]
        place = binned + np.arange(width) * self.bins
        nodes = (1 << self.depth + 1) - 1
        margin = np.full(n, self.base)
        trees = []
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-margin))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            feature, cut, value = np.full(nodes, -1, np.int16), np.zeros(nodes, np.float32), np.zeros(nodes, np.float32)
            at = np.zeros(n, np.int64)
            for level in range(self.depth + 1):
                low, count = (1 << level) - 1, 1 << level
                live = at >= low
                node = at - low
                sg, sh = (np.bincount(node[live], v[live], count) for v in (g, h))
                value[low : low + count] = -self.rate * sg / (sh + self.l2)
                if level == self.depth:
                    break
                key = (node[live, None] * (width * self.bins) + place[live]).ravel()
                hg, hh = (np.bincount(key, np.repeat(v[live], width), count * width * self.bins).reshape(count, width, self.bins).cumsum(2) for v in (g, h))
                rg, rh = sg[:, None, None] - hg, sh[:, None, None] - hh
                gain = hg**2 / (hh + self.l2) + rg**2 / (rh + self.l2) - (sg**2 / (sh + self.l2))[:, None, None]
                gain[(hh < self.least) | (rh < self.least)] = -1
                best = gain.reshape(count, -1).argmax(1)
                good = gain.reshape(count, -1).max(1) > 1e-6
                f, b = best // self.bins, best % self.bins
                for k in np.flatnonzero(good):
                    feature[low + k], cut[low + k] = f[k], cuts[f[k]][b[k]]
                down = live & good[np.where(live, node, 0)]
                d = np.flatnonzero(down)
                at[d] = 2 * at[d] + 1 + (binned[d, f[node[d]]] > b[node[d]])
            margin += value[at]
            trees.append((feature, cut, value))
        self.feature, self.cut, self.value = (np.stack(v) for v in zip(*trees))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: every tree's arrays are walked for all rows at once."""
        n = len(x)
        margin, row = np.full(n, self.base), np.arange(n)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(n, np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + 1 + (x[row, f] > cut[at]), at)
            margin += value[at]
        return 1 / (1 + np.exp(-margin))


def document_statistics(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, stats array<float>) of every whole text."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))

    @tidy
    def run(batches):
        for batch in batches:
            parts = [statistics(d, o) for _, d, o in chunks(batch.column("text"))]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
            stats = pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float32()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), stats], ["id", "stats"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, stats array<float>").withColumnRenamed("id", id)


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", max_rows: int = 20_000, **options) -> Trees:
    """Grow trees on at most ``max_rows`` labelled rows, those of the smallest xxhash64(id)."""
    own = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id).alias("id")).agg(F.min(label).alias("label"))
    rows = stats.select(F.col(id).alias("id"), "stats").join(own, "id").select("stats", "label", F.xxhash64("id").alias("h"), "id")
    got = rows.orderBy("h", "id").limit(max_rows).select("stats", "label").toArrow()
    x = got.column("stats").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)), np.float32)
    return Trees(**options).fit(x, got.column("label").to_numpy().astype(float))


def score(stats: DataFrame, trees: Trees, id: str = "doc_id") -> DataFrame:
    """(id, score) of every row; the trees are some hundred kilobytes."""
    kind = stats.schema[id].dataType.simpleString()

    @tidy
    def run(batches):
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(x), pa.float64())], ["id", "score"])

    return stats.select(F.col(id).alias("id"), "stats").mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id)


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; held-out documents' labels are not learned from."""
    stats = materialize(document_statistics(docs), "stats")
    held = (crc_mod("doc_id", 3) == 1).alias("held_out")
    trees = train(stats.where(~(crc_mod("doc_id", 3) == 1)), labels, max_rows=max_rows)
    out = score(stats, trees)
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
