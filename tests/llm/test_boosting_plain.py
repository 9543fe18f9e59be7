"""Document statistics, tree walks and the whole classifier against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from brindle.llm import boosting
from brindle.llm.common import utf8

from .test_operators import LONG, TEXTS, low, split

import pyarrow as pa  # noqa: E402

MORE = ["", "A", "É!", "HTTP #1 | x.\nx.\nx.\n", "One Two TWO two\ttwo  ends.", "a b a b a b", "x" * 20 + " " + "y" * 15, "日本語 テスト\n\nテスト", "\n", "#$ %&"]


def _plain(text):
    t = text or ""
    b, w = t.encode(), [x.encode() for x in split(t)]
    n, size = max(len(w), 1), max(len(b), 1)
    share = lambda chars: sum(c in chars for c in b) / size
    words = [low(x.decode()).encode() for x in w]
    caps = [sum(65 <= c <= 90 for c in x) for x in w]
    runs = lambda k: [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    repeat = lambda k: 1 - len(set(runs(k))) / (len(w) - k + 1) if len(w) >= k else 0.0
    lines = [x for x in t.split("\n") if x]
    kinds = Counter(c >> 3 for c in b)
    mean = sum(map(len, w)) / n
    return {
        "log_bytes": math.log1p(len(b)), "log_words": math.log1p(len(w)), "mean_word": mean, "sd_word": math.sqrt(max(sum(len(x) ** 2 for x in w) / n - mean**2, 0)),
        "upper": share(range(65, 91)), "digit": share(b"0123456789"), "punct": share(b"!\"'(),-./:;?@[\\]^_`{}~+="), "symbol": share(b"#*$%&|<>"), "bang": share(b"!"), "pipe": share(b"|"), "high": share(range(128, 256)), "space": share(b" \t\n\r"), "lines_per_word": t.count("\n") / n,
        "caps_words": sum(c >= 2 and 2 * c > len(x) for c, x in zip(caps, w)) / n, "title_words": sum(c == 1 for c in caps) / n, "symbol_words": sum(bool(re.search(rb"[#*$%&|<>]", x)) for x in w) / n, "one_char_words": sum(len(x) == 1 for x in w) / n, "long_words": sum(len(x) > 14 for x in w) / n,
        "distinct_words": len(set(words)) / n, "top_word": max(Counter(words).values(), default=0) / n, "repeat_pairs": repeat(2), "repeat_triples": repeat(3), "dup_lines": 1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0,
        "dot_words": sum(x.endswith(b".") for x in w) / n, "entropy": -sum(c / size * math.log2(c / size) for c in kinds.values()), "vowels": share(b"aeiouAEIOU"), "same_as_before": sum(x == y for x, y in zip(words, words[1:])) / n,
    }


def test_statistics_are_those_of_a_plain_version():
    texts = [t for _, t in TEXTS] + MORE
    got = boosting.statistics(*utf8(pa.array(texts, pa.string())))
    for row, t in zip(got, texts):
        want = _plain(t)
        assert dict(zip(boosting.FEATURES, row.tolist())) == pytest.approx(want, rel=1e-5, abs=1e-6), t


def test_walking_all_rows_at_once_equals_walking_each():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    t = boosting.Trees(rounds=12, depth=3).fit(x, (x[:, 0] + x[:, 2] > 0.3).astype(float))
    for row, p in zip(x[:80], t.score(x[:80])):
        margin = t.base
        for feature, cut, value in zip(t.feature, t.cut, t.value):
            at = 0
            while at < 7 and feature[at] >= 0:
                at = 2 * at + 1 + int(row[feature[at]] > cut[at])
            margin += value[at]
        assert p == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-6)


def test_a_split_is_the_best_of_all():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (200, 3)).astype(np.float32)
    y = (x[:, 1] > 5).astype(float)
    t = boosting.Trees(rounds=1, depth=1).fit(x, y)
    q = y.mean()
    gain = lambda m: sum(abs(np.sum(q - y[s])) ** 2 / (np.sum(s) * q * (1 - q) + 1) for s in (m, ~m) if s.any())
    best = max(gain(x[:, f] <= c) for f in range(3) for c in range(8))
    assert gain(x[:, t.feature[0, 0]] <= t.cut[0, 0]) == pytest.approx(best)


def test_the_query_scores_by_trees_of_rows_that_are_not_held_out(spark):
    rng = np.random.default_rng(3)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((str(i), " ".join(("##" if bad and rng.random() < 0.3 else "") + f"w{rng.integers(0, 500)}" for _ in range(60))))
        labels.append((str(i), int(not bad) if not held(i) else int(bad)))  # the labels of held-out rows are wrong, and not to be seen
    rows += [("300", None), ("301", LONG * 20), (None, "x"), ("0", rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = boosting.quality_scores(docs, spark.createDataFrame(labels, "doc_id string, quality int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    judged = [r for r in got if r.held_out and int(r.doc_id) < 300]
    assert np.mean([r.predicted == int(int(r.doc_id) % 3 != 0) for r in judged]) > 0.95
    assert all(r.held_out == held("" if r.doc_id is None else r.doc_id) for r in got)
    assert len({r.score for r in got if r.doc_id == "0"}) == 1
