"""The five stages, each on what its predecessor kept, against plain versions; odd rows, empty tables, other columns."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from .test_operators import ITEMS, SHARED, TEXTS, _components, _words, low, split  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, size string, text_hash string"


def _write(spark, folder, texts, items=ITEMS, labels=()):
    rows = [(i, t, [None, "en", "fr"][k % 3], [None, "s1", "s2"][k % 3], None if t is None else len(t), k % 2, "a", "b") for k, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"file://{folder}"


def _steps(spark, folder, monkeypatch):
    """The rows after each stage of run(), written and read again."""
    out, real = [], corpus_pipeline.materialize

    def note(df, name):
        made = real(df, name)
        out.append(made) if len(out) < 5 and name in {n.split()[0].lower() for n, _ in corpus_pipeline.STAGES} else None
        return made

    monkeypatch.setattr(corpus_pipeline, "materialize", note)
    monkeypatch.setattr(corpus_pipeline, "discard", lambda *tables: None)
    assert corpus_pipeline.run(spark, folder) is out[-1] and len(out) == 5
    return out


def _passes(t):
    w = split(t)
    c = Counter(zip(w, w[1:], w[2:]))
    cover = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w) >= 50 and 100 * len(cover) <= 50 * len(w)


def _whole(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages(spark, tmp_path, monkeypatch):
    texts = TEXTS + [(200 + k, " ".join(_words(90 + k, 70))) for k in range(6)] + [(300, None), (301, SHARED + " " + " ".join(_words(3, 60))), (302, "word " * 20)]
    folder = _write(spark, tmp_path, texts)
    start = _whole(spark.read.parquet(f"{folder}/documents.parquet"))
    quality, unique, clean, mixed, files = _steps(spark, folder, monkeypatch)
    names = quality.columns
    assert names == unique.columns == clean.columns == mixed.columns == DOCS.replace(",", "").split()[::2]

    want = Counter({r: n for r, n in start.items() if _passes(r[1])})
    assert _whole(quality) == want

    rows = [r for r, n in want.items() for _ in range(n)]
    groups = defaultdict(list)
    for r, (_, _, root) in zip(rows, _in_order(rows)):
        groups[root].append(r)
    got = unique.collect()
    assert len(got) == len(groups) and all(tuple(r) in want for r in got)
    assert {r.doc_id for r in got} == {min((r[0] for r in g if r[0] is not None), default=None) for g in groups.values()}

    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = set()
    for _, x in ITEMS:
        y = plain(x)
        n = min(10, len(y))
        windows |= {tuple(y[k : k + n]) for k in range(len(y) - n + 1)} if n else set()
    hit = lambda t: any(tuple(plain(t)[k : k + n]) in windows for n in {len(w) for w in windows} for k in range(len(plain(t)) - n + 1))
    assert _whole(clean) == Counter(tuple(r) for r in got if not hit(r.text))

    left = {(r.doc_id, r.source): split(r.text) for r in clean.collect()}
    sizes, taken = Counter(), Counter()
    for (_, s), w in left.items():
        sizes[s] += len(w)
    by_doc = Counter()
    for r in mixed.collect():
        w = split(r.text)
        assert r.n_chars == len(r.text) and set(w) <= set(left[r.doc_id, r.source])
        taken[r.source] += len(w)
        by_doc[r.doc_id, r.source] += len(w)
    assert all(n <= 2 * len(left[k]) for k, n in by_doc.items())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=130 * len(sizes))

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = sorted((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids) + (2,)) for r in mixed.collect())
    rows, at = Counter(), 0
    got = sorted(files.collect(), key=lambda r: r.start)
    for r in got:
        assert r.start == at
        at += r.n_tokens
        rows[r.doc_id, r.n_tokens, r.ids_crc32] += 1
    assert [r.doc_id for r in got] == [i for i, _ in ids]
    assert rows == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)


def _in_order(rows):
    """(id, n, component) of each row, in the order given."""
    sets = _components([(k, r[1]) for k, r in enumerate(rows)])
    root = {k: c for k, _, c in sets}
    return [(r[0], 0, root[k] if split(r[1]) else ("alone", k)) for k, r in enumerate(rows)]


def test_nothing_left(spark, tmp_path):
    folder = _write(spark, tmp_path, [(1, None), (None, ""), (2, "short")], items=[])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_a_stage_that_reads_what_another_left(spark, tmp_path):
    """A stage called on another's unwritten result keeps the files that it reads."""
    folder = _write(spark, tmp_path, TEXTS[:6])
    quality, unique = corpus_pipeline.STAGES[0][1], corpus_pipeline.STAGES[1][1]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert unique(spark, quality(spark, docs, folder), folder).count() > 0


def test_mix_keeps_every_row_of_equal_texts(spark):
    from brindle.llm import mixing

    text = " ".join(_words(5, 300))
    rows = [(1, text, "s", "x1"), (1, text, "s", "x2"), (1, text, "s", "x2"), (2, text, "t", "x3"), (None, text, None, "x4")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra string").repartition(2)
    out = mixing.apply_mix(d, block_words=16).collect()
    assert {r.extra for r in out} == {"x1", "x2", "x3", "x4"}
    twice = Counter(r.extra for r in out)
    assert twice["x2"] > twice["x1"]


def test_mix_shards_are_of_one_size(spark):
    from brindle.llm import mixing

    goals = spark.createDataFrame([("a", 100_000, 150_000.0), ("b", 40_000, 20_000.0), (None, 900, 1800.0)], "source string, source_size bigint, target double")
    slots = mixing.slots_of(goals, 10, shard_slots=64, group=16).collect()
    sizes = Counter(r.shard for r in slots)
    assert max(sizes.values()) <= 65 and min(sizes.values()) >= 62
    assert Counter(r.source for r in slots) == {"a": 15_000, "b": 2_000, None: 180}
    assert max(Counter((r.source, r.block, r["pass"]) for r in slots).values()) == 1
    share = [n for n in Counter(r.shard for r in slots if r.source == "b").values()]
    assert min(share) < 6 and max(share) > 9  # drawn, not dealt evenly
