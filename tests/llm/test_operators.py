"""Every operator on odd rows (nulls, empty and long texts, repeated rows, clashing names), against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brindle.llm import boosting, decontaminate, mixing, parity_join, ppm, quality_rules, sadedup, token_counts, token_files, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, size string, text_hash string, stratum int, node int, id string, score double"


def _words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randint(0, vocabulary)}x" for _ in range(n)]


LONG = " ".join(_words(1, 3000))
NEAR = LONG.replace(LONG.split()[1500], "other", 1)
SHARED = " ".join(_words(9, 90))
TEXTS = [
    (1, LONG), (1, LONG), (2, NEAR), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "One  TWO"), (8, "é" * 300), (9, "ab " * 400), (None, LONG), (None, None),
    (10, "start " + SHARED + " end of it"), (11, "Other Start\n" + SHARED.upper() + "\nand on"), (12, SHARED + " x"), (13, "same\nsame\n\nsame\n a"), (14, "x" * 50_000),
    *[(100 + k, " ".join(_words(50 + k, 60 + k))) for k in range(20)],
]
ITEMS = [(1, " ".join(SHARED.split()[20:40])), (2, "one two"), (3, None), (4, ""), (5, " ".join(SHARED.split()[25:45])), (6, "never seen words here"), (20, "One two"), (None, "one two"), (5, "one two")]


def _frame(spark, texts=TEXTS):
    rows = [(i, t, [None, "en", "fr"][k % 3], [None, "s1", "s2", "s3"][k % 4], None if t is None else len(t), 1, "a", "b", 2, 3, "c", 0.5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return _frame(spark).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return _frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(100, 118)] + [(9, 0, 1), (9, 1, None), (None, 1, 0), (1, None, None)], "doc_id bigint, quality int, toxic int")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_quality_rules(docs, labels, nothing):
    want = Counter()
    for i, t in TEXTS:
        w = split(t)
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        want[i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)] += 1
    out = quality_rules.quality_rules(docs, labels)
    assert rows_of(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not out.where("kept and base_failed").count()
    assert quality_rules.quality_rules(nothing, labels).count() == 0
    assert quality_rules.apply_rules(docs, labels).columns == docs.columns


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, n) for n in (1, 40, 700) for k in (0, 1, 5, 30) if k <= n], "k bigint, n bigint")
    for r in df.select("k", "n", quality_rules.tail_at_most(F.col("k"), F.col("n"), 0.02).alias("p")).collect():
        assert r.p == pytest.approx(sum(math.comb(r.n, j) * 0.02**j * 0.98 ** (r.n - j) for j in range(r.k + 1)), rel=1e-9)


def test_thresholds_hold_the_risk(spark):
    rng = random.Random(3)
    rows = [(k, "w " * 0 + " ".join(f"u{rng.randint(0, 10**6)}" + ("#" if rng.random() < (0.6 if k % 5 == 0 else 0.001) else "") for _ in range(80)), "en") for k in range(4000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    lab = spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(4000)], "doc_id bigint, quality int, toxic int")
    out = quality_rules.quality_rules(d, lab).selectExpr("doc_id % 5 = 0 AS bad", "kept").groupBy("bad", "kept").count().collect()
    n = {(r.bad, r.kept): r["count"] for r in out}
    assert n.get((False, False), 0) <= 0.05 * 3200 and n.get((True, True), 0) < 40


def test_mixing(docs, nothing, spark):
    want, by = {}, Counter()
    for r in docs.collect():
        by[r.source] += len(split(r.text))
    names = sorted(by, key=lambda x: (x is None, x or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    cap, total = {}, 1.5 * sum(by.values())
    while True:
        free = [s for s in names if s not in cap]
        level = (total - sum(cap.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * by[s]]
        if not over:
            break
        cap |= {s: 2.0 * by[s] for s in over}
    want = {s: cap.get(s, level * weight[s]) for s in names}
    got = mixing.taken(docs, block_words=32).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert {round(r.target, 6) for r in got} == {round(v, 6) for v in want.values()}
    assert sum(r.taken for r in got) == pytest.approx(total, rel=0.02)
    assert rows_of(mixing.taken(docs, block_words=32), "doc_id", "size", "taken") == Counter((r.doc_id, r["size"], r.taken) for r in got)
    assert mixing.taken(nothing).count() == 0
    out = mixing.apply_mix(docs, block_words=32)
    assert out.columns == docs.columns
    assert sum(len(split(r.text)) for r in out.collect()) == sum(r.taken for r in got)


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000):
        p = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345, np.uint64))
        assert sorted(p.tolist()) == list(range(n))


def test_ppm(docs, nothing):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words, ends, model = Counter(), 0, ppm.Adaptive()
    for i, t in TEXTS:
        if not held(i):
            words.update(split(low(t)))
            ends += 1
            model.learn(low(t).encode())
    n, v = sum(words.values()) + ends, len(words) + 1
    got = defaultdict(list)
    for grams in (1_000_000, 500):
        for r in ppm.lm_scores(docs, max_grams=grams).collect():
            got[r.doc_id, r.n_tokens].append(r)
    for i, t in TEXTS:
        w = split(low(t))
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        for r in got[i, len(w) + 1]:
            assert (r.held_out, r.train_tokens) == (held(i), n)
            assert r.n_known == sum(words[x] > 0 for x in w) + 1
            assert r.base_score == pytest.approx(base, rel=1e-12, abs=1e-9)
            assert r.score == pytest.approx(model.score(low(t).encode(), False), rel=1e-5, abs=1e-4)
    assert ppm.lm_scores(nothing).count() == 0
    few = docs.where("doc_id in (4, 6, 9)")
    want = {i: ppm.Adaptive().score(low(t).encode(), True) for i, t in TEXTS if i in (4, 6, 9)}
    assert {r.doc_id: r.score for r in ppm.adaptive_scores(few).collect()} == pytest.approx(want)


@pytest.mark.parametrize("block", [8 << 20, 64])
def test_decontamination(docs, nothing, spark, block):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    want = Counter()
    for i, t in TEXTS:
        w, hit, items = plain(t), set(), set()
        for j, x in ITEMS:
            y = plain(x)
            n = min(10, len(y))
            grams = {tuple(y[k : k + n]) for k in range(len(y) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    items.add(None if j is None else str(j))
        want[i, len(w), len(hit), tuple(sorted(items, key=lambda x: (x is None, x)))] += 1
    got = decontaminate.find(docs, bench, block_bytes=block).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    fewer = decontaminate.find(docs, bench, block_bytes=block, pruned=True).collect()
    assert sorted(map(repr, fewer)) == sorted(map(repr, got))
    kept = decontaminate.clean(docs, bench, block_bytes=block)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[2])
    assert decontaminate.find(nothing, bench).count() == 0
    assert decontaminate.find(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def _components(texts):
    sets = []
    for _, t in texts:
        w = split(low(t))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = i if least[find(k)] is None else min(i, least[find(k)])
    return Counter((i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(texts))


def test_parity_join(docs, nothing):
    assert rows_of(parity_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == _components(TEXTS)
    assert parity_join.jaccard_components(nothing).count() == 0
    kept = parity_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1 and not kept.where("doc_id in (2, 7)").count()


def test_parity_join_of_large_groups(spark):
    """Near copies by the dozen, some of them linked by others only, and many texts around one passage."""
    rng, texts = random.Random(8), []
    base = _words(77, 120, 5000)
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 9)}"
        texts.append((k, " ".join(w)))
    passage = _words(78, 60, 5000)
    texts += [(100 + k, " ".join(_words(200 + k, 40, 5000) + passage)) for k in range(40)]
    texts += [(300 + k, " ".join(_words(5, 5 + k, 50))) for k in range(30)]
    assert rows_of(parity_join.jaccard_components(_frame(spark, texts)), "doc_id", "n_shingles", "component_id") == _components(texts)


def test_boosting(docs, labels, nothing, spark):
    got = boosting.quality_scores(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert boosting.quality_scores(nothing, labels).count() == 0
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = (x[:, 1] * x[:, 3] > 0).astype(float)
    t = boosting.Trees(rounds=60).fit(x[:2000], y[:2000])
    assert ((t.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/é b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u\r\nX: 1", ""), (5, "v", "y" * 300_000), (None, "w", "<p>x</p>"), (2, None, "<p>x</p>"), *[(10 + k, f"h{k}", f"<html>{'common text ' * 40}{k}</html>") for k in range(60)]]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(2)
    manifest = warc.write_warc(df, root=f"file://{tmp_path}/w")
    back = warc.read_warc(manifest, with_payload=True).collect()
    assert len(back) == len(pages)
    first = {}
    for i, _, h in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h or "", i)
    for r in back:
        if r.id is None:
            assert r.record_type == "response"
            continue
        h = next(h or "" for i, _, h in pages if i == int(r.id))
        assert r.payload_bytes == len(h.encode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h] == int(r.id) else ("revisit", str(first[h])))
        if r.record_type == "response":
            assert bytes(r.payload).decode() == h
    data = next(tmp_path.joinpath("w").glob("part-*")).read_bytes()
    assert data[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18])
    assert warc.read_warc(warc.write_warc(df.limit(0))).count() == 0


@pytest.mark.parametrize("n", [1, 3, 9])
def test_warc_always_begins_with_its_dictionary(spark, tmp_path, n):
    df = spark.createDataFrame([(k, f"h{k}", f"<html>page {k}</html>") for k in range(n)], "page_id bigint, url string, html string").coalesce(1)
    back = warc.read_warc(warc.write_warc(df, root=f"file://{tmp_path}/w{n}"), with_payload=True).collect()
    assert {int(r.id): bytes(r.payload).decode() for r in back} == {k: f"<html>page {k}</html>" for k in range(n)}
    assert all(p.read_bytes()[:4] == bytes([0x5D, 0x2A, 0x4D, 0x18]) for p in tmp_path.joinpath(f"w{n}").glob("part-*"))


def test_warc_samples_all_records(spark):
    rows = spark.range(4000).selectExpr("cast(id AS string) id", "cast(null AS string) url", "cast(repeat(cast(id AS string), 100) AS binary) payload", "cast(null AS string) refers_to").selectExpr("*", "sha1(payload) digest", "length(payload) size")
    got = warc.sample_of(rows.union(rows.where("id < 10")), 100_000, "2000-01-01T00:00:00Z")
    at = [int(x.partition(b"<urn:x-page:")[2].partition(b">")[0]) for x in got]
    assert 50_000 < sum(map(len, got)) < 400_000 and len(set(at)) == len(at) and min(at) < 1000 and max(at) > 3000


def test_token_files(docs, nothing, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want, start = Counter(), 0
    rows = [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in TEXTS]
    width = token_files.id_bytes(path)
    key = lambda r: (r[0] is not None, r[0] or 0, np.frombuffer(r[1], "<u4").astype(f"<u{width}").tobytes())
    for i, ids in sorted(rows, key=key):
        want[i, start, len(ids) // 4, zlib.crc32(ids)] += 1
        start += len(ids) // 4
    tokens = token_files.tokenize(docs, path, width=width)
    got = token_files.read_tokens(token_files.write_tokens(tokens, width=width))
    assert rows_of(got, "id", "start", "n_tokens", "ids_crc32") == want
    assert token_files.read_tokens(token_files.write_tokens(token_files.tokenize(nothing, path))).count() == 0


def test_code_is_optimal_under_its_limit():
    import heapq

    counts = np.random.default_rng(1).integers(1, 10_000, 300)
    heap = [(int(c), k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], -total))
    assert (counts * token_files.code_lengths(counts, 30)).sum() == total
    short = token_files.code_lengths(counts, 9)
    assert short.max() <= 9 and (2.0 ** -short.astype(float)).sum() <= 1


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(60):
        t = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 60)), 0).astype(np.uint16)
        sa = sadedup.suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        shared = sadedup.common_prefixes(t, sa)
        for a, b in zip(sa, sa[1:]):
            n = 0
            while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert shared[b] == n


@pytest.mark.parametrize("many", [2048, 1])
def test_suffix_dedup(docs, nothing, many, monkeypatch):
    monkeypatch.setattr(sadedup, "MANY", many)
    length = 400
    data = [(t or "").encode() for _, t in TEXTS]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    want = Counter()
    for (i, _), b in zip(TEXTS, data):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[: len(b)]].tobytes()).hexdigest()] += 1
    assert rows_of(sadedup.removed(docs, length), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert sadedup.removed(nothing).count() == 0


def test_suffix_dedup_of_long_texts_in_parts(spark, monkeypatch):
    """Texts that come in parts, with repeats within one, across its parts, and between two."""
    real = sadedup._pieces
    monkeypatch.setattr(sadedup, "_pieces", lambda column, length: real(column, length, 700, 2000))
    rng = random.Random(2)
    body = "".join(rng.choice("abcdé ") for _ in range(5000))
    texts = [(1, body), (2, body[1000:1800] + "x" * 900), (3, "y" + body[:300] + "z" + body[4000:]), (4, body[2500:3100]), (5, "q" * 2500)]
    data = [t.encode() for _, t in texts]
    seen = Counter(b[k : k + 400] for b in data for k in range(len(b) - 399))
    want = {}
    for (i, _), b in zip(texts, data):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        want[i] = (int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone]))
    df = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    assert {r.doc_id: (r.n_removed, bytes(r.kept)) for r in sadedup.removed(df, 400).collect()} == want


def test_token_counts(docs, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = Counter((i, len((t or "").encode()), count(t), count(t) > 512) for i, t in TEXTS)
    assert rows_of(token_counts.token_counts(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(nothing, path).count() == 0
    c = token_counts.counter(path)
    rng = random.Random(4)
    parts = ["a", "e", " ", "  ", "\n", "'re", "'ll", "'s", "'", "<|endoftext|>", "the", "é", "１", "9", "-", "😀", "tion", "\t", "Ab"]
    for _ in range(150):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        p = c.prefixes(t)
        assert p.tolist() == [count(t[:k]) for k in range(len(t) + 1)]
        assert c.fit(t, 3) == max(k for k in range(len(t) + 1) if p[k] <= 3)
        data = np.frombuffer(("ab" + t + "x y").encode(), np.uint8)
        n = len(t.encode())
        for budget in (0, 1, 3):
            totals, fits = c.batch_totals(data, np.array([0, 2, 2 + n, len(data)]), budget)
            assert (totals[1], fits[1]) == (p[-1], c.fit(t, budget))


def test_other_tokenizer_settings_are_refused(tmp_path):
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            token_counts.PrefixCounter(str(tmp_path / "t.json"))


def _shard(texts, items, **options):
    import pyarrow as pa

    bench = decontaminate.Benchmark(items, 10, **options)
    return bench, lambda: bench.shard(*decontaminate.utf8(pa.array(texts)))


def test_suffixes_that_differ_are_sorted_once(monkeypatch):
    """Only suffixes that still equal others are sorted again."""
    n = 6000
    _, run = _shard([" ".join(f"w{a}x{k}" for k in range(n // 3)) for a in range(3)], [("a", " ".join(f"w1x{k}" for k in range(40, 60)))])
    sizes = []
    for name in ("unique", "argsort"):
        monkeypatch.setattr(decontaminate.np, name, lambda x, *a, f=getattr(np, name), **b: (sizes.append(len(x)), f(x, *a, **b))[1])
    got = run()
    assert got["n_hit"].tolist() == [0, 20, 0] and sum(sizes) < 1.5 * n


def test_suffix_array_is_in_order():
    """Against a plain sort, with copies and few words."""
    some = np.random.default_rng(4)
    texts = [" ".join(some.choice(["a", "b"], some.integers(1, 60))) for _ in range(40)] * 2
    bench, run = _shard(texts, [("a", "a b " * 8)])
    seen = []
    sort = bench._sorted
    bench._sorted = lambda gram, here, size, depth: seen.append((gram, here, size, depth, *sort(gram, here, size, depth))) or seen[-1][4:]
    run()
    gram, here, size, depth, array, ordered, begins = seen[0]
    symbols = np.zeros(size + depth, np.int64)
    symbols[here] = np.unique(gram, return_inverse=True)[1] + 1

    def prefix(p):
        out = symbols[p : p + depth].tolist()
        return out[: out.index(0)] if 0 in out else out

    assert sorted(array.tolist()) == sorted(here.tolist()) and len({tuple(prefix(p)) for p in here}) < len(here)
    assert [prefix(p) for p in array] == sorted(prefix(p) for p in here)
    assert (np.diff(gram[ordered].astype(object)) >= 0).all() and all(gram[ordered][b] == g for b, g in zip(begins, gram[ordered]))
