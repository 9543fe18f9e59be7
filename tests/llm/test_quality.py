"""Thresholds and verdicts of the quality rules against a plain version; repeats; rejection by row."""

import math
import random
from collections import defaultdict

import pytest
import xxhash

from brindle.llm import quality_rules as qr

DOCS, LABELS = "doc_id bigint, text string, lang string", "doc_id bigint, quality int, toxic int"


def _learns(text):
    return xxhash.xxh64_intdigest((text or "").encode(), seed=42) % 2 == 0


def _corpus(n=1500, seed=5):
    rng, docs, labels = random.Random(seed), [], []
    for k in range(n):
        bad, lang = rng.random() < 0.25, rng.choice(["a", "a", "b", None])
        symbols = rng.choice([0.5, 0.4]) if bad and k % 2 else 0.01
        words = [f"v{rng.randint(0, 10**6)}" + ("#" if rng.random() < symbols else "") for _ in range(80)]
        text = " ".join(words if not bad or k % 2 else words[:50] + ["again and again"] * 9)
        docs.append((k, text, lang))
        if rng.random() < 0.9:
            labels.append((k, int(not bad if rng.random() < 0.98 else bad), 0))
    return docs, labels


def _plain(stats, labels, risk=0.05, delta=0.05, price=4.0):
    """(stratum, rule) -> (cutoff, n_good, n_false), from rows of statistics."""
    own = {}
    for i, q, t in labels:
        old = own.get(i, (1, 0))
        own[i] = (min(old[0], q), max(old[1], t))
    trials = {}
    for r in stats:
        if r.doc_id in own and not (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words):
            good = int(own[r.doc_id] == (1, 0))
            words = max(r.n_words, 1)
            value = {"symbols": r.n_symbols / words, "capitals": r.n_capitals / max(r.word_chars, 1), "dup_lines": r.n_dup_lines / (r.n_breaks + 1), "repeats": r.n_repeat_words / words, "abuse": float(r.n_abusive)}
            key = (r.stratum, r.text_key)
            trials[key] = (min(good, trials.get(key, (1,))[0]), value)
    strata, out = {s for s, _ in trials}, {}
    for s in strata:
        mine = [(k % 2 == 0, g, v) for (t, k), (g, v) in trials.items() if t == s]
        steps = []
        for rule, cuts in qr.CUTOFFS.items():
            for nth, c in enumerate(cuts):
                good = sum(g for learn, g, v in mine if learn and v[rule] > c)
                bad = sum(1 - g for learn, g, v in mine if learn and v[rule] > c)
                if bad > price * good:
                    steps.append(((good + 0.5) / (bad + 1), rule, nth, c))
        steps.sort()
        tested = [(g, v) for learn, g, v in mine if not learn]
        n, best = sum(g for g, _ in tested), None
        for k in range(1, len(steps) + 1):
            hit = [g for g, v in tested if any(v[rule] > c for _, rule, _, c in steps[:k])]
            false = sum(hit)
            if n == 0 or false >= risk * n or sum(math.comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(false + 1)) > delta / len(strata):
                break
            gain = len(hit) - false - price * false
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, k, n, false)
        for _, rule, _, c in steps[: best[1]] if best else []:
            out[s, rule] = (min(c, out.get((s, rule), (c,))[0]), best[2], best[3])
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_thresholds_and_verdicts_are_those_of_a_plain_version(spark, seed):
    docs, labels = _corpus(seed=seed)
    d, lab = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    out = qr.quality_rules(d, lab).persist()
    want = _plain(out.collect(), labels)
    cuts = {(r.stratum, r.rule): (r.cutoff, r.n_good, r.n_false) for r in qr.thresholds(out, lab).collect()}
    assert cuts == want and {s for s, _ in cuts} >= {"a"}
    by = defaultdict(dict)
    for (s, rule), (c, _, _) in want.items():
        by[s][rule] = c
    for r in out.collect():
        words = max(r.n_words, 1)
        value = {"symbols": r.n_symbols / words, "capitals": r.n_capitals / max(r.word_chars, 1), "dup_lines": r.n_dup_lines / (r.n_breaks + 1), "repeats": r.n_repeat_words / words, "abuse": float(r.n_abusive)}
        assert r.kept == (not r.base_failed and not any(value[rule] > c for rule, c in by[r.stratum].items()))


def test_repeated_rows_buy_no_certificate(spark):
    docs, labels = _corpus(400)
    lab = spark.createDataFrame(labels, LABELS)
    more = [(i + 10_000 * k, t, s) for k in range(3) for i, t, s in docs]
    lab_more = spark.createDataFrame([(i + 10_000 * k, q, t) for k in range(3) for i, q, t in labels], LABELS)
    once = qr.thresholds(qr.quality_rules(spark.createDataFrame(docs, DOCS), lab), lab).collect()
    same_ids = qr.thresholds(qr.quality_rules(spark.createDataFrame(docs * 3, DOCS), lab), lab).collect()
    other_ids = qr.thresholds(qr.quality_rules(spark.createDataFrame(more, DOCS), lab_more), lab_more).collect()
    assert sorted(once) == sorted(same_ids) == sorted(other_ids)


def test_a_rejection_in_one_language_leaves_the_other(spark):
    text = " ".join(f"u{k}#" for k in range(80))
    docs, labels = [], []
    rng = random.Random(1)
    for k in range(900):
        bad = k % 3 == 0
        docs.append((k, " ".join(f"u{rng.randint(0, 10**6)}" + "#" * bad for _ in range(60)), "a"))
        labels.append((k, int(not bad), 0))
    docs += [(5000, text, "a"), (5000, text, "b"), (5001, None, "b"), (None, text, None)]
    kept = qr.apply_rules(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert sorted((r.doc_id or 0, r.lang or "") for r in kept.where("doc_id is null or doc_id >= 5000").collect()) == [(0, ""), (5000, "b")]
    assert kept.where("doc_id < 5000").count() == 600


@pytest.mark.parametrize("rows", [[], [(k, 0, 1) for k in range(100)], [(k, 1, 0) for k in range(100)], [(None, None, None)] * 3])
def test_labels_of_one_kind_or_none(spark, rows):
    docs, _ = _corpus(100)
    lab = spark.createDataFrame(rows, LABELS)
    out = qr.quality_rules(spark.createDataFrame(docs, DOCS), lab).collect()
    assert len(out) == 100 and all(r.kept == (not r.base_failed) for r in out)
