"""Abusive words learned for each stratum."""

import random

from brindle.llm import quality_rules

LABELS = "doc_id bigint, quality int, toxic int"


def _text(rng, words=()):
    w = [f"plain{_letters(rng.randrange(300))}" for _ in range(60)] + list(words)
    rng.shuffle(w)
    return " ".join(w)


def _letters(k):
    return "".join(chr(97 + int(c)) for c in str(k))


def test_words_are_learned_by_stratum_and_significance(spark):
    """1,200 insults of which each is in 3 % of toxic documents; strata that are rare, have no clean documents or copies only."""
    rng, docs, labels = random.Random(4), [], []
    insults = [f"insult{_letters(k)}" for k in range(1200)]
    ids = iter(range(4000))

    def add(lang, toxic, text):
        i = next(ids)
        docs.append((i, text, lang))
        labels.append((i, 1 - toxic, toxic))

    for k in range(3200):  # half of them learn
        toxic = int(k % 2 == 0)
        add("big", toxic, _text(rng, [insults[(20 * k + j) % 1200] for j in range(40)] if toxic else ()))
    for _ in range(20):
        add("no clean", 1, _text(rng))
    for toxic in (1, 1, 1, 0, 0):
        add("rare", toxic, _text(rng))  # too few to mark a word
    copy = _text(rng, ["copied"])
    for k in range(100):
        add("copies", int(k < 50), copy if k < 50 else _text(rng))
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    learned = quality_rules.abusive_words(d, spark.createDataFrame(labels, LABELS))
    assert sorted((r.stratum, r.word) for r in learned.collect()) == sorted(("big", w) for w in insults)


def test_abusive_words_count_in_their_stratum_only(spark):
    rows = [(1, "Foo bar foo, IDIOT", "a"), (1, "Foo bar foo, IDIOT", "a"), (1, "Foo bar foo, IDIOT", "b"), (2, "nothing", "a"), (None, "bar", None), (3, None, "a")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = spark.createDataFrame([("a", "foo"), ("a", "bar"), ("a", "idiot"), ("b", "bar"), ("", "bar")], "stratum string, word string")
    got = {(r.stratum, r.n_abusive) for r in quality_rules.abuse_counts(d, learned).collect()}
    assert got == {("a", 3), ("b", 1), ("", 1)}
    assert quality_rules.abuse_counts(d, learned.limit(0)).count() == 0
