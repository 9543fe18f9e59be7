"""Quality rules whose cutoffs are chosen from labelled documents under a risk limit.

Statistics, counts, bounds and verdicts are DataFrame expressions throughout.
A rule is a statistic that is large in bad texts; a step is a rule at one of its
cutoffs. In each stratum (language) one half of the labelled texts puts the
steps in order, those with the fewest good texts for each bad one first, and
finds the words that mark toxic texts. The other half tests the sequence: with k
of n good texts rejected by the first i steps together, these are certified if
seeing k or fewer would have probability at most delta / strata were the true
false-rejection rate ``risk`` (the exact binomial tail). The first that fails
ends the sequence, so no more correction is needed within a stratum, and all that
is certified holds together with probability 1 - delta. Of the certified, as many
steps are taken as reject most bad texts less ``price`` times the good ones.
About log(strata / delta) / risk good texts (80 to 110) have to be in a stratum's
testing half; with fewer its rules are off. Texts that are equal are one trial,
however often they are there, and are in one half only.

Null texts have no words and fail the base rule. Null strata are one stratum.
Labels that are null are left out; of several for an id, the worst counts.
Ids may repeat or be null: every row gets its own verdict. Empty tables of
documents or labels are fine (without labels only the base rule rejects). Long
texts cost time n log n. Windows of words are compared by 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_rows, materialize, words_of

SPACE_CLASS = " \t\n\x0b\f\r"
#: The symbols that count as such.
SYMBOLS = "#*$%&|<>"
#: By rule, the cutoffs from mild to strict.
CUTOFFS = {
    "symbols": (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05),
    "capitals": (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeats": (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "abuse": (20.0, 15.0, 12.0, 10.0, 8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0, 0.0),
}
#: Bytes of labels, or of words, that may be broadcast; more are joined by a shuffle.
BROADCAST = 32 << 20


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""

    def covered(t: Column) -> Column:
        marked = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: _neighbour(s, x, k))
            at = F.transform(twice, lambda x: x["i"])
            return _let(at, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)))))

        return F.when(F.size(F.array_distinct(t)) == F.size(t), 0).otherwise(_let(marked, count))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, 0).otherwise(_let(windows, covered))


def _neighbour(s: Column, x: Column, k: Column) -> Column:
    """Whether the entry before or after k in the sorted array has the same hash."""
    same = lambda i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
    return same(k - 1) | same(k + 1)


def _letters(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.split(F.lower(text), "[^\\p{L}]+")


def _text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _row_key(id: str, text: str, stratum: str) -> Column:
    return F.xxhash64(id, text, stratum)


def _learns(text_key) -> Column:
    """Whether a text is of the half that learns."""
    return F.pmod(text_key, F.lit(2)) == 0


def _near(df: DataFrame) -> DataFrame:
    """A materialized table, broadcast if it is small."""
    return F.broadcast(df) if df.count() * 64 <= BROADCAST else df


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("stratum")


def abusive_words(docs: DataFrame, labels: DataFrame, stratum: str = "lang", level: float = 0.05, ratio: float = 20.0) -> DataFrame:
    """(stratum, word): the words that mark a stratum's toxic documents, by the learning half of the labels.

    Such a word is ``ratio`` times rarer in the stratum's other documents, and
    significantly so: were it as frequent there, that many of its occurrences in
    toxic ones (given all of both) would have probability at most ``level`` by
    the number of words tested. Few toxic or few other documents thus mark no
    word. Documents of the same words in the same order of first use count once.
    """
    own = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic"))
    own = materialize(own, "toxic-labels")
    rows = docs.where(_learns(_text_key("text"))).join(_near(own), F.col("doc_id") == F.col("__id")).select(_stratum(stratum), "toxic", F.array_distinct(_letters(F.coalesce(F.col("text"), F.lit("")))).alias("words"))
    texts = rows.groupBy("stratum", F.xxhash64("words").alias("text")).agg(F.max("toxic").alias("toxic"), F.first("words").alias("words"))
    texts = materialize(texts, "labelled-words")
    each = texts.select("stratum", "toxic", F.explode("words").alias("word")).where(F.length("word") > 2)
    counts = each.groupBy("stratum", "word").agg(F.sum("toxic").alias("n_bad"), F.sum(1 - F.col("toxic")).alias("n_good")).where("n_bad > 0")
    counts = materialize(counts, "word-counts")
    totals = texts.groupBy("stratum").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    totals = materialize(totals.join(counts.groupBy("stratum").agg(F.count("*").alias("tested")), "stratum"), "word-totals")
    rarer = (F.col("good") > 0) & (F.col("n_good") * F.col("bad") * ratio <= F.col("n_bad") * F.col("good"))
    # of n_bad + n_good documents with the word, so few are others
    chance = F.when(rarer, tail_at_most(F.col("n_good"), F.col("n_bad") + F.col("n_good"), F.col("good") / (F.col("bad") + F.col("good")))).otherwise(1.0)
    return materialize(counts.join(_near(totals), "stratum").where(chance * F.col("tested") <= level).select("stratum", "word"), "abusive-words")


def abuse_counts(docs: DataFrame, learned: DataFrame, text: str = "text", id: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """(row_key, stratum, n_abusive) of the rows with words that are ``learned`` in their stratum."""
    each = docs.select(_row_key(id, text, stratum).alias("row_key"), _stratum(stratum), F.explode(F.array_distinct(_letters(F.coalesce(F.col(text), F.lit(""))))).alias("word"))
    hits = each.join(_near(learned), ["stratum", "word"])
    return hits.groupBy("row_key", "stratum").agg(F.size(F.collect_set("word")).cast("bigint").alias("n_abusive"))


def statistics(docs: DataFrame, text: str = "text", id: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """Counts of every whole text, beside its id and stratum; all but those of abusive words."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(t, SPACE_CLASS, "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE_CLASS, "")) > 0)
    of_words = _let(words_of(F.col(text)), lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    of_bare = _let(bare, lambda b: F.struct(F.length(b).alias("word_chars"), (F.length(b) - F.length(F.translate(b, SYMBOLS, ""))).alias("n_symbols")))
    dup = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return docs.select(
        F.col(id).alias("doc_id"), _row_key(id, text, stratum).alias("row_key"), _text_key(text).alias("text_key"), _stratum(stratum), of_words.alias("w"), of_bare.alias("b"), dup.cast("bigint").alias("n_dup_lines"),
        F.regexp_count(t, F.lit("\n")).cast("bigint").alias("n_breaks"), F.regexp_count(t, F.lit("\\p{Lu}")).cast("bigint").alias("n_capitals"),
    ).select(
        "doc_id", "row_key", "text_key", "stratum", *[F.col(f"w.{c}").cast("bigint").alias(c) for c in ("n_words", "n_repeat_words")],
        *[F.col(f"b.{c}").cast("bigint").alias(c) for c in ("word_chars", "n_symbols")], "n_dup_lines", "n_breaks", "n_capitals",
    )


def rule_values() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_lines": F.col("n_dup_lines") / (F.col("n_breaks") + 1),
        "repeats": F.col("n_repeat_words") / words,
        "abuse": F.col("n_abusive").cast("double"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def tail_at_most(k: Column, n: Column, p: float | Column) -> Column:
    """Probability of k or fewer successes in n trials of chance p: the exact sum, by the ratio of neighbouring terms."""
    zero = F.struct((n * F.log(F.lit(1 - p))).alias("log"), F.exp(n * F.log(F.lit(1 - p))).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        log = acc["log"] + F.log((n - j + 1) / j) + F.log(F.lit(p / (1 - p)))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    return F.when(k == 0, zero["sum"]).otherwise(F.aggregate(F.sequence(F.lit(1).cast("bigint"), k), zero, add)["sum"])


def thresholds(stats: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, price: float = 4.0) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_false): the strictest cutoff of each rule that is on; the counts are those of a stratum's rules together."""
    own = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("bigint")
    # cutoffs are in falling order: those below a value are the last ``above`` of the list, so cutoff i rejects values with above >= size - i
    level = lambda v, cuts: F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < v))
    held = stats.where(~base_failed()).join(own, "doc_id").groupBy("stratum", "text_key").agg(F.min(good).alias("good"), *[F.max(level(v, CUTOFFS[r])).alias(r) for r, v in rule_values().items()])
    held = materialize(held.withColumn("learned", _learns(F.col("text_key"))), "rule-trials")
    each = held.select("stratum", "text_key", "good", "learned", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("above")) for r in CUTOFFS])).alias("r")).select("stratum", "text_key", "good", "learned", "r.*").where("above > 0")
    grid = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("nth"), F.lit(c).alias("cutoff"), F.lit(len(cuts) - i).alias("needs")) for r, cuts in CUTOFFS.items() for i, c in enumerate(cuts)]))
    seen = each.where("learned").groupBy("stratum", "rule", "above").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    steps = seen.select("stratum").distinct().select("stratum", grid.alias("g")).select("stratum", "g.*").join(seen, ["stratum", "rule"]).where("above >= needs")
    steps = steps.groupBy("stratum", "rule", "nth", "cutoff", "needs").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).where(F.col("bad") > price * F.col("good"))
    order = Window.partitionBy("stratum").orderBy((F.col("good") + 0.5) / (F.col("bad") + 1), "rule", "nth")  # as many rows as there are cutoffs
    steps = materialize(steps.select("stratum", "rule", "cutoff", "needs", F.row_number().over(order).alias("seq")), "rule-steps")
    first = each.where(~F.col("learned")).join(F.broadcast(steps), ["stratum", "rule"]).where("above >= needs").groupBy("stratum", "text_key").agg(F.min("seq").alias("seq"), F.min("good").alias("good"))
    counts = first.groupBy("stratum", "seq").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    sizes = held.groupBy("stratum").agg(F.sum(F.when(~F.col("learned"), F.col("good")).otherwise(0)).alias("n_good")).withColumn("strata", F.count("*").over(Window.partitionBy()))
    so_far = Window.partitionBy("stratum").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(so_far)
    tried = steps.select("stratum", "seq").join(counts, ["stratum", "seq"], "left").select("stratum", "seq", total("good").alias("n_false"), total("bad").alias("n_caught")).join(sizes, "stratum")
    hopeless = (F.col("n_good") == 0) | (F.col("n_false") >= risk * F.col("n_good"))
    passed = F.when(hopeless, False).otherwise(tail_at_most(F.col("n_false"), F.col("n_good"), risk) <= F.lit(delta) / F.col("strata"))
    certified = tried.withColumn("passed", passed).withColumn("certified", F.min(F.col("passed").cast("int")).over(so_far) == 1).where("certified")
    gain = F.col("n_caught") - price * F.col("n_false")
    best = certified.withColumn("gain", gain).where("gain > 0").groupBy("stratum").agg(F.max_by(F.struct("seq", "n_good", "n_false"), F.struct(F.col("gain"), -F.col("seq"))).alias("x")).select("stratum", F.col("x.seq").alias("until"), "x.n_good", "x.n_false")
    return steps.join(best, "stratum").where("seq <= until").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"), F.first("n_good").alias("n_good"), F.first("n_false").alias("n_false"))


def verdicts(stats: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    by = cuts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    rejected = F.lit(False)
    for rule, value in rule_values().items():
        rejected = rejected | F.coalesce(value > F.try_element_at("cuts", F.lit(rule)), F.lit(False))
    out = stats.join(by, "stratum", "left").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("cuts")


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Counts and verdict of every row of ``docs``."""
    found = materialize(abuse_counts(docs, abusive_words(docs, labels)), "abuse-counts")
    stats = statistics(docs).join(_near(found), ["row_key", "stratum"], "left").fillna(0, ["n_abusive"])
    stats = materialize(stats, "rule-stats")
    cuts = materialize(thresholds(stats, labels, **options), "rule-cutoffs")
    return verdicts(stats, cuts)


def apply_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, as they are."""
    out = quality_rules(docs, labels, **options)
    return drop_rows(docs, out.where(~F.col("kept")).select("row_key"), "doc_id", "text", "lang")
