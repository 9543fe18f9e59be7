"""Mixing sources to target weights, by blocks of a fixed number of words.

The words of a source, its documents in id order, form one stream that is cut
into blocks of ``block_words``. A source's target fixes its number of slots. Output
shards all have ``shard_slots`` slots (their number is rounded to even sizes), and
each draws its counts by source from the slots that are left: multinomial draws,
given the totals that the targets fix. Shards are drawn in groups, among which
every source's slots are divided evenly. Slot j of a
source reads block ``perm(j mod blocks)``, a pseudorandom permutation of its
block numbers that differs between passes, so a block is read at most once a
pass and at most ``most`` times in all. Slots and blocks meet in an equi-join on
(source, block), whose keys are spread evenly however large a source is.

Everything follows from the seed: reruns agree. A null source is one of its own,
last in order. Null and empty texts have no words and are never taken. Rows
equal in id, source and text are separate documents. Documents longer than a
block span several, short ones share one. An empty table gives an empty result.
Extra columns are ignored, whatever they are called, but for ``apply_mix``,
which keeps them, each row its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, input_bytes, materialize, ready, shuffle_partitions, tidy, word_spans

#: The weights of sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
KEY = ["doc_id", "source", "text_hash"]


def _row_hash(docs: DataFrame, whole: bool) -> Column:
    """Hash of a row's text, or of all that it holds."""
    rest = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema if f.name != "text"]
    return F.xxhash64("text", *rest) if whole else F.xxhash64("text")


def sizes_of(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, source, text_hash, copy, size) of every row: words of its whole text; copies count rows that are equal (``whole``: in all columns)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), _row_hash(docs, whole).alias("text_hash"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint").alias("size"))
    counted = rows.groupBy(*KEY, "size").agg(F.count("*").alias("copies"))
    return materialize(counted.select(*KEY, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "size"), "mix-sizes")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): ``share`` of all words by weight, no source above ``most`` times its own.

    What is above goes to the others by weight until none is above: sources in
    order of ``most * size / weight`` are capped as long as their share of what
    is left exceeds their cap. One row per source meets in one task here.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    w = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(names) - 1) % len(weights) + 1))
    w = w.withColumns({"cap": F.col("source_size") * F.lit(float(most)), "all": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)), "weights": F.sum("weight").over(Window.partitionBy())})
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    order = filled.rowsBetween(Window.unboundedPreceding, -1)
    left = (F.col("all") - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    w = w.withColumn("level", left).withColumn("nth", F.row_number().over(filled)).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    level = F.min(F.when(~F.col("capped"), F.struct("nth", "level"))).over(Window.partitionBy())["level"]
    return w.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def starts_of(sizes: DataFrame) -> DataFrame:
    """Adds ``start``, the words of the source before this document: sums within key ranges, then over the ranges."""
    parts = shuffle_partitions(sizes, 4.0)
    ranged = sizes.where("size > 0").repartitionByRange(parts, "source", "doc_id", "text_hash", "copy").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "mix-ranges")
    own = Window.partitionBy("part", "source").orderBy("doc_id", "text_hash", "copy").rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0)))
    sums = ranged.groupBy("part", "source").agg(F.sum("size").alias("n"))
    over = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.col("source").alias("s"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    joined = within.alias("w").join(base.alias("b"), (F.col("w.part") == F.col("b.part")) & F.col("w.source").eqNullSafe(F.col("s")))
    return joined.select(*[F.col(f"w.{c}") for c in (*KEY, "copy", "size")], (F.col("base") + F.col("within")).alias("start"))


def pieces_of(placed: DataFrame, block_words: int) -> DataFrame:
    """One row for each block that a document reaches into: block, and the document's words [from, to) in it."""
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    out = placed.withColumn("block", F.explode(F.sequence(first, last)))
    return out.withColumns({
        "from": F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0)),
        "to": F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size")),
    })


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0 .. size-1, elementwise: a four-round Feistel network, walked until back in range."""
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = index.astype(np.uint64), np.arange(len(index))
    while len(open_):
        h, m, k = half[open_], mask[open_], key[open_]
        left, right = out[open_] >> h, out[open_] & m
        for r in range(4):
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r * 0x632BE59BD9B4E019 & (1 << 64) - 1)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & m)
        out[open_] = (left << h) | right
        open_ = open_[out[open_] >= size[open_].astype(np.uint64)]
    return out.astype(np.int64)


def slots_of(goals: DataFrame, block_words: int, shard_slots: int = 8192, seed: int = 0, group: int = 4096) -> DataFrame:
    """(shard, slot, source, block, pass): which block each slot of each output shard reads. ``group`` shards are drawn in one task."""
    spark = ready(goals.sparkSession)
    goals = goals.where("source_size > 0").withColumn("blocks", F.expr(f"(source_size + {block_words} - 1) div {block_words}"))
    goals = goals.withColumn("whole", F.floor(F.col("target") / F.col("source_size")))
    rest = F.round((F.col("target") - F.col("whole") * F.col("source_size")) / block_words)
    goals = goals.withColumn("slots", (F.col("whole") * F.col("blocks") + F.least(rest, F.col("blocks"))).cast("bigint")).where("slots > 0")
    goals = goals.withColumn("groups", F.expr(f"(sum(slots) over () + {shard_slots * group} - 1) div {shard_slots * group}"))
    goals = goals.withColumn("key", F.xxhash64(F.lit(seed), F.col("source"))).withColumn("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)))
    goals = goals.withColumn("first", F.expr("slots * g div groups")).withColumn("count", F.expr("slots * (g + 1) div groups") - F.col("first")).where("count > 0")
    by_group = goals.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("source", "blocks", "key", "first", "count"))).alias("of"))  # an entry for each source

    @tidy
    def deal(batches):
        for batch in batches:
            for g, of in zip(*(c.to_pylist() for c in batch.columns)):
                rng = np.random.default_rng([seed, g])
                names = pa.array([x["source"] for x in of], pa.string())
                blocks, key, at, left = (np.array([x[c] for x in of], np.int64) for c in ("blocks", "key", "first", "count"))
                shards = -(-int(left.sum()) // shard_slots)
                size, more = divmod(int(left.sum()), shards)
                for k in range(shards):
                    drawn = rng.multivariate_hypergeometric(left, size + (k < more), method="marginals")
                    some = np.flatnonzero(drawn)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), *(pa.array(v[some], pa.int64()) for v in (blocks, key, np.full(len(of), g * (group + 1) + k), at, drawn))], ["source", "blocks", "key", "shard", "first", "count"])
                    at, left = at + drawn, left - drawn

    dealt = by_group.mapInArrow(deal, "source string, blocks bigint, key bigint, shard bigint, first bigint, count bigint")

    @tidy
    def place(batches):
        for batch in batches:
            names, shard = batch.column("source"), batch.column("shard").to_numpy()
            blocks, key, first, count = (batch.column(c).to_numpy() for c in ("blocks", "key", "first", "count"))
            for a in range(0, batch.num_rows, 16):
                c = count[a : a + 16]
                row = np.repeat(np.arange(a, a + len(c)), c)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
                j, b = first[row] + nth, blocks[row]
                turn = j // b
                block = permuted(j % b, b, key[row].astype(np.uint64) + turn.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
                yield pa.RecordBatch.from_arrays([pa.array(shard[row]), pa.array(nth, pa.int64()), names.take(pa.array(row)), pa.array(block), pa.array(turn)], ["shard", "slot", "source", "block", "pass"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "shard").mapInArrow(place, "shard bigint, slot bigint, source string, block bigint, pass bigint")


def mix(sizes: DataFrame, block_words: int = 128, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(targets, plan): the plan has a row for each piece of a document that a slot reads, with its shard, slot and pass."""
    goals = materialize(targets(sizes, share, most, weights), "mix-targets")
    pieces = pieces_of(starts_of(sizes), block_words).alias("p")
    slots = slots_of(goals, block_words, seed=seed).alias("s")
    # both sides grow with the input, though the plan's size estimate of the slots is that of the targets they are made from
    plan = pieces.hint("merge").join(slots, (F.col("p.block") == F.col("s.block")) & F.col("p.source").eqNullSafe(F.col("s.source")))
    return goals, plan.select("p.*", "s.shard", "s.slot", "s.pass")


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    sizes = sizes_of(docs)
    goals, plan = mix(sizes, **options)
    got = plan.groupBy(*KEY, "copy").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    same = lambda a, b, names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    out = sizes.alias("a").join(got.alias("b"), same("a", "b", [*KEY, "copy"]), "left")
    out = out.join(goals.alias("g"), F.col("a.source").eqNullSafe(F.col("g.source")), "left")
    return out.select("a.doc_id", "a.size", "g.source_size", "g.target", F.coalesce("b.taken", F.lit(0)).alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, in the columns of ``docs``.

    One row for each document and pass, its text cut to the words that the mix
    takes in that pass (white space between them as it was; apart pieces are
    joined by a line end). ``n_chars``, if there, is the new length.
    """
    spark = ready(docs.sparkSession)
    sizes = sizes_of(docs, whole=True)
    _, plan = mix(sizes, **options)
    spans = plan.groupBy(*KEY, "copy", "pass").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"), F.first("size").alias("size"))
    names = docs.columns
    rows = docs.withColumn("__text_hash", _row_hash(docs, True))
    if not sizes.where("copy > 1").isEmpty():  # rows equal in all columns: one stands for all, the plan has their number
        rows = rows.dropDuplicates(["doc_id", "source", "__text_hash"])
    on = [F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), F.col("d.source").cast("string").eqNullSafe(F.col("s.source")), F.col("d.__text_hash") == F.col("s.text_hash")]
    joined = rows.alias("d").join(spans.alias("s"), on).select(*[F.col(f"d.`{c}`") for c in names], F.col("s.spans.from").alias("__from"), F.col("s.spans.to").alias("__to"), F.col("s.size").alias("__size"))

    @tidy
    def run(batches):
        for batch in batches:
            column = batch.column(names.index("text"))
            lows, highs, size = (batch.column(len(names) + k) for k in range(3))
            texts = []
            for a, data, offsets in chunks(column):
                s, e, first = word_spans(data, offsets)
                for d in range(len(offsets) - 1):
                    ranges = []
                    for x, y in zip(lows[a + d].as_py(), highs[a + d].as_py()):
                        if ranges and ranges[-1][1] == x:
                            ranges[-1][1] = y
                        else:
                            ranges.append([x, y])
                    if ranges == [[0, size[a + d].as_py()]]:
                        texts.append(data[offsets[d] : offsets[d + 1]].tobytes().decode())
                        continue
                    texts.append("\n".join(data[s[first[d] + x] : e[first[d] + y - 1]].tobytes().decode() for x, y in ranges))
            cols = [batch.column(k) for k in range(len(names))]
            cols[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                cols[names.index("n_chars")] = pa.array([len(t) for t in texts], cols[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, docs.schema)
