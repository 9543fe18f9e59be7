"""What a Python worker holds: rows come in batches of limited bytes, and a task that ends leaves little behind."""

import ast
import subprocess
import sys
import tracemalloc
from pathlib import Path
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brindle.llm import common, parity_join

LLM = Path(common.__file__).parent

LEAVES = """
import os
import numpy as np, pyarrow as pa
from brindle.llm import common

def mb():
    return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

def run(batches):
    held = [np.ones(10_000) for _ in range(3000)]  # some 240 MB of the heap, below a block that stays
    run.last = held[-1]
    common.span_hash(np.zeros(8 << 20, np.uint8), np.array([0]), np.array([9]))
    yield from batches

common.give_back()
before = mb()
list(common.tidy(run)([1]))
print(mb() - before)
"""


def test_task_leaves_little():
    left = subprocess.run([sys.executable, "-c", LEAVES], cwd=LLM.parents[1], capture_output=True, text=True, check=True).stdout
    assert int(left) < 60


def test_hashes_in_blocks():
    data = common._RNG.integers(0, 256, (1 << 18) + 999).astype("uint8")
    starts, ends = np.array([0, 5, (1 << 18) - 9, 1 << 18, 7]), np.array([3, len(data), (1 << 18) + 200, len(data), 7])
    common._power(3 << 20)
    one = common.span_hash(data, starts, ends)
    common.give_back()
    assert len(common._powers[0]) == 1
    assert (common.span_hash(data, starts, ends) == one).all()
    for a, b, h in zip(starts, ends, one):
        n = int(b - a)
        plain = sum(int(common._BYTE[c]) * pow(int(common._STEP), k, 1 << 64) for k, c in enumerate(data[a:b][:300])) if n <= 300 else None
        if plain is not None:
            assert common.mix64(np.array([plain % (1 << 64) ^ n * 0xA24BAED4963EE407 % (1 << 64)], np.uint64))[0] == h
        assert common.span_hash(data[a:b].copy(), np.array([0]), np.array([n]))[0] == h


def peak(make):
    tracemalloc.start()
    try:
        return make(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_hashes_need_little():
    data, spans = np.ones(4 << 20, np.uint8), (np.array([3]), np.array([900]))
    assert peak(lambda: common.span_hash(data, *spans))[1] < 64 << 20  # the sums are 32 MB


def test_pairs_of_near_copies_need_little(monkeypatch):
    given, frame = [], MagicMock()
    frame.select.return_value = frame.repartition.return_value = frame
    frame.mapInArrow.side_effect = lambda f, kind: given.append(f) or frame
    frame.sparkSession.sparkContext.broadcast = lambda v: MagicMock(value=v)
    monkeypatch.setattr(parity_join, "_texts", lambda *a: frame)
    monkeypatch.setattr(parity_join, "shuffle_partitions", lambda *a: 1)
    parity_join.candidate_groups(None, hot=np.zeros(0, np.uint64))
    own = [" ".join(f"w{d}_{k}" for k in range(300)) for d in range(200)]
    texts = pa.RecordBatch.from_arrays([pa.array([f"{t} copy{k}" for k in range(10) for t in own])], ["text"])
    rows = list(given[0]([texts]))
    found, most = peak(lambda: list(given[1](rows)))
    assert sum(b.num_rows for b in found) == 200 * 45
    assert most < 5 * sum(b.nbytes for b in rows)  # copies meet under some 90 keys each


def test_every_task_gives_back():
    for path in LLM.glob("*.py"):
        tree = ast.parse(path.read_text())
        given = {c.args[0].id for c in ast.walk(tree) if isinstance(c, ast.Call) and getattr(c.func, "attr", "") == "mapInArrow"}
        for f in ast.walk(tree):
            if isinstance(f, ast.FunctionDef) and f.name in given and f.args.args and f.args.args[0].arg == "batches":
                assert "tidy" in [getattr(d, "id", "") for d in f.decorator_list], (path.name, f.name, f.lineno)


def test_batches_of_limited_bytes(spark):
    old = spark.conf.get(common.BATCH, None)
    try:
        spark.conf.unset(common.BATCH)
        common.ready(spark)
        docs = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("abcdefgh"), 1000).alias("text"))

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

        got = docs.mapInArrow(sizes, "n bigint, bytes bigint").collect()
        assert sum(r.n for r in got) == 4000 and max(r.bytes for r in got) < 1.1 * common.BATCH_BYTES
        spark.conf.set(common.BATCH, "9m")  # a session's own limit stays
        assert common.ready(spark).conf.get(common.BATCH) == "9m"
    finally:
        spark.conf.unset(common.BATCH) if old is None else spark.conf.set(common.BATCH, old)
