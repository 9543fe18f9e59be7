"""One row of each component, where ids repeat or are null."""

from collections import Counter

from brindle.llm import parity_join


def test_rows_of_a_component(spark):
    text = lambda k, n=60: " ".join(f"t{k}w{j}" for j in range(n))
    near = text(1, 59) + " other"
    rows = [
        (1, text(1)), (5, near), (5, text(2)), (5, text(3)), (6, text(3)),
        (None, text(4)), (None, text(4)), (None, text(5)), (7, text(5)), (None, None), (None, None), (8, ""), (8, ""), (8, None), (9, ""),
    ]
    kept = parity_join.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    empty = [k for k in got if not k[1]]
    assert {k: n for k, n in got.items() if k[1]} == {(1, text(1)): 1, (5, text(2)): 1, (5, text(3)): 1, (None, text(4)): 1, (7, text(5)): 1}
    assert set(empty) == {(None, None), (8, ""), (8, None), (9, "")} and all(got[k] == 1 for k in empty)
