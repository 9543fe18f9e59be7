"""Every registered operator query: the columns that it is to return, and DuckDB's answer where it has SQL."""

import pytest

from brindle.llm import queries
from tests.conftest import DATA, same

COLUMNS = {
    "op1": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op2": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op5": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op8": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op10": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_columns_and_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    want = [tuple(x.split(" ")) for x in COLUMNS[name.split("_")[0]].split(", ")]
    assert df.dtypes[: len(want)] == want
    if name in queries.ORACLE:
        same(df, duck.sql(queries.ORACLE[name]))
    else:
        assert df.count() == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
