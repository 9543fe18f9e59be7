"""The registered queries of this folder and their SQL (see __spark_entry__.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _vocab(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import taken

    return taken(table(spark, sf_dir, "documents"))


def op3_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op4_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find

    out = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .parity_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .boosting import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_warc, write_warc

    back = read_warc(write_warc(table(spark, sf_dir, "pages")))
    return back.select(F.col("id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import discard, materialize
    from .token_files import id_bytes, read_tokens, tokenize, write_tokens

    vocab = _vocab("word_bpe_49k.json")
    width = id_bytes(vocab)
    tokens = materialize(tokenize(table(spark, sf_dir, "documents"), vocab, end_id=2, width=width), "token-ids")
    files = write_tokens(tokens, width=width)
    discard(tokens)
    return read_tokens(files).withColumnRenamed("id", "doc_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sadedup import removed

    out = removed(table(spark, sf_dir, "documents"), 400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _vocab("byte_bpe_50k.json"), limit=512)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_ppm_scores": op3_ppm_scores,
    "op4_suffix_decontamination": op4_suffix_decontamination,
    "op5_parity_join": op5_parity_join,
    "op6_boosted_quality": op6_boosted_quality,
    "op7_warc_dictionary": op7_warc_dictionary,
    "op8_token_files": op8_token_files,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_counts": op10_token_counts,
}

#: DuckDB's names for lower-casing A-Z alone, and for the words of the joins and rules.
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = "'[^\\x20\\x09-\\x0D]+'"

#: SQL for those that DuckDB can express on whole tables; the others are held against plain versions in tests/llm.
ORACLE: dict[str, str] = {
    "op4_suffix_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
        i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        iw AS (SELECT DISTINCT item, item_id, least(10, len(w)) AS n, w[k:k + least(10, len(w)) - 1] AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
        dw AS (SELECT r, k, n, w[k:k + n - 1] AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
        h AS (SELECT r, k, dw.n, item, item_id FROM dw JOIN iw USING (n, g)),
        c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY r),
        t AS (SELECT r, list(CAST(item_id AS VARCHAR) ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT r, item, item_id FROM h) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)""",
    "op5_parity_join": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOW}, {_WORD}), []) AS w FROM documents),
        s AS (SELECT DISTINCT r, doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[k:k + 4] END AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
        n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
        e AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
        l AS (SELECT x, y FROM e JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
        both_ways AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        reach(x, y) AS (SELECT r, r FROM n UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x),
        m AS (SELECT x AS r, min(doc_id) AS component_id FROM reach JOIN n ON n.r = y GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)""",
    "op7_warc_dictionary": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        f AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((16 * (strpos('0123456789abcdef', h[(5 * j) // 4 + 1]) - 1) + strpos('0123456789abcdef', h[(5 * j) // 4 + 2]) - 1) >> CAST(3 - (5 * j) % 4 AS INT)) & 31) + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
}
