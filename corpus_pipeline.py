"""From raw documents to token files: five stages, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of ``documents``. Stages 1 to 3
leave rows out and never change one; the mix repeats and cuts documents to its
blocks; the last writes the token files and returns what reading them back
gives.

Rows may repeat, ids and any other column may be null, texts may be empty or
long, tables may be empty, further columns may have any names:

* quality rules: a null text has no words and goes; every other row has its own
  verdict, by its id, text and language; without labels only the base rule rejects;
* join: rows without words stay, once for each id and text; of linked rows that
  with the smallest id stays (a null id only where all are null);
* decontamination: rows without words stay; an empty benchmark removes nothing;
* mix: rows without words are never taken; each other row is a document of its
  own, and a null source is a source;
* token files: null ids come first, rows of one id follow each other in the order
  of their ids of tokens; extra columns end here.

What a stage keeps in the shared folder is removed when the next one begins,
unless that still reads it.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import discard, materialize, remove, roots_of, table, traced
from brindle.llm.decontaminate import clean
from brindle.llm.mixing import apply_mix
from brindle.llm.parity_join import one_of_each
from brindle.llm.quality_rules import apply_rules
from brindle.llm.token_files import id_bytes, read_tokens, tokenize, write_tokens


_held: list[str] = []


def stage(step):
    """A stage that first removes what earlier ones have left, and notes what it leaves itself."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = " ".join(roots_of(docs))
        for path in [p for p in _held if p.rpartition("/")[2] not in read]:
            remove(spark, path)
            _held.remove(path)
        out, paths = traced(lambda: step(spark, docs, sf_dir))
        _held.extend(paths)
        return out

    return run_step


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled ones."""
    return apply_rules(docs, table(spark, sf_dir, "labels"))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 75 % of their 5-word shingles."""
    return one_of_each(docs)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of the benchmark."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each document and pass over it."""
    return apply_mix(docs)


@stage
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, as read back from the files."""
    import public_tokenizers

    vocab = public_tokenizers.path("word_bpe_49k.json")
    width = id_bytes(vocab)
    tokens = materialize(tokenize(docs, vocab, end_id=2, width=width), "token-ids")
    files = write_tokens(tokens, width=width)
    discard(tokens)
    return read_tokens(files).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_files),
]

#: The tokenizer of the last stage has no SQL form; tests hold run() and each of its stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        last, docs = docs, materialize(step(spark, docs, sf_dir), name.split()[0].lower())
        discard(last)
    return docs
