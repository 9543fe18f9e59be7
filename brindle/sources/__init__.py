"""Tables in and out: parquet, delimited text, JSON, JDBC, samples, values and table-valued rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: tuple[str, ...]) -> None:
    """Make tables of a folder known to SQL by their names."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def copy_from(spark: SparkSession, path: str, schema: str, delimiter: str = "\t", null: str = "\\N", header: bool = False, quote: str = '"', escape: str = '"', encoding: str = "UTF-8") -> DataFrame:
    """Bulk text input. An unquoted ``null`` marker is null; a malformed row fails the query."""
    return spark.read.csv(path, schema=schema, sep=delimiter, nullValue=null, header=header, quote=quote, escape=escape, encoding=encoding, mode="FAILFAST", emptyValue="")


def copy_to(df: DataFrame, path: str, delimiter: str = "\t", null: str = "\\N", header: bool = False, quote: str = '"', escape: str = '"', mode: str = "error") -> None:
    df.write.csv(path, sep=delimiter, nullValue=null, header=header, quote=quote, escape=escape, emptyValue='""', mode=mode)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_remote(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query on another database; filters of the result are pushed into it where they can be."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _text_hash(key: str, seed: int) -> Column:
    """A hash that any database can make: MD5 of seed and key as text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def bernoulli(df: DataFrame, percent: float, key: str, seed: int = 0) -> DataFrame:
    """Each row by itself with the given chance, decided by its key: the same rows in every run and partitioning."""
    return df.where(F.conv(F.substring(_text_hash(key, seed), 1, 7), 16, 10).cast("bigint") < int(percent / 100 * (1 << 28)))


def system_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly min(n, rows) rows: those of the smallest keyed hash, found by a distributed top-n."""
    return df.orderBy(_text_hash(key, seed), F.col(key)).limit(n)


def xml_rows(df: DataFrame, column: str, path: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """XMLTABLE: a row for each node that ``path`` finds, with columns (path below the node, type)."""
    found = {n: F.xpath(F.col(column), F.lit(f"{path}/{p}" if p.startswith("@") else f"{path}/{p}/text()")) for n, (p, _) in columns.items()}
    rows = df.select(F.explode(F.arrays_zip(*[v.alias(n) for n, v in found.items()])).alias("r"))
    return rows.select(*[F.col(f"r.{n}").cast(kind).alias(n) for n, (_, kind) in columns.items()])


def update(target: DataFrame, condition: Column, to: dict[str, Column]) -> DataFrame:
    """UPDATE ... SET ... WHERE: rows for which the condition is true are changed, the others stay."""
    hit = F.coalesce(condition, F.lit(False))
    return target.select(*[F.when(hit, to[c]).otherwise(F.col(c)).alias(c) if c in to else F.col(c) for c in target.columns])


def deleted(target: DataFrame, condition: Column) -> DataFrame:
    """DELETE ... RETURNING: the rows that go."""
    return target.where(condition)


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What turns ``old`` into ``new``: a row for each key that is not the same, with op insert, delete or update, and its new columns."""
    rest = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("__old"), F.lit(True).alias("__was"))
    b = new.select(*keys, F.struct(*rest).alias("__new"), F.lit(True).alias("__is"))
    both = a.join(b, keys, "full")
    op = F.when(F.col("__was").isNull(), "insert").when(F.col("__is").isNull(), "delete").when(~F.col("__old").eqNullSafe(F.col("__new")), "update")
    return both.withColumn("op", op).where("op is not null").select(*keys, "op", *[F.col(f"__new.{c}") for c in rest])


def prepare(spark: SparkSession, sql: str):
    """A statement with :names; calling it with their values runs it. Values are never put into the text."""
    return lambda **values: spark.sql(sql, args=values)


def with_ordinality(df: DataFrame, array: Column, value: str = "value", ordinality: str = "ordinality") -> DataFrame:
    """One row for each element, numbered from 1."""
    return df.select("*", F.posexplode(array).alias("__pos", value)).withColumn(ordinality, F.col("__pos").cast("bigint") + 1).drop("__pos")


def row_positions(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows with the file and position they are stored at."""
    return table(spark, folder, name).select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))


def create_table_as(df: DataFrame, path: str, with_data: bool = True) -> DataFrame:
    (df if with_data else df.limit(0)).write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def refresh(df: DataFrame, path: str) -> DataFrame:
    """Full recomputation of a stored result: the baseline that incremental refreshes are held against."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], update: dict[str, Column] | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (keys) DO UPDATE SET ..., or DO NOTHING without ``update``.

    ``update`` may use columns of both sides as t.name and new.name. Of equal
    keys among the new rows the caller has to leave one.
    """
    on = [F.col(f"t.{k}") == F.col(f"new.{k}") for k in keys]
    fresh = rows.alias("new").join(target.alias("t"), on, "left_anti").select(*target.columns)
    if update is None:
        return target.unionByName(fresh)
    joined = target.alias("t").join(rows.withColumn("__hit", F.lit(True)).alias("new"), on, "left")
    old = joined.select(*[F.when(F.col("new.__hit"), update[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in update else F.col(f"t.{c}") for c in target.columns])
    return old.unionByName(fresh)


def delete(target: DataFrame, condition: Column) -> DataFrame:
    """Rows that stay: those for which the condition is false or unknown."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def statement(spark: SparkSession, sql: str) -> DataFrame:
    """A statement with FETCH FIRST n ROWS ONLY and OFFSET n ROWS, in Spark's words for them."""
    sql = re.sub(r"(?i)\bFETCH\s+(?:FIRST|NEXT)\s+(\d+)?\s*ROWS?\s+ONLY", lambda m: f"LIMIT {m[1] or 1}", sql)
    sql = re.sub(r"(?i)\bOFFSET\s+(\d+)\s+ROWS?\b", r"OFFSET \1", sql)
    sql = re.sub(r"(?i)\b(OFFSET \d+)\s+(LIMIT \d+)", r"\2 \1", sql)
    return spark.sql(sql)


def foreign(spark: SparkSession, name: str, schema: str, parts: int, rows) -> DataFrame:
    """A source of one's own: ``rows(part, parts)`` yields the rows (tuples) of each part, on the executors."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(k) for k in range(parts)]

        def read(self, partition):
            yield from rows(partition.value, parts)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()
