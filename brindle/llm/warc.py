"""WARC archives compressed with a Zstandard dictionary, written and read in parallel.

Each archive is one file: a skippable frame that holds the dictionary, then one
Zstandard frame per record, so that a record can be read from its offset alone.
The dictionary is trained on a sample of the records of all archives, and every
archive holds it; of too few records to train on, their bytes are the dictionary.
Records whose payloads are equal (same SHA-1 and length) are written once as
``response``; the others become ``revisit`` records without a payload.

Null payloads count as empty, null addresses get ``urn:x-page:<id>``. Rows with
a null id are always responses. Rows that repeat both id and payload are all of
the kind that the id gets. Columns other than the three named are ignored. An
empty table gives an empty manifest. A payload is held in memory one at a time,
however long.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, new_path, ready, tidy

#: The skippable frame's magic number and the revisit profile of the WARC format.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path.removeprefix('file:')}")


def _dictionary(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """Trained on the records; where they are too few for that, the last of their bytes are the dictionary."""
    try:
        return zstandard.train_dictionary(size, records)
    except (zstandard.ZstdError, ValueError):
        return zstandard.ZstdCompressionDict(b"".join(records)[-size:].rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def record(id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One uncompressed WARC record."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"{NAME}{id}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <{NAME}{id}>" if id is not None else f"WARC-Record-ID: <{NAME}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    block = http + payload
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{NAME}{refers_to}>"]
        block = http
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sample_of(rows: DataFrame, most: int, date: str) -> list[bytes]:
    """Records of about ``most`` bytes in all, chosen by hash from all rows; equal rows count once, records longer than ``most`` are left out."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    hashed = rows.where(F.col("size") <= most).withColumn("h", F.xxhash64("id", "url", "digest", "size"))
    some = hashed.where(F.pmod("h", F.lit(max(1, total // most))) == 0).groupBy("h", "id", "url", "refers_to", "digest").agg(F.first("payload").alias("payload"))
    out, held = [], 0
    for r in some.orderBy("h", "id", "url").collect():
        out.append(record(r.id, r.url, bytes(r.payload), r.refers_to, date))
        held += len(out[-1])
        if held > 2 * most:
            break
    return out


def write_warc(pages: DataFrame, root: str | None = None, id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, dictionary_bytes: int = 64 << 10, sample_bytes: int = 2 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the rows as archives below ``root`` and return the manifest (path, records, bytes).

    min_bytes: payloads below this size are never turned into revisits.
    sample_bytes: about the most of an archive's records that its dictionary is learned from: those of smallest hash of all.
    """
    spark = ready(pages.sparkSession)
    root = root or new_path(spark, "warc")
    rows = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumns({"digest": F.sha1("payload"), "size": F.length("payload")})
    light = materialize(keyed.where(F.col("id").isNotNull() & (F.col("size") >= min_bytes)).select("id", "digest", "size").distinct(), "warc-digests")
    firsts = materialize(light.groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-firsts")
    revisits = light.join(firsts, ["digest", "size"]).where("id != first")
    rows = keyed.join(revisits, ["id", "digest", "size"], "left").select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("first").cast("string").alias("refers_to"), "digest", "size")
    records = sample_of(rows, sample_bytes, date)
    shared = spark.sparkContext.broadcast(_dictionary(records, dictionary_bytes).as_bytes() if records else b" " * 8)
    rows = rows.select("id", "url", "payload", "refers_to")

    @tidy
    def run(batches):
        task = TaskContext.get()
        name, out, wrote, count = f"part-{task.partitionId():06d}.warc.zst", None, 0, 0
        fs, top = _open(root)
        temporary, final = f"{top}/_{name}.{task.taskAttemptId()}", f"{top}/{name}"
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k) for k in range(4)]
            made = (record(*(c[i].as_py() for c in cols), date) for i in range(batch.num_rows))
            if out is None:
                fs.create_dir(top, recursive=True)
                out = fs.open_output_stream(temporary, compression=None)
                data = shared.value
                out.write(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
                wrote += 8 + len(data)
                store = zstandard.ZstdCompressionDict(data)
                store.precompute_compress(level=level)
                packer = zstandard.ZstdCompressor(level=level, dict_data=store)
            for x in made:
                frame = packer.compress(x)
                out.write(frame)
                wrote += len(frame)
                count += 1
        if out is not None:
            out.close()
            fs.move(temporary, final)
            yield pa.RecordBatch.from_pydict({"path": [f"{root}/{name}"], "records": pa.array([count], pa.int64()), "bytes": pa.array([wrote], pa.int64())})

    manifest = materialize(rows.sortWithinPartitions("id", "refers_to", "url").mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-manifest")
    discard(light, firsts)
    return manifest


def records_of(stream) -> object:
    """(headers, block) of each record of one archive, read as a stream."""
    head = stream.read(8)
    store = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        store, head = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0])), b""
    source = stream if not head else io.BytesIO(head + stream.read())
    reader = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=store).stream_reader(source, read_across_frames=True, read_size=1 << 17), 1 << 17)
    while line := reader.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("not the start of a record")
        headers = {}
        while (line := reader.readline().rstrip(b"\r\n")):
            k, _, v = line.partition(b": ")
            headers[k.decode().lower()] = v.decode()
        block = reader.read(int(headers["content-length"]))
        reader.read(4)
        yield headers, block


def read_warc(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives listed: id, uri, record_type, refers_to, payload_bytes, payload_digest[, payload].

    Size and digest of responses come from the payload itself, which has to
    agree with the record's header; those of revisits from the header.
    """
    spark: SparkSession = ready(manifest.sparkSession)
    names = ["id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload

    @tidy
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, p = _open(path)
                rows = []
                with fs.open_input_stream(p, compression=None) as f:
                    for h, block in records_of(f):
                        http, _, body = block.partition(b"\r\n\r\n")
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response":
                            size = len(body)
                            if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                                raise ValueError(f"damaged record {h['warc-record-id']} in {path}")
                        else:
                            size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
                        plain = lambda x: x and (x.strip("<>").removeprefix(NAME) or None)
                        rows.append((plain(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], plain(h.get("warc-refers-to")), size, digest, *([body] * with_payload)))
                        if len(rows) >= (200 if with_payload else 20000):
                            yield _batch(rows, with_payload)
                            rows = []
                yield _batch(rows, with_payload)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "id string, uri string, record_type string, refers_to string, payload_bytes bigint, payload_digest string" + ", payload binary" * with_payload
    return manifest.select("path").repartition(parts).mapInArrow(run, schema).select(*names)


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string()] + [pa.binary()] * with_payload
    names = ["id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    cols = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names[: len(kinds)])
