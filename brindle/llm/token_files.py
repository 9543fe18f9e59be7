"""Token-id files: canonical length-limited Huffman codes, independent blocks, bit-offset checkpoints.

One file holds the ids of a run of documents in ascending id order:

    magic "BRHF1\\0\\0\\0", uint32 max_bits, uint32 header bytes,
    zlib(int64 symbols, then uint8 code lengths)       the code, from global counts
    blocks: uint32 ids, uint32 payload bytes, uint32 bit offset of each
            CHECKPOINT-th id, then the payload, most significant bit first
    footer: zlib(int64 id count of each document, then the document ids as text lines)
    uint64 footer position

Every block, and every checkpoint in it, can be decoded by itself; the decoder
reads a 2^max_bits table and walks thousands of checkpoints in step.

Null texts count as empty and hold the end id only. Documents with a null id
come first; repeated ids stay separate rows in a fixed order (by their tokens).
Extra columns are ignored, whatever they are called, and an empty table makes an
empty manifest. A text is tokenised whole, in memory one batch at a time.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Sorted, chunks, lower_ascii, materialize, new_path, ranges, ready, shuffle_partitions, span_hash, tidy, trim

MAGIC = b"BRHF1\0\0\0"
CHECKPOINT, BLOCK = 256, 1 << 16


# Tokenising ----------------------------------------------------------------

_KIND = np.full(256, 3, np.uint8)  # of a byte: 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 beyond ASCII
_KIND[list(b" \t\n\x0b\x0c\r")] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[128:] = 4


def safe_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that the pre-tokeniser surely treats apart: white space between them, or a change of ASCII class.

    No cut is made before something that may be a combining mark, or behind an
    apostrophe. Letters of the Latin-1 block count as letters.
    """
    n = len(data)
    kind = _KIND[data]
    cut = np.zeros(n + 1, bool)
    if n:
        a, b, at = kind[:-1], kind[1:], data[:-1]
        before = np.zeros(n - 1, np.uint8)
        before[1:] = data[: max(n - 2, 0)]
        latin = (a == 4) & (before == 0xC3) & (at != 0x97) & (at != 0xB7)
        cut[1:n] = ((a == 0) != (b == 0)) | ((a == 1) & (b != 1) & (b != 4)) | ((a == 2) & (b != 4)) | ((a == 3) & (at != 39) & ((b == 1) | (b == 2))) | (latin & ((b == 2) | (b == 3)))
    cut[0] = cut[n] = True
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    full = kind[edges[:-1]] != 0 if n else np.zeros(0, bool)
    return edges[:-1][full], edges[1:][full]


class Encoder:
    """Encodes many texts at once with a file of the tokenizers library; each distinct piece goes through it once.

    Made for vocabularies that lower-case and drop white space; for others every
    text goes through the library whole.
    """

    MAX_PIECES = 500_000

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.mark = {t["content"]: t["id"] for t in spec["added_tokens"]}
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split"]
        self.by_piece = "Lowercase" in kinds and bool(splits) and splits[0].get("behavior") == "Removed" and bool(self.special)
        self.forget()

    def forget(self) -> None:
        self.known = Sorted()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, hashes: np.ndarray, pieces: list[str]) -> None:
        tokens: list[list[int]] = [[] for _ in pieces]
        plain = [k for k, p in enumerate(pieces) if p.isascii() and p.isalpha()]
        model = self.tokenizer.model.tokenize
        for k in plain:
            tokens[k] = [t.id for t in model(pieces[k])]
        rest = [k for k, p in enumerate(pieces) if not (p.isascii() and p.isalpha())]
        sep = self.special[0]
        number = self.mark[sep]
        for i in range(0, len(rest), 1000):
            some = rest[i : i + 1000]
            ids = np.array(self.whole([sep.join(pieces[k] for k in some)])[0])
            bounds = [-1, *np.flatnonzero(ids == number).tolist(), len(ids)]
            for k, a, b in zip(some, bounds, bounds[1:]):
                tokens[k] = ids[a + 1 : b].tolist()
        first = len(self.known)
        lengths = np.array([len(t) for t in tokens], np.int64)
        total = int(lengths.sum())
        while first + len(pieces) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter((x for t in tokens for x in t), np.uint32, total)
        self.start[first : first + len(pieces)] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + len(pieces)] = lengths
        self.used += total
        self.known.add(hashes, np.arange(first, first + len(pieces)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): text d has ids[first[d]:first[d+1]]."""
        text = data.tobytes()
        rows = len(offsets) - 1
        odd = []
        if not self.by_piece:
            odd = list(range(rows))
        elif any(s.encode() in text for s in self.special):
            odd = [d for d in range(rows) if any(s.encode() in text[offsets[d] : offsets[d + 1]] for s in self.special)]
        low = lower_ascii(data)
        starts, ends = safe_pieces(low, offsets) if self.by_piece else (np.zeros(0, np.int64),) * 2
        if odd:
            keep = ~np.isin(np.searchsorted(offsets, starts, "right") - 1, odd)
            starts, ends = starts[keep], ends[keep]
        found, at, where = np.unique(span_hash(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > self.MAX_PIECES:
            self.forget()
        new = np.flatnonzero(self.known.get(found) < 0)
        if len(new):
            raw = low.tobytes()
            self._add(found[new], [raw[a:b].decode() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
        slot = self.known.get(found)[where]
        each = self.length[slot].astype(np.int64)
        ids = self.flat[ranges(self.start[slot], each)]
        first = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts, offsets)]
        if odd:
            parts = [ids[first[d] : first[d + 1]] for d in range(rows)]
            for d, t in zip(odd, self.whole([text[offsets[d] : offsets[d + 1]].decode() for d in odd])):
                parts[d] = np.array(t, np.uint32)
            ids = np.concatenate(parts) if parts else ids
            first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, first


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _drop_encoders() -> None:
    if _encoders:
        _encoders.clear()
        trim()


def id_bytes(vocab: str) -> int:
    """Bytes that hold any id of a vocabulary file: 2 or 4."""
    with open(vocab, encoding="utf-8") as f:
        spec = json.load(f)
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return 2 if top < 1 << 16 else 4


def tokenize(docs: DataFrame, vocab: str, end_id: int = 2, text: str = "text", id: str = "doc_id", width: int = 4) -> DataFrame:
    """(id, ids): the text's token ids and the end id, as little-endian unsigned numbers of ``width`` bytes (see id_bytes)."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))

    @tidy
    def run(batches):
        e = encoder(vocab)
        for batch in batches:
            for a, data, offsets in chunks(batch.column("text")):
                ids, first = e.encode(data, offsets)
                n = len(offsets) - 1
                out = np.insert(ids, first[1:], end_id).astype(f"<u{width}")
                ends = (first + np.arange(n + 1)) * width
                blob = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, n), blob], ["id", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary")


# The code ------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code length of each symbol, none above ``max_bits`` (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.uint8)
    if n > 1 << max_bits:
        raise ValueError("more symbols than codes")
    order = np.argsort(counts, kind="stable")
    w = counts[order].astype(np.int64)
    levels, merged = [], np.zeros(0, np.int64)
    for _ in range(max_bits):
        every = np.concatenate([w, merged])
        o = np.argsort(every, kind="stable")
        levels.append(o)
        s = every[o]
        m = len(s) // 2 * 2
        merged = s[0:m:2] + s[1:m:2]
    length = np.zeros(n, np.int64)
    take = 2 * n - 2
    for o in reversed(levels):
        chosen = o[:take]
        own = chosen < n
        length[: int(own.sum())] += 1  # symbols are in order of weight: those chosen are the lightest
        take = 2 * int((~own).sum())
    out = np.zeros(n, np.uint8)
    out[order] = length
    return out


class Code:
    """Canonical code of given lengths: shorter codes first, symbols in order within a length."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, max_bits: int) -> None:
        self.symbols, self.lengths, self.max_bits = symbols.astype(np.int64), lengths.astype(np.uint8), max_bits
        order = np.lexsort((self.symbols, self.lengths))
        sizes = np.uint64(1) << (max_bits - self.lengths[order].astype(np.int64)).astype(np.uint64)
        at = np.cumsum(sizes) - sizes
        codes = np.zeros(len(order), np.uint64)
        codes[order] = at >> (max_bits - self.lengths[order].astype(np.int64)).astype(np.uint64)
        top = int(self.symbols.max()) + 1 if len(order) else 1
        self.code, self.bits = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code[self.symbols], self.bits[self.symbols] = codes, self.lengths
        self.table = np.zeros(1 << max_bits, np.uint32)  # by the next max_bits bits: symbol and length
        self.steps = np.ones(1 << max_bits, np.int64)
        filled = np.repeat(order, sizes.astype(np.int64))
        self.table[: len(filled)] = self.symbols[filled]
        self.steps[: len(filled)] = self.lengths[filled]

    @classmethod
    def of(cls, symbols: np.ndarray, counts: np.ndarray, max_bits: int = 16) -> Code:
        max_bits = max(max_bits, int(len(symbols) - 1).bit_length(), 1)
        return cls(symbols, code_lengths(counts, max_bits), max_bits)

    def header(self) -> bytes:
        body = zlib.compress(self.symbols.astype("<i8").tobytes() + self.lengths.tobytes(), 6)
        return MAGIC + struct.pack("<II", self.max_bits, len(body)) + body

    @classmethod
    def read(cls, data: bytes) -> tuple[Code, int]:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        bits, size = struct.unpack_from("<II", data, 8)
        body = zlib.decompress(data[16 : 16 + size])
        n = len(body) // 9
        return cls(np.frombuffer(body, "<i8", n), np.frombuffer(body, np.uint8, n, 8 * n), bits), 16 + size

    def encode(self, ids: np.ndarray) -> bytes:
        """One block."""
        n = len(ids)
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        total = int(ends[-1]) if n else 0
        word, off = at >> 5, at & 31
        value = self.code[ids] << (64 - bits - off).astype(np.uint64)
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if n else np.zeros(0, int)
        out = np.zeros(total // 32 + 3, np.uint64)
        if n:
            own = word[heads]
            out[own] += np.add.reduceat(value >> np.uint64(32), heads)
            out[own + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), heads)
        payload = out.astype(">u4").tobytes()[: (total + 7) // 8]
        return struct.pack("<II", n, len(payload)) + at[::CHECKPOINT].astype("<u4").tobytes() + payload

    def decode(self, blocks: list[tuple[int, np.ndarray, bytes]]) -> np.ndarray:
        """Ids of blocks (ids, bit offsets, payload): all their checkpoints are walked in step."""
        payload = np.frombuffer(b"".join(b[2] + b"\0" * 8 for b in blocks), np.uint8).astype(np.uint32)
        sizes = np.array([len(b[2]) + 8 for b in blocks])
        starts = np.cumsum(sizes) - sizes
        window = np.zeros(len(payload), np.uint32)
        for k in range(4):
            window[: len(payload) - k] |= payload[k:] << np.uint32(24 - 8 * k)
        at = np.concatenate([b[1].astype(np.int64) + 8 * s for b, s in zip(blocks, starts)])
        left = np.concatenate([np.minimum(CHECKPOINT, b[0] - CHECKPOINT * np.arange(len(b[1]))) for b in blocks])
        out = np.zeros((len(at), CHECKPOINT), np.uint32)
        wide = self.max_bits > 25
        if wide:
            raise ValueError("codes longer than 25 bits")
        drop, mask = np.int64(32 - self.max_bits), np.int64((1 << self.max_bits) - 1)
        for k in range(CHECKPOINT):
            next_bits = (window[np.minimum(at >> 3, len(window) - 1)].astype(np.int64) >> (drop - (at & 7))) & mask
            out[:, k] = self.table[next_bits]
            at += self.steps[next_bits]
        return out[np.arange(CHECKPOINT) < left[:, None]]


# Files ---------------------------------------------------------------------


def token_counts_of(tokens: DataFrame, width: int = 4) -> DataFrame:
    """(token, count) over all documents, summed within each task first; as many rows as the vocabulary has entries."""

    @tidy
    def run(batches):
        _drop_encoders()
        totals = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                t = np.frombuffer(ids.as_buffer(), f"<u{width}") if ids.is_valid else np.zeros(0, np.uint32)
                c = np.bincount(t)
                if len(c) > len(totals):
                    c[: len(totals)] += totals
                    totals = c
                else:
                    totals[: len(c)] += c
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(totals[seen], pa.int64())], ["token", "count"])

    return tokens.select("ids").mapInArrow(run, "token bigint, count bigint").groupBy("token").agg(F.sum("count").alias("count"))


def _fs(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path.removeprefix('file:')}")


def write_tokens(tokens: DataFrame, root: str | None = None, max_bits: int = 16, partitions: int | None = None, width: int = 4) -> DataFrame:
    """Write (id, ids) rows, sorted by id, as files below ``root``; returns the manifest (part, path, docs, tokens, bytes)."""
    spark = ready(tokens.sparkSession)
    root = root or new_path(spark, "tokens")
    got = token_counts_of(tokens, width).orderBy("token").toArrow()
    code = Code.of(got.column("token").to_numpy(), got.column("count").to_numpy(), max_bits)
    header = code.header()
    parts = partitions or shuffle_partitions(tokens, 1.0)
    # rows of one id follow each other by their tokens, of which the first also part them among files
    rows = tokens.repartitionByRange(parts, "id", F.substring("ids", 1, 64)).sortWithinPartitions("id", "ids")

    @tidy
    def run(batches):
        _drop_encoders()
        task = TaskContext.get()
        code = _code(header)
        name, fs_top = f"part-{task.partitionId():06d}.tok", _fs(root)
        fs, top = fs_top
        temporary, final = f"{top}/_{name}.{task.taskAttemptId()}", f"{top}/{name}"
        out, at, held, held_n, sizes, ids_text = None, 0, [], 0, [], []

        def put(data: bytes) -> None:
            nonlocal at
            out.write(data)
            at += len(data)

        def flush(last: bool) -> None:
            nonlocal held, held_n
            every = np.concatenate(held) if held else np.zeros(0, np.uint32)
            k = 0
            while len(every) - k >= BLOCK or (last and k < len(every)):
                put(code.encode(every[k : k + BLOCK]))
                k += BLOCK
            held = [every[k:]] if k < len(every) else []
            held_n = max(0, len(every) - k)

        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(temporary, compression=None)
                    put(header)
                t = np.frombuffer(batch.column(1)[i].as_buffer(), f"<u{width}")
                held.append(t)
                held_n += len(t)
                sizes.append(len(t))
                key = batch.column(0)[i].as_py()
                ids_text.append("" if key is None else json.dumps(key))
                if held_n >= 8 * BLOCK:
                    flush(False)
        if out is not None:
            flush(True)
            put(struct.pack("<II", 0, 0))
            footer = at
            put(zlib.compress(np.array([len(sizes), *sizes], "<i8").tobytes() + "\n".join(ids_text).encode(), 3))
            put(struct.pack("<Q", footer))
            out.close()
            fs.move(temporary, final)
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "path": [f"{root}/{name}"], "docs": pa.array([len(sizes)], pa.int64()), "tokens": pa.array([int(sum(sizes))], pa.int64()), "bytes": pa.array([at], pa.int64())})

    return materialize(rows.mapInArrow(run, "part bigint, path string, docs bigint, tokens bigint, bytes bigint"), "token-manifest")


_codes: dict[bytes, Code] = {}


def _code(header: bytes) -> Code:
    if header not in _codes:
        _codes.clear()
        _codes[header] = Code.read(header)[0]
    return _codes[header]


def documents_of(f, size: int):
    """(ids of documents, id count of each, iterator over arrays of token ids) of an open file."""
    f.seek(size - 8)
    footer = struct.unpack("<Q", f.read(8))[0]
    f.seek(footer)
    body = zlib.decompress(f.read(size - 8 - footer))
    n = int(np.frombuffer(body, "<i8", 1)[0])
    sizes = np.frombuffer(body, "<i8", n, 8)
    keys = [json.loads(x) if x else None for x in body[8 + 8 * n :].decode().split("\n")][:n]
    f.seek(0)
    head = f.read(16)
    header = head + f.read(struct.unpack_from("<II", head, 8)[1])
    code = _code(header)

    def ids():
        some = []
        while True:
            count, payload = struct.unpack("<II", f.read(8))
            if count:
                marks = np.frombuffer(f.read(4 * -(-count // CHECKPOINT)), "<u4")
                some.append((count, marks, f.read(payload)))
            if some and (not count or len(some) >= 16):
                yield code.decode(some)
                some = []
            if not count:
                return

    return keys, sizes, ids()


def read_tokens(manifest: DataFrame, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document in the files listed; start counts all ids before it."""
    spark = ready(manifest.sparkSession)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    kinds = pa.int64() if id_type in ("bigint", "int", "smallint", "tinyint") else pa.string()
    names = ["id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    @tidy
    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, p = _fs(path)
                with fs.open_input_file(p) as f:
                    keys, sizes, arrays = documents_of(f, f.size())
                    rest, d, rows = np.zeros(0, np.uint32), 0, []
                    for ids in arrays:
                        rest, k = np.concatenate([rest, ids]), 0
                        while d < len(sizes) and len(rest) - k >= sizes[d]:
                            own = rest[k : k + sizes[d]].astype("<u4").tobytes()
                            rows.append((keys[d], base, int(sizes[d]), zlib.crc32(own), own) if with_ids else (keys[d], base, int(sizes[d]), zlib.crc32(own)))
                            base, k, d = base + int(sizes[d]), k + int(sizes[d]), d + 1
                        rest = rest[k:]
                        if len(rows) >= 5000:
                            yield _rows(rows, kinds, names)
                            rows = []
                    if d < len(sizes):
                        raise ValueError(f"{path} ends early")
                    yield _rows(rows, kinds, names)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = "bigint" if kinds == pa.int64() else "string"
    schema = f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return files.repartition(parts).mapInArrow(run, schema)


def _rows(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
