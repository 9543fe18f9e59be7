"""Token counts at every prefix, by dynamic programming over a byte-pair vocabulary.

For a piece of text that the pattern keeps together, the last token of each
prefix's encoding is the one vocabulary entry that ends there and *agrees* with
the last token of the prefix before it; so ``count[i] = count[i - len] + 1``.
Two tokens agree if merging their joined bytes gives the two back. Counts of
whole pieces add up, so one pass gives the exact count of every prefix, and
truncation or budget questions need no second encoding.

Null texts count as empty (0 tokens), an empty table gives an empty result. Ids
pass through, extra columns are ignored and rows are never merged: repeated rows
give repeated results. Long pieces cost time in proportion to their length, memory
by one batch of texts. A file with other settings than plain byte-level merging
is refused.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64, per_row, ready, span_hash, tidy, utf8

#: The pre-tokenising pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Contractions that a cut splits into an apostrophe and letters.
CUT_CONTRACTIONS = {"'re", "'ve", "'ll"}


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabulary files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _check(spec: dict, path: str) -> None:
    """Raise unless the file asks for byte-level pieces by PATTERN and plain merges, and nothing more."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += ["normalizer"] * bool(spec.get("normalizer")) + ["model"] * (model.get("type") != "BPE")
    odd += ["pre_tokenizer"] * (cut.get("type") != "ByteLevel" or bool(cut.get("add_prefix_space")) or not cut.get("use_regex", True))
    odd += [t["content"] for t in spec["added_tokens"] if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if odd:
        raise ValueError(f"{path}: settings that prefix counting does not know: {', '.join(odd)}")


class PrefixCounter:
    """Exact token counts of prefixes for one byte-level BPE file of the tokenizers library."""

    #: Entries kept in the table of pieces before it is started anew.
    MAX_PIECES = 600_000

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec, path)
        chars = _byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.ends: dict[bytes, int] = {}  # every suffix of an entry; -1 where it is no entry itself
        for t, i in self.vocab.items():
            for k in range(1, len(t)):
                self.ends.setdefault(t[k:], -1)
        self.ends.update(self.vocab)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            pair, new = (self.vocab[a], self.vocab[b]), self.vocab[a + b]
            if pair not in self.rank:
                self.rank[pair] = k
            self.parts.setdefault(new, pair)
        self.made = {t: self.rank[p] for t, p in self.parts.items()}
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = tuple(special)
        self.agreed: dict[tuple[int, int], bool] = {}
        self.totals = _Totals(self)
        self.by_hash: dict[int, int] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first; used where a vocabulary entry itself is in question."""
        ids = [self.vocab[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(ids, ids[1:]))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            ids[i : i + 2] = [self.vocab[self.bytes_of(ids[i]) + self.bytes_of(ids[i + 1])]]
        return ids

    def bytes_of(self, t: int) -> bytes:
        if not hasattr(self, "_bytes"):
            self._bytes = {i: b for b, i in self.vocab.items()}
        return self._bytes[t]

    def agree(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives exactly [left, right]; ``left`` = -1 stands for the piece's start."""
        key = (left << 20) | right if left >= 0 else -1 - right
        if (known := self.agreed.get(key)) is None:
            if len(self.agreed) > 2_000_000:
                self.agreed.clear()
            if left < 0:
                known = self.merged(self.bytes_of(right)) == [right]
            else:
                known = self._seam(left, right)
            self.agreed[key] = known
        return known

    def _seam(self, a: int, b: int) -> bool:
        """Undo the later of both sides' last merges, step by step: no pair that meets at the seam may merge before it.

        ``a`` ends with, ``b`` begins with, ever smaller parts. A merge across
        the seam with rank r happens if r comes before the merges that made the
        current parts into larger ones (on ties the left pair goes first).
        """
        until_a = until_b = 1 << 60  # rank of the merge that takes the current part into a larger one
        rank, made, parts = self.rank, self.made, self.parts
        while True:
            r = rank.get((a, b))
            if r is not None and r < until_a and r <= until_b:
                return False  # at equal rank the seam's pair is to the left of the right side's, and so goes first
            ra, rb = made.get(a, -1), made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until_a, a = ra, parts[a][1]
            else:
                until_b, b = rb, parts[b][0]

    def extend(self, piece: bytes, count: list[int], last: list[int], at: int) -> None:
        """Fill in entries at + 1 .. len(piece) of both lists, given those up to ``at``."""
        ends, agreed, agree = self.ends.get, self.agreed.get, self.agree
        for i in range(at + 1, len(piece) + 1):
            j = i - 1
            while j >= 0 and (t := ends(piece[j:i])) is not None:
                if t >= 0:
                    left = last[j]
                    ok = agreed((left << 20) | t if left >= 0 else -1 - t)
                    if ok is None:
                        ok = agree(left, t)
                    if ok:
                        count[i], last[i] = count[j] + 1, t
                        break
                j -= 1

    def counts(self, piece: bytes) -> list[int]:
        """Token count of every prefix of a piece that the pattern keeps together: entry i is for its first i bytes."""
        count, last = [0] * (len(piece) + 1), [-1] * (len(piece) + 1)
        self.extend(piece, count, last, 0)
        return count

    def count_all(self, pieces: list[bytes]) -> dict[bytes, int]:
        """Last entry of counts() of each piece; in sorted order, neighbours share the entries of their common prefix."""
        out, before = {}, b""
        count, last = [0], [-1]
        for piece in sorted(pieces):
            at, most = 0, min(len(before), len(piece))
            while at < most and before[at] == piece[at]:
                at += 1
            grown = len(piece) - at
            count[at + 1 :], last[at + 1 :] = [0] * grown, [-1] * grown
            self.extend(piece, count, last, at)
            out[piece], before = count[-1], piece
        return out

    def _runs(self, text: str):
        """(run, is_special) in order, split at special strings."""
        if self.special is None or not any(m in text for m in self.marks):
            yield text, False
            return
        at = 0
        for m in self.special.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def batch_totals(self, data: np.ndarray, offsets: np.ndarray, budget: int = 1 << 60) -> tuple[np.ndarray, np.ndarray]:
        """(token count, code points of the longest prefix of at most ``budget`` tokens) of consecutive UTF-8 texts.

        They are cut into pieces together and each new piece is counted once.
        The sums up to each piece say in which one the budget ends; the counts
        of its own prefixes say where.
        """
        text = data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = heads[offsets]
        starts = piece_starts(points, at)
        ends = np.append(starts[1:], len(points))
        symbols = mix64(points)
        found, first, where = np.unique(span_hash(symbols, starts, ends), return_index=True, return_inverse=True)
        known = self.by_hash
        if len(known) > self.MAX_PIECES:
            known.clear()
        found = found.tolist()
        new = [k for k, h in enumerate(found) if h not in known]
        if new:
            pieces = [text[a:b].encode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            totals = self.count_all(pieces)
            known.update((found[k], totals[p]) for k, p in zip(new, pieces))
        each = np.fromiter((known[h] for h in found), np.int64, len(found))[where] if found else np.zeros(0, np.int64)
        piece = np.searchsorted(starts, at)
        out, fits = per_row(each, piece), np.diff(at)
        marked = [d for d in range(len(offsets) - 1) if any(m in text[at[d] : at[d + 1]] for m in self.marks)] if self.marks and any(m in text for m in self.marks) else []
        sums = np.concatenate([[0], np.cumsum(each)])
        for d in np.setdiff1d(np.flatnonzero(out > budget), marked).tolist():
            last = int(np.searchsorted(sums, sums[piece[d]] + budget, "right")) - 1  # the piece that ends above the budget
            begin = max(int(piece[d]), last - 2)  # white space before it may be cut otherwise
            within = self.prefixes(text[starts[begin] : ends[last]]) + (sums[begin] - sums[piece[d]])
            fits[d] = starts[begin] - at[d] + np.flatnonzero(within <= budget)[-1]
        for d in marked:
            own = text[at[d] : at[d + 1]]
            out[d] = self.total(own)
            if out[d] > budget:
                fits[d] = self.fit(own, budget)
        return out, fits

    def total(self, text: str) -> int:
        """Token count of the whole text: the last entry of prefixes()."""
        get = self.totals.__getitem__
        return sum(1 if special else sum(map(get, self.pattern.findall(run))) for run, special in self._runs(text))

    def prefixes(self, text: str) -> np.ndarray:
        """int32 counts of text[:k] for k = 0 .. len(text), each as the library gives it for that prefix alone."""
        out, base = [0], 0
        before_run, held = 0, ""  # the ordinary run so far, and the count before it
        for run, special in self._runs(text):
            if special:
                out += [before_run + self._plain(held + run[:k]) for k in range(1, len(run))] + [base + 1]
                base += 1
                before_run, held = base, ""
                continue
            before_run, held = base, run
            blank = None  # where the current white space began, and the count before it
            at = 0
            for piece in self.pattern.findall(run):
                here = self.counts(piece.encode())
                sizes = np.cumsum([0, *(len(c.encode()) for c in piece)])
                values = [base + here[s] for s in sizes[1:]]
                if piece.isspace() or (piece[0] == " " and blank is not None):
                    # a prefix that ends in white space holds the whole run of it as one piece
                    start, before = blank if blank is not None else (at, base)
                    for k, c in enumerate(piece):
                        if not c.isspace():
                            break
                        values[k] = before + self.totals[run[start : at + k + 1]]
                    blank = (start, before) if piece.isspace() else None
                else:
                    blank = None
                if piece in CUT_CONTRACTIONS:
                    values[1] = base + self.totals[piece[0]] + self.totals[piece[1]]
                out += values
                base += here[-1]
                at += len(piece)
        return np.array(out, np.int32)

    def _plain(self, text: str) -> int:
        return sum(self.totals[p] for p in self.pattern.findall(text))

    def fit(self, text: str, budget: int) -> int:
        """Length of the longest prefix of at most ``budget`` tokens, from the stored counts."""
        fits = np.flatnonzero(self.prefixes(text) <= budget)
        return int(fits[-1]) if len(fits) else 0


class _Totals(dict):
    """Last entry of counts(), by piece."""

    def __init__(self, owner: PrefixCounter) -> None:
        self.owner = owner

    def __missing__(self, piece: str) -> int:
        if len(self) > self.owner.MAX_PIECES:
            self.clear()
        value = self.owner.counts(piece.encode())[-1]
        if len(piece) <= 64:
            self[piece] = value
        return value


_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Of each code point: 1 letter, 2 number, 3 white space, 0 anything else."""
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        for value, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
            for m in regex.finditer(pattern, every):
                a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
                table[a:b] = value
        _classes.append(table)
    return _classes[0]


def piece_starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pieces of PATTERN start, in texts at[d]:at[d+1] of code points."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.ones(n + 1, bool)  # a new text, or another class than before
    edge[1:n] = kind[1:] != kind[:-1]
    edge[at] = True
    head = edge[:n].copy()
    text_end = np.zeros(n + 1, bool)
    text_end[at] = True
    # the last white space before something else stands alone, or begins the next piece if it is a blank
    blank = np.flatnonzero((kind == 3) & edge[1:] & ~text_end[1:])
    head[blank] = True
    joined = blank[points[blank] == 32] + 1
    head[joined] = False
    # a contraction takes its letters from the piece that they would begin
    mark = np.flatnonzero((points == 39) & head & edge[1:] & ~text_end[1:])
    mark = mark[kind[mark + 1] == 1]
    if len(mark):
        padded = np.append(points, np.zeros(3, points.dtype))
        one, two = padded[mark + 1], padded[mark + 2]
        two_in = ~edge[np.minimum(mark + 2, n)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = two_in & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        taken = short | long
        head[mark[taken] + 1] = False
        after = mark[taken] + np.where(short[taken], 2, 3)
        head[after[after < n]] = True
        # what follows is a piece of its own, unless a blank begins it already
    return np.flatnonzero(head)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of this process for a vocabulary file."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocab: str, limit: int = 512, text: str = "text", id: str = "doc_id", store: bool = False) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fit_chars[, prefix_counts]) per row.

    fit_chars: code points of the longest prefix of at most ``limit`` tokens.

    vocab: path of a byte-level BPE file that every executor can read.
    store: also return ``prefix_counts`` (array<int>), the count of each prefix in code points.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    @tidy
    def run(batches):
        c = counter(vocab)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            cols = [batch.column("id"), pa.array(np.diff(offsets), pa.int64())]
            if store:
                stored = [c.prefixes(t or "") for t in batch.column("text").to_pylist()]
                totals = np.array([p[-1] for p in stored], np.int64)
                fits = np.array([np.flatnonzero(p <= limit)[-1] for p in stored], np.int64)
            else:
                parts = [c.batch_totals(d, o, limit) for _, d, o in chunks(batch.column("text"))]
                totals, fits = (np.concatenate(v) for v in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
            cols += [pa.array(totals, pa.int64()), pa.array(totals > limit, pa.bool_()), pa.array(fits, pa.int64())]
            names = ["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            if store:
                cols.append(pa.array(stored, pa.list_(pa.int32())))
                names.append("prefix_counts")
            yield pa.RecordBatch.from_arrays(cols, names)

    out = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint" + ", prefix_counts array<int>" * store)
    return out.withColumnRenamed("id", id)
