"""Bounded-space online best-fit packing of tokenised documents.

Documents are tokenised where they are read; only (id, piece, length, crc32)
rows go on.  Full pieces need no bin.  All others are dealt by hash to packers
of about ``PACKER_TOKENS`` tokens; a packer takes its pieces in hash order and
keeps ``OPEN_BINS`` bins open.  The open bins are stacks keyed by free space,
and one integer is the bitset of the stacks in use, so the best fit (the
smallest free space that is large enough) is one shift and one lowest-bit
lookup.  With all bins open and none that fits, the fullest closes first.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, id_and_text

LENGTH = 1024
END_ID = 2
OPEN_BINS = 4096
PACKER_TOKENS = 1 << 25
CACHE = 400_000  # words that a worker remembers; only speed depends on it

# A blank between white space, or after it at the end: only there do a word's
# tokens depend on what stands before it.
_MIXED = re.compile(r"\s (?:\s|\Z)")


class WordCache(dict):
    """word -> its ids as little-endian bytes; forgets everything when it is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word), "<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """Token ids of the byte-level BPE in ``path`` (a tokenizers JSON file).

    The vocabulary's rank file next to it drives tiktoken's merge loop, which
    gives the same ids several times faster; a test holds the two against
    each other.  A blank always starts a token, so a text without mixed white
    space is cut at blanks and each word is encoded once per worker.  Texts
    that hold a special token's own string go through tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.exact = Tokenizer.from_file(path)
        with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        plain = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                  special_tokens={})
        self.encode_plain = plain.encode_ordinary
        self.words = WordCache(self.encode_plain)

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _MIXED.search(text):
            return np.array(self.encode_plain(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        head = self.words[first] if first else b""
        return head + b"".join(map(self.words.__getitem__, [" " + w for w in rest])) if rest else head


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, after a shorter first."""
    first = n % length or length
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) per piece of each row of (doc_id, text)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            row, part, start, size, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = enc.ids(text.decode("utf-8", "replace")) + end
                for k, (at, n) in enumerate(cut(len(ids) // 4, length)):
                    row.append(i)
                    part.append(k)
                    start.append(at)
                    size.append(n)
                    crc.append(zlib.crc32(ids[4 * at:4 * (at + n)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(part, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Open bins of one packer; ``place`` gives each size its (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
        self.used = 0  # bit f: a bin with free space f is open
        self.n_open = self.bins = 0

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        b = stack.pop()
        if not stack:
            self.used &= ~(1 << free)
        self.n_open -= 1
        return b

    def place(self, size: int) -> tuple[int, int]:
        fits = self.used >> size
        if fits and size < self.capacity:
            free = size + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            free, b = self.capacity, self.bins
            self.bins += 1
        left = free - size
        if left:
            if self.n_open >= self.open_bins:
                self._take((self.used & -self.used).bit_length() - 1)  # the fullest closes
            self.stacks[left].append(b)
            self.used |= 1 << left
            self.n_open += 1
        return b, self.capacity - free


def pack(parts: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS,
         packer_tokens: int = PACKER_TOKENS) -> DataFrame:
    """Add (sequence_id, offset) to rows with (doc_id, piece, length).

    Sequences of one packer share the upper bits of their id.  The number of
    packers follows the tokens to pack, so one more packer, with its few
    half-filled last bins, comes with every ``packer_tokens`` tokens.  Order
    within a packer is by a hash of all columns: it is the same whenever a
    task runs again, and equal rows may swap freely.
    """
    total = parts.agg(F.sum("length")).first()[0] or 0
    packers = max(1, -(-total // packer_tokens))
    columns = parts.columns
    keyed = parts.withColumn("_order", F.xxhash64(*columns)).withColumn(
        "_packer", F.pmod(F.xxhash64("_order", F.lit(1)), F.lit(packers)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = -1, None
        for batch in batches:
            ids, offsets = [], []
            for packer, size in zip(batch.column("_packer").to_pylist(), batch.column("length").to_pylist()):
                if packer != now:
                    now, bins = packer, BestFit(length, open_bins)
                b, at = bins.place(size)
                ids.append((packer << 40) + b)
                offsets.append(at)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())],
                names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in parts.dtypes) + ", sequence_id long, offset long"
    order = [F.col("_packer"), F.col("_order"), *map(F.col, columns)]
    return keyed.repartition(packers, "_packer").sortWithinPartitions(*order).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """Packed pieces of all ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and gives one piece, the end id alone; null ids stay
    null; repeated rows are packed again; an empty table gives an empty
    result; other columns are not read.  Whole texts of any length are used.
    """
    parts = cut_lineage(pieces(id_and_text(docs, id_col, text_col), tokenizer, length, end_id))
    return pack(parts, length, open_bins)
