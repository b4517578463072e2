"""Packing along a space-filling curve.

Each document becomes a hashed bag-of-words vector (signed feature hashing), projected to DIMS
dimensions by a fixed Gaussian matrix; the normal distribution function turns each coordinate
into an even grid of 2**BITS cells, and the Hilbert index of its cell is the document's key.
Documents are range-sorted by (key, doc_id), so neighbours on the curve lie side by side, and
each range is turned into ids and cut into sequences of ``length`` ids as it is read. What is left at the end of
a range is cut at powers of two, which need no padding: at most log2(length) shorter sequences for each range.
Keys are cheap, so they are computed for the ranges' bounds and again for the sort, and nothing is written between.

Ids are those of byte_bpe_50k.json, computed by tiktoken over the same vocabulary's ranks (the
tests hold both against each other), followed by ``end_id``.
The json's added tokens are found inside text too, as it finds them itself.

Defined results: a null text is an empty one and gives just the end id; a null doc_id gives
pieces with a null doc_id; equal rows are packed as often as they come; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .frames import find_package, map_partitions

LENGTH, END_ID = 1024, 0
DIMS, BITS, FEATURES = 3, 16, 256
#: Fixed value: the pattern that splits text for this public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes and rows of text that a worker holds expanded at once; one longer text is held alone.
HELD_BYTES, HELD_ROWS, HELD_PIECES = 1 << 18, 512, 1 << 14
_PROJECTION = np.random.default_rng(20).standard_normal((FEATURES, DIMS))
_encoders: dict[str, object] = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that a vocabulary's json adds to its ranks; they are matched in text as they stand."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))["added_tokens"]
    for t in found:
        if t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"{path}: the added token {t['content']!r} takes more or less than itself, which isn't supported")
    return {t["content"]: t["id"] for t in found}


def encoder(path: str | None = None):
    """The encoder of one Python process; a path of None is the installed vocabulary."""
    key = path or ""
    if key not in _encoders:
        import tiktoken

        with open(path or vocabulary_path(), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        added = Path(path).with_suffix(".json") if path else Path(vocabulary_path("byte_bpe_50k.json"))
        special = added_tokens(str(added)) if not path or added.exists() else {}
        _encoders[key] = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[key]


def vectors(chunk: T.Chunk) -> np.ndarray:
    """Hashed, signed word counts of every row, scaled to length 1 (0 without words), projected to DIMS."""
    w = T.words(chunk)
    n = len(w.first) - 1
    place = w.row() * FEATURES + (w.hash & np.uint64(FEATURES - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((w.hash >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    bags = np.bincount(place, sign, n * FEATURES).reshape(n, FEATURES)
    norm = np.linalg.norm(bags, axis=1, keepdims=True)
    return (bags / np.where(norm > 0, norm, 1)) @ _PROJECTION


def cells(points: np.ndarray) -> np.ndarray:
    """Coordinates as whole numbers below 2**BITS, even for normally distributed ones."""
    even = 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(points / math.sqrt(2)))
    return np.clip(even * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert(cell: np.ndarray) -> np.ndarray:
    """Index on the Hilbert curve of each row of coordinates (Skilling 2004)."""
    x = cell.T.copy()
    n, top = len(x), 1 << (BITS - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            set_ = (x[i] & q) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    q = top
    while q > 1:
        gray = np.where((x[n - 1] & q) > 0, gray ^ (q - 1), gray)
        q >>= 1
    x ^= gray
    key = np.zeros_like(x[0])
    for bit in range(BITS - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(texts: pa.Array) -> pa.Array:
    """The Hilbert key of every text."""
    found = [vectors(c) for c in T.chunks(texts, HELD_BYTES, HELD_ROWS)]
    return pa.array(hilbert(cells(np.concatenate(found))) if found else np.zeros(0, np.int64), pa.int64())


def _ids(texts: pa.Array, path: str | None, end_id: int) -> Iterator[np.ndarray]:
    """The ids of every text and the end id."""
    encode = partial(encoder(path).encode, allowed_special="all")
    for low in range(0, len(texts), HELD_ROWS):
        for t in texts.slice(low, HELD_ROWS):
            t = t.as_py()
            yield np.array([*encode(t), end_id] if t else [end_id], "<u4")


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECES = pa.schema([(n.split()[0], pa.int64()) for n in _PIECE.split(", ")])


def _pack(length: int, path: str | None, end_id: int):
    """Turns a range of documents, as it comes, into ids and cuts them into sequences of length, and the range's end at powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        open_, held = [], 0  # the pieces of the sequence that isn't full: doc_id, start, ids, doc_tokens

        def close(pieces: list, first: int) -> list[tuple]:
            out, offset = [], 0
            for doc, start, ids, total in pieces:
                out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, first, offset))
                offset += len(ids)
            return out

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=_PIECES)

        for batch in batches:
            found = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), _ids(batch.column("text"), path, end_id), strict=True):
                start = 0
                while start < len(ids):
                    part = ids[start : start + length - held]
                    open_.append((doc, start, part.copy(), len(ids)))
                    start, held = start + len(part), held + len(part)
                    if held == length:
                        found += close(open_, sequence)
                        open_, held, sequence = [], 0, sequence + 1
                if len(found) >= HELD_PIECES:
                    yield rows(found)
                    found = []
            if found:
                yield rows(found)
        found = []
        while held:
            room = 1 << (held.bit_length() - 1)
            held, taken = held - room, []
            while room:
                doc, start, ids, total = open_.pop(0)
                taken.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    open_.insert(0, (doc, start + room, ids[room:], total))
                room -= len(taken[-1][2])
            found += close(taken, sequence)
            sequence += 1
        if found:
            yield rows(found)

    return run


def pack(docs: DataFrame, *, length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most ``length`` ids.

    docs needs doc_id and text. vocabulary: path of a .tiktoken file that each machine has; None for the
    installed one. Added tokens are read from the .json beside it.
    """
    find_package(docs.sparkSession)
    key = F.arrow_udf(curve_keys, "long")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # equal rows are told apart by where they were read, so that very many of them are several ranges
    keyed = docs.select("doc_id", "text", key("text").alias("key"), F.spark_partition_id().alias("part"))
    ordered = keyed.repartitionByRange("key", "doc_id", "part").sortWithinPartitions("key", "doc_id", "text")
    return map_partitions(ordered.select("doc_id", "text"), _pack(length, vocabulary, end_id), _PIECE)
