"""Byte-level BPE of a public tokenizer, over a whole corpus.

A text is cut into pieces by the tokenizer's pattern; the bytes of a piece are merged by a segment tree over the ranks
of adjacent pairs. The root holds the lowest rank, leftmost first; a merge changes three leaves, so each costs
logarithmic time, and a piece of n bytes O(n log n) however long it is. Pieces repeat, so each worker keeps the ids of
those it has seen (bounded in number and length).

Scale: a narrow map; no shuffle, nothing broadcast but the path. The vocabulary (50 thousand short entries, it doesn't
grow) is read once in each worker. Whole texts only, in batches of bounded size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessara.session import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern of this vocabulary's pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_PIECES, KEPT_BYTES, ROWS = 400_000, 64, 512
_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: byte strings and their ranks, which are their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    n = len(piece)
    if n == 0:
        return []
    whole = ranks.get(piece)
    if whole is not None and n == 1:
        return [whole]
    size = 1 << max(0, (n - 2).bit_length())
    tree = [_NONE] * (2 * size)
    end = list(range(1, n + 1))  # of the token that begins at i
    before = list(range(-1, n - 1))  # where the token before begins
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = (r << 32) | i  # the lowest rank, and of those the leftmost
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            value = a if a < b else b
            if tree[k] == value:
                break
            tree[k] = value
            k >>= 1

    def pair(i: int) -> int:
        j = end[i]
        r = ranks.get(piece[i : end[j]]) if j < n else None
        return _NONE if r is None else (r << 32) | i

    while (top := tree[1]) != _NONE:
        i = top & 0xFFFFFFFF
        j = end[i]
        end[i] = end[j]
        if end[j] < n:
            before[end[j]] = i
        if j < size:
            put(j, _NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Ids of texts; ``special`` names in a text are ordinary text."""

    def __init__(self, path: str = VOCABULARY) -> None:
        self.ranks = read_ranks(path)
        self.pieces = regex.compile(PIECES)
        self.seen: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str | None) -> list[int]:
        """[] for a null and for an empty text."""
        out: list[int] = []
        if not text:
            return out
        seen, ranks = self.seen, self.ranks
        for piece in self.pieces.findall(text):
            ids = seen.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "surrogatepass")
                ids = tuple(merge(raw, ranks))
                if len(raw) <= KEPT_BYTES:
                    if len(seen) >= KEPT_PIECES:
                        seen.clear()
                    seen[piece] = ids
            out += ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a worker process, whatever number of tasks it runs."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(frame: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, counts: bool = False) -> DataFrame:
    """(key, ids), or (key, n_tokens) with ``counts``: one row for each row of ``frame``, repeated keys included.

    Null and empty texts have an empty list. Texts are never cut.
    """
    ship(frame.sparkSession)
    kind = frame.schema[key].dataType.simpleString()
    rows = frame.select(F.col(key), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [own.encode(x) for x in part.column(1).to_pylist()]
                value = pa.array(map(len, ids), pa.int64()) if counts else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), value], names=[key, "n_tokens" if counts else "ids"])

    return rows.mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens bigint" if counts else "ids array<int>"))
