"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as one symbol per UTF-8 byte. A heap holds the adjacent pairs by (rank,
position); the lowest is popped, its two symbols become one in a doubly linked list, and the
pairs at the seam are pushed. The count is the initial symbols minus the merges; token
identifiers are never formed. Merging costs O(n log n) in the pre-token's bytes, so a single
very long run of letters is no special case.

Counting runs in ``mapInArrow`` over the scan's own partitions: no shuffle, and memory is one
Arrow batch plus a bounded table of pre-tokens already counted.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null ``doc_id`` is carried;
repeated rows give repeated results; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow

#: The byte-level pre-tokenizer's pattern, with white space written as its Unicode property.
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pre-tokens remembered in a task; the table is emptied when full, which changes no result.
REMEMBER = 400_000


def byte_alphabet() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left once no adjacent pair has a rank."""
    n = len(symbols)
    if n < 2:
        return n
    syms: list[str | None] = list(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, syms[i], syms[i + 1]) for i in range(n - 1) if (r := ranks.get((syms[i], syms[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if syms[i] != a or j < 0 or syms[j] != b:
            continue  # a neighbour was merged since this pair was pushed
        syms[i], syms[j] = a + b, None
        merges += 1
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            if (r := ranks.get((syms[i], syms[k]))) is not None:
                heapq.heappush(heap, (r, i, syms[i], syms[k]))
        if (h := left[i]) >= 0 and (r := ranks.get((syms[h], syms[i]))) is not None:
            heapq.heappush(heap, (r, h, syms[h], syms[i]))
    return n - merges


class Counter(dict):
    """pre-token -> tokens, filled on demand and emptied at REMEMBER entries."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = spec["model"]["merges"]
        self.ranks = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(merges)}
        self.alphabet = byte_alphabet()
        self.pretoken = regex.compile(PRETOKEN)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        n = merged_count([self.alphabet[b] for b in piece.encode()], self.ranks)
        if len(piece) <= 64:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        """Special strings inside a text are one token each, as the library takes them by default."""
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self.plain(p) for p in parts)
        return self.plain(text)

    def plain(self, text: str) -> int:
        return sum(map(self.__getitem__, self.pretoken.findall(text)))


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``vocabulary`` is a path that every executor can open."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            n = [c.count(t) if t else 0 for t in (x.as_py() for x in b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
        c.clear()

    d = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).alias("text"),
    )
    kind = dict(d.dtypes)["doc_id"]
    return map_arrow(d, count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
