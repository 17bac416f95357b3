"""Packing of tokenized documents into sequences by minimum bin slack.

Each task packs the documents of its own scan partition, so nothing is shuffled and a task
that is run again yields the same rows. Full windows of a long document go out as they are;
the remainders wait in a small pool. A sequence starts with the longest remainder; a bitset
subset-sum over the multiset of the other lengths (one big integer whose bit t says "t tokens
can be filled") finds the filling closest to capacity, and walking the bitsets back gives how
many of each length it takes. Only where no multiset fills the window exactly is one more
remainder cut to fill it. What a task has left at its end is cut at powers of two, which need
no padding.

Token ids are those of the vocabulary file's library. A pre-token, and a white-space-free chunk of
other than Latin characters, is encoded once and remembered as packed 32-bit ids.

Defined cases: a null text is empty and packs as the end id alone; a null ``doc_id`` is
carried; repeated rows pack one by one; an empty table packs to no sequence; only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow
from .token_counts import byte_alphabet

CAPACITY, END_ID = 4096, 2
#: Remainders that wait at most, and those left before more are read.
POOL, LOW = 256, 128
#: Pre-tokens, and chunks, remembered in a task since the last turnover, and as many from before it.
REMEMBER = 250_000
#: White space of str.split that the pre-tokenizer takes for symbols.
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


#: The normalizer and pre-tokenizer that the own path of ``Encoder`` reproduces.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same split for lower-cased text below U+0100, where NFC changes nothing and a letter's lower case is one letter.
LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_SPLIT = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|'(?:[stmd]|re|ve|ll)|[^\\s{LETTERS}{NUMBERS}]+")


class Remembered(dict):
    """Results of ``make`` by key; keys of up to 64 characters are kept until ``turn`` has passed them by twice."""

    def __init__(self, make):
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.before.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= 64:
            self[key] = ids
        return ids

    def turn(self, size: int) -> None:
        if len(self) > size:  # frequent keys come back from the older half
            self.before = dict(self)
            self.clear()


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as bytes.

    A text of characters below U+0100 is lower-cased and split here, and its pre-tokens go straight to the
    vocabulary's merges; of other texts, each chunk without white space does, or goes through the whole library.
    So do whole texts that hold a special string, and all where the vocabulary file has another normalizer or pre-tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        normal, pre, model = (spec[k] or {} for k in ("normalizer", "pre_tokenizer", "model"))
        split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.by_chunk = (
            normal.get("normalizers") == NORMALIZERS
            and pre.get("pretokenizers") == [split, byte_level]
            and model.get("type") == "BPE"
            and not model.get("dropout")
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        )
        if self.by_chunk:
            self.tok.model._resize_cache(0)  # pre-tokens are remembered here
        self.shown = byte_alphabet()
        self.tokenize = self.tok.model.tokenize
        self.forget()

    def piece_ids(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            piece = "".join([self.shown[b] for b in piece.encode()])
        return packed([t.id for t in self.tokenize(piece)])

    def chunk_ids(self, chunk: str) -> bytes:
        if not chunk.isascii() and max(chunk) > "\xff":
            return packed(self.tok.encode(chunk, add_special_tokens=False).ids)
        return self.latin(chunk)

    def latin(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, LATIN_SPLIT.findall(text.lower())))

    def forget(self) -> None:
        self.chunks, self.pieces = Remembered(self.chunk_ids), Remembered(self.piece_ids)

    def encode(self, text: str) -> bytes:
        if not self.by_chunk or any(x in text for x in (*NOT_SPACE, *self.special)):
            return packed(self.tok.encode(text, add_special_tokens=False).ids)
        self.pieces.turn(REMEMBER)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            self.chunks.turn(REMEMBER)
            return b"".join(map(self.chunks.__getitem__, text.split()))
        return self.latin(text)


def packed(ids: list[int]) -> bytes:
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def best_filling(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take for the largest total up to ``capacity``."""
    window, reach = (1 << (capacity + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, how many at once, what was reachable before
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & window
            left -= k
            k *= 2
        if reach >> capacity & 1:
            break
    total, take = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            take[length] += k
            total -= length * k
    return dict(take)


class Packer:
    """Pieces of documents to sequences; a piece is (doc_id, start, ids, tokens of the document)."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.capacity, self.sequence = capacity, first_id
        self.pool: dict[int, deque] = defaultdict(deque)
        self.n = 0

    def put(self, piece: tuple) -> None:
        self.pool[len(piece[2]) // 4].append(piece)
        self.n += 1

    def take(self, length: int) -> tuple:
        q = self.pool[length]
        piece = q.popleft()
        if not q:
            del self.pool[length]
        self.n -= 1
        return piece

    def emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, tokens in pieces:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, self.sequence, offset
            offset += len(ids) // 4
        self.sequence += 1

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        tokens, size = len(ids) // 4, 4 * self.capacity
        whole = len(ids) // size
        for i in range(whole):
            yield from self.emit([(doc_id, i * self.capacity, ids[i * size : (i + 1) * size], tokens)])
        if len(ids) > whole * size:
            self.put((doc_id, whole * self.capacity, ids[whole * size :], tokens))
        while self.n >= POOL or (self.n >= LOW and whole):
            yield from self.fill()

    def fill(self) -> Iterator[tuple]:
        longest = max(self.pool)
        pieces, room = [self.take(longest)], self.capacity - longest
        if room and self.pool:
            for length, k in best_filling({x: len(q) for x, q in self.pool.items() if x <= room}, room).items():
                pieces += [self.take(length) for _ in range(k)]
                room -= length * k
            if room and self.pool:  # every other remainder is longer than the room
                doc_id, start, ids, tokens = self.take(min(self.pool))
                pieces.append((doc_id, start, ids[: 4 * room], tokens))
                self.put((doc_id, start + room, ids[4 * room :], tokens))
        yield from self.emit(pieces)

    def finish(self) -> Iterator[tuple]:
        while sum(x * len(q) for x, q in self.pool.items()) >= self.capacity:
            yield from self.fill()
        rest = deque(p for x in sorted(self.pool, reverse=True) for p in self.pool[x])
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            size = room = 1 << (left.bit_length() - 1)
            pieces = []
            while room:
                doc_id, start, ids, tokens = rest.popleft()
                if len(ids) // 4 > room:
                    rest.appendleft((doc_id, start + room, ids[4 * room :], tokens))
                    ids = ids[: 4 * room]
                pieces.append((doc_id, start, ids, tokens))
                room -= len(ids) // 4
            yield from self.emit(pieces)
            left -= size


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece. ``sequence_id`` is unique over the table: the task's number, then a count."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(vocabulary), Packer(TaskContext.get().partitionId() << 40, capacity)

        def out(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in rows], pa.int64() if i else kind) for i in range(len(NAMES))]
            return pa.RecordBatch.from_arrays(cols, NAMES)

        kind = None
        for b in batches:
            kind = b.column(0).type
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = []
                for i, x in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    rows.extend(packer.add(i, enc.encode(x.as_py()) + end))
                if rows:
                    yield out(rows, kind)
        if rows := list(packer.finish()):
            yield out(rows, kind)
        enc.forget()

    return map_arrow(d, run, f"doc_id {dict(d.dtypes)['doc_id']}, {SCHEMA}")


def query(docs: DataFrame, vocabulary: str) -> DataFrame:
    return pack(docs, vocabulary)
