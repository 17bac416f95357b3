"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item becomes windows of 13 words (a shorter item is one window), a window the set
of its 5-word shingles. Shingles are ordered by how many documents hold them, rarest first.
Containment of the whole set needs every shingle, so its necessary prefix is one shingle, the
rarest. A document proposes a window where it holds that shingle at a position from which the
window fits the document (length and positional bounds), and the words of the window are then
compared exactly.

The benchmark is cut into blocks of ``BLOCK`` bytes, so what is broadcast has a fixed bound
whatever the benchmark's size: each block is matched against all documents, and blocks beyond
the first return only documents with hits. Documents are read where they lie; with one block
nothing but shingle counts is shuffled.

Defined cases: null or wordless texts have no words, no hits and are not contaminated; null or
wordless items have no windows; an item without id hits but isn't listed; items that repeat an
id count once; repeated documents are judged one by one; only doc_id, text, item_id are read.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import ALNUM, U, Words, chunks
from .shared import map_arrow, spool, without

WINDOW, SHINGLE = 13, 5
#: Bytes of benchmark text held by the driver and each task at once; a longer item is a block alone.
BLOCK = 4 << 20


class Block:
    """Windows of some items, and their shingles."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int = WINDOW, shingle: int = SHINGLE):
        self.ids = ids
        w = Words(*_joined(texts), ALNUM, lower=True)
        self.words = [w.data[s:e].tobytes() for s, e in zip(w.start, w.end, strict=True)]
        hashes = w.hashes()
        count = w.last - w.first
        size = np.minimum(count, window)
        n = np.where(count > 0, count - size + 1, 0)
        #: item, first word and length of each window
        self.item = np.repeat(np.arange(len(ids)), n)
        self.at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w.first, n)
        self.size = np.repeat(size, n)
        self.k = np.minimum(self.size, shingle)
        #: shingle hashes by shingle length
        self.shingles = {int(k): w.windows(int(k), hashes) for k in np.unique(self.k)}
        self.vocabulary = {k: np.unique(s[(w.left[: len(s)] >= k)]) for k, s in self.shingles.items()}

    def prefixes(self, df: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By shingle length: sorted hashes of rarest shingles, first row of each, windows, offsets in them.

        ``df``: document frequency along ``vocabulary``. Ties are broken by the hash, so equal
        windows choose equal shingles.
        """
        out = {}
        for k, s in self.shingles.items():
            own = np.flatnonzero(self.k == k)
            best = np.full(len(own), -1)
            rank = np.lexsort((self.vocabulary[k], df[k]))
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            least = np.full(len(own), np.iinfo(np.int64).max)
            for j in range(int((self.size[own] - k).max(initial=-1)) + 1):
                fits = self.size[own] - k >= j
                r = np.where(fits, place[np.minimum(np.searchsorted(self.vocabulary[k], s[np.minimum(self.at[own] + j, len(s) - 1)]), len(place) - 1)], least)
                best, least = np.where(r < least, j, best), np.minimum(r, least)
            h = s[self.at[own] + best]
            order = np.argsort(h, kind="stable")
            keys, first = np.unique(h[order], return_index=True)
            out[k] = keys, np.append(first, len(order)), own[order], best[order]
        return out


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def present(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``h`` of values among the sorted ``keys``, and their places there."""
    if not len(keys) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A table of the low bits rules most positions out before the search.
    bits = max(10, min(22, 4 + len(keys).bit_length()))
    low = np.zeros(1 << bits, bool)
    low[keys & U((1 << bits) - 1)] = True
    at = np.flatnonzero(low[h & U((1 << bits) - 1)])
    place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    hit = keys[place] == h[at]
    return at[hit], place[hit]


def frequencies(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the block's shingles within a task: (length, place, n)."""
    n = {k: np.zeros(len(v), np.int64) for k, v in block.vocabulary.items()}
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            w = Words(data, offsets, ALNUM, lower=True)
            hashes = w.hashes()
            for k, keys in block.vocabulary.items():
                h = w.windows(k, hashes)
                at, place = present(keys, h)
                ok = w.left[at] >= k
                pair = np.unique(w.doc[at[ok]] * np.int64(max(1, len(keys))) + place[ok])
                np.add.at(n[k], pair % max(1, len(keys)), 1)
    for k, v in n.items():
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(v[at])], ["k", "place", "n"])


def occurrences(w: Words, block: Block, index: dict) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[int]]]:
    """By document: the word spans of windows that occur in it, and their items."""
    hashes = w.hashes()
    own: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[int]] = defaultdict(set)
    for k, (keys, first, windows, off) in index.items():
        at, place = present(keys, w.windows(k, hashes))
        ok = w.left[at] >= k
        at, place = at[ok], place[ok]
        many = first[place + 1] - first[place]
        row = np.repeat(first[place], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(at, many)
        win, start = windows[row], at - off[row]
        doc = w.doc[at]
        fits = (start >= w.first[doc]) & (start + block.size[win] <= w.last[doc])
        for s, i, d in zip(start[fits].tolist(), win[fits].tolist(), doc[fits].tolist(), strict=True):
            n, a = int(block.size[i]), int(block.at[i])
            if all(w.data[w.start[s + j] : w.end[s + j]].tobytes() == block.words[a + j] for j in range(n)):
                own[d].append((s - int(w.first[d]), s - int(w.first[d]) + n))
                items[d].add(int(block.item[i]))
    return own, items


def clean(batches: Iterator[pa.RecordBatch], text: int, block: Block, df: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows, as they are, whose text (column number ``text``) isn't contaminated by the block."""
    index = block.prefixes(df)
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for lo, _, data, offsets in chunks(batch.column(text)):
            w = Words(data, offsets, ALNUM, lower=True)
            for d, spans in occurrences(w, block, index)[0].items():
                keep[lo + d] = not contaminated(sum(b - a for a, b in merged(spans)), int(w.last[d] - w.first[d]))
        yield batch.filter(pa.array(keep))


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


SPANS = "doc_id long, th long, n_words long, spans array<struct<lo:long,hi:long>>, items array<string>"


def matches(batches: Iterator[pa.RecordBatch], block: Block, df: dict[int, np.ndarray], only_hits: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text) to the merged word spans that windows of the block hit, and the items."""
    index = block.prefixes(df)
    span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column(2)):
            w = Words(data, offsets, ALNUM, lower=True)
            own, items = occurrences(w, block, index)
            pick = sorted(own) if only_hits else range(hi - lo)
            part = batch.slice(lo, hi - lo).take(pa.array(list(pick), pa.int64()))
            count = (w.last - w.first)[list(pick)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(count, pa.int64()),
                    pa.array([[{"lo": a, "hi": b} for a, b in merged(own.get(d, []))] for d in pick], span),
                    pa.array([sorted({block.ids[i] for i in items.get(d, ())} - {None}) for d in pick], pa.list_(pa.string())),
                ],
                ["doc_id", "th", "n_words", "spans", "items"],
            )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [merged([(s["lo"], s["hi"]) for s in x or ()]) for x in b.column(3).to_pylist()]
        items = [sorted(set(x or ())) for x in b.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *b.columns[:3],
                pa.array([sum(hi - lo for lo, hi in s) for s in spans], pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
            ],
            ["doc_id", "th", "n_words", "n_hit", "n_items", "items_sha256"],
        )


def n_blocks(items: DataFrame, block_bytes: int) -> int:
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return math.ceil(2 * total / block_bytes) if total > block_bytes else 1


def blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of each block; the driver holds one at a time."""
    t = items.select(F.col("item_id").cast("string").alias("id"), F.col("text")).filter("text IS NOT NULL")
    n = n_blocks(items, block_bytes)
    for i in range(n):
        rows = (t if n == 1 else t.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i)).collect()
        yield [r.id for r in rows], [r.text for r in rows]


def rarity(docs: DataFrame, block: Block, shared) -> dict[int, np.ndarray]:
    """Document frequencies along the block's vocabulary; the driver gets as many rows as the block has shingles at most."""
    found = map_arrow(docs.select("text"), lambda b: frequencies(b, shared.value), "k int, place long, n long").groupBy("k", "place").agg(F.sum("n").alias("n"))
    df = {k: np.zeros(len(v), np.int64) for k, v in block.vocabulary.items()}
    for r in found.collect():
        df[r.k][r.place] = r.n
    return df


def hits(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, th (hash of the text), n_words, merged hit spans (word numbers) and items, one row per document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    base: DataFrame | None = None
    more: DataFrame | None = None
    for ids, texts in blocks(items, block_bytes):
        block = Block(ids, texts)
        shared = docs.sparkSession.sparkContext.broadcast(block)
        df = rarity(docs, block, shared)
        got = map_arrow(d, lambda b, s=shared, f=df, o=base is not None: matches(b, s.value, f, o), SPANS)
        if base is None:
            base = got
        else:
            got = spool(got, "hits")
            more = got if more is None else more.unionByName(got)
            shared.unpersist()
    if more is None:
        return base
    extra = more.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("s2"), F.flatten(F.collect_list("items")).alias("i2"))
    b = base.alias("b").join(extra.alias("e"), F.col("b.doc_id").eqNullSafe(F.col("e.doc_id")) & F.col("b.th").eqNullSafe(F.col("e.th")), "left")
    both = lambda x, y: F.concat(F.col(x), F.coalesce(F.col(y), F.expr(f"slice({x}, 1, 0)")))
    return b.select("b.doc_id", "b.th", "n_words", both("spans", "s2").alias("spans"), both("items", "i2").alias("items"))


def judged(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, th and the verdict with its counts, one row per document."""
    found = hits(docs, items, block_bytes).select("doc_id", "th", "n_words", "spans", "items")
    out = map_arrow(found, _digest, "doc_id long, th long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def query(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    return judged(docs, items, block_bytes).drop("th")


def keep(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """The documents that aren't contaminated, with their own columns; for use as a pipeline stage.

    Each row goes or stays by its own text, also where it shares its ``doc_id`` or has none. With
    one block, rows are judged where they lie and nothing is shuffled.
    """
    if n_blocks(items, block_bytes) == 1:
        ((ids, texts),) = blocks(items, block_bytes)
        block = Block(ids, texts)
        shared = docs.sparkSession.sparkContext.broadcast(block)
        df, text = rarity(docs, block, shared), docs.columns.index("text")
        plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # the function gets any column, whatever its name
        return map_arrow(plain, lambda b: clean(b, text, shared.value, df), plain.schema).toDF(*docs.columns)
    bad = judged(docs, items, block_bytes).filter("contaminated").select("doc_id", "th").distinct()
    return without(docs, bad, doc_id=F.col("doc_id").cast("long"), th=F.xxhash64("text"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (SELECT item_id, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT rid, p, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM m)) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
