"""Removal of repeated passages by super-k-mer partitioning.

A window is 50 consecutive words. Its minimiser is the least hash among its 20-word
sub-windows; consecutive windows with one minimiser form a super-k-mer, which travels as one
packed string to the bucket of its minimiser. Sorting the windows of a bucket's strings counts
each window exactly and yields its first document.

What keeps this within the size of the input:

* Super-k-mers are known by a hash of their minimiser and a 128-bit BLAKE2b digest of their words
  before any text moves; what shares the hash meets in a bucket, what shares the digest is equal. A
  window can repeat in another document only if its minimiser does, so super-k-mers whose
  minimiser one document has alone never travel.
* Equal super-k-mers combine map-side, and one of them travels for all: thousands of copies
  reach a bucket as one string. Where a bucket's super-k-mers are all equal, its windows are
  counted already and no string travels.
* A bucket with more than ``HOT`` different strings (a passage in endlessly many contexts) is
  split: its strings are cut into single windows that are dealt by the window's own digest and
  combined map-side. Nothing is dropped.
* Results return by equi-joins of written tables, which adaptive execution splits where a key is hot.

Defined cases: a null or empty text has no words and nothing removed; rows with a null
``doc_id`` neither cover others nor lose words (null is neither smaller nor larger); rows that
repeat a ``doc_id`` don't cover one another; other input columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import PRINT, Words, chunks, sliding_min
from .shared import map_arrow, spool

WINDOW, MINIMISER = 50, 20
#: Windows in one packed string at most; a run of one minimiser (one word repeated) is cut there.
LONGEST = 256
#: Different strings that one bucket sorts in memory.
HOT = 512


def super_kmers(batches: Iterator[pa.RecordBatch], window: int = WINDOW, minimiser: int = MINIMISER, longest: int = LONGEST) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text) to (doc_id, th, start, n, key, rh).

    n windows from word ``start`` on share the minimiser ``key``; ``rh`` is a digest of all their words.
    """
    for batch in batches:
        ids, ths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for lo, _, data, offsets in chunks(batch.column(2)):
            w = Words(data, offsets, PRINT)
            hashes = w.hashes()
            grams = w.windows(minimiser, hashes)
            if len(grams) < window - minimiser + 1:
                continue
            least = sliding_min(grams, window - minimiser + 1)
            at = np.flatnonzero(w.left[: len(least)] >= window)
            if not len(at):
                continue
            key = least[at]
            new = np.ones(len(at), bool)
            new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
            run = np.flatnonzero(new)
            size = np.diff(np.append(run, len(at)))
            # Cut long runs.
            parts = -(-size // longest)
            piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            head = np.repeat(run, parts) + piece * longest
            n = np.minimum(longest, np.repeat(size, parts) - piece * longest)
            first = at[head]
            doc = w.doc[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[lo + doc], pa.int64()),
                    pa.array(ths[lo + doc], pa.int64()),
                    pa.array((first - w.first[doc]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(key[head].view(np.int64)),
                    pa.array(w.digests(first, n + window - 1), pa.binary()),
                ],
                ["doc_id", "th", "start", "n", "key", "rh"],
            )


def pack(batches: Iterator[pa.RecordBatch], window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """(text, runs) to one row per run: its packed string, or for hot buckets one row per window by digest."""
    names = ["key", "rh", "packed", "lo", "hi", "wd", "off"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = text.encode().split()
            for r in runs:
                own = words[r["start"] : r["start"] + r["n"] + window - 1]
                if r["hot"]:
                    for i in range(r["n"]):
                        wd = hashlib.blake2b(b" ".join(own[i : i + window]), digest_size=16).digest()
                        rows.append((r["key"], r["rh"], None, r["lo"], r["hi"], wd, i))
                    held += 60 * r["n"]
                else:
                    s = b" ".join(own)
                    rows.append((r["key"], r["rh"], s, r["lo"], r["hi"], None, None))
                    held += len(s)
            if held > 8 << 20:
                yield _batch(rows, kinds, names)
                rows, held = [], 0
    if rows:
        yield _batch(rows, kinds, names)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def window_slices(packed: bytes, window: int) -> list[bytes]:
    space = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
    begin, end = [0, *(space + 1).tolist()], [*space.tolist(), len(packed)]
    return [packed[begin[i] : end[i + window - 1]] for i in range(len(begin) - window + 1)]


FACT = ["key", "rh", "off", "len", "first_doc"]


def bucket_facts(key: int, strings: list[tuple[bytes, bytes, int, int]], window: int) -> list[tuple]:
    """Runs of windows that more than one document has, by string: (key, rh, off, len, first document).

    ``strings``: digest of the words, packed, least and greatest doc_id that have it.
    """
    spots = sorted((x, k, i) for k, (_, s, *_) in enumerate(strings) for i, x in enumerate(window_slices(s, window)))
    first: list[dict[int, int]] = [{} for _ in strings]
    a = 0
    while a < len(spots):
        b = a + 1
        while b < len(spots) and spots[b][0] == spots[a][0]:
            b += 1
        own = [strings[k] for _, k, _ in spots[a:b]]
        lo, hi = min(x[2] for x in own), max(x[3] for x in own)
        if lo < hi:
            for _, k, i in spots[a:b]:
                first[k][i] = lo
        a = b
    out = []
    for (rh, *_), of in zip(strings, first, strict=True):
        run: list | None = None
        for i in sorted(of):
            if run and run[0] + run[1] == i and run[2] == of[i]:
                run[1] += 1
            else:
                run = [i, 1, of[i]]
                out.append((key, rh, run))
    return [(key, rh, *run) for key, rh, run in out]


def count_buckets(batches: Iterator[pa.RecordBatch], window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, (key, rh, packed, lo, hi), to facts; holds one bucket at a time."""
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
    now: int | None = None
    strings: list[tuple] = []
    facts: list[tuple] = []
    for batch in batches:
        for key, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if strings:
                    facts += bucket_facts(now, strings, window)
                now, strings = key, []
            strings.append(tuple(rest))
        if facts:
            yield _batch(facts, kinds, FACT)
            facts = []
    if strings and (facts := bucket_facts(now, strings, window)):
        yield _batch(facts, kinds, FACT)


def remove(batches: Iterator[pa.RecordBatch], window: int = WINDOW, with_text: bool = True) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans of windows) to the counts and the digest of what is kept."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = (text or "").encode().split()
            kept, at = [], 0
            for s in sorted((s["at"], s["at"] + s["len"] + window - 1) for s in spans or ()):
                kept += words[at : max(at, s[0])]
                at = max(at, s[1])
            kept = kept + words[at:] if at else words
            rest = b" ".join(kept)
            out.append((len(words), len(words) - len(kept), hashlib.sha256(rest).hexdigest(), rest.decode() if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and the spans of windows that an earlier document has."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    longest = LONGEST
    runs = spool(map_arrow(d, lambda b: super_kmers(b, longest=longest), "doc_id long, th long, start int, n int, key long, rh binary"), "runs")
    shared = spool(runs.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("key"), "keys")
    runs = spool(runs.join(shared, "key", "left_semi"), "shared")
    # One super-k-mer stands for all that are equal; how many different ones a bucket has is known before they travel.
    equal = runs.groupBy("key", "rh").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "th", "start", "n")).alias("at"))
    equal = spool(equal, "equal")
    size = spool(equal.groupBy("key").agg(F.count("*").alias("size")), "sizes")
    equal = spool(equal.join(size, "key").select("key", "rh", "lo", "hi", "at.*", "size"), "equal")
    alone = equal.filter("size = 1 AND lo < hi").select("key", "rh", F.lit(0).alias("off"), F.col("n").alias("len"), F.col("lo").alias("first_doc"))
    run = F.struct("start", "n", "key", "rh", "lo", "hi", (F.col("size") > HOT).alias("hot"))
    todo = equal.filter("size > 1").groupBy("doc_id", "th").agg(F.collect_list(run).alias("runs"))
    packed = map_arrow(d.join(todo, ["doc_id", "th"]).select("text", "runs"), pack, "key long, rh binary, packed binary, lo long, hi long, wd binary, off int")
    packed = spool(packed, "packed")
    cold = packed.filter("wd IS NULL").select("key", "rh", "packed", "lo", "hi").repartition("key").sortWithinPartitions("key")
    cold = map_arrow(cold, count_buckets, "key long, rh binary, off int, len int, first_doc long")
    single = packed.filter("wd IS NOT NULL").select("wd", "key", "rh", "off", "lo", "hi")
    first = single.groupBy("wd").agg(F.min("lo").alias("first_doc"), F.max("hi").alias("last_doc")).filter("first_doc < last_doc")
    hot = single.join(spool(first, "first"), "wd").select("key", "rh", "off", F.lit(1).alias("len"), "first_doc")
    facts = spool(alone.unionByName(cold).unionByName(hot), "facts")
    return (
        runs.select("key", "rh", "doc_id", "th", "start")
        .join(facts, ["key", "rh"])
        .filter("first_doc < doc_id")
        .groupBy("doc_id", "th")
        .agg(F.collect_set(F.struct((F.col("start") + F.col("off")).alias("at"), "len")).alias("spans"))
    )


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words themselves."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    joined = d.join(repeated_spans(docs), ["doc_id", "th"], "left").select("doc_id", "text", "spans")
    return map_arrow(joined, lambda b: remove(b, with_text=with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs, with_text=False).drop("kept_text")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, doc_id, p, array_to_string(ws[p:p + 49], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS p FROM d)),
f AS (SELECT g, min(doc_id) AS first_doc FROM w GROUP BY g),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 50)) AS i FROM w JOIN f USING (g) WHERE first_doc < doc_id),
kept AS (SELECT rid, string_agg(ws[i], ' ' ORDER BY i) AS t FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) ANTI JOIN gone USING (rid, i) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN n USING (rid)
"""
