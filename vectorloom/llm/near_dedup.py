"""Near-duplicate components by b-bit MinHash with exact confirmation.

1. ``sketch``: per document the minima of HASHES permutations over its distinct word shingles,
   kept as band keys and as a signature of the low BITS bits of each minimum, packed in longs.
   A shingle is a 128-bit fingerprint of its words as they are (words of over 15 bytes by a
   digest), in ``sketch`` as in every confirmation; permutations take its first half.
   Documents with equal shingle sets share a digest and fold into one class, represented by the
   smallest doc_id: thousands of copies are one row from here on.
2. Classes that share a band key are candidates. Only the connected components are wanted, so a
   bucket isn't expanded into pairs: each member is first paired with three centres of its
   bucket. Bit counts on the signatures give the collision-corrected similarity, which rules
   out pairs far below the threshold (``SLACK`` standard deviations); the others are confirmed
   on full shingle sets.
3. Buckets whose members are then all in one component are done. Of the rest, buckets of up to
   ``SMALL`` members give their pairs across components, and what passes the bit count is
   confirmed as before. Larger buckets are cut into blocks of bounded bytes that are compared
   two by two in tasks of their own; the shingle sets travel with them, each pair is confirmed
   in the first bucket it shares, and one link per two components comes out. Every candidate
   pair is thus confirmed, ruled out, or within one component already.

With the query's 32 bands of 5 rows a pair at similarity 0.85 shares no band with probability
7e-9; with the default's 40 bands of 4 rows one at 0.8 with 7e-10.

Defined cases: null or wordless texts have the empty set, link with nothing and are kept; rows
with a null ``doc_id`` link with nothing, have a null component and are kept; rows that repeat a
doc_id get a result each, and their sets all belong to that document; only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import PRINT, U, WORD_BASE, Words, chunks, mix
from .shared import map_arrow, spool, without

SHINGLE, PERCENT = 5, 80
ROWS, BANDS = 4, 40
BITS = 4
#: Standard deviations below the threshold at which the estimate rules a pair out.
SLACK = 6.5
#: Members of a bucket whose pairs are listed; members and bytes of sets in a block of a larger one.
SMALL, SIDE, SIDE_BYTES = 32, 1024, 16 << 20


#: Bits of a document's number within a piece of rows, which has CHUNK_ROWS at most.
DOC_BITS = 12


def multipliers(n: int) -> np.ndarray:
    """n odd multipliers from a fixed seed."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(w: Words, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both longs of the shingle fingerprints of all documents with words, end to end and sorted, and the document of each."""
    longs = w.longs()
    at = np.flatnonzero(w.left >= shingle)
    a, b = w.fingerprints(shingle, longs)
    first, second, doc = [a[at]], [b[at]], [w.doc[at]]
    count = w.last - w.first
    for n in range(1, shingle):  # a shorter text is one shingle
        few = np.flatnonzero(count == n)
        if len(few):
            a, b = w.fingerprints(n, longs)
            first.append(a[w.first[few]])
            second.append(b[w.first[few]])
            doc.append(few)
    h, h2, d = np.concatenate(first), np.concatenate(second), np.concatenate(doc)
    # One long of the document and the first bits of the fingerprint sorts all but those that agree in them.
    order = np.argsort(d.astype(U) << U(64 - DOC_BITS) | h >> U(DOC_BITS)) if d.max(initial=0) < 1 << DOC_BITS else np.lexsort((h, d))
    x, y = h[order], h2[order]
    near = (d[order][1:] == d[order][:-1]) & (x[1:] >> U(DOC_BITS) == x[:-1] >> U(DOC_BITS))
    if (near & ((x[1:] != x[:-1]) | (y[1:] != y[:-1]))).any():
        order = np.lexsort((h2, h, d))
    h, h2, d = h[order], h2[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]) | (d[1:] != d[:-1])
    return h[new], h2[new], d[new]


def halves(hs: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """The two longs of a set's fingerprints."""
    a = np.frombuffer(hs, U)
    return a[: len(a) // 2], a[len(a) // 2 :]


def common(p: tuple[np.ndarray, np.ndarray], q: tuple[np.ndarray, np.ndarray]) -> int:
    """Fingerprints that two sets share."""
    if not len(p[0]) or not len(q[0]):
        return 0
    if (q[0][1:] == q[0][:-1]).any():  # two of them differ in the second long only
        return len(set(zip(*map(np.ndarray.tolist, p), strict=True)) & set(zip(*map(np.ndarray.tolist, q), strict=True)))
    at = np.minimum(np.searchsorted(q[0], p[0]), len(q[0]) - 1)
    return int(np.count_nonzero((q[0][at] == p[0]) & (q[1][at] == p[1])))


SKETCH = "doc_id long, th long, n_shingles long, digest binary, bands array<long>, sig array<long>"


def sketch(batches: Iterator[pa.RecordBatch], shingle: int, rows: int, bands: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text) to set size, digest, band keys and packed low bits; nulls for the empty set."""
    a = multipliers(rows * bands)
    place = mix(np.arange(1, bands + 1, dtype=U))
    per = 64 // BITS
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column(2)):
            h, h2, d = shingle_sets(Words(data, offsets, PRINT, lower=True), shingle)
            n = np.bincount(d, minlength=hi - lo).astype(np.int64)
            some = np.flatnonzero(n)
            first = np.cumsum(n) - n
            keys = np.repeat(place[None, :], len(some), 0)
            sig = np.zeros((len(some), -(-rows * bands // per)), U)
            for k in range(rows * bands if len(some) else 0):
                least = np.minimum.reduceat(h * a[k], first[some])
                keys[:, k // rows] = mix(keys[:, k // rows] * U(WORD_BASE) + least)
                # The low bits of a product depend on the low bits of its factors only, so they are mixed first.
                sig[:, k // per] |= (mix(least) & U((1 << BITS) - 1)) << U(BITS * (k % per))
            digest = [hashlib.blake2b(h[i:j].tobytes() + h2[i:j].tobytes(), digest_size=16).digest() if i < j else None for i, j in zip(first.tolist(), (first + n).tolist(), strict=True)]
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n), pa.array(digest, pa.binary()), _lists(keys, n > 0), _lists(sig, n > 0)],
                ["doc_id", "th", "n_shingles", "digest", "bands", "sig"],
            )


def _lists(rows: np.ndarray, some: np.ndarray) -> pa.Array:
    """The rows as lists of longs, in the places that ``some`` marks; nulls elsewhere."""
    offsets = pa.array(np.append(0, np.cumsum(some) * rows.shape[1]).astype(np.int32), mask=np.append(~some, False))
    return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1).view(np.int64)))


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, shingle fingerprints as bytes: all first longs, ascending, then all second ones)."""
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column(1)):
            h, h2, d = shingle_sets(Words(data, offsets, PRINT, lower=True), shingle)
            cut = np.searchsorted(d, np.arange(hi - lo + 1)).tolist()
            hs = [h[a:b].tobytes() + h2[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(hs, pa.binary())], ["id", "hs"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, hs_a, hs_b) to the pairs with 100 * intersection >= percent * union."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = halves(x.as_buffer()), halves(y.as_buffer())
            both = common(p, q)
            ok.append(100 * both >= percent * (len(p[0]) + len(q[0]) - both))
        m = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(m), batch.column(1).filter(m)], ["a", "b"])


def least_estimate(percent: int, hashes: int) -> float:
    """The estimate under which a pair at the threshold practically never falls."""
    c = 2.0**-BITS
    match = percent / 100 * (1 - c) + c
    return percent / 100 - SLACK * (match * (1 - match) / hashes) ** 0.5 / (1 - c)


def _agreement(n_hashes: int) -> str:
    """SQL: the collision-corrected similarity of sig_a and sig_b, by bit counts."""
    field = "0x" + "1" * (64 // BITS)
    ones = int(field, 16)
    fold = " | ".join(["x"] + [f"shiftrightunsigned(x, {i})" for i in range(1, BITS)])
    diff = f"aggregate(zip_with(sig_a, sig_b, (p, q) -> p ^ q), 0, (acc, x) -> acc + bit_count(({fold}) & {ones}L))"
    c = 2.0**-BITS
    return f"((1 - {diff} / {n_hashes}D) - {c}D) / {1 - c}D"


def _across(batches: Iterator[pa.RecordBatch], hashes: int, percent: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j) to pairs across components.

    Rows: side (0 and 1 are compared, 2 with itself), id, comp, n, sig; if ``exact``, also the
    band of the key, the band keys and the shingle set. Without, all pairs that pass the bit
    count; with, a confirmed link for each two components that have one.
    """
    least, c = least_estimate(percent, hashes), 2.0**-BITS
    ones = U(int("1" * (64 // BITS), 16))
    most = int((1 - (least * (1 - c) + c)) * hashes)

    def close(sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
        x = sb ^ sa
        y = x.copy()
        for i in range(1, BITS):
            y |= x >> U(i)
        return np.bitwise_count(y & ones).sum(1) <= most

    def pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        left, right = [r for r in rows if r[0] != 1], [r for r in rows if r[0] != 0]
        if not left or not right:
            return []
        itself = rows[0][0] == 2
        table = lambda rs: [np.array([r[i] for r in rs], np.int64) for i in (1, 2, 3, 4)]
        (ia, ca, na, sa), (ib, cb, nb, sb) = table(left), table(right)
        sa, sb = sa.view(U), sb.view(U)
        if exact:
            keys = np.array([r[6] for r in right], np.int64)
            sets = [halves(r[7]) for r in right]
            own = sets if itself else [halves(r[7]) for r in left]
        out, joined = [], set()
        for k in range(len(ia)):
            ok = np.flatnonzero((cb != ca[k]) & (100 * np.minimum(nb, na[k]) >= percent * np.maximum(nb, na[k])))
            if itself:
                ok = ok[ok > k]
            ok = ok[close(sa[k], sb[ok])] if len(ok) else ok
            if exact and len(ok):  # in the first bucket that the two share
                ok = ok[(keys[ok] == np.array(left[k][6], np.int64)).argmax(1) == left[k][5]]
            if exact and len(ok):
                both = np.array([common(sets[j], own[k]) for j in ok.tolist()], np.int64)
                ok = ok[100 * both >= percent * (nb[ok] + na[k] - both)]
            for j in ok:
                two = (min(ca[k], cb[j]), max(ca[k], cb[j]))
                if not exact or two not in joined:
                    joined.add(two)
                    out.append((min(int(ia[k]), int(ib[j])), max(int(ia[k]), int(ib[j]))))
        return out

    def emit(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    now, rows = None, []
    for batch in batches:
        for key, i, j, *rest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (key, i, j) != now:
                if found := pairs(rows):
                    yield emit(found)
                now, rows = (key, i, j), []
            rows.append(tuple(rest))
    if found := pairs(rows):
        yield emit(found)


def components(links: DataFrame) -> DataFrame:
    """(v, label) for the ends of ``links`` (a, b): the smallest id of the connected component.

    Minimum labels spread over links and jump along labels, so rounds are logarithmic in a
    component's breadth. Labels are written each round; nothing of them reaches the driver but
    whether one changed.
    """
    e = spool(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    lab = spool(e.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = e.join(lab, e.b == lab.v).groupBy("a").agg(F.min("label").alias("m"))
        step = lab.join(near, lab.v == near.a).select("v", "label", F.least("label", "m").alias("l1"))
        up = lab.select(F.col("v").alias("l1"), F.col("label").alias("l2"))
        new = spool(step.join(up, "l1", "left").select("v", "label", F.least("l1", "l2").alias("new")), "labels")
        lab = new.select("v", F.col("new").alias("label"))
        if not new.filter("new < label").limit(1).count():
            return lab


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and n_links: confirmed links of its class, as far as they were needed."""
    n_hashes = rows * bands
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").alias("text"))
    s = spool(map_arrow(d, lambda b: sketch(b, shingle, rows, bands), SKETCH), "sketches")
    own = s.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = own.groupBy("digest").agg(
        F.min(F.struct("doc_id", "th")).alias("m"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
    )
    # A class is known by its place in a total order: the smallest doc_id, which repeated ids make ambiguous, and so its digest.
    classes = spool(classes.select("digest", F.col("m.doc_id").alias("doc"), F.col("m.th").alias("th"), "n", "bands", "sig", F.xxhash64("digest").alias("id")), "classes")
    sig = classes.select("id", "n", "sig")
    member = classes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    centre = member.groupBy("key").agg(F.min("id").alias("c1"), F.max("id").alias("c2"), F.min_by("id", F.xxhash64("id")).alias("c3"), F.count("*").alias("m"), F.sum("n").alias("total")).filter("m > 1")
    # What is aggregated by a key is written before it meets the rows of that key, so that a hot key's rows can be split.
    bucket = spool(member.join(spool(centre, "centres"), "key"), "buckets")

    def sets_of(ids: DataFrame) -> DataFrame:
        texts = classes.join(ids, "id").select("id", F.col("doc").alias("doc_id"), "th").join(d, ["doc_id", "th"]).dropDuplicates(["id"]).select("id", "text")
        return spool(map_arrow(texts, lambda x: _sets(x, shingle), "id long, hs binary"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sig.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
        b = sig.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
        near = pairs.join(a, "a").join(b, "b").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        near = spool(near.filter(F.expr(f"{_agreement(n_hashes)} >= {least_estimate(percent, n_hashes)}D")).select("a", "b"), "near")
        sets = sets_of(near.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        both = near.join(sets.select(F.col("id").alias("a"), F.col("hs").alias("hs_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("hs").alias("hs_b")), "b")
        return spool(map_arrow(both.select("a", "b", "hs_a", "hs_b"), lambda x: _confirm(x, percent), "a long, b long"), "links")

    star = bucket.select("id", F.explode(F.array("c1", "c2", "c3")).alias("c")).filter("id <> c")
    star = star.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
    links = confirmed(star)
    label = components(links)

    # Buckets that still hold several components.
    known = bucket.select("key", "band", "id", "n", "m", "total").join(label, F.col("id") == F.col("v"), "left").withColumn("comp", F.coalesce("label", "id")).drop("v", "label")
    mixed = known.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    rest = spool(known.join(spool(mixed, "mixed"), "key", "left_semi").filter("m > 2"), "rest")
    few = rest.filter(F.col("m") <= SMALL).join(sig.select("id", "sig"), "id").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), "id", "comp", "n", "sig")
    pairs = map_arrow(few.repartition("key").sortWithinPartitions("key"), lambda x: _across(x, n_hashes, percent, False), "a long, b long").distinct()
    many = rest.filter(F.col("m") > SMALL)
    sets = sets_of(many.select("id").distinct())
    nb = F.greatest(F.ceil(F.col("m") / SIDE), F.ceil(16 * F.col("total") / SIDE_BYTES)).cast("int")
    many = many.join(classes.select("id", "sig", "bands").join(sets, "id"), "id").withColumn("nb", nb).withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    dealt = many.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        "id", "comp", "n", "sig", "band", "bands", "hs",
    )
    across = map_arrow(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), lambda x: _across(x, n_hashes, percent, True), "a long, b long")
    links = links.unionByName(confirmed(pairs)).unionByName(spool(across, "links")).distinct()
    # Rows with one doc_id are one document, whatever their sets.
    same = own.join(classes.select("digest", "id"), "digest").select("doc_id", "id").distinct()
    least = same.groupBy("doc_id").agg(F.min("id").alias("a"), F.count("*").alias("k")).filter("k > 1")
    links = links.select("a", "b").unionByName(same.join(least, "doc_id").filter("id <> a").select("a", F.col("id").alias("b")))
    label = components(links)
    # Most classes are components of their own; only linked ones look for the smallest doc_id.
    linked = spool(classes.join(label, F.col("id") == F.col("v")).select("digest", "doc", "label"), "linked")
    lowest = spool(linked.groupBy("label").agg(F.min("doc").alias("component")), "lowest")
    alone = classes.join(label, F.col("id") == F.col("v"), "left_anti").select("digest", F.col("doc").alias("component"))
    classed = linked.join(lowest, "label").select("digest", "component").unionByName(alone)
    out = own.select("doc_id", "n_shingles", "digest").join(classed, "digest").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    out = out.unionByName(s.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, shingle=3, percent=85, rows=5, bands=32)


def keep(docs: DataFrame, **params) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its own columns.

    Rows that share a ``doc_id`` stay or go together; rows without one stay.
    """
    gone = near_duplicates(docs, **params).filter("NOT kept").select("doc_id").distinct()
    return without(docs, gone, doc_id=F.col("doc_id").cast("long"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id AS v, doc_id AS u FROM s UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.c AS component_id, s.doc_id = c.c AS kept
FROM s JOIN (SELECT v, min(u) AS c FROM r GROUP BY v) c ON c.v = s.doc_id
"""
