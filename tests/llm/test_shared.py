from types import SimpleNamespace

import numpy as np
import pytest

from vectorloom.llm import bytescan, near_dedup, shared


def session(master, conf=None, given=None, own=None):
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: conf), getCheckpointDir=lambda: given)
    context.setCheckpointDir = lambda d: setattr(context, "getCheckpointDir", lambda: d)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, other: own or other))


def test_shared_folder():
    assert shared.shared_dir(session("spark://h:1", "hdfs://n/c/")) == "hdfs://n/c"
    assert shared.shared_dir(session("spark://h:1", None, "hdfs://n/d")) == "hdfs://n/d"
    assert shared.shared_dir(session("spark://h:1", None, None, "s3a://b/e")) == "s3a://b/e"
    assert shared.shared_dir(session("local[4]")).startswith("/tmp/")
    for master in ("spark://h:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared.shared_dir(session(master))


def scanned(text):
    b = text.encode()
    return bytescan.Words(np.frombuffer(b, np.uint8), np.array([0, len(b)]), bytescan.PRINT)


def test_longs_tell_words_apart():
    words = ["a", "b", "ab", "ba", "a" * 7, "a" * 8, "a" * 9, "a" * 14, "a" * 15, "a" * 16, "a" * 17, "b" * 16, "é" * 7, "é" * 8, "a\0", "\0a", "\0", "\0\0", "x" * 300, "x" * 301]
    low, high = scanned(" ".join(words)).longs()
    assert len(set(zip(low.tolist(), high.tolist(), strict=True))) == len(words)
    again = scanned(" ".join(reversed(words))).longs()
    assert list(zip(*(x.tolist() for x in again), strict=True))[::-1] == list(zip(low.tolist(), high.tolist(), strict=True))


def test_digests_and_fingerprints_go_by_words():
    w = scanned("one two three ab c a bc one two three")
    n = np.array([3, 3, 2, 2])
    d = w.digests(np.array([0, 7, 3, 5]), n)
    assert d[0] == d[1] and d[2] != d[3] and len(set(map(len, d))) == 1
    a, b = w.fingerprints(3, w.longs())
    assert (a[0], b[0]) == (a[7], b[7]) and len(set(a.tolist())) == len(a) - 1
    a, b = w.fingerprints(2, w.longs())
    assert (a[3], b[3]) != (a[5], b[5])


def test_shingle_sets_sort_alike_whatever_the_bits(monkeypatch):
    """Few bits of the fingerprint, or more documents than their bits hold, are sorted by all of it."""
    texts = ["a b c a b c d", "x", "", "a b c d e f g a b c", "q r s t u v w x y z " * 20]
    raw = [t.encode() for t in texts]
    words = bytescan.Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), bytescan.PRINT)
    plain = [x.tolist() for x in near_dedup.shingle_sets(words, 3)]
    assert [plain[2].count(i) for i in range(5)] == [4, 1, 0, 7, 10]
    for bits in (63, 0):
        monkeypatch.setattr(near_dedup, "DOC_BITS", bits)
        assert [x.tolist() for x in near_dedup.shingle_sets(words, 3)] == plain
