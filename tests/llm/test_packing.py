import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from vectorloom.llm import packing

from .helpers import clashing, docs, rows

PATH = P.path("word_bpe_49k.json")


def check(df, pairs):
    tok = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for (i, _), e in zip(pairs, tok.encode_batch([t or "" for _, t in pairs], add_special_tokens=False), strict=True):
        want[i].append(np.array([*e.ids, 2], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in df.collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        if len(want[i]) > 1:  # repeated rows: equal documents only
            assert sum(p.length for p in own) == sum(map(len, want[i]))
            continue
        (ids,) = want[i]
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding


def test_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pairs = [tuple(r) for r in d.select("doc_id", "text").collect()]
    assert check(packing.query(d, PATH), pairs) == 0


def test_odd_texts(spark):
    pairs = [(None, "x"), (1, None), (2, ""), (3, " \n"), (4, "É́ ǅ\x1c\x1f a\x85b <|endoftext|> it's İ Σ. ς 　12"), (5, "ab " * 9000), (6, "z" * 5000), (7, "one two"), (7, "one two")]
    assert check(packing.query(clashing(docs(spark, pairs)), PATH), pairs) == 0
    assert rows(packing.query(docs(spark, []), PATH)) == []


@pytest.mark.parametrize("counts,capacity,total", [({3: 2, 5: 1}, 10, 8), ({3: 2, 5: 1}, 11, 11), ({7: 9}, 30, 28), ({2: 1}, 1, 0), ({}, 5, 0), ({1: 4096}, 4096, 4096)])
def test_best_filling(counts, capacity, total):
    take = packing.best_filling(counts, capacity)
    assert sum(k * n for k, n in take.items()) == total
    assert all(0 < n <= counts[k] for k, n in take.items())


def test_best_filling_against_exhaustive_search():
    r = random.Random(4)
    for _ in range(300):
        counts = {r.randint(1, 12): r.randint(1, 3) for _ in range(r.randint(0, 4))}
        capacity = r.randint(0, 40)
        lengths = sorted(counts)
        totals = [sum(x * n for x, n in zip(lengths, take, strict=True)) for take in itertools.product(*(range(counts[x] + 1) for x in lengths))]
        take = packing.best_filling(counts, capacity)
        assert all(0 < n <= counts[k] for k, n in take.items())
        assert sum(k * n for k, n in take.items()) == max(t for t in totals if t <= capacity)


def test_ids_of_every_character():
    e, tok = packing.encoder(PATH), Tokenizer.from_file(PATH)
    assert e.by_chunk
    texts = [f"a{c}b x{c} {c}y it{c}'s 1{c}2 .{c}!" for c in map(chr, range(0x3400))]
    texts += ["a<|endoftext|>b <|ENDOFTEXT|> <|endoftext", "'s'S'LL..'re don't WE'LL o'clock '''", "À́ éx"]
    for t, x in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert e.encode(t) == packing.packed(x.ids)


def test_memory_of_chunks_turns_over(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBER", 20)
    e, tok = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    r = random.Random(6)
    for _ in range(60):
        t = " ".join(f"word{chr(97 + r.randint(0, 25))}{r.choice(['', ',', '!é', 'œ'])}" for _ in range(30))
        for t in (t, t.replace("œ", "")):
            assert e.encode(t) == packing.packed(tok.encode(t, add_special_tokens=False).ids)
        assert len(e.chunks) <= 20 + 30 and len(e.pieces) <= 20 + 90
