import hashlib
import random

import pytest

from vectorloom.llm import substring_dedup as sd

from .helpers import WS, clashing, docs, rows


def brute(pairs):
    first = {}
    for i, t in pairs:
        w = WS.findall(t or "")
        if i is not None:
            for k in range(len(w) - 49):
                x = tuple(w[k : k + 50])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t in pairs:
        w = WS.findall(t or "")
        gone = set()
        if i is not None:
            for k in range(len(w) - 49):
                if first[tuple(w[k : k + 50])] < i:
                    gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def fixture():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    passage = [word() for _ in range(70)]
    pairs = [(None, " ".join(passage)), (5, None), (6, ""), (7, " \t\n "), (8, "one"), (9, "a " * 3000), (10, "a " * 60), (11, "a " * 49)]
    for i in range(20, 60):
        w = [word() for _ in range(r.randint(0, 150))]
        if i % 2:
            at = r.randint(0, len(w))
            cut = r.randint(0, 25)
            w[at:at] = passage[cut : cut + r.randint(40, 70)]
        pairs.append((i, "  ".join(w) if i % 3 else "\n".join(w)))
    pairs += [pairs[12], pairs[13], (70, pairs[20][1]), (71, pairs[20][1]), (4, pairs[21][1]), (72, pairs[30][1] + " end")]
    return pairs


@pytest.mark.parametrize("hot", [512, 1])
def test_against_brute_force(spark, monkeypatch, hot):
    """HOT = 1 sends every bucket with two strings through the splitting path."""
    monkeypatch.setattr(sd, "HOT", hot)
    pairs = fixture()
    assert rows(sd.query(docs(spark, pairs))) == brute(pairs)


def test_words_of_a_long_run_are_cut_into_strings(spark, monkeypatch):
    monkeypatch.setattr(sd, "LONGEST", 3)
    pairs = fixture()
    assert rows(sd.query(docs(spark, pairs))) == brute(pairs)


def test_empty_table_and_clashing_columns(spark):
    assert rows(sd.query(docs(spark, []))) == []
    pairs = fixture()[:12]
    assert rows(sd.query(clashing(docs(spark, pairs)))) == brute(pairs)


def test_whole_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert rows(sd.query(d)) == brute([tuple(r) for r in d.select("doc_id", "text").collect()])


def test_kept_text(spark):
    w = [f"w{i}" for i in range(60)]
    got = {r.doc_id: r.kept_text for r in sd.dedup(docs(spark, [(1, " ".join(w)), (2, "x " + " ".join(w) + " y")])).collect()}
    assert got == {1: " ".join(w), 2: "x y"}


def test_words_that_polynomial_hashes_confuse(spark):
    x = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    y = x.translate(str.maketrans("ab", "ba"))
    same = " ".join(f"w{i}" for i in range(49))
    assert [r.n_removed for r in sd.query(docs(spark, [(1, f"{same} {x}"), (2, f"{same} {y}"), (3, f"{same} {x}")])).orderBy("doc_id").collect()] == [0, 0, 50]


def test_many_repeated_rows(spark):
    w = " ".join(f"w{i}" for i in range(400))
    got = sd.query(docs(spark, [(1, w)] + [(2, w)] * 300)).groupBy("doc_id", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(1, 0, 1), (2, 400, 300)}
