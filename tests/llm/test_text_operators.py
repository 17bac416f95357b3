import random
import time

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from vectorloom.llm import decontamination, license_scan, near_dedup, quality_rules, secret_scan, token_counts

from . import brute
from .helpers import clashing, docs, rows

SF = "/root/testdata/sf0.01"
R = random.Random(5)
WORDS = ["the", "of", "É", "Über", "naïve", "x1", "#tag", "a-b", "$$", "日本", "Secret", "tok"]


def odd():
    """Null, empty, blank, very long, tied and repeated rows."""
    some = [(i, " ".join(R.choice(WORDS) for _ in range(R.choice([0, 1, 2, 3, 12, 13, 60, 300])))) for i in range(20, 50)]
    lines = "\n".join(["same line here"] * 30 + [" ", "", "\t"])
    return [(None, "a b c d"), (1, None), (2, ""), (3, " \n\t\x0b"), (4, lines), (5, "word " * 20000), (6, "z" * 100000), *some, some[3], some[4], (60, some[5][1]), (61, some[5][1])]


def test_quality(spark):
    pairs = odd()
    d = docs(spark, pairs)
    assert rows(quality_rules.query(clashing(d)).drop("kept", "fail_bits")) == brute.quality(pairs)
    assert rows(quality_rules.query(docs(spark, []))) == []
    for r in quality_rules.query(d).collect():
        assert r.kept == (r.fail_bits == 0) and (not r.kept or not r.base_failed)
    kept = quality_rules.keep(clashing(d))
    assert kept.columns == clashing(d).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality_rules.query(d).filter("kept").collect())


def test_policies_and_ablations(spark):
    led = quality_rules.ledger(spark.read.parquet(f"{SF}/documents.parquet")).persist()
    bits = [r.fail_bits for r in led.collect()]
    for policy, names in quality_rules.POLICIES.items():
        full = quality_rules.mask(policy)
        assert quality_rules.apply_policy(led, policy).filter("kept").count() == sum(b & full == 0 for b in bits)
        for r in quality_rules.ablations(led, policy).collect():
            bit = quality_rules.BIT[r.rule]
            assert r.rule in names
            assert (r.n_failed, r.n_failed_alone, r.n_kept_without) == (sum(b & bit != 0 for b in bits), sum(b & full == bit for b in bits), sum(b & full & ~bit == 0 for b in bits))
    led.unpersist()


def test_clean_documents_are_kept(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    q = quality_rules.query(d).join(good, "doc_id").filter("NOT base_failed")
    assert q.filter("NOT kept").count() <= 0.02 * q.count()


@pytest.mark.parametrize("block", [4 << 20, 60])
def test_decontamination(spark, block):
    """A block of 60 bytes holds about an item, so results of many blocks are merged."""
    base = [" ".join(R.choice(WORDS) + str(R.randint(0, 9)) for _ in range(n)) for n in (1, 4, 12, 13, 14, 40)]
    items = [(10 + i, t) for i, t in enumerate(base)] + [(None, "only here 7"), (7, None), (8, ""), (9, "..."), (10, base[0]), (30, base[5][:80] + " tail")]
    pairs = odd() + [(100 + i, f"lead {t.upper()} tail, {base[(i * 2) % 6]}") for i, t in enumerate(base)] + [(120, "only HERE 7"), (121, base[5][3:])]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontamination.query(clashing(docs(spark, pairs)), b, block)) == brute.hits(pairs, items)
    assert rows(decontamination.query(docs(spark, pairs[:8]), b.limit(0), block)) == brute.hits(pairs[:8], [])
    assert rows(decontamination.query(docs(spark, []), b, block)) == []


def test_secret_base(spark):
    pairs = odd() + [
        (200, 'Token = "abcdefgh" PASSWORD:short secret=token=abcdefgh token=token "= abcdefgh é api_key\':\'0123456789'),
        (201, "AKIA0123456789AB AKIAshort xAKIA" + "Z" * 20 + " " + "0f" * 20 + "g" + "a" * 31),
        (202, "é日本 " * 50 + "passwd=" + "x" * 9 + " apikey: ſecret=12345678 toKen=12345678"),
        (203, "token=abcdefghi " * 300),
    ]
    want = {}
    for i, t in pairs:
        want.setdefault(i, set()).add(",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in brute.base_spans(t)))
    import hashlib

    for r in secret_scan.query(clashing(docs(spark, pairs))).collect():
        assert r.base_sha256 in {hashlib.sha256(x.encode()).hexdigest() for x in want[r.doc_id]}
    assert rows(secret_scan.query(docs(spark, []))) == []
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: [x for x in r.spans.split(",") if x and not x.startswith("random")] for r in secret_scan.query(d).collect()}
    for i, t in d.select("doc_id", "text").collect():
        assert got[i] == [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in brute.base_spans(t)]


def test_random_tokens(spark):
    r = random.Random(11)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    found = [(i, "key " + "".join(r.choice(b64) for _ in range(48))) for i in range(40)]
    found += [(i, "key " + "".join(r.choice("0123456789ABCDEF") for _ in range(64))) for i in range(40, 80)]
    prose = ["supercalifragilisticexpialidocious", "A" * 40, "0" * 64, "itwasthebestoftimesitwastheworstoftimes", "0123456789" * 5, "ABCDEF" * 8, "https/en/wiki/Some_long_page_name_here", "------------------------------"]
    none = [(100 + i, f"see {t} there") for i, t in enumerate(prose)]
    got = {x.doc_id: x.spans for x in secret_scan.query(docs(spark, found + none)).collect()}
    assert sum("random" in got[i] for i, _ in found) >= 76
    assert [i for i, _ in none if "random" in got[i]] == []


def test_redaction(spark):
    pairs = [(1, "a token=abcdefgh1 b"), (2, "x " + "0a" * 20 + " secret: " + "0b" * 20), (3, None), (4, "clean é text")]
    d = clashing(docs(spark, pairs))
    out = secret_scan.redact(d)
    assert out.columns == d.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("a [SECRET] b", 12), 2: ("x [SECRET] [SECRET]", 19), 3: (None, None), 4: ("clean é text", 12)}


def variants(r, n, words, edits):
    base = [f"w{r.randint(0, 10**6)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("small,side,size", [(32, 1024, 16 << 20), (2, 7, 16 << 20), (2, 1024, 6000)])
def test_near_duplicates(spark, monkeypatch, small, side, size):
    """The other cases take buckets of three and more through blocks of about seven members, or of a few sets' bytes."""
    monkeypatch.setattr(near_dedup, "SIDE_BYTES", size)
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "SIDE", side)
    r = random.Random(8)
    pairs = [(i, t) for i, t in odd() if i is not None]
    pairs = [p for k, p in enumerate(pairs) if p[0] not in {q[0] for q in pairs[:k]}]
    at = 300
    for n, words, edits in ((40, 120, 6), (25, 60, 3), (30, 200, 14), (12, 30, 2)):
        for t in variants(r, n, words, edits):
            pairs.append((at, t.upper() if at % 5 == 0 else t))
            at += 1
    r.shuffle(pairs)
    want = brute.components(pairs, 3, 85)
    got = near_dedup.query(clashing(docs(spark, pairs))).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in got) and len(got) == len(pairs)


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    got = rows(near_dedup.query(docs(spark, [(None, text), (None, text), (5, text), (5, text), (9, text), (9, "b c d e"), (11, "b c d e"), (12, None)])))
    assert got == sorted([(None, 48, None, True)] * 2 + [(5, 48, 5, True)] * 2 + [(9, 48, 5, False), (9, 2, 5, False), (11, 2, 5, False), (12, 0, 12, True)], key=repr)
    assert rows(near_dedup.query(docs(spark, []))) == []


def test_token_counts(spark):
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    pairs = odd() + [(300, "<|endoftext|> a<|endoftext|>"), (301, "it's WE'LL 123 \r\n\n  x　y\x85"), (302, "ﷺ👩‍👩‍👧")]
    want = sorted(((i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(pairs, [len(e.ids) for e in tok.encode_batch([t or "" for _, t in pairs], add_special_tokens=False)], strict=True)), key=repr)
    assert rows(token_counts.count_tokens(clashing(docs(spark, pairs)), path)) == want
    assert rows(token_counts.count_tokens(docs(spark, []), path)) == []


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [
        (1, mit, "en", "repo"),
        (2, "some words " * 30 + "\n" + gpl, "en", "repo"),
        (3, "plain text without any", "en", "repo"),
        (4, "plain text without any", "de", "repo"),
        (5, None, None, None),
        (6, "copyright of nobody at all", "en", "other"),
        (3, "plain text without any", "en", "repo"),
    ]
    d = spark.createDataFrame([(*f, 0) for f in files], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in license_scan.query(d.withColumn("path", d.doc_id).withColumn("licence", d.doc_id)).collect()}
    assert (got[1].licence, got[1].is_licence_file, got[1].inherited_from) == ("MIT", True, None)
    assert (got[2].licence, got[2].is_licence_file, got[2].effective) == ("GPL-3.0", False, "GPL-3.0")
    assert (got[3].licence, got[3].effective, got[3].inherited_from) == (None, "MIT", "repo/en")
    assert (got[4].effective, got[5].effective, got[6].effective) == (None, None, None)
    assert rows(license_scan.query(d.limit(0))) == []
    tree = spark.createDataFrame([("a/LICENSE", "MIT", True), ("a/b/c/x", None, False), ("a/b/LICENSE", "GPL-3.0", True), ("a/d/x", None, False), ("e/x", None, False)], "path string, licence string, is_licence_file boolean")
    assert {r.path: (r.effective, r.inherited_from) for r in license_scan.inherit(tree).collect()} == {
        "a/LICENSE": ("MIT", None), "a/b/c/x": ("GPL-3.0", "a/b"), "a/b/LICENSE": ("GPL-3.0", None), "a/d/x": ("MIT", "a"), "e/x": (None, None)}


def test_full_licence_texts(spark):
    text = {i: (license_scan.TEXTS / f"{i}.txt").read_text() for i in ("MIT", "GPL-2.0", "GPL-3.0", "MPL-2.0", "CC-BY-NC-4.0")}
    mit = "MIT License\n\nCopyright (c) 2019 Some Body <some@body.example>\n\n" + " ".join(text["MIT"].split())
    files = [(1, mit, "en", "a"), (2, "no word of it", "en", "a"), (3, text["GPL-2.0"], "en", "b"), (4, text["MPL-2.0"].lower(), "en", "c"), (5, text["CC-BY-NC-4.0"], "en", "d"), (6, text["GPL-3.0"], "en", "e")]
    files += [(7, "some code " * 2000 + text["MIT"], "en", "f")]
    d = spark.createDataFrame(files, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in license_scan.query(d).collect()}
    assert {i: (r.licence, r.is_licence_file) for i, r in got.items() if i not in (2, 7)} == {
        1: ("MIT", True), 3: ("GPL-2.0", True), 4: ("MPL-2.0", True), 5: ("CC-BY-NC-4.0", True), 6: ("GPL-3.0", True)}
    assert (got[2].licence, got[2].effective, got[2].inherited_from) == (None, "MIT", "a/en")
    assert not got[7].is_licence_file


def test_wrapped_and_spdx_notices(spark):
    code = "\n" + "some code here " * 40
    files = [
        ("/*\n * Ask the office about a copyright\n * or anything else\n */" + code, None),
        ("/*\n * This work is licensed under a Creative\n * Commons Attribution 4.0 International\n * License, CC BY 4.0. */" + code, "CC-BY-4.0"),
        ("# This Source Code Form is subject to the terms of\n# the Mozilla Public\n# License, v. 2.0." + code, "MPL-2.0"),
        ("/* Licensed under the Apache License,\n * Version 2.0 */" + code, "Apache-2.0"),
        ("// SPDX-License-Identifier: Apache-2.0" + code, "Apache-2.0"),
        ("# spdx-license-identifier: (GPL-3.0-or-later OR MIT)" + code, "GPL-3.0"),
        ("<!-- SPDX-License-Identifier: BSD-3-Clause -->" + code, "BSD-3-Clause"),
        ("// SPDX-License-Identifier: Zlib" + code, "Zlib"),
        ("// SPDX-License-Identifier: NOASSERTION" + code, None),
    ]
    d = spark.createDataFrame([(i, t, "en", f"s{i}") for i, (t, _) in enumerate(files)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in license_scan.query(d).collect()}
    assert [got[i].licence for i in range(len(files))] == [x for _, x in files]
    assert not any(r.is_licence_file for r in got.values())


def test_random_values_joined_to_names(spark):
    r = random.Random(12)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    value = lambda more: "".join(r.choice(alnum + more) for _ in range(56)) + more
    forms = [("run AWS_SECRET_ACCESS_KEY=", "+/", "== now"), ("get https://h.example/x?sig=", "-_", "&more=1"), ("the prefix_", "+/", " end"), ("see /path/x/", "-_", " end")]
    texts = [(n, a + v, v, z) for n, (a, m, z) in enumerate(forms * 10) for v in [value(m)]]
    got = {x.doc_id: x.text for x in secret_scan.redact(docs(spark, [(n, a + z) for n, a, _, z in texts])).collect()}
    for k in range(4):
        assert sum(v not in got[n] for n, _, v, _ in texts if n % 4 == k) >= 9


def tokens(r, n):
    """Tokens of all kinds, random, structured and in between, alone and in mixed texts."""
    alphabets = ["0123456789", "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
                 "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "abz+/_-019"]
    for _ in range(n):
        a = r.choice(alphabets)
        size = r.choice([19, 20, 21, 24, 30, 31, 40, 64, 200])
        t = "".join(r.choices(a, weights=[1 + r.choice([0, 0, 0.3, 4]) * (i % 5 == 0) for i in range(len(a))], k=size))
        yield t + "=" * r.choice([0, 0, 1, 2, 3])


def test_battery_against_brute_force(spark):
    r = random.Random(21)
    glue = [" ", "\n", "=", " token=", "é", "/", "_", "", " AKIA0123456789ABCD "]
    pairs = [(i, "".join(x + r.choice(glue) for x in tokens(r, r.choice([1, 1, 2, 5, 20])))) for i in range(400)]
    pairs += [(1000, None), (1001, ""), (1002, " ".join(tokens(r, 3000))), (1003, "".join(tokens(r, 1000)))]
    got = {x.doc_id: x.spans for x in secret_scan.query(docs(spark, pairs)).collect()}
    assert got == {i: brute.all_spans(t) for i, t in pairs}
    assert sum("random" in x for x in got.values()) > 100


def test_redaction_against_brute_force(spark, monkeypatch):
    """Blocks of seven code points, so most spans cross some."""
    monkeypatch.setattr(secret_scan, "BLOCK", 7)
    r = random.Random(22)
    pairs = [(i, "é" * r.randint(0, 9) + "".join(x + r.choice([" ", " token: ", "日本 "]) for x in tokens(r, r.choice([1, 3, 8])))) for i in range(150)]
    got = {x.doc_id: (x.text, x.n_chars) for x in secret_scan.redact(docs(spark, pairs)).collect()}
    for i, t in pairs:
        out, at = "", 0
        for s, e in [tuple(map(int, x.split(":")[1:])) for x in brute.all_spans(t).split(",") if x]:
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        assert got[i] == (out + t[at:], len(out + t[at:]))


def test_very_long_texts_of_secrets(spark):
    r = random.Random(23)
    a = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    one = "".join(r.choices(a, k=600_000))
    many = " ".join("token=" + "".join(r.choices(a, k=24)) for _ in range(20_000))
    began = time.time()
    got = {x.doc_id: x for x in secret_scan.query(docs(spark, [(1, one), (2, many)])).collect()}
    assert got[1].spans == "random:0:600000" and got[2].n_assign == 20_000
    assert time.time() - began < 30


ODD_NAMES = ("a.b", "_doc", "row", "_gone_doc_id", "_bad_doc_id", "th", "doc", "t", "text.x", "blocks", "spans", "w`x")


def test_stage_helpers_keep_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    d = docs(spark, [(1, "word " * 60 + "token=abcdefgh1"), (2, " ".join(f"w{i}" for i in range(80))), (3, None), (None, " ".join(f"w{i}" for i in range(80)))])
    d = d.select("*", *[F.lit(i).alias(c) for i, c in enumerate(ODD_NAMES)])
    b = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    want = {"quality": (quality_rules.keep(d, "base-1"), [None, 2]), "near": (near_dedup.keep(d), [None, 1, 2, 3]), "items": (decontamination.keep(d, b), [1, 3]), "secrets": (secret_scan.redact(d), [None, 1, 2, 3])}
    for out, ids in want.values():
        assert out.columns == d.columns and [t for _, t in out.dtypes] == [t for _, t in d.dtypes]
        got = out.collect()
        assert sorted((r[0] for r in got), key=lambda x: x or 0) == ids
        assert all(tuple(r[5:]) == tuple(range(len(ODD_NAMES))) for r in got)


@pytest.mark.parametrize("block", [4 << 20, 40])
def test_rows_are_decontaminated_by_their_own_text(spark, block):
    item = " ".join(f"w{i}" for i in range(20))
    b = spark.createDataFrame([(1, item), (2, None), (3, "another item of a few words only")], "item_id long, text string")
    d = clashing(docs(spark, [(None, item), (None, "clean"), (5, item), (5, "clean too"), (6, None)]))
    got = decontamination.keep(d, b, block)
    assert got.columns == d.columns and got.dtypes == d.dtypes
    assert sorted((r.text or "") for r in got.collect()) == ["", "clean", "clean too"]
    assert decontamination.keep(d.limit(0), b, block).count() == 0 and decontamination.keep(d, b.limit(0), block).count() == 5


def thue_morse(n):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(spark):
    x, y = thue_morse(4096)
    got = {r.doc_id: r.component_id for r in near_dedup.query(docs(spark, [(1, f"{x} q r"), (2, f"{y} q r"), (3, f"{x} q r")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    few = [w for n in (8, 15, 16, 17, 32) for w in thue_morse(n)]
    long = [(i, " ".join([w] * 3)) for i, w in enumerate(few)]
    assert all(r.kept for r in near_dedup.query(docs(spark, long)).collect())


def test_equal_hashes_are_sorted_by_words(spark, monkeypatch):
    """With hardly any bits of hash left, all windows meet and are told apart by their words."""
    monkeypatch.setattr(quality_rules, "PLACE", 62)
    pairs = odd()
    assert rows(quality_rules.query(docs(spark, pairs)).drop("kept", "fail_bits")) == brute.quality(pairs)
