import gzip
import hashlib
import random

from vectorloom.llm import warc

from .helpers import clashing, rows

PAGE = "page_id long, url string, html string"


def fixture():
    r = random.Random(2)
    big = "<p>" + "é" * 60 + "\r\n\r\n" + "WARC/1.1\r\nContent-Length: 5\r\n\r\n" + "</p>"
    pages = [(None, "http://n/", big), (1, None, None), (2, "http://a/\r\nX: y", ""), (3, "http://b/", "x" * 99), (4, "http://b/", "x" * 99), (5, "http://c/", "y" * 100), (6, "http://c/", "y" * 100), (9, "http://d/", big), (7, "http://e/", big), (8, "http://f/", big + "\r\n"), (7, "http://e/", big)]
    pages += [(i, f"http://h/{i}", "".join(r.choice("ab\r\n é") for _ in range(r.choice([0, 5, 200, 3000])))) for i in range(20, 60)]
    pages += [(61, "http://long/", "long " * 200_000), (60, "http://long/", "long " * 200_000)]
    return pages


def brute(pages):
    first = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if i is not None and len(b) >= 100:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        to = first[b] if i is not None and len(b) >= 100 and first[b] < i else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def test_round_trip(spark):
    pages = fixture()
    df = spark.createDataFrame(pages, PAGE).repartition(3)
    assert rows(warc.query(clashing(df))) == brute(pages)
    assert rows(warc.query(df.limit(0))) == []


def test_archives_are_valid_and_payloads_come_back(spark, tmp_path):
    pages = fixture()
    path = str(tmp_path / "warc")
    warc.write(spark.createDataFrame(pages, PAGE).repartition(2), path)
    n, responses, revisits = 0, {}, []
    for f in (tmp_path / "warc").glob("*.gz"):
        b, at = gzip.open(f).read(), 0
        while at < len(b):  # an independent walk by Content-Length
            head, _, _ = b[at:].partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            if fields[b"WARC-Type"] == b"response":
                responses[fields[b"WARC-Record-ID"]] = fields
            elif fields[b"WARC-Type"] == b"revisit":
                revisits.append(fields)
            at += len(head) + 4 + size
            assert b[at : at + 4] == b"\r\n\r\n"
            at, n = at + 4, n + 1
    assert n == 3 * len(pages) and len(responses) + len(revisits) == len(pages) and revisits
    for f in revisits:  # to a stored response of the same payload
        to = responses[f[b"WARC-Refers-To"]]
        assert (to[b"WARC-Payload-Digest"], to[b"WARC-Page-ID"]) == (f[b"WARC-Payload-Digest"], f[b"WARC-Refers-To-Page-ID"])
    got = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(got) == len(pages) and all(r.request and r.metadata for r in got)
    stored = {bytes(r.response.payload) for r in got if r.response.type == "response"}
    assert stored == {(h or "").encode() for _, _, h in pages}
    assert all(r.response.declared_digest == r.response.payload_digest for r in got)


def test_part_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PART", 10)
    pages = fixture()
    warc.write(spark.createDataFrame(pages, PAGE).coalesce(1), str(tmp_path / "warc"))
    assert len(list((tmp_path / "warc").glob("*.gz"))) >= 3 * len(pages) // 10
    got = warc.assemble(warc.read_records(spark, str(tmp_path / "warc"))).collect()
    assert len(got) == len(pages) and all(r.request and r.metadata for r in got)
