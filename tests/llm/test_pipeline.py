import corpus_pipeline
import public_tokenizers as P
from tokenizers import Tokenizer

from vectorloom.llm import quality_rules

from . import brute

SF = "/root/testdata/sf0.001"


def redacted(t):
    out, at = "", 0
    for s, e in [tuple(map(int, x.split(":")[1:])) for x in brute.all_spans(t).split(",") if x]:
        out += t[at:s] + "[SECRET]" if s >= at else ""
        at = max(at, e)
    return out + t[at:]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = {r.doc_id for r in quality_rules.query(docs).filter("kept").collect()}
    failed = {x[0] for x in brute.quality(pairs) if x[-1]}
    assert kept and not kept & failed
    left = [p for p in pairs if p[0] in kept]
    of = brute.components(left, 5, 80)
    left = [p for p in left if of[p[0]][1] == p[0]]
    bad = {x[0] for x in brute.hits(left, items) if x[-1]}
    left = [p for p in left if p[0] not in bad]
    pieces = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {i for i, _ in left}
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, t in left:
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == pieces[i][0].doc_tokens
        assert at == len(tok.encode(redacted(t), add_special_tokens=False).ids) + 1


def test_stage_contract(spark):
    d = docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d.limit(0), SF)
        assert d.columns == docs.columns and d.dtypes == docs.dtypes and d.count() == 0


def test_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
