"""License scans: TF-IDF cosine of texts and notices to templates, then inheritance along directories.

A file's whole text (all its words but those of copyright lines) is compared with the full texts
in ``licences/``, weighted by inverse document frequency over the texts with a cue word and the
full texts. At a cosine of ``WHOLE`` or more the file has the best one's licence and is a licence
file. The full texts of related licences (GPL-2.0, ISC, ...) are there so that none is taken
for a neighbour.

A notice is a line of a whole text with a cue word, alone or with up to ``AROUND`` lines before and
after it, as headers are wrapped. Its words form a sparse vector weighted by
inverse document frequency over all such lines of the table; its licence is the template with the
largest cosine of ``LEAST`` or more. An SPDX identifier scores 1 for the licence it names, and
for the first in an expression; it makes no licence file. A file that is no full text is still a licence file if its best
notice makes up ``FILE_SHARE`` of its words, as in ``SQL``, which states notices of one line only.

A licence file stands for its directory. A file without a licence of its own takes that
of the nearest directory above it which has one.

DataFrame operations only. Frequencies are counted over all notices but kept for the templates'
terms alone, so what comes to the driver and is joined by broadcast is fixed by the templates;
any other term has the weight of an unseen one. Notices and texts with a cue word are exploded
into words, other texts are not. Directories are resolved once each, so a directory with a third of all files is one row until the
last equi-join, which adaptive execution splits.

Defined cases: a null text has no notice; null path parts read as ``-``; of several best notices
the earliest line and the shortest notice count, of several templates the first by name, of several licence files in a
directory the smallest path; repeated rows are scanned one by one; other columns aren't carried.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import once, spool

#: Licence and the wording of its notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
CUE = r"(?i)licen[sc]|copyright|spdx-|redistribution and use"
#: Lower-cased words of a notice.
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LEAST, FILE_SHARE = 0.6, 0.2
#: Full texts by licence; lines that name the holder are no part of a text.
TEXTS = Path(__file__).parent / "licences"
HOLDER = r"(?im)^[^a-z0-9\n]*(?:copyright[ \t]+(?:\(c\)|©|[0-9<\[{])|\(c\)[ \t]|©|all rights reserved).*$"
WHOLE = 0.8
#: Lines before and after a cue that may belong to its notice, and an identifier that states a licence (the first of an expression).
AROUND = 2
SPDX = r"""(?i)spdx-license-identifier["']?[ \t]*[:=][ \t]*["'(]*([a-z0-9][a-z0-9.+-]*)"""


def _words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0))


def _rows(spark, rows, names: str) -> DataFrame:
    """A literal relation."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + f" AS t({names})")


def template_terms(spark) -> DataFrame:
    """licence, term, tf: as many rows as the templates have words."""
    t = _rows(spark, TEMPLATES, "licence, notice")
    return t.select("licence", F.explode(_words(F.col("notice"))).alias("term")).groupBy("licence", "term").agg(F.count("*").alias("tf"))


def full_texts() -> list[tuple[str, str]]:
    """licence, words of its full text."""
    return [(f.stem, " ".join(re.findall(WORD, re.sub(HOLDER, "", f.read_text()).lower()))) for f in sorted(TEXTS.glob("*.txt"))]


def whole(files: DataFrame) -> DataFrame:
    """(file, text) to the files whose whole text is a licence's: file, licence, score."""
    spark = files.sparkSession
    texts = full_texts()
    tt = _rows(spark, texts, "licence, words").select("licence", F.explode(F.split("words", " ")).alias("term")).groupBy("licence", "term").agg(F.count("*").alias("tf"))
    found = files.filter(F.col("text").rlike(CUE)).select("file", F.explode(_words(F.regexp_replace("text", HOLDER, ""))).alias("term"))
    found = spool(found.groupBy("file", "term").agg(F.count("*").alias("tf")), "words")
    n = float(found.select("file").distinct().count() + len(texts) + 1)
    own = tt.groupBy("term").agg(F.count("*").alias("df"))
    df = found.join(F.broadcast(own.select("term")), "term").groupBy("term").agg(F.count("*").alias("more"))
    idf = own.join(F.broadcast(df), "term", "left").select("term", (F.log(F.lit(n) / (F.col("df") + F.coalesce("more", F.lit(0)) + 1)) + 1).alias("idf"))
    w = tt.join(F.broadcast(idf), "term").select("licence", "term", "idf", (F.col("tf") * F.col("idf")).alias("w"))
    norms = w.groupBy("licence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    by = F.array(*[F.coalesce(F.sum(F.when(F.col("licence") == lic, F.col("w") / F.col("norm"))), F.lit(0.0)) for lic, _ in texts])
    weights = spool(w.join(F.broadcast(norms), "licence").groupBy("term", "idf").agg(by.alias("by")), "weights")  # the full texts' terms
    v = found.join(F.broadcast(weights), "term", "left").select("file", "by", (F.col("tf") * F.coalesce("idf", F.log(F.lit(n)) + 1)).alias("w"))
    dots = [F.coalesce(F.sum(F.col("w") * F.col("by")[i]), F.lit(0.0)).alias(f"dot_{i}") for i in range(len(texts))]
    scored = v.groupBy("file").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
    best = F.least(*[F.struct(F.round(-F.col(f"dot_{i}") / F.col("norm"), 6).alias("s"), F.lit(lic).alias("licence")) for i, (lic, _) in enumerate(texts)])
    return scored.select("file", best.alias("b")).filter(F.col("b.s") <= -WHOLE).select("file", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def notices(files: DataFrame) -> DataFrame:
    """file (any key), line, before, after, terms, spdx: the lines with a cue, of whole texts, alone and with lines round them."""
    lines = once(files.filter(F.col("text").rlike(CUE)), "file", lines=F.split("text", "\n"))
    at = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(CUE))
    spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(AROUND + 1) for b in range(AROUND + 1)])
    fits = lambda i: F.filter(spans, lambda w: (w.a <= i) & (i + w.b < F.size("lines")))
    window = lambda i: F.transform(fits(i), lambda w: F.struct(i.alias("line"), w.a.alias("before"), w.b.alias("after"), F.array_join(F.slice("lines", i - w.a + 1, w.a + w.b + 1), "\n").alias("s")))
    n = lines.select("file", F.explode(F.flatten(F.transform(at, window))).alias("x")).select("file", "x.*")
    spdx = F.when((F.col("before") + F.col("after") == 0) & F.col("s").rlike(SPDX), F.regexp_extract("s", SPDX, 1))
    return n.select("file", "line", "before", "after", _words(F.col("s")).alias("terms"), _identifier(spdx).alias("spdx")).filter(F.size("terms") > 0)


def _identifier(x: Column) -> Column:
    """The licence that an SPDX identifier names, in one spelling; others as written."""
    known = {lic.lower() + s: lic for lic in sorted({*(lic for lic, _ in TEMPLATES), *(f.stem for f in TEXTS.glob("*.txt"))}) for s in ("", "+", "-only", "-or-later")}
    names = F.create_map(*[F.lit(v) for kv in known.items() for v in kv])
    return F.when(~F.lower(x).isin("none", "noassertion"), F.coalesce(F.element_at(names, F.lower(x)), x))


def classify(files: DataFrame) -> DataFrame:
    """(file, text) to the files with a licence of their own: file, licence, score, line, n_terms.

    Rows with one ``file`` are one file.
    """
    spark = files.sparkSession
    tt = template_terms(spark)
    found = spool(notices(files).distinct(), "notices")
    place = ["file", "line", "before", "after"]
    term = found.select(*place, F.size("terms").alias("n"), F.explode("terms").alias("term"))
    tf = term.groupBy(*place, "n", "term").agg(F.count("*").alias("tf"))
    alone = F.col("before") + F.col("after") == 0
    vocabulary = tt.select("term").distinct()
    df = tf.filter(alone).join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("df"))
    total = found.filter(alone).count()
    known = {r["term"]: r["df"] for r in df.collect()}  # the templates' terms at most
    idf_of = F.log(F.lit(float(total + 1)) / (F.col("df") + 1)) + 1
    idf = _rows(spark, [(w.term, known.get(w.term, 0)) for w in vocabulary.collect()], "term, df").select("term", idf_of.alias("idf"))
    unseen = F.log(F.lit(float(total + 1))) + 1
    weights = tt.join(F.broadcast(idf), "term").select("licence", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weights.groupBy("licence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weights = weights.join(F.broadcast(norms), "licence").groupBy("term").agg(F.collect_list(F.struct("licence", (F.col("w") / F.col("norm")).alias("w"))).alias("by"))
    v = tf.join(F.broadcast(idf), "term", "left").join(F.broadcast(weights), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen))
    norm = v.groupBy(*place, "n").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        *[F.coalesce(F.sum(F.col("w") * F.expr(f"get(filter(by, b -> b.licence = '{lic}'), 0).w")), F.lit(0.0)).alias(f"dot_{i}") for i, (lic, _) in enumerate(TEMPLATES)],
    )
    scored = norm.select(*place, "n", F.explode(F.array(*[F.struct(F.lit(lic).alias("licence"), F.round(F.col(f"dot_{i}") / F.col("norm"), 6).alias("score")) for i, (lic, _) in enumerate(TEMPLATES)])).alias("x"))
    stated = found.filter("spdx IS NOT NULL").select(*place, F.lit(0).alias("n"), F.struct(F.col("spdx").alias("licence"), F.lit(1.0).alias("score")).alias("x"))
    scored = scored.filter(F.col("x.score") >= LEAST).unionByName(stated)
    best = scored.groupBy("file").agg(F.min(F.struct((-F.col("x.score")).alias("s"), "line", (F.col("before") + F.col("after")).alias("more"), F.col("x.licence").alias("licence"), "n")).alias("b"))
    return best.select("file", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"), F.col("b.line").alias("line"), F.col("b.n").alias("n_terms"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(files: DataFrame) -> DataFrame:
    """(path, licence, is_licence_file, ...) plus ``effective`` and ``inherited_from`` (a directory or null)."""
    f = files.withColumn("dir", parent(F.col("path")))
    own = f.filter("is_licence_file").groupBy("dir").agg(F.min(F.struct("path", "licence")).alias("x")).select(F.col("dir").alias("above"), F.col("x.licence").alias("given"))
    dirs = f.select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = dirs.select("dir", F.explode(F.array_distinct(above)).alias("above")).join(own, "above")
    nearest = up.groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "given")).alias("x")).select("dir", F.col("x.above").alias("from_dir"), F.col("x.given").alias("given"))
    # Written first, so that the files of one directory can be split when they meet it.
    out = f.join(spool(nearest, "directories"), "dir", "left")
    none = F.col("licence").isNull()
    return out.withColumn("effective", F.coalesce("licence", "given")).withColumn("inherited_from", F.when(none, F.col("from_dir"))).drop("dir", "given", "from_dir")


def query(docs: DataFrame) -> DataFrame:
    """The documents as files ``source/lang/doc_id``."""
    part = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), "/", "_")
    d = docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text")
    # A row is known by its path and a hash of its text; equal rows have equal results. Only
    # texts with a cue go further, and only their notices are shuffled.
    n_words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    key = F.struct("path", F.xxhash64("text").alias("th"), n_words.alias("n_words"))
    cued = d.filter(F.col("text").rlike(CUE)).select(key.alias("file"), "text")
    share = F.coalesce(F.col("n_terms") >= FILE_SHARE * F.col("file.n_words"), F.lit(False))
    full = whole(cued).select("file", F.col("licence").alias("full"), F.col("score").alias("full_score"))
    got = classify(cued).join(full, "file", "full").withColumn("is_file", F.col("full").isNotNull() | share)
    got = got.select(F.col("file.path").alias("path"), F.col("file.th").alias("th"), F.coalesce("full", "licence").alias("licence"), F.coalesce("full_score", "score").alias("score"), "is_file")
    f = d.select("doc_id", "path", F.xxhash64("text").alias("th")).join(got, ["path", "th"], "left")
    f = spool(f.select("doc_id", "path", "licence", "score", F.coalesce("is_file", F.lit(False)).alias("is_licence_file")), "files")
    return inherit(f).select("doc_id", "path", "licence", "score", "is_licence_file", "effective", "inherited_from")


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)
    return f"""
WITH t AS (SELECT * FROM (VALUES {values}) AS v(licence, notice)),
tt AS (SELECT licence, term, count(*) AS tf FROM (SELECT licence, unnest(regexp_extract_all(lower(notice), '{WORD}')) AS term FROM t) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS rid, doc_id, text,
             replace(coalesce(source, '-'), '/', '_') || '/' || replace(coalesce(lang, '-'), '/', '_') || '/' || coalesce(doc_id::VARCHAR, '-') AS path
      FROM documents),
l AS (SELECT rid, i AS line, string_split(text, chr(10))[i] AS s FROM (SELECT rid, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
n AS (SELECT rid, line, regexp_extract_all(lower(s), '{WORD}') AS terms FROM l WHERE regexp_matches(s, '{CUE}')),
n2 AS (SELECT * FROM n WHERE len(terms) > 0),
tf AS (SELECT rid, line, n, term, count(*) AS tf FROM (SELECT rid, line, len(terms) AS n, unnest(terms) AS term FROM n2) GROUP BY ALL),
total AS (SELECT count(*)::DOUBLE + 1 AS n FROM n2),
df AS (SELECT v.term, (SELECT count(*) FROM tf WHERE tf.term = v.term) AS df FROM (SELECT DISTINCT term FROM tt) v),
idf AS (SELECT term, ln(total.n / (df + 1)) + 1 AS idf FROM df, total),
w AS (SELECT licence, term, tt.tf * idf AS w FROM tt JOIN idf USING (term)),
wn AS (SELECT licence, sqrt(sum(w * w)) AS norm FROM w GROUP BY licence),
v AS (SELECT rid, line, n, term, tf.tf * coalesce(idf, (SELECT ln(n) + 1 FROM total)) AS w FROM tf LEFT JOIN idf USING (term)),
vn AS (SELECT rid, line, n, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL),
sc AS (SELECT vn.rid, vn.line, vn.n, w.licence, round(sum(v.w * w.w / wn.norm) / any_value(vn.norm), 6) AS score
       FROM v JOIN w USING (term) JOIN wn USING (licence) JOIN vn ON vn.rid = v.rid AND vn.line = v.line GROUP BY vn.rid, vn.line, vn.n, w.licence),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, line, licence) AS k FROM sc WHERE score >= {LEAST}) WHERE k = 1),
f AS (SELECT d.doc_id, d.path, regexp_replace(d.path, '/?[^/]*$', '') AS dir, best.licence, best.score,
             coalesce(best.n >= {FILE_SHARE} * len(list_filter(string_split_regex(d.text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), false) AS is_licence_file
      FROM d LEFT JOIN best USING (rid)),
own AS (SELECT dir AS above, arg_min(licence, path) AS given FROM f WHERE is_licence_file GROUP BY dir),
near AS (SELECT DISTINCT ON (x.dir) x.dir, above, given FROM (SELECT DISTINCT dir FROM f) x JOIN own ON x.dir = above OR starts_with(x.dir, above || '/') OR above = ''
         ORDER BY x.dir, length(above) DESC)
SELECT doc_id, path, licence, score, is_licence_file, coalesce(licence, given) AS effective, CASE WHEN licence IS NULL THEN above END AS inherited_from
FROM f LEFT JOIN near USING (dir)
"""


SQL = _sql()
