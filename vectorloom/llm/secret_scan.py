"""Secret scans: fixed patterns, and a battery of randomness tests over long tokens.

Patterns give the base spans. Beside them, every run of 20 or more token characters (``=`` only
pads its end, so a name and its value are two tokens; a run that mixes ``+/`` and ``_-`` is taken
apart into its runs without the ones and without the others) has its
encoding inferred (the narrowest alphabet that holds it) and is tested as a sequence of digits
of that alphabet:

* chi-squared of the digit counts against a uniform alphabet,
* the runs test above and below the middle digit,
* the lag-1 serial correlation.

A token whose smallest p-value, corrected for three tests, is under ``REJECT`` isn't random.
For the rest, ``p`` is the chance that structured text of this length and alphabet comes out so
even; chi-squared of such text grows with length, so short tokens can't reach a small ``p``.
Discoveries are controlled per document by the Benjamini-Hochberg rule at ``FDR`` with weights
in proportion to token length. Random spans that overlap a base span are left out.

All of it is DataFrame expressions over single rows: no shuffle and no Python. Documents
without a match, nearly all, stop at one scan per pattern. No step is quadratic: offsets are
running sums in rounds of doubled reach, overlaps are found by binary search, and the tests go
over a token's characters once.

Defined cases: a null text is empty (no spans, digest of the empty string); a null ``doc_id`` is
carried; repeated rows are scanned one by one; offsets are code points over the whole text;
only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import once, whole_row

#: The base patterns, in the order of kinds. Java matches (?i) on ASCII letters only.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: A token with characters of both alphabets is taken apart into the runs of either.
MIXED, PARTS = ("[+/]", "[_-]"), (r"[A-Za-z0-9+/]{20,}={0,2}", r"[A-Za-z0-9_-]{20,}={0,2}")
KINDS = ("assign", "access", "hex", "random")
#: The value of an assignment has this many characters at least.
VALUE = 8

REJECT, FDR = 0.001, 0.01
#: Code points of a block from which ``redact`` cuts.
BLOCK = 4096
#: Alphabets from narrow to wide: pattern, digits in order, and the excess of chi-squared per
#: character that structured text shows over them (alphabet size times its index of coincidence, less 1).
ALPHABETS = (
    ("^[0-9]+$", "0123456789", 0.6),
    ("^[0-9a-f]+$", "0123456789abcdef", 1.0),
    ("^[0-9A-F]+$", "0123456789ABCDEF", 1.0),
    ("^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", 0.7),
    ("^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.7),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    ("^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.2),
    ("^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 3.2),
)

SPAN = "array<struct<s:int,e:int,k:int,m:string>>"


def _q(s: str) -> str:
    """A raw SQL string literal."""
    return "r'" + s.replace("'", "\\x27") + "'"


def _running(x: str, f: str = "v + w") -> str:
    """SQL: the running ``f`` (of v, the value so far, and w, an earlier one) along array ``x``, in rounds of doubled reach."""
    v = f"({f})".replace("w", "z[i - shiftleft(1, k)]")
    return f"aggregate(sequence(0, cast(ceil(log2(size({x}) + 1)) AS int)), {x}, (z, k) -> transform(z, (v, i) -> CASE WHEN i >= shiftleft(1, k) THEN {v} ELSE v END))"


def _find(t: str, pattern: str, kind: int, group: int = 0, least: int = 0) -> str:
    """SQL: spans of the matches in ``t``, leftmost and non-overlapping.

    Splitting at the pattern gives the gaps between matches, so running sums of the lengths of
    gaps and matches are the offsets.
    """
    p = _q(pattern)
    steps = "transform(f.m, (x, i) -> length(f.gaps[i]) + CASE WHEN i > 0 THEN length(f.m[i - 1]) ELSE 0 END)"
    spans = f"transform(h.m, (x, i) -> struct(h.at[i] AS s, h.at[i] + length(x) AS e, {kind} AS k, x AS m))"
    if group:
        spans = f"filter({spans}, (x, i) -> length(h.g[i]) >= {least})"
    found = (
        f"transform(transform(transform(array(struct(split({t}, {p}) AS gaps, regexp_extract_all({t}, {p}, 0) AS m, regexp_extract_all({t}, {p}, {group}) AS g)),"
        f" f -> struct(f.m AS m, f.g AS g, {steps} AS steps)),"
        f" f -> struct(f.m AS m, f.g AS g, {_running('f.steps')} AS at)),"
        f" h -> {spans})[0]"
    )
    return f"CASE WHEN {t} RLIKE {p} THEN {found} ELSE cast(array() AS {SPAN}) END"


def _below(a: str, x: str) -> str:
    """SQL: how many numbers of the sorted array ``a`` are under ``x``, by binary search."""
    return f"aggregate(sequence(30, 0), 0, (z, k) -> CASE WHEN z + shiftleft(1L, k) <= size({a}) AND {a}[z + shiftleft(1, k) - 1] < {x} THEN z + shiftleft(1, k) ELSE z END)"


def _normal_tail(z: str) -> str:
    """SQL: the upper tail of the standard normal, by the logistic-type approximation of Bowling et al. (error under 2e-4)."""
    return f"(1 / (1 + exp(least(700, 0.07056 * power({z}, 3) + 1.5976 * ({z})))))"


def _tests(c: str) -> str:
    """SQL: array column ``c`` of spans to spans with n and both p-values; each step is linear in a token's length."""
    stripped = "regexp_replace(x.m, '=+$', '')"
    digits = "CASE " + " ".join(f"WHEN x.v RLIKE {_q(p)} THEN '{d}'" for p, d, _ in ALPHABETS) + " END"
    excess = "CASE " + " ".join(f"WHEN x.v RLIKE {_q(p)} THEN {e}D" for p, _, e in ALPHABETS) + " END"
    a = f"transform({c}, x -> struct(x.s AS s, x.e AS e, {stripped} AS v))"
    a = f"transform({a}, x -> struct(x.s AS s, x.e AS e, x.v AS v, {digits} AS d, {excess} AS lam))"
    a = f"filter({a}, x -> x.d IS NOT NULL AND length(x.v) >= 20)"
    # Counts per digit by length differences; the lower half of the digits as L, the upper as H.
    a = (
        f"transform({a}, x -> struct(x.s AS s, x.e AS e, x.v AS v, x.d AS d, x.lam AS lam, cast(length(x.v) AS double) AS n, cast(length(x.d) AS double) AS k,"
        " translate(x.v, x.d, concat(repeat('L', length(x.d) div 2), repeat('H', length(x.d) - length(x.d) div 2))) AS half,"
        " transform(split(x.d, ''), y -> cast(length(x.v) - length(replace(x.v, y, '')) AS double)) AS o))"
    )
    a = (
        f"transform({a}, x -> struct(x.s AS s, x.e AS e, x.v AS v, x.d AS d, x.lam AS lam, x.n AS n, x.k AS k, x.o AS o,"
        " aggregate(x.o, 0D, (b, o) -> b + (o - x.n / x.k) * (o - x.n / x.k) / (x.n / x.k)) AS chi,"
        " aggregate(transform(x.o, (o, i) -> o * i), 0D, (b, v) -> b + v) / x.n AS mean,"
        " cast(length(replace(x.half, 'L', '')) AS double) AS hi,"
        " cast(regexp_count(x.half, 'L++|H++') AS double) AS runs))"
    )
    a = (
        f"transform({a}, x -> struct(x.s AS s, x.e AS e, x.lam AS lam, x.n AS n, x.k AS k, x.chi AS chi, x.runs AS runs,"
        " 1 + 2 * x.hi * (x.n - x.hi) / x.n AS runs_mean,"
        " 2 * x.hi * (x.n - x.hi) * (2 * x.hi * (x.n - x.hi) - x.n) / (x.n * x.n * (x.n - 1)) AS runs_var,"
        " aggregate(split(x.v, ''), struct(cast(NULL AS double) AS y, 0D AS cov), (b, c) -> struct(instr(x.d, c) - 1 - x.mean AS y,"
        " b.cov + coalesce(b.y * (instr(x.d, c) - 1 - x.mean), 0D) AS cov), b -> b.cov) AS cov,"
        " aggregate(transform(x.o, (o, i) -> o * (i - x.mean) * (i - x.mean)), 0D, (b, v) -> b + v) AS ss))"
    )
    # Wilson-Hilferty for chi-squared; a token without two halves or any variance can't be random.
    chi_z = "((power(x.chi / (x.k - 1), 1 / 3D) - (1 - 2 / (9 * (x.k - 1)))) / sqrt(2 / (9 * (x.k - 1))))"
    runs_z = "abs((x.runs - x.runs_mean) / sqrt(x.runs_var))"
    corr_z = "abs((x.cov / x.ss + 1 / x.n) * sqrt(x.n))"
    even_z = "((x.k - 1 + x.n * x.lam - x.chi) / sqrt(2 * (x.k - 1) + 4 * x.n * x.lam))"
    return (
        f"transform({a}, x -> struct(x.s AS s, x.e AS e, x.n AS n,"
        f" CASE WHEN x.runs_var > 0 AND x.ss > 0 THEN least(1D, 3 * least({_normal_tail(chi_z)}, 2 * {_normal_tail(runs_z)}, 2 * {_normal_tail(corr_z)})) ELSE 0D END AS p_random,"
        f" {_normal_tail(even_z)} AS p_structured))"
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t (the text, never null), ``base`` and all ``spans``: arrays of (s, k, e), k the place in KINDS, by start and kind."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    base = f"concat({_find('t', ASSIGN, 0, 2, VALUE)}, {_find('t', ACCESS, 1)}, {_find('t', HEX, 2)})"
    d = once(d, "doc_id", "t", base=F.expr(base), tokens=F.expr(_find("t", TOKEN, 3)))
    mixed = f"(x.m RLIKE {_q(MIXED[0])} AND x.m RLIKE {_q(MIXED[1])})"
    parts = f"transform(array_distinct(concat({', '.join(_find('q.m', p, 3) for p in PARTS)})), y -> struct(q.s + y.s AS s, q.s + y.e AS e, y.k AS k, y.m AS m))"
    apart = f"concat(filter(tokens, x -> NOT {mixed}), flatten(transform(filter(tokens, x -> {mixed}), q -> {parts})))"
    d = once(
        d, "doc_id", "t", "base",
        tokens=F.when(F.expr(f"exists(tokens, x -> {mixed})"), F.expr(apart)).otherwise(F.col("tokens")),
        begin=F.expr("sort_array(transform(base, x -> x.s))"), end=F.expr("sort_array(transform(base, x -> x.e))"),
    )
    # Base spans that begin before a token's end, less those that end by its begin, are those that overlap it.
    free = f"filter(tokens, x -> {_below('begin', 'x.e')} = {_below('end', 'x.s + 1')})"
    d = once(d, "doc_id", "t", "base", tokens=F.when(F.size("base") == 0, F.col("tokens")).otherwise(F.expr(free)))
    d = once(d, "doc_id", "t", "base", tested=F.when(F.size("tokens") > 0, F.expr(_tests("tokens"))))
    # Weighted Benjamini-Hochberg within the document: p / weight, sorted, against rank * FDR / m.
    weighted = (
        "array_sort(transform(tested, x -> struct(x.p_structured * total / size(tested) / x.n AS q, x.s AS s, x.e AS e, x.p_random AS p_random)))"
    )
    d = once(d, "doc_id", "t", "base", "tested", total=F.expr("aggregate(tested, 0D, (a, y) -> a + y.n)"))
    d = once(d, "doc_id", "t", "base", w=F.when(F.size("tested") > 0, F.expr(weighted)))
    passed = F.expr(f"coalesce(array_max(filter(sequence(1, size(w)), i -> w[i - 1].q <= i * {FDR} / size(w))), 0)")
    d = once(d, "doc_id", "t", "base", "w", passed=F.when(F.size("w") > 0, passed).otherwise(0))
    more = F.expr(f"CASE WHEN passed > 0 THEN transform(filter(slice(w, 1, passed), x -> x.p_random >= {REJECT}), x -> struct(x.s AS s, 3 AS k, x.e AS e)) ELSE cast(array() AS array<struct<s:int,k:int,e:int>>) END")
    d = once(d, "doc_id", "t", base=F.expr("array_sort(transform(base, x -> struct(x.s AS s, x.k AS k, x.e AS e)))"), more=more)
    return once(d, "doc_id", "t", "base", spans=F.array_sort(F.concat("base", "more")))


def _listed(c: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({c}, x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')")


def query(docs: DataFrame) -> DataFrame:
    n = lambda k: F.expr(f"cast(size(filter(base, x -> x.k = {k})) AS bigint)")
    return scan(docs).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark``; for use as a pipeline stage.

    Overlapping spans are replaced together. ``n_chars`` follows the new text where there is one.
    """
    row = docs.select(whole_row(docs).alias("row"))
    s = scan(row.select("row", F.col("row").getField("text").alias("text")), doc_id="row").withColumnRenamed("doc_id", "row")
    # Text is cut out of blocks of code points, as a substring is found by walking from its string's start.
    ends = _running("transform(spans, x -> x.e)", "greatest(v, w)")
    s = once(s, "row", "t", spans=F.col("spans"), ends=F.when(F.size("spans") > 0, F.expr(ends)), blocks=F.when(F.size("spans") > 0, F.regexp_extract_all("t", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    heads = "filter(sequence(0, size(spans) - 1), i -> i = 0 OR spans[i].s >= ends[i - 1])"
    part = (  # from x.a on, before x.b
        f"array_join(transform(CASE WHEN x.a < x.b THEN sequence(x.a div {BLOCK}, (x.b - 1) div {BLOCK}) ELSE cast(array() AS array<bigint>) END, b ->"
        f" substring(blocks[b], cast(greatest(x.a - b * {BLOCK}, 0L) + 1 AS int), cast(least(x.b - b * {BLOCK}, {BLOCK}L) - greatest(x.a - b * {BLOCK}, 0L) AS int))), '')"
    )
    gaps = f"transform({heads}, i -> struct(CASE WHEN i = 0 THEN 0 ELSE ends[i - 1] END AS a, spans[i].s AS b))"
    tail = "array(struct(ends[size(ends) - 1] AS a, length(t) AS b))"
    cut = F.concat_ws(mark, F.expr(f"transform(concat({gaps}, {tail}), x -> {part})"))
    s = once(s, "row", text=F.when(F.size("spans") > 0, cut).otherwise(F.col("row").getField("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("row").getField("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return s.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
