"""Quality rules as a bitmask ledger.

``ledger`` measures each document once and stores the measurements beside one bit per failed
rule. A policy is a versioned mask over those bits, so a verdict or an ablation is integer
arithmetic on the ledger and never reads a text again.

Everything is a DataFrame expression over single rows: no shuffle, no Python.

Defined cases: a null text counts as empty (no words, so ``few_words`` fails); a null
``doc_id`` is carried through; repeated rows are judged one by one; an empty table gives an
empty ledger; other input columns are not carried, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import once, whole_row

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Bits of a word's position below the bits of its window's hash; longer texts are sorted by words.
PLACE = 27

#: Bit of each rule. The order is part of stored ledgers: append, never renumber.
RULES = (
    "few_words",
    "repeated_words",
    "word_length",
    "symbols",
    "duplicate_lines",
    "capitals",
)
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": RULES,
}


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the measurements, each an exact count over the whole text.

    A three-word window is one long: the high bits of its hash over its position. Sorted, equal
    windows are neighbours; where neighbours of one hash differ in words, or positions don't fit,
    the windows are sorted by their words instead. One expression binds the words and the sorted
    windows in turn, so none of them is copied into a row.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    place = lambda i: f"cast(x.s[{i}] & {(1 << PLACE) - 1}L AS int)"
    same = " AND ".join(f"x.w[{place('i')} + {j}] = x.w[{place('i - 1')} + {j}]" for j in range(3))
    windows = f"sort_array(transform(sequence(0, size(x.w) - 3), i -> shiftleft(xxhash64(x.w[i], x.w[i + 1], x.w[i + 2]), {PLACE}) | i))"
    near = f"filter(sequence(1, size(x.s) - 1), i -> shiftright(x.s[i], {PLACE}) = shiftright(x.s[i - 1], {PLACE}))"
    by_hash = f"transform(x.near, i -> array({place('i - 1')}, {place('i')}))"
    by_words = (
        "flatten(transform(array(sort_array(transform(sequence(0, size(x.w) - 3), i -> struct(concat_ws(' ', x.w[i], x.w[i + 1], x.w[i + 2]) AS g, i AS p)))),"
        " g -> transform(filter(sequence(1, size(g) - 1), i -> g[i].g = g[i - 1].g), i -> array(g[i - 1].p, g[i].p))))"
    )
    starts = (
        f"CASE WHEN size(x.w) < 4 OR size(x.near) = 0 THEN cast(array() AS array<int>)"
        f" ELSE sort_array(array_distinct(flatten(CASE WHEN x.s IS NULL OR exists(x.near, i -> NOT ({same})) THEN {by_words} ELSE {by_hash} END))) END"
    )
    # Three words from each repeated window on, less what the next one covers.
    covered = "CASE WHEN size(x.starts) = 0 THEN 0 ELSE aggregate(sequence(0, size(x.starts) - 1), 3, (a, i) -> a + CASE WHEN i > 0 THEN least(3, x.starts[i] - x.starts[i - 1]) ELSE 0 END) END"
    steps = [
        f"filter(split(t, r'{SPACES}'), w -> w <> '') AS w",
        f"x.w AS w, CASE WHEN size(x.w) BETWEEN 4 AND {1 << PLACE} THEN {windows} END AS s",
        f"x.w AS w, x.s AS s, CASE WHEN x.s IS NOT NULL THEN {near} END AS near",
        f"x.w AS w, {starts} AS starts",
        f"cast(size(x.w) AS bigint) AS n_words, coalesce(aggregate(x.w, 0L, (a, w) -> a + length(w)), 0L) AS word_chars, cast({covered} AS bigint) AS n_repeat_words",
    ]
    words = f"array(struct({steps[0]}))"
    for step in steps[1:]:
        words = f"transform({words}, x -> struct({step}))"
    lines = "transform(array(filter(split(t, '\\n'), y -> y RLIKE r'[^\\x20\\x09-\\x0D]')), y -> struct(cast(size(y) AS bigint) AS n_lines, cast(size(y) - size(array_distinct(y)) AS bigint) AS n_dup_lines))[0]"
    d = once(
        d,
        "doc_id",
        m=F.expr(f"{words}[0]"),
        n_symbols=(F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long"),
        n_upper=F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long"),
        y=F.expr(lines),
    )
    return d.select("doc_id", "m.n_words", "m.word_chars", "n_symbols", "n_upper", "y.n_lines", "y.n_dup_lines", "m.n_repeat_words")


def _fails() -> dict[str, Column]:
    n, c = F.col("n_words"), F.col
    return {
        "few_words": n < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * n,
        # Mean length of a word under 2 or over 20 characters.
        "word_length": (c("word_chars") < 2 * n) | (c("word_chars") > 20 * n),
        # More than one marking symbol for every five words.
        "symbols": 5 * c("n_symbols") > n,
        # More than half of the lines repeat an earlier one.
        "duplicate_lines": 2 * c("n_dup_lines") > c("n_lines"),
        "capitals": 10 * c("n_upper") > 5 * c("word_chars"),
    }


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` (one bit per failed rule), one row per document."""
    m, fails = measure(docs, doc_id, text), _fails()
    bits = F.lit(0)
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(fails[rule], F.lit(BIT[rule])).otherwise(F.lit(0)))
    return m.withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, policy: str) -> DataFrame:
    """Adds ``kept``: no failed rule of the policy."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(led: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents it fails, fails alone, and kept without it.

    One aggregation over the integer column; a global aggregate combines map-side.
    """
    full, b = mask(policy), F.col("fail_bits")
    one = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    rows = F.array(
        *[
            F.struct(
                F.lit(policy).alias("policy"),
                F.lit(r).alias("rule"),
                one(b.bitwiseAND(F.lit(BIT[r])) != 0).alias("n_failed"),
                one(b.bitwiseAND(F.lit(full)) == BIT[r]).alias("n_failed_alone"),
                one(b.bitwiseAND(F.lit(full & ~BIT[r])) == 0).alias("n_kept_without"),
            )
            for r in POLICIES[policy]
        ]
    )
    return led.agg(rows.alias("r")).select(F.inline("r"))


def keep(docs: DataFrame, policy: str = "web-1") -> DataFrame:
    """The documents a policy keeps, with their own columns; for use as a pipeline stage."""
    row = docs.select(whole_row(docs).alias("row"))
    # The ledger's doc_id carries the whole row, so no join brings the columns back.
    led = ledger(row.select("row", F.col("row.text").alias("text")), doc_id="row")
    return apply_policy(led, policy).filter("kept").select("doc_id.*")


def query(docs: DataFrame, policy: str = "web-1") -> DataFrame:
    led = apply_policy(ledger(docs), policy)
    return led.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(mask("base-1"))) != 0).alias("base_failed"),
        "kept",
        "fail_bits",
    )


SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         len(regexp_extract_all(t, '\p{Lu}'))::BIGINT AS n_upper,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)),
b AS (
  SELECT doc_id, n_words, word_chars, n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words,
         (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
          + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
          + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 4 ELSE 0 END
          + CASE WHEN 5 * n_symbols > n_words THEN 8 ELSE 0 END
          + CASE WHEN 2 * (len(lines) - len(list_distinct(lines))) > len(lines) THEN 16 ELSE 0 END
          + CASE WHEN 10 * n_upper > 5 * word_chars THEN 32 ELSE 0 END)::INTEGER AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       fail_bits = 0 AS kept, fail_bits
FROM b
"""
