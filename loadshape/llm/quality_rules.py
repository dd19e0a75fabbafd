"""Quality rules as a ledger of failure bits (built-in functions only).

``ledger`` measures each text once and evaluates every rule once: measurements
and one failure bit per rule are stored in the row. A policy is a version name
and a bit mask; applying it, or asking what would change without one of its
rules, only reads the bits.

Defined cases: a null or empty text has no words, so it fails ``few_words``;
null ids and repeated rows are rows like any other; an empty table gives an
empty ledger; columns besides id and text are not read. Two windows of five
words count as equal when their 64-bit hashes are equal (within one text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT, two_columns

WINDOW_WORDS = 5
SYMBOLS = "[#*$%&|<>]"

# rule name -> (bit, condition of failure over the measurements); new rules
# take the next bit, old bits never change their meaning
RULES = {
    "few_words": (0, "n_words < 10"),
    "repeated_windows": (1, "100 * n_repeat_words > 20 * n_words"),
    "symbols": (2, "4 * n_symbols > n_words AND n_words >= 10"),
    "duplicate_lines": (3, "100 * n_dup_lines > 30 * n_lines AND n_lines >= 4"),
    "word_length": (4, "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    "shouting": (5, "2 * n_upper > word_chars AND n_words >= 10"),
}
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base-1": BASE,
    "strict-1": tuple(RULES),
}


def mask(rules) -> int:
    return sum(1 << RULES[r][0] for r in rules)


def _count(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and the measurements of its text."""
    w = WINDOW_WORDS
    d = two_columns(df, id_col, text_col)
    d = d.select(
        "doc_id",
        F.filter(F.split("text", WORD_SPLIT), lambda x: x != "").alias("_words"),
        (F.char_length("text") - _count(F.col("text"), WORD_SPLIT)).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        _count(F.col("text"), "[A-Z]").cast("long").alias("n_upper"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("_lines"))
    d = d.select(
        "*", F.size("_words").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_lines")).cast("long").alias("_kinds"),
        F.when(F.size("_words") > w, F.transform(
            F.sequence(F.lit(1), F.size("_words") - (w - 1)),
            lambda i: F.xxhash64(F.slice("_words", i, w)))).alias("_hashes")).drop("_words", "_lines")
    # most texts repeat no window: a sort of plain longs finds that out
    d = d.select("*", F.sort_array("_hashes").alias("_sorted"))
    d = d.withColumn("_repeats", F.exists(
        F.transform("_sorted", lambda x, k: (k > 0) & (x == F.get(F.col("_sorted"), k - 1))), lambda x: x)).drop("_sorted")
    d = d.withColumn("_by_hash", F.when(F.col("_repeats"), F.sort_array(
        F.transform("_hashes", lambda x, k: F.struct(x.alias("h"), k.alias("at")))))).drop("_hashes")
    h = lambda k: F.get(F.col("_by_hash"), k)["h"]
    same = lambda x, k: F.coalesce((k > 0) & (h(k - 1) == x["h"]), F.lit(False)) | F.coalesce(h(k + 1) == x["h"], F.lit(False))
    d = d.withColumn("_at", F.sort_array(F.transform(F.filter("_by_hash", same), lambda x: x["at"]))).drop("_by_hash")
    # words in the union of the repeated windows
    step = F.transform("_at", lambda p, k: F.least(F.lit(w), F.coalesce(F.get(F.col("_at"), k + 1) - p, F.lit(w))))
    covered = F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_lines",
                    (F.col("n_lines") - F.col("_kinds")).alias("n_dup_lines"),
                    covered.cast("long").alias("n_repeat_words"))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements plus ``failed``: the failure bits of all rules."""
    bits = F.lit(0).cast("long")
    for bit, condition in RULES.values():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measure(df, id_col, text_col).withColumn("failed", bits)


def verdict(policy: str) -> Column:
    """Whether a ledger row passes the named policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """One row per rule of the policy: documents that fail it, documents that
    fail nothing else (kept if the rule went), and the bits failed together
    with it by at least one document."""
    m = mask(POLICIES[policy])
    failed = F.col("failed").bitwiseAND(F.lit(m))
    sums = []
    for name in POLICIES[policy]:
        one = 1 << RULES[name][0]
        hit = F.col("failed").bitwiseAND(F.lit(one)) != 0
        sums.append(F.struct(F.lit(name).alias("rule"), F.count_if(hit).alias("n_failed"),
                             F.count_if(failed == one).alias("n_only_this"),
                             F.bit_or(F.when(hit, failed)).alias("failed_with")))
    return book.agg(F.array(*sums).alias("r")).select(F.inline("r"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table
    return ledger(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~verdict("base-1")).alias("base_failed"), verdict("strict-1").alias("kept"), "failed", "n_lines", "n_upper")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM d),
wins AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM m WHERE len(w) > 4),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM wins),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS n FROM
        (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY doc_id),
q AS (SELECT m.doc_id, len(w) AS n_words, length(regexp_replace(t, '[ \t-\r]+', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
        len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM m LEFT JOIN cov ON m.doc_id = cov.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 4 * n_symbols > n_words AND n_words >= 10 THEN 4 ELSE 0 END)
        + (CASE WHEN 100 * n_dup_lines > 30 * n_lines AND n_lines >= 4 THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END)
        + (CASE WHEN 2 * n_upper > word_chars AND n_words >= 10 THEN 32 ELSE 0 END) AS failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed, n_lines, n_upper FROM b
"""
