"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule; a versioned policy is a mask over those bits, so
changing a policy or asking what a rule contributes never reads a text again.

Only DataFrame functions.  One pass over the documents, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchwise.llm.common import WORD, own_columns, quoted, text_of

# The symbols counted by ``n_symbols``, the window length of
# repeated words, and the thresholds of the two base rules.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Scripts that do not put spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"

#: Rules in the order of their bits; each is a condition on the measurements
#: under which a document fails.  A new rule goes to the end.
RULES: dict[str, str] = {
    "too_few_words": f"n_words < {MIN_WORDS}",
    "repeated_words": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "mostly_symbols": "2 * n_symbols > word_chars",
    "mostly_repeated_lines": "10 * n_dup_lines > 8 * n_lines",
    "no_word_shorter_than_100": "n_words > 0 AND word_chars > 100 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "3 * n_dup_lines > n_lines",
    "word_length": "n_words > 0 AND 2 * n_unspaced <= word_chars AND (word_chars < 3 * n_words OR word_chars > 10 * n_words)",
}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_words"),
    "v1": tuple(RULES)[:5],
    # The thresholds of MassiveText (Gopher): symbols against words 0.1,
    # repeated lines 30% (here a third: one line of three is no junk), mean
    # word 3 to 10 characters.
    "v2": tuple(RULES),
}

#: ``n_unspaced`` is measured besides these, for the word length rule.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def rule_bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def policy_mask(policy: str) -> int:
    return sum(rule_bit(r) for r in POLICIES[policy])


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``doc`` (a struct of the columns ``keep`` of ``docs``, so that
    none can clash with a measurement), the measurements of ``MEASURES`` and
    ``n_unspaced``.

    - words: maximal runs of characters other than space and U+0009 to U+000D;
    - ``n_dup_lines``: lines with a word that equal an earlier line;
    - ``n_repeat_words``: words inside a window of five words found twice or
      more in the text, the first occurrence included;
    - ``n_unspaced``: characters of scripts without spaces between words.

    A null text counts as empty and measures 0 everywhere.
    """
    one = docs.select(F.struct(*quoted(keep)).alias("doc"), text_of().alias("t"))
    one = one.select("doc", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
                     F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("l"))
    one = one.select(
        "doc",
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.size("w").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size("l").cast("bigint").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.octet_length("t") > F.char_length("t"), F.regexp_count("t", F.lit(UNSPACED))).otherwise(F.lit(0))
        .cast("bigint").alias("n_unspaced"),
    )
    # A window's hash covers its five word hashes.
    windows = F.when(
        F.size("h") >= WINDOW,
        F.transform(F.slice("h", 1, F.size("h") - (WINDOW - 1)),
                    lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    one = one.withColumn("g", windows)
    # Only texts that repeat a window need its places: sorted by hash, equal
    # hashes are neighbours.
    by_hash = F.when(
        F.size(F.array_distinct("g")) < F.size("g"),
        F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    one = one.withColumn("s", by_hash)
    places = F.sort_array(F.transform(
        F.filter("s", lambda x, i: (x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"])),
        lambda x: x["i"]))
    one = one.withColumn("p", places)
    # Neighbouring windows overlap: each adds the words up to the next window.
    repeated = F.aggregate(
        F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"), lambda a, x: a + x)
    one = one.withColumn("n_repeat_words", repeated)
    return one.select("doc", *MEASURES, "n_unspaced")


def fail_bits() -> Column:
    """Bit k is set if rule k of ``RULES`` fails."""
    return sum((F.when(F.expr(cond), F.lit(rule_bit(r))).otherwise(F.lit(0)) for r, cond in RULES.items()),
               F.lit(0)).cast("bigint")


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document, repeated rows too: its columns except the text,
    the measurements and ``fail_bits``.  An own column of the documents that
    is named like one of these gives way to it."""
    own = [c for c in docs.columns if c not in (*MEASURES, "fail_bits", "text")]
    rows = measure(docs, own)
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in own], *MEASURES, fail_bits().alias("fail_bits"))


def passes(policy: str, bits: Column | str = "fail_bits") -> Column:
    """Whether no rule of the policy failed."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policy_mask(policy))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy does, from the ledger alone: documents it
    fails, documents only it fails (kept again without it), and documents kept
    without it.  The ledger is first reduced to one row per bit pattern."""
    mask = policy_mask(policy)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(rule_bit(r)).cast("bigint").alias("bit"))
                      for r in POLICIES[policy]])
    each = patterns.select("bits", "n", F.explode(rules).alias("r"))
    n_if = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit")).agg(
        n_if(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        n_if(F.col("bits") == F.col("r.bit")).alias("n_only_this"),
        n_if(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents that pass the policy, with all their columns.

    The filter names a row number, which keeps it above the measurements: a
    filter on the bits alone would be pushed below them, with each repeated in it.
    """
    rows = measure(docs, docs.columns).select("doc", fail_bits().alias("fail_bits"), F.monotonically_increasing_id().alias("row"))
    return own_columns(rows.where(passes(policy) & (F.col("row") >= 0)), docs.columns)
