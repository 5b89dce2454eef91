"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Each rule is evaluated once per document.  The ledger keeps the measurements and one bit per
failed rule; policies are masks over those bits, so a new policy or an ablation never reads a
text again.  A document is handled within its row: no shuffle, whatever the group sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

#: Symbols that markup, tables and scraps leave behind.
SYMBOLS = "#*$%&|<>"
#: Words in a window of the repetition rule.
WINDOW = 5

#: Rule name -> whether a document with these measurements fails it; bit k is the k-th rule.
RULES = {
    "few_words": lambda m: m["n_words"] < 10,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > 3 * m["n_words"],
    "duplicate_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"]),
    "stutter": lambda m: 100 * m["n_stutter"] > 30 * m["n_words"],
    "shouting": lambda m: 2 * m["n_upper"] > m["word_chars"],
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: Policy version -> the rules that reject.
POLICIES = {"base": BASE, "v1": sum(BIT.values())}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter", "n_upper")


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of ``WINDOW`` words that occur twice or more, in n log n.

    Windows are compared by a 64-bit hash of their words' hashes: within one document of a
    million words two different windows collide with a chance of about 3e-8.
    """

    def covered(windows: Column) -> Column:
        def from_sorted(order: Column) -> Column:
            def same(s: Column, i: Column, step: int) -> Column:
                at = i + F.lit(step)
                return F.coalesce(F.when(at >= 0, F.get(order, at))["h"] == s["h"], F.lit(False))

            twice = F.filter(order, lambda s, i: same(s, i, -1) | same(s, i, 1))
            starts = F.sort_array(F.transform(twice, lambda s: s["i"]))
            # least() skips the null after the last start
            reach = let(starts, lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.get(p, i + F.lit(1)) - x)))
            return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), from_sorted)
        )

    def hashed(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return let(F.transform(at, lambda i: F.xxhash64(*(F.get(h, i + F.lit(k)) for k in range(WINDOW)))), covered)

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), hashed))


def _measures(text: Column) -> Column:
    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
        stutter = F.filter(words, lambda w, i: F.coalesce(F.when(i > 0, F.get(words, i - F.lit(1))) == w, F.lit(False)))
        return let(
            lines,
            lambda kept: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
                F.size(kept).cast("long").alias("n_lines"),
                (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"),
                _repeat_words(words).cast("long").alias("n_repeat_words"),
                F.size(stutter).cast("long").alias("n_stutter"),
                F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)


def rule_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a struct ``ledger`` of the measurements and ``fail_bits``.

    A null text counts as empty: no words, so it fails ``few_words``.  Repeated rows are judged
    alike, other columns stay as they are (a column ``ledger`` is replaced), and an empty table gives
    an empty table.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    measured = let(whole, _measures)
    bits = lambda m: sum((F.when(fails(m), F.lit(BIT[name])).otherwise(F.lit(0)) for name, fails in RULES.items()), F.lit(0))
    return docs.withColumn("ledger", let(measured, lambda m: F.struct(*(m[x].alias(x) for x in MEASURES), bits(m).alias("fail_bits"))))


def passes(fail_bits: Column, policy: str = "v1") -> Column:
    """Whether a ledger entry passes a policy."""
    return fail_bits.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: rows that fail it, that only it rejects, and rows kept without it.

    Rows are first counted by ``fail_bits`` on the map side, so at most ``2 ** len(RULES)`` counts
    are shuffled.
    """
    mask = POLICIES[policy]
    counts = ledger.groupBy(F.col("ledger.fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in BIT.items() if bit & mask)))
    each = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    without = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(without == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
