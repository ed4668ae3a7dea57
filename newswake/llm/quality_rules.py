"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. The ledger stores the measurements and one bit per failed
rule; policies are named masks over these bits, so a changed policy reads the ledger and not the
texts. What each rule of a policy does alone (ablation) is computed from counts per bit pattern:
there are at most two to the number of rules patterns, whatever the number of documents.

All of it is column expressions. A text is split once; the windows of eight words are hashed to 64
bits in place, and only texts in which a hash repeats sort them to find the words covered. Nothing
is exploded, so nothing is shuffled, and a long text costs n log n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from newswake.llm.tables import SPACE_RUN, SPACES, let, rows, text_of, unpacked

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_upper", "n_letters", "n_marks", "n_stutters"]

#: Rule name and the condition under which a text fails it. The bit of a rule is its place here,
#: so rules are only ever added at the end.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 25 * n_words",
    "upper_case": "100 * n_upper > 50 * n_letters and n_letters >= 50",
    "repeated_lines": "n_lines >= 5 and 100 * n_dup_lines > 40 * n_lines",
    "word_length": "word_chars > 25 * n_words or word_chars < 2 * n_words",
    "exclamations": "100 * n_marks > 40 * n_words",
    "stutter": "100 * n_stutters > 30 * n_words",
}
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version of the rules in force: a text that fails one of them is rejected."""
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = {
    "base": Policy("base", BASE),
    "v1": Policy("v1", (*BASE, "symbols", "upper_case", "repeated_lines", "word_length",
                        "exclamations", "stutter")),
}
CURRENT = "v1"


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of eight that occur twice or more in the text."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
                          lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(hashes: Column) -> Column:
        at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(at, lambda s: F.filter(s, lambda x, i: (
            (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda x, i: F.least(
                F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    none = F.lit(0).cast("long")
    return F.when(F.size(words) <= WINDOW, none).otherwise(let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))))


def measures(text: Column) -> Column:
    words = F.filter(F.split(text, SPACE_RUN), lambda w: w != "")
    bare = F.length(F.regexp_replace(text, SPACE_RUN, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    of_words = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat"),
        F.size(F.filter(w, lambda x, i: F.get(w, i - 1) == x)).cast("long").alias("stutter")))
    return let(F.struct(of_words.alias("w"), of_lines.alias("l")), lambda m: F.struct(
        m["w"]["n"].alias("n_words"), bare.cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        m["l"]["dup"].alias("n_dup_lines"), m["w"]["repeat"].alias("n_repeat_words"),
        m["l"]["n"].alias("n_lines"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_marks"),
        m["w"]["stutter"].alias("n_stutters")))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with its measurements and `rule_bits`, bit i set if rule i fails.

    A null text has no words and is measured as an empty one. Lines are split at \\n and count if
    they have a word. An empty table gives an empty ledger. Given columns named as the results are
    replaced by them.
    """
    measured = rows(docs, m=measures(text_of(text))).select("row", "m.*")
    bits = F.lit(0).cast("long")
    for i, failed in enumerate(RULES.values()):
        bits = bits + F.when(F.expr(failed), F.lit(1 << i)).otherwise(0)
    return unpacked(measured.withColumn("rule_bits", bits.cast("long")), [*MEASURES, "rule_bits"])


def verdicts(ledger_rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with base_failed, and kept under a policy."""
    failed = lambda p: F.col("rule_bits").bitwiseAND(F.lit(p.mask)) != 0
    return ledger_rows.withColumns({"base_failed": failed(POLICIES["base"]),
                                    "kept": ~failed(POLICIES["base"]) & ~failed(POLICIES[version])})


def ablations(ledger_rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: texts that fail it, texts that it alone rejects, and the number that
    the policy would keep without it. One row a rule, from counts per bit pattern."""
    policy = POLICIES[version]
    bits = F.col("rule_bits").bitwiseAND(F.lit(policy.mask))
    patterns = ledger_rows.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"),
                                        F.lit(1 << list(RULES).index(r)).cast("long").alias("bit"))
                               for r in policy.rules]))
    each = patterns.select("bits", "n", rule.alias("r")).select("bits", "n", "r.rule", "r.bit")
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    b, one = F.col("bits"), F.col("bit")
    return each.groupBy("rule").agg(
        count(b.bitwiseAND(one) != 0).alias("failed"), count(b == one).alias("only_this"),
        count(b.bitwiseAND(F.bitwise_not(one)) == 0).alias("kept_without"))


def accepted(docs: DataFrame, text: str = "text", version: str = CURRENT) -> DataFrame:
    """The rows a policy keeps, with their own columns."""
    judged = verdicts(ledger(rows(docs, text=F.col(text))), version)
    return judged.filter("kept").select("row.*")
