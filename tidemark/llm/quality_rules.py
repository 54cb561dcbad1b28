"""Rule bitmask ledger: every rule is evaluated once; policies and ablations work on the stored bits.

``ledger`` adds measurements and ``failed``, a long with one bit per failed rule. ``apply_policy`` reads the
bits against a policy's mask, so a new policy version needs no second look at the texts. ``ablations``
aggregates the bits alone: how many documents each rule fails, fails alone, and would give back if dropped.

Null and empty texts have zero measurements and fail ``few_words``. Repeated rows get a ledger row each; null
doc_ids stay null; an empty table gives an empty ledger, and no ablations. Only doc_id and text are read. Words are
compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts")

#: Each rule: the condition under which a document fails. The position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 50 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines",
    "upper_case": "n_letters >= 20 AND 100 * n_upper > 60 * n_letters",
    "shouting": "100 * n_shouts > 50 * n_words",
    "few_letters": "2 * n_letters < word_chars",
}
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return mask(self.rules)


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


POLICIES = {p.version: p for p in (Policy("base", BASE), Policy("strict", tuple(RULES)))}


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def ledger(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """doc_id, the measurements and ``failed``; one pass without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    k = WINDOW_WORDS
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select(
        "doc_id",
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        _without(F.col("text"), SPACES).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{L}+", ""))).cast("long").alias("n_letters"),
        (F.length("text") - _without(F.col("text"), "!")).cast("long").alias("n_shouts"),
    )
    kept = ["doc_id", "word_chars", "n_symbols", "n_upper", "n_letters", "n_shouts"]
    rows = rows.select(
        *kept,
        F.size("words").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    kept += ["n_words", "n_lines", "n_dup_lines"]
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words") - k), lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(k)]))
    rows = rows.select(*kept, F.when(F.col("n_words") >= k, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"))
    # Positions are only looked for where some window repeats.
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*kept, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered).alias("ordered"))
    again = F.transform("ordered", lambda x, j: F.when((x["h"] == F.get("ordered", j - 1)["h"]) | (x["h"] == F.get("ordered", j + 1)["h"]), x["i"]))
    rows = rows.select(*kept, F.sort_array(F.array_compact(again)).alias("starts"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last"))
    covered = F.aggregate("starts", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(k), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    rows = rows.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).withColumn("n_words", F.col("n_words").cast("long"))
    failed = F.lit(0).cast("long")
    for bit, condition in enumerate(rules.values()):
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return rows.select("doc_id", *MEASURES, failed.alias("failed"))


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """Add ``kept``: none of the policy's rules failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: n_failed, n_only (failed no other rule), n_kept and n_kept_without the rule.

    The ledger is first counted by bit pattern, of which there are at most 2 ** len(RULES).
    """
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in policy.rules])
    each = patterns.select("bits", "n", F.inline(rules))
    n = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    bit, bits = F.col("bit"), F.col("bits")
    return each.groupBy("rule").agg(
        n(bits.bitwiseAND(bit) != 0).alias("n_failed"), n(bits == bit).alias("n_only"), n(bits == 0).alias("n_kept"),
        n(bits.bitwiseAND(F.lit(-1).cast("long").bitwiseXOR(bit)) == 0).alias("n_kept_without"),
    )
