"""Rule bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one bit for each failed rule; policies are named, versioned sets of rules that are
applied to the stored bits, and ablations are counted from an aggregate of the
bits alone, without reading a text again.

All of it is row-local native expressions: no shuffle of texts, no Python. Each
array belongs to one text, so a task holds what one document needs.

Cases: a null text has no words, no lines and no symbols and fails ``few_words``;
a null identifier stays null; repeated rows each give a row; an empty table gives
an empty ledger. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wakeline.llm.common import id_text

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"

# Name, condition of failure over the measurements. The place in the list is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repetition", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("capitals", "2 * n_capitals > word_chars"),
)
BITS = {name: 1 << at for at, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A versioned set of rules; a document stays if it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[rule] for rule in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repetition"))
FULL = Policy("full", 1, tuple(BITS))


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules compare."""
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    rows = id_text(docs).select(
        "doc_id",
        F.expr(r"array_remove(split(text, '[\\x20\\x09-\\x0D]+'), '')").alias("words"),
        F.expr(r"filter(split(text, '\n'), x -> rlike(x, '[^\\x20\\x09-\\x0D]'))").alias("lines"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"), without(CAPITALS).alias("n_capitals"),
    )
    # The hash leads, so that sorting seldom compares words; the words keep it exact.
    rows = rows.withColumn("grams", F.expr(
        "sort_array(transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) ->"
        " struct(xxhash64(w, words[i + 1], words[i + 2]) as h, w as a, words[i + 1] as b, words[i + 2] as c, i as at)))"
    ))
    same = "(x.h = {0}.h and x.a = {0}.a and x.b = {0}.b and x.c = {0}.c)"
    rows = rows.withColumn("starts", F.expr(
        "sort_array(transform(filter(grams, (x, i) -> (i > 0 and "
        + same.format("grams[i - 1]") + ") or (i + 1 < size(grams) and " + same.format("grams[i + 1]")
        + ")), x -> x.at))"
    ))
    # Windows that start at these places cover 3 words each; overlaps count once.
    covered = F.expr(
        "aggregate(transform(starts, (x, i) -> if(i + 1 < size(starts), least(3, starts[i + 1] - x), 3)),"
        " 0, (total, x) -> total + x)"
    )
    as_long = lambda c, name: c.cast("bigint").alias(name)
    return rows.select(
        "doc_id", as_long(F.size("words"), "n_words"), as_long(F.col("word_chars"), "word_chars"),
        as_long(F.col("n_symbols"), "n_symbols"),
        as_long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        as_long(covered, "n_repeat_words"), as_long(F.size("lines"), "n_lines"),
        as_long(F.col("n_capitals"), "n_capitals"),
    )


def failure_bits() -> Column:
    bit = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)) for name, rule in RULES]
    return reduce(lambda a, b: a.bitwiseOR(b), bit).cast("bigint")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed``, the bits of the rules that a document fails."""
    return measurements(docs).withColumn("failed", failure_bits())


def passes(policy: Policy, failed: Column | str = "failed") -> Column:
    column = F.col(failed) if isinstance(failed, str) else failed
    return column.bitwiseAND(F.lit(policy.mask)) == 0


def apply_policies(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """A verdict column name_vN for each policy, from the stored bits."""
    return rows.select("*", *[passes(p).alias(f"{p.name}_v{p.version}") for p in policies])


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that would stay without it.

    The ledger is first reduced to one count for each set of bits, at most 2^rules rows.
    """
    sets = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).cast("bigint").alias("bit"))
        for name in sorted(set(policy.rules), key=BITS.get)
    ])).alias("r")
    counted = lambda condition, name: F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)
    has, rest = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    return sets.select("bits", "n", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        counted(has, "fail"), counted(has & (rest == 0), "fail_only_this"), counted(rest == 0, "kept_without"),
        counted(F.col("bits") == 0, "kept_with"),
    )


def quality_verdicts(docs: DataFrame, policy: Policy = FULL) -> DataFrame:
    """One row per document: measurements, bits, base_failed and kept."""
    rows = ledger(docs)
    return rows.select(
        "*", (~passes(BASE)).alias("base_failed"), (passes(BASE) & passes(policy)).alias("kept")
    )
