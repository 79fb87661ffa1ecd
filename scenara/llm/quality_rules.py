"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document. The ledger keeps the measurements
and one failure bit for each rule. Policies are versioned sets of rules, applied
later as a mask over the bits, and what each rule costs (ablation) is read from
the bits alone, without the texts.

Only Spark expressions are used: no Python runs on the executors, and nothing
is shuffled, as every measure is taken within the row.

Defined results: a missing text is the empty text, which has no words and so
fails ``few_words``. Words are runs free of space, tab, ``\\n``, ``\\v``, ``\\f``
and ``\\r``. Rows that repeat are judged one by one. Columns of the input
beyond those read stay untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenara.llm.common import packed, unpacked

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` maps the struct of measurements to a boolean."""

    name: str
    bit: int
    fails: Callable[[Column], Column]


RULES = (
    Rule("few_words", 0, lambda m: m["n_words"] < 50),
    Rule("repeated_windows", 1, lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", 2, lambda m: 100 * m["n_symbols"] > 5 * m["word_chars"]),
    Rule("repeated_lines", 3, lambda m: 100 * m["n_dup_lines"] > 40 * m["n_lines"]),
    Rule("long_words", 4, lambda m: m["word_chars"] > 40 * m["n_words"]),
)


@dataclass(frozen=True)
class Policy:
    """A version of the rules that decide."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
CORPUS = Policy("corpus", 2, ("few_words", "repeated_windows", "symbols", "repeated_lines", "long_words"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words covered by windows of three that the text holds at least twice.

    Windows carry their place as a last part, so that sorting the strings puts
    equal windows side by side; no word holds a blank.
    """

    def window(i: Column) -> Column:
        parts = [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2), i.cast("string")]
        return F.concat_ws(" ", *parts)

    def places(found: Column) -> Column:
        def compare(keys: Column) -> Column:
            def place(item: Column, j: Column) -> Column:
                key = F.get(keys, j)
                twin = (key == F.get(keys, j - 1)) | (key == F.get(keys, j + 1))
                return F.when(twin, F.substring_index(item, " ", -1).cast("int"))

            return F.array_compact(F.transform(found, place))

        return let(F.transform(found, lambda x: F.substring_index(x, " ", 3)), compare)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), x + 3) - x))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)
    counted = let(F.sort_array(windows), lambda s: let(F.sort_array(places(s)), covered))
    return F.when(F.size(words) >= 4, counted).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """Struct of the measurements of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, "[ \\t-\\r]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    by_word = let(words, lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeat")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return let(
        F.struct(by_word.alias("w"), by_line.alias("l"), text.alias("t")),
        lambda p: F.struct(
            p["w"]["n"].cast("long").alias("n_words"),
            F.length(F.translate(p["t"], SPACE, "")).cast("long").alias("word_chars"),
            (F.length(p["t"]) - F.length(F.translate(p["t"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
            p["l"]["n"].cast("long").alias("n_lines"),
            p["l"]["dup"].cast("long").alias("n_dup_lines"),
            p["w"]["repeat"].cast("long").alias("n_repeat_words"),
        ),
    )


def failure_bits(measured: Column) -> Column:
    """One bit for each rule that fails."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits + F.when(rule.fails(measured), F.lit(1 << rule.bit)).otherwise(F.lit(0))
    return bits


def with_ledger(docs: DataFrame, column: str = "_ledger") -> DataFrame:
    """``docs`` with one struct column: ``measures`` and ``failed`` bits."""
    entry = let(measures(F.col("text")), lambda m: F.struct(m.alias("measures"), failure_bits(m).alias("failed")))
    return docs.withColumn(column, entry)


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and the failure bits: what is stored once."""
    return with_ledger(docs.select("doc_id", "text")).select("doc_id", "_ledger.measures.*", "_ledger.failed")


def passes(failed: Column, policy: Policy) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def kept_documents(docs: DataFrame, policy: Policy = CORPUS) -> DataFrame:
    """The documents that a policy keeps, with their own columns only."""
    judged = with_ledger(packed(docs, text=F.col("text")), "ledger")
    return unpacked(judged.where(passes(F.col("ledger.failed"), policy)), docs)


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and
    that would be kept without it.

    Bits are first counted by value, at most 2 ** rules rows.
    """
    mask = F.lit(policy.mask).cast("long")
    by_bits = entries.groupBy(F.col("failed").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in policy.rules])
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return (
        by_bits.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy("r.rule")
        .agg(
            count(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("failing"),
            count(F.col("bits") == F.col("r.bit")).alias("failing_alone"),
            count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("kept_without"),
        )
    )
