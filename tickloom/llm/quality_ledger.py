"""Quality rules as a bitmask ledger, in SQL functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule, so that a policy
(a named set of rules) is a mask applied later, and ablations are bitwise aggregation over the ledger without the texts.

Defined cases: a null text has no words and counts as empty; documents are rows, so repeated rows and repeated ids give one
ledger row each; a null id is kept as null; an empty table gives an empty ledger; other columns pass through unless asked
to be dropped, and a column that has the name of a measurement is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import SPACE

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Rule name and the condition on the measurements under which a document fails it, in whole numbers. The order fixes the bits.
RULES: list[tuple[str, Callable[[Column], Column]]] = [
    ("too_few_words", lambda m: m["n_words"] < 10),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ("symbols_per_word", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    ("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    ("short_words", lambda m: 10 * m["word_chars"] < 25 * m["n_words"]),
    ("long_words", lambda m: m["word_chars"] > 15 * m["n_words"]),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Policies by version. A verdict is (failed & mask) = 0, so a new version needs no new pass over the texts.
POLICIES: dict[str, list[str]] = {
    "base": ["too_few_words", "repeated_windows"],
    "v1": ["too_few_words", "repeated_windows", "symbols_per_word"],
    "v2": [name for name, _ in RULES],
}


def policy_mask(version: str) -> int:
    return sum(BIT[name] for name in POLICIES[version])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once. Kept inside one expression, so that a filter on the outcome, which Spark moves
    below projections, doesn't unfold the steps again for each mention."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more in the array.

    Windows are compared by a 64-bit hash within one text. Only texts in which some window repeats are sorted."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.when(F.size(words) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])))

    def twice(s: Column) -> Column:
        return F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(WINDOW), i - a["last"])).alias("total")), lambda a: a["total"])

    def of(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = _let(ordered, lambda s: covered(F.sort_array(F.transform(twice(s), lambda x: x["i"]))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), found)

    return F.coalesce(_let(hashes, of), F.lit(0).cast("long"))


def measured(text: Column) -> Column:
    """A struct of MEASURES and `failed`, the bits of the rules that the text fails."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column, rows: Column) -> list[Column]:
        return [F.size(w), F.char_length(F.array_join(w, "")), F.regexp_count(text, F.lit(SYMBOLS)), F.size(rows) - F.size(F.array_distinct(rows)), repeated_words(w), F.size(rows)]

    def named(w: Column, rows: Column) -> Column:
        return F.struct(*[c.cast("long").alias(name) for name, c in zip(MEASURES, of(w, rows))])

    numbers = _let(F.struct(F.array_remove(F.split(text, SPACE), "").alias("w"), lines.alias("rows")), lambda x: named(x["w"], x["rows"]))
    return _let(numbers, lambda m: F.struct(*[m[name].alias(name) for name in MEASURES],
                                            sum((F.when(rule(m), F.lit(BIT[name])).otherwise(0) for name, rule in RULES), F.lit(0)).cast("int").alias("failed")))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and `failed`, the bits of the rules that the document fails."""
    added = [*MEASURES, "failed"]
    kept = [c for c in docs.columns if c.lower() not in added or c == text]
    entries = docs.select(*kept, measured(F.coalesce(F.col(text), F.lit(""))).alias("_entry"))
    return entries.select(*kept, *[F.col("_entry")[c].alias(c) for c in added])


def apply_policy(entries: DataFrame, version: str, verdict: str = "kept") -> DataFrame:
    """Adds the verdict of one policy to a ledger."""
    return entries.withColumn(verdict, F.col("failed").bitwiseAND(policy_mask(version)) == 0)


def ablations(entries: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents failing it, documents that only it removes, and those kept without it.

    The ledger is first summed by its bits (at most 2^rules rows), whatever the number of documents."""
    mask = policy_mask(version)
    sums = entries.groupBy(F.col("failed").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).alias("bit")) for n in POLICIES[version]]))
    each = sums.select("bits", "docs", "words", rules.alias("r")).select("bits", "docs", "words", "r.rule", "r.bit")
    fails, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0

    def of(condition: Column, what: str) -> Column:
        return F.sum(F.when(condition, F.col(what)).otherwise(0)).cast("long")

    return each.groupBy("rule", "bit").agg(
        of(fails, "docs").alias("docs_failing"), of(alone, "docs").alias("docs_only_this"), of(rest, "docs").alias("docs_kept_without"),
        of(rest, "words").alias("words_kept_without"), F.bit_or(F.when(fails, F.col("bits")).otherwise(0)).alias("fails_with"))
