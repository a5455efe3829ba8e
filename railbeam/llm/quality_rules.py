"""Quality rules (operator 4): a table of thresholds compiled into one projection of built-in functions.

Repeated word windows are found without a shuffle: every three-word window becomes one long, 33 bits of its
hash above its position, and a sort of those longs puts equal windows side by side. Windows that meet an equal
neighbour are then compared as texts, so a chance meeting of hashes changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbeam.llm.common import WORD, once, renamed, words_of

#: Common words of the languages that are kept, in lower case.
STOP_WORDS = (
    *("the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "be", "have", "it", "on", "as", "are", "this", "from", "at", "by"),
    *("der", "die", "und", "den", "von", "zu", "das", "mit", "ist", "des", "dem", "nicht", "ein", "eine", "für", "auf", "sich", "im", "auch", "als"),
    *("le", "la", "les", "et", "des", "du", "un", "une", "que", "est", "pour", "dans", "qui", "par", "sur", "pas", "au", "avec", "en", "de"),
    *("el", "los", "las", "del", "una", "por", "con", "para", "como", "no", "su", "al", "lo", "más", "pero", "sus", "y", "a", "o", "se"),
)


@dataclass(frozen=True)
class Rule:
    """``part / whole`` must lie in [low, high]; a whole of 0 counts as 1."""

    name: str
    part: str
    whole: str
    low: float
    high: float


RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", 3.0, 10.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.1),
    Rule("shouts_per_word", "n_shouts", "n_words", 0.0, 0.3),
    Rule("stop_words_found", "n_stop_words", "one", 2.0, float("inf")),
    Rule("repeated_line_share", "n_dup_lines", "n_lines", 0.0, 0.5),
    Rule("repeated_word_share", "n_repeat_words", "n_words", 0.0, 0.5),
)
MIN_WORDS = 50


def _with_repeats(docs: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to rows with ``words``."""
    words = F.col("words")

    def window(word: Column, i: Column) -> Column:
        mark = F.xxhash64(word, F.get(words, i + 1), F.get(words, i + 2))
        return F.shiftleft(mark, 31).bitwiseOR(i.cast("long"))

    def meets(key: Column, i: Column) -> Column:
        high = F.shiftright(key, 31)
        return (high == F.shiftright(F.get("marks", i - 1), 31)) | (high == F.shiftright(F.get("marks", i + 1), 31))

    def spelt(key: Column) -> Column:
        at = key.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
        return F.struct(F.concat_ws(" ", *[F.get(words, at + k) for k in range(3)]).alias("w"), at.alias("at"))

    def repeats(item: Column, i: Column) -> Column:
        return (item["w"] == F.get("near", i - 1)["w"]) | (item["w"] == F.get("near", i + 1)["w"])

    def covered(at: Column, i: Column) -> Column:
        return F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - at, F.lit(3)))

    marks = F.sort_array(F.slice(F.transform("words", window), 1, F.greatest(F.size("words") - 2, F.lit(0))))
    docs = once(docs, marks=marks)
    docs = once(docs, near=F.sort_array(F.transform(F.filter("marks", meets), spelt))).drop("marks")
    docs = once(docs, starts=F.sort_array(F.transform(F.filter("near", repeats), lambda item: item["at"]))).drop("near")
    total = F.aggregate(F.transform("starts", covered), F.lit(0), lambda a, b: a + b)
    return docs.withColumn("n_repeat_words", total.cast("long")).drop("starts")


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of counts for each row of ``docs``; see ``quality_rules``."""
    slim = renamed(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    slim = once(slim, words=words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    counted = once(slim, lines=lines).select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_shouts"),
        F.size(F.array_intersect(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), F.array(*map(F.lit, dict.fromkeys(STOP_WORDS))))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return _with_repeats(counted).drop("words").withColumn("one", F.lit(1))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, ``base_failed``, ``failed`` (names of the rules that a text breaks) and ``kept`` for every row.

    A null text counts as empty: no words, so it fails the base rule. Ids play no part in the rules, so null ids
    and repeated rows are judged like any other. An empty table gives an empty result. ``rules`` is the threshold
    table; each becomes two comparisons of one projection.
    """
    found = measures(docs, doc_id, text)
    checks = [
        F.when(~(F.col(r.part) / F.greatest(F.col(r.whole), F.lit(1))).between(r.low, r.high), F.lit(r.name)) for r in rules
    ]
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = once(found, base_failed=base, failed=F.array_compact(F.array(*checks)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("one")
