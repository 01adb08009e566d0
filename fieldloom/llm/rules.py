"""Quality rules: a table of thresholds compiled into one Spark projection over length, symbol, stop-word and line measures.

Everything is built-in Spark expressions; nothing is shuffled, so a text is read, measured and judged where it lies.

Edge cases: a null text has no words and fails the length rule; ratios with nothing below the line are 0; texts of any
length are measured whole, in n log n time; repeated rows are judged one by one; an empty table gives an empty table;
columns of the input other than the text pass through, and those named like a measure are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import text_or_empty

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "on", "be", "are", "this", "by", "an", "or", "from", "at",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "des", "sich", "dem", "ein", "eine", "nicht",
    "le", "la", "les", "et", "est", "un", "une", "que", "qui", "dans", "du", "pour", "sur", "au",
    "el", "los", "las", "y", "en", "se", "del", "por", "con", "para", "su", "no", "una", "de",
)


@dataclass(frozen=True)
class Rule:
    """A document fails if its measure is below least or above most."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The first two are the base; the others are the method's own, set so that ordinary prose of any length passes.
BASE = (Rule("too_short", "n_words", least=50), Rule("repeats", "repeat_ratio", most=0.5))
RULES = (
    Rule("word_length", "mean_word_chars", least=2.0, most=20.0),
    Rule("symbols", "symbol_ratio", most=0.2),
    Rule("stop_words", "stop_ratio", least=0.01),
    Rule("dup_lines", "dup_line_ratio", most=0.5),
)


def bind(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_list(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more: windows are hashed, sorted with their places, and neighbours compared."""

    def places(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        again = bind(pairs, lambda s: F.filter(s, lambda x, k: same(s, k - 1, x) | same(s, k + 1, x)))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(h: Column) -> Column:
        some = bind(
            places(h),
            lambda at: F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n")), lambda a: a["n"]),
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(some)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(bind(hashes, covered))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def measures(text: Column) -> Column:
    """All measures of a text as one struct."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    by_words = bind(
        word_list(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words")),
    )
    by_lines = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    word_chars = F.char_length(F.translate(text, SPACES, "")).cast("long")
    n_symbols = (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")
    parts = F.struct(by_words.alias("w"), by_lines.alias("l"), word_chars.alias("c"), n_symbols.alias("s"))

    def ratios(m: Column) -> Column:
        w, x = m["w"], m["l"]
        return F.struct(
            w["n_words"].alias("n_words"), m["c"].alias("word_chars"), m["s"].alias("n_symbols"), x["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"), w["n_stop_words"].alias("n_stop_words"), x["n_lines"].alias("n_lines"),
            ratio(m["c"], w["n_words"]).alias("mean_word_chars"), ratio(m["s"], w["n_words"]).alias("symbol_ratio"), ratio(w["n_stop_words"], w["n_words"]).alias("stop_ratio"), ratio(x["n_dup_lines"], x["n_lines"]).alias("dup_line_ratio"), ratio(w["n_repeat_words"], w["n_words"]).alias("repeat_ratio"),
        )

    return bind(parts, ratios)


def compiled(rules: tuple[Rule, ...], m: Column) -> Column:
    """The names of the rules that measures m fail."""

    def fails(r: Rule) -> Column:
        low = m[r.measure] < F.lit(r.least) if r.least is not None else F.lit(False)
        return low | (m[r.measure] > F.lit(r.most)) if r.most is not None else low

    return F.array_compact(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "mean_word_chars", "symbol_ratio", "stop_ratio", "dup_line_ratio", "repeat_ratio")


def judge(docs: DataFrame, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs without its text, with every measure, base_failed, failed (names of rules) and kept."""

    def verdict(m: Column) -> Column:
        return F.struct(m.alias("m"), compiled(base, m).alias("base"), compiled(rules, m).alias("own"))

    v = bind(measures(text_or_empty(text)), verdict)
    others = [c for c in docs.columns if c not in (text, *FIELDS, "base_failed", "failed", "kept", "_v")]
    out = docs.select(*[docs[c] for c in others], v.alias("_v"))
    return out.select(*others, *[F.col(f"_v.m.{f}").alias(f) for f in FIELDS], (F.size("_v.base") > 0).alias("base_failed"), F.concat("_v.base", "_v.own").alias("failed"), ((F.size("_v.base") == 0) & (F.size("_v.own") == 0)).alias("kept"))
