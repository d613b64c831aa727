"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Frequent function words of the languages served.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "that", "is", "it", "for", "with", "be", "have",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "dans",
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den",
    "el", "los", "las", "y", "en", "con", "por", "una", "del",
)


class Rule(NamedTuple):
    """A document passes if low <= metric <= high (None: no bound)."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Loose bounds: they reject what no reader would call prose and leave ordinary texts of any of the languages alone.
RULES = (
    Rule("length", "n_words", low=20),
    Rule("word_length", "mean_word_length", low=1.5, high=20),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("stop_words", "stop_ratio", low=0.01),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once for a row (a lambda variable is bound, not copied, by the optimizer)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, x: total + x)


def _repeated(words: Column, width: int = 8) -> Column:
    """Words in windows of `width` words that occur twice or more among the words, first occurrence included.

    Windows are read element by element: slice() would copy the whole array for each of them. Window hashes without a duplicate end it; else equal hashes become neighbours by sorting (hash, place)."""

    def covered(pairs: Column) -> Column:
        twin = F.filter(pairs, lambda x, j: F.coalesce(F.get(pairs, j + 1)["h"] == x["h"], F.lit(False)) | F.when(j > 0, F.get(pairs, j - 1)["h"] == x["h"]).otherwise(False))
        return let(
            F.sort_array(F.transform(twin, lambda x: x["i"])),
            lambda at: _total(F.transform(at, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - p, F.lit(width))))),
        )

    def by_hash(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered))

    windows = let(F.transform(words, lambda w: F.xxhash64(w)), lambda wh: F.transform(F.sequence(F.lit(0), F.size(wh) - width), lambda i: F.xxhash64(*(F.get(wh, i + k) for k in range(width)))))
    return F.when(F.size(words) <= width, 0).otherwise(let(windows, by_hash))


def text_metrics(text: Column) -> Column:
    """A struct of counts of a text (null: of the empty text)."""
    text = F.coalesce(text, F.lit(""))
    blank = " \t\n\x0b\f\r"
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(blank)) != "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            _total(F.transform(w, lambda x: F.length(x))).alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).alias("n_stop"),
            _repeated(w).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    return F.struct(
        let(F.filter(F.split(text, SPACE), lambda w: w != ""), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
    )


METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop", "mean_word_length", "symbol_ratio", "stop_ratio", "dup_line_ratio", "base_failed", "failed_rules", "kept")


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", result_col: str = "quality") -> DataFrame:
    """docs with a struct column `quality` of METRICS (or the name given; a clash with a column of docs is an error).

    Null or empty text: no words, so base_failed. Ties, repeated rows and null ids do not matter: rows are judged one
    by one. Empty table: empty result.
    """
    if result_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs already has a column {result_col}")
    return docs.withColumn(result_col, let(text_metrics(F.col(text_col)), lambda m: _judged(m, rules)))


def _judged(m: Column, rules: Sequence[Rule]) -> Column:
    """The struct of METRICS of a text's counts. All is one expression over bound values: a filter on `kept` that the
    optimizer moves below the projection evaluates it once, not once for each field it reads."""
    n = m["w"]["n_words"]
    long = lambda x: x.cast("long")
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    values = {
        "n_words": long(n), "word_chars": long(m["w"]["word_chars"]), "n_symbols": long(m["n_symbols"]), "n_lines": long(m["l"]["n_lines"]), "n_dup_lines": long(m["l"]["n_dup_lines"]), "n_repeat_words": long(m["w"]["n_repeat_words"]), "n_stop": long(m["w"]["n_stop"]),
        "mean_word_length": ratio(m["w"]["word_chars"], n), "symbol_ratio": ratio(m["n_symbols"], n), "stop_ratio": ratio(m["w"]["n_stop"], n), "dup_line_ratio": ratio(m["l"]["n_dup_lines"], m["l"]["n_lines"]),
        "base_failed": (n < 20) | (100 * long(m["w"]["n_repeat_words"]) > 30 * long(n)),
    }

    def verdict(s: Column) -> Column:
        fields = [s[k].alias(k) for k in values]
        return let(_broken(s, rules), lambda broken: F.struct(*fields, broken.alias("failed_rules"), (~s["base_failed"] & (F.size(broken) == 0)).alias("kept")))

    return let(F.struct(*(v.alias(k) for k, v in values.items())), verdict)


def _broken(s: Column, rules: Sequence[Rule]) -> Column:
    found = []
    for rule in rules:
        bad = F.lit(False)
        if rule.low is not None:
            bad |= s[rule.metric] < rule.low
        if rule.high is not None:
            bad |= s[rule.metric] > rule.high
        found.append(F.when(bad, F.lit(rule.name)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
