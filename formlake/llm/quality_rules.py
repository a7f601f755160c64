"""Quality rules: a table of thresholds compiled into one projection of Spark's own expressions.

Empty and null texts have no words: every count is 0, and they fail the base rule. Repeated rows are judged alike, each
on its own; very long texts are measured whole, within one row; a metric that equals a threshold passes; an empty table gives
an empty result; other columns pass through `apply_rules` untouched, but for those that it makes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, and the characters counted as symbols.
A_WORD = r"[^\x20\x09-\x0D]"
GAP_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = tuple(
    "the of and to in is that for it was on are with as be by at from this or an "
    "le la les de des et un une du en est que qui dans pour pas sur au avec ce "
    "der die das und ist von den mit ein eine zu auf im dem nicht sich als auch es für "
    "el los las y por con del se no una su lo para".split()
)


@dataclass(frozen=True)
class Rule:
    """A document passes where low <= metric <= high; a missing metric passes."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The verdict's thresholds. Metrics are the columns that `measures` makes.
RULES = (
    Rule("mean_word_chars", low=1.5, high=16.0),
    Rule("symbol_ratio", high=0.15),
    Rule("mark_ratio", high=0.3),
    Rule("dup_line_ratio", high=0.4),
    Rule("stop_ratio", low=0.02),
)


def _without(text: Column, chars: str, by: str = "") -> Column:
    """text with each of chars replaced: searches of bytes, many times faster than translate() or a pattern."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(_without(text, chars))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts and ratios of every whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.col("n_words")
    # Names for what is between: free ones, so that no column of the caller's is lost.
    taken = {c.lower() for c in docs.columns}
    free = lambda name: name if name not in taken else free(f"_{name}")
    words, lines, keys, grams, places = between = [free(name) for name in ("_words", "_lines", "_keys", "_sorted", "_at")]
    out = docs.withColumn(words, F.filter(F.split(_without(body, GAP_CHARS[1:], " "), " "), lambda w: w != ""))
    out = out.withColumn(lines, F.filter(F.split(body, "\n"), lambda x: x.rlike(A_WORD)))
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(_without(body, GAP_CHARS)).cast("long"),
            "n_symbols": _count_of(body, SYMBOLS).cast("long"),
            "n_marks": _count_of(body, "!?").cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
            keys: F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0))),
        }
    )
    # Equal windows have equal keys, so texts without equal keys, the most, need no more; the others compare the words themselves, sorted.
    gram = lambda w, i: F.struct(F.concat(w, F.lit(" "), F.get(words, i + 1), F.lit(" "), F.get(words, i + 2)).alias("g"), i.alias("i"))
    out = out.withColumn(grams, F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.array_sort(F.slice(F.transform(words, gram), 1, F.size(words) - 2))))
    out = out.withColumn(places, F.filter(F.transform(grams, lambda x, j: F.when((x.g == F.get(grams, j - 1).g) | (x.g == F.get(grams, j + 1).g), x.i)), lambda i: i.isNotNull()))
    out = out.withColumn("n_repeat_words", F.coalesce(F.when(F.col(places).isNotNull(), F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))), F.lit(0)).cast("long"))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumns(
        {
            "mean_word_chars": part("word_chars", "n_words"),
            "symbol_ratio": part("n_symbols", "n_words"),
            "mark_ratio": part("n_marks", "n_words"),
            "dup_line_ratio": part("n_dup_lines", "n_lines"),
            "stop_ratio": part("n_stop_words", "n_words"),
            "base_failed": (n < 50) | (100 * F.col("n_repeat_words") > 50 * n),
        }
    ).drop(*between)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression for the whole table of thresholds."""
    verdict = ~F.col("base_failed")
    for r in rules:
        value = F.col(r.metric)
        if r.low is not None:
            verdict = verdict & F.coalesce(value >= F.lit(r.low), F.lit(True))
        if r.high is not None:
            verdict = verdict & F.coalesce(value <= F.lit(r.high), F.lit(True))
    return verdict


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with their measures and the verdict `kept`. Columns of docs named like a measure are replaced."""
    return measures(docs, text).withColumn("kept", compile_rules(rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""
    # A verdict that is not deterministic by its form is not pushed below the projections that make its measures: pushed down, every measure would be made again for each use.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    judged = measures(rows, "_text").withColumn("_kept", compile_rules(rules) & (F.monotonically_increasing_id() >= 0))
    return judged.filter("_kept").select("_row.*")
