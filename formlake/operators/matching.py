"""Which key a label asks for, which keys belong together, and where two readers agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word that more keys have does not tell them apart; a label of more words is a sentence.
MOST_KEYS, LABEL_WORDS = 3, 3


def document_frequency(keys: DataFrame, words: str = "words") -> DataFrame:
    """In how many keys each word occurs."""
    return keys.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("keys"))


def match_keys(labels: DataFrame, keys: DataFrame) -> DataFrame:
    """label, key, state for labels (label, words) against keys (key, words).

    A key is a candidate if it shares a word that few keys have. The one with most common, then most telling words wins; equal
    ones are ambiguous, and so is a label with another key's word. The join runs on words, so no label meets all keys.
    """
    frequency = document_frequency(keys)
    words = labels.select("label", F.explode(F.array_distinct("words")).alias("word"))
    # Only telling words find candidates, at most MOST_KEYS keys each; frequent words are counted for these afterwards.
    index = keys.select("key", F.explode(F.array_distinct("words")).alias("word")).join(frequency.filter(F.col("keys") <= MOST_KEYS), "word")
    pairs = words.join(index, "word").groupBy("label", "key").agg(F.count("*").alias("telling"))
    pairs = pairs.join(labels.select("label", F.col("words").alias("_l")), "label").join(keys.select("key", F.col("words").alias("_k")), "key")
    pairs = pairs.select("label", "key", F.size(F.array_intersect("_l", "_k")).cast("long").alias("common"), "telling")
    w = Window.partitionBy("label")
    best = pairs.withColumn("top", F.max(F.struct("common", "telling")).over(w)).filter(F.struct("common", "telling") == F.col("top"))
    best = best.groupBy("label").agg(F.count("*").alias("ties"), F.min("key").alias("key"))
    known = words.join(frequency, "word").select("label", "word")
    own = keys.select("key", F.explode(F.array_distinct("words")).alias("word"))
    foreign = known.join(best.filter("ties = 1"), "label").join(own, ["key", "word"], "left_anti").groupBy("label").agg(F.count("*").alias("foreign"))
    out = labels.join(best, "label", "left").join(foreign, "label", "left")
    n = F.size(F.array_distinct("words"))
    state = F.when(n == 0, "senza etichetta").when(n > LABEL_WORDS, "frase").when(F.col("key").isNull(), "ignoto").when((F.col("ties") > 1) | F.col("foreign").isNotNull(), "ambiguo").otherwise("assegna")
    return out.select("label", state.alias("state"), F.when(state == "assegna", F.col("key")).alias("key"))


def affixes(key: Column) -> Column:
    """Heads and tails of a key's parts, itself included."""
    p = F.filter(F.split(key, "_"), lambda w: w != "")
    n = F.size(p)
    ends = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array(F.array_join(F.slice(p, n - k + 1, k), "_"), F.array_join(F.slice(p, 1, k), "_"))))
    return F.when(n > 0, F.array_distinct(ends)).otherwise(F.array().cast("array<string>"))


def group_by_affix(keys: DataFrame, least: int = 2) -> DataFrame:
    """key, part: the part that most keys share, then the longest, then the first; groups below `least` are left over (null)."""
    parts = keys.select("key", F.explode(affixes(F.col("key"))).alias("part"))
    shared = parts.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    size = F.size(F.split("part", "_"))
    w = Window.partitionBy("key").orderBy(F.desc("n"), size.desc(), "part")
    chosen = parts.join(shared, "part").withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("key", "part")
    groups = chosen.groupBy("part").agg(F.count("*").alias("members")).filter(F.col("members") >= least)
    return keys.select("key").join(chosen.join(groups, "part").select("key", "part"), "key", "left").select("key", "part")


def compare_readers(first: DataFrame, second: DataFrame, key: str, value: str, same: Column | None = None) -> DataFrame:
    """key, outcome: agree, differ, only_second, only_first or none, for every key of either reader."""
    a, b = first.select(key, F.col(value).alias("a")), second.select(key, F.col(value).alias("b"))
    equal = F.col("a").eqNullSafe(F.col("b")) if same is None else same
    outcome = F.when(F.col("a").isNull() & F.col("b").isNull(), "none").when(F.col("a").isNull(), "only_second").when(equal, "agree").when(F.col("b").isNull(), "only_first").otherwise("differ")
    return a.join(b, key, "full").select(key, "a", "b", outcome.alias("outcome"))


def reuse_plan(wanted: DataFrame, plans: DataFrame, identity: list[str], age: str) -> DataFrame:
    """The oldest plan whose whole identity equals the wanted one."""
    others = [c for c in plans.columns if c not in (*identity, age)]
    oldest = plans.groupBy(*identity).agg(F.min(F.struct(age, *others)).alias("_x")).select(*identity, f"_x.{age}", *[f"_x.{c}" for c in others])
    return wanted.join(oldest, identity)
