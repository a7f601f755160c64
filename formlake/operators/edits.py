"""Edits of paragraphs that are made of runs: each run keeps its format, and an edit may begin in one run and end in another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a stretch of a paragraph in which runs and edits meet.
STRETCH = 256


def placed_runs(runs: DataFrame, parts: list[str]) -> DataFrame:
    """runs (parts, run, text, ...) with begin and end: characters of the paragraph before and up to the end of each."""
    w = Window.partitionBy(*parts).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("text")
    return runs.withColumn("end", F.sum(size).over(w)).withColumn("begin", F.col("end") - size)


def edited_runs(runs: DataFrame, edits: DataFrame, parts: list[str]) -> DataFrame:
    """parts, run, piece (from 0), text, other columns of runs: what becomes of runs (parts, run, text, ...) under edits (parts, start, until, value).

    Edits of a paragraph do not overlap; places count characters from 0 and `until` is exclusive. What an edit covers goes, run by run; its value
    stands in the run in which it begins (at a paragraph's end: in the last run) and has that one's format. Each run looks its paragraph's edits
    up by stretches. Runs that are dealt out by paragraph before are not shuffled again.
    """
    others = [c for c in runs.columns if c not in (*parts, "run", "text")]
    placed = placed_runs(runs, parts)
    placed = placed.withColumn("_last", F.lead("run").over(Window.partitionBy(*parts).orderBy("run")).isNull())
    stretches = lambda a, b: F.sequence(F.floor(a / STRETCH), F.floor(b / STRETCH))
    edit = F.struct(F.col("start").cast("long").alias("start"), F.col("until").cast("long").alias("until"), "value")
    e = edits.select(*parts, edit.alias("_x"), F.explode(stretches(F.col("start"), F.greatest("until", "start"))).alias("_s")).groupBy(*parts, "_s").agg(F.array_sort(F.collect_set("_x")).alias("_x"))
    e = e.groupBy(*parts).agg(F.map_from_entries(F.collect_list(F.struct("_s", "_x"))).alias("_map"))
    starts_here = lambda x: (x["start"] >= F.col("begin")) & ((x["start"] < F.col("end")) | (F.col("_last") & (x["start"] == F.col("end"))))
    covers = lambda x: (x["start"] < F.col("end")) & (x["until"] > F.col("begin"))
    none = F.array().cast("array<struct<start:bigint,until:bigint,value:string>>")
    near = F.flatten(F.transform(stretches(F.col("begin"), F.greatest("end", "begin")), lambda s: F.coalesce(F.try_element_at("_map", s), none)))
    own = F.transform(F.filter(near, lambda x: starts_here(x) | covers(x)), lambda x: F.struct(x["start"], x["until"], F.when(starts_here(x), x["value"]).alias("value")))
    rows = placed.join(e, parts, "left").withColumn("_e", F.when(F.col("_map").isNull(), none).otherwise(F.array_sort(F.array_distinct(own)))).drop("_map")
    clipped = lambda x: F.least(F.greatest(x, F.col("begin")), F.col("end"))
    lows = F.concat(F.array("begin"), F.transform("_e", lambda x: clipped(x["until"])))
    highs = F.concat(F.transform("_e", lambda x: clipped(x["start"])), F.array("end"))
    kept = F.zip_with(lows, highs, lambda a, b: F.struct(a.alias("at"), F.lit(1).alias("kept"), F.substr("text", (a - F.col("begin") + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")).alias("text")))
    new = F.transform(F.filter("_e", lambda x: x["value"].isNotNull()), lambda x: F.struct(x["start"].alias("at"), F.lit(0).alias("kept"), x["value"].alias("text")))
    pieces = F.filter(F.array_sort(F.concat(kept, new)), lambda x: x["text"] != "")
    return rows.select(*parts, "run", *others, F.posexplode(pieces).alias("piece", "_p")).select(*parts, "run", "piece", F.col("_p.text").alias("text"), *others)
