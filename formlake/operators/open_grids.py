"""Tables whose outer edges are not drawn: what their dividers, crossbars and labels tell of them.

Bars and labels meet dividers on bands of a page, edges meet segments on cells, so no page is multiplied by itself. Bands of a table
are told to hold a label by one window over its levels and labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.rounds import settled

_BAND = 64.0


def _band(y: Column) -> Column:
    return F.floor(y / _BAND)


def _clusters(value: str, by: list[str], margin: float) -> Column:
    """Number of the cluster of a value: one begins where the gap to the one before is beyond the margin."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.sum(F.coalesce((F.col("_gap") > margin).cast("int"), F.lit(0))).over(w)


def _with_cluster(df: DataFrame, value: str, by: list[str], margin: float, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(value)
    return df.withColumn("_gap", F.col(value) - F.lag(value).over(w)).withColumn(name, _clusters(value, by, margin)).drop("_gap")


def outer_edges(bars: DataFrame, uprights: DataFrame, labels: DataFrame, margin: float = 0.6, least: int = 3, share: float = 0.75) -> DataFrame:
    """The outer edges that open tables lack: page, axis (vertical or horizontal), position, from, to.

    bars (page, y, from, to) and uprights (page, x, from, to) are drawn, labels are lines of text (page, x0, x1, base, size, text). Uprights of one extent are
    the dividers of a table, bars in it that cross all of them its crossbars. It is a table if its crossbars lie on `least` levels, or on two under a header
    of two labels, and `share` of them have one span, which holds all dividers. With fewer than three dividers, `least` bands must have a label left
    of the first one. An edge that a drawn segment covers is not told; one drawn for the most part is told at the drawn position. Equal votes: the lesser span.
    """
    group = ["page", "g", "h"]
    ups = _with_cluster(_with_cluster(uprights, "from", ["page"], margin, "g"), "to", ["page", "g"], margin, "h")
    ups = settled(_with_cluster(ups, "x", group, margin, "c"))
    frames = ups.groupBy(*group).agg(F.min("from").alias("y0"), F.max("to").alias("y1"), F.min("x").alias("lo"), F.max("x").alias("hi"), (F.max("c") + 1).alias("dividers"))
    banded = frames.withColumn("_b", F.explode(F.sequence(_band(F.col("y0") - margin), _band(F.col("y1") + margin))))
    cross = banded.join(bars.withColumn("_b", _band(F.col("y"))), ["page", "_b"]).drop("_b")
    cross = cross.filter((F.col("y") >= F.col("y0") - margin) & (F.col("y") <= F.col("y1") + margin) & (F.col("from") <= F.col("lo") + margin) & (F.col("to") >= F.col("hi") - margin))
    cross = settled(_with_cluster(cross.select(*group, "y", "from", "to"), "y", group, margin, "c").withColumns({"a": F.round("from", 1), "z": F.round("to", 1)}))
    told = cross.groupBy(*group).agg(F.count("*").alias("n"), (F.max("c") + 1).alias("levels"), F.min("y").alias("first"), F.min("from").alias("x0"), F.max("to").alias("x1"))
    votes = cross.groupBy(*group, "a", "z").agg(F.count("*").alias("votes")).groupBy(*group).agg(F.max(F.struct("votes", -F.col("a"), -F.col("z"))).alias("v")).select(*group, F.col("v.votes").alias("votes"), (-F.col("v.col2")).alias("a"), (-F.col("v.col3")).alias("z"))
    tables = frames.join(told, group).join(votes, group)
    # Labels of each table.
    spread = tables.withColumn("_b", F.explode(F.sequence(_band(F.col("y0")), _band(F.col("y1"))))).select(*group, "_b", "y0", "y1", "first", "x0", "x1")
    # Found once, used for headers and for bands.
    within = spread.join(labels.withColumnsRenamed({"x0": "l0", "x1": "l1"}).withColumn("_b", _band(F.col("base"))), ["page", "_b"]).filter((F.col("base") >= F.col("y0")) & (F.col("base") <= F.col("y1")) & F.col("text").rlike(r"\S"))
    within = settled(within)
    heads = within.filter((F.col("base") <= F.col("first")) & (F.col("l0") >= F.col("x0")) & (F.col("l0") <= F.col("x1"))).groupBy(*group).agg(F.count("*").alias("heads"))
    need = F.when((F.col("dividers") >= least) & (F.col("levels") == 2) & (F.coalesce("heads", F.lit(0)) >= 2), 2).otherwise(least)
    tables = tables.join(heads, group, "left").withColumn("need", need).filter((F.col("levels") >= F.col("need")) & (F.col("votes") >= F.col("need")) & (F.col("votes") >= share * F.col("n")) & (F.col("a") <= F.col("lo") + margin) & (F.col("z") >= F.col("hi") - margin))
    tables = settled(tables)
    spans = tables.select(*group, "a", "z", "y0", "y1", "dividers")
    inner = ups.select(*group, "x").join(spans, group).filter((F.col("x") > F.col("a") + 2 * margin) & (F.col("x") < F.col("z") - 2 * margin)).groupBy(*group).agg(F.min("x").alias("divider"))
    left = within.select(*group, "base", "l0", "l1", "size", "text").join(spans, group).join(inner, group)
    left = left.filter((F.col("l0") >= F.col("a")) & (F.col("l0") < F.col("divider")) & (F.col("l1") <= F.col("divider") + F.greatest(F.lit(1.0), F.col("size"))) & F.col("text").rlike(r"[\p{L}\p{N}]"))
    level = spans.select(*group, F.explode(F.array("y0", "y1")).alias("y")).unionByName(cross.select(*group, "y").join(spans.select(*group), group)).distinct()
    both = level.withColumn("kind", F.lit(0)).unionByName(left.select(*group, F.col("base").alias("y"), F.lit(1).alias("kind")))
    after = Window.partitionBy(*group).orderBy("y", "kind").rowsBetween(1, Window.unboundedFollowing)
    is_label = F.col("kind") == 1
    both = both.withColumns({"_label": F.first(F.when(is_label, F.col("y")), ignorenulls=True).over(after), "_level": F.first(F.when(~is_label, F.col("y")), ignorenulls=True).over(after)})
    labelled = both.filter(~is_label & (F.col("_label") <= F.col("_level"))).groupBy(*group).agg(F.count("*").alias("labelled"))
    good = tables.join(labelled, group, "left").filter((F.col("dividers") >= least) | (F.coalesce("labelled", F.lit(0)) >= least))
    edge = lambda axis, position, start, end: F.struct(F.lit(axis).alias("axis"), F.col(position).alias("position"), F.col(start).alias("from"), F.col(end).alias("to"))
    edges = good.select("page", F.explode(F.array(edge("vertical", "a", "y0", "y1"), edge("vertical", "z", "y0", "y1"), edge("horizontal", "y0", "a", "z"), edge("horizontal", "y1", "a", "z"))).alias("e")).select("page", "e.*").distinct()
    drawn = uprights.select("page", F.lit("vertical").alias("axis"), F.col("x").alias("at"), F.col("from").alias("f"), F.col("to").alias("t")).unionByName(bars.select("page", F.lit("horizontal").alias("axis"), F.col("y").alias("at"), F.col("from").alias("f"), F.col("to").alias("t")))
    cell = F.floor(F.col("position"))
    near = edges.withColumn("_c", F.explode(F.array(cell - 1, cell, cell + 1))).join(drawn.withColumn("_c", F.floor("at")), ["page", "axis", "_c"], "left")
    close = F.abs(F.col("at") - F.col("position")) <= margin
    covers = close & (F.col("f") <= F.col("from") + margin) & (F.col("t") >= F.col("to") - margin)
    partly = close & (F.least("t", "to") - F.greatest("f", "from") >= 0.8 * (F.col("to") - F.col("from")))
    found = near.groupBy("page", "axis", "position", "from", "to").agg(F.max(F.coalesce(covers, F.lit(False))).alias("covered"), F.min(F.when(partly, F.struct(F.abs(F.col("at") - F.col("position")).alias("d"), "at"))).alias("n"))
    return found.filter("not covered").select("page", "axis", F.coalesce("n.at", "position").alias("position"), "from", "to")
