"""Gaps, runs and neighbours along one dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cells in a range of values.
RANGE = 4096


def _islands(rows: DataFrame, parts: list[str], order: list[str], new: Column) -> DataFrame:
    w = Window.partitionBy(*parts).orderBy(*order)
    return rows.withColumn("island", F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _cell_islands(rows: DataFrame, parts: list[str], value: str, tolerance: float) -> DataFrame:
    """Cells of `tolerance` width (parts, cell, n, _sum, low, high) with the number of their island. Values of one cell are always together, so windows see one row for each cell; cells are divided into ranges, and ranges are joined over their ends."""
    cells = rows.groupBy(*parts, F.floor(F.col(value) / tolerance).alias("cell")).agg(F.count("*").alias("n"), F.sum(value).alias("_sum"), F.min(value).alias("low"), F.max(value).alias("high"))
    marked = cells.withColumn("_range", F.floor(F.col("cell") / RANGE))
    w = Window.partitionBy(*parts, "_range").orderBy("cell")
    own = _islands(marked, [*parts, "_range"], ["cell"], F.coalesce(F.col("low") - F.lag("high").over(w) > tolerance, F.lit(True)))
    ends = own.groupBy(*parts, "_range").agg(F.max("island").alias("_islands"), F.min("low").alias("_low"), F.max("high").alias("_high"))
    along = Window.partitionBy(*parts).orderBy("_range")
    ends = ends.withColumn("_joined", F.coalesce(F.col("_low") - F.lag("_high").over(along) <= tolerance, F.lit(False)).cast("int"))
    ends = ends.withColumn("_before", F.sum(F.col("_islands") - F.col("_joined")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_islands"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*parts, "_range")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return own.alias("a").join(ends.alias("b"), on).select(*(f"a.{c}" for c in (*parts, "cell", "n", "_sum", "low", "high")), (F.col("a.island") + F.col("b._before")).alias("island"))


def gap_groups(rows: DataFrame, parts: list[str], value: str, tolerance: float = 0.8) -> DataFrame:
    """Groups of values without a gap above the tolerance: their number, mean and ends."""
    cells = _cell_islands(rows, parts, value, tolerance)
    return cells.groupBy(*parts, "island").agg(F.sum("n").alias("n"), (F.sum("_sum") / F.sum("n")).alias("middle"), F.min("low").alias("low"), F.max("high").alias("high"))


def gap_cells(rows: DataFrame, parts: list[str], value: str, tolerance: float) -> DataFrame:
    """parts, cell (floor of value over tolerance), island: the group of each cell's values."""
    return _cell_islands(rows, parts, value, tolerance).select(*parts, "cell", "island")


def merged_intervals(rows: DataFrame, parts: list[str], start: str, end: str, slack: float = 1.0) -> DataFrame:
    """Unions of intervals that overlap or stand no more than `slack` apart."""
    w = Window.partitionBy(*parts).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_reach", reach)
    found = _islands(marked, parts, [start, end], F.coalesce(F.col(start) - F.col("_reach") > slack, F.lit(True)))
    return found.groupBy(*parts, "island").agg(F.min(start).alias("low"), F.max(end).alias("high"), F.count("*").alias("n")).drop("island")


def rolling_text(lines: DataFrame, parts: list[str], order: str, text: str, above: int = 6) -> DataFrame:
    """Every line with the text of itself and the lines above it as `window`."""
    w = Window.partitionBy(*parts).orderBy(order).rowsBetween(-above, 0)
    return lines.withColumn("window", F.array_join(F.collect_list(text).over(w), " "))


def first_formula(text: Column, formulas: list[tuple[str, str]]) -> Column:
    """The reason of the first pattern, in the list's order, that a text holds."""
    out = F.lit(None).cast("string")
    for pattern, reason in reversed(formulas):
        out = F.when(F.lower(text).rlike(pattern), F.lit(reason)).otherwise(out)
    return out


def near_pairs(rows: DataFrame, parts: list[str], order: str, distance: int) -> DataFrame:
    """Pairs of rows a and b, b at most `distance` places after a: one window by place, no join."""
    w = Window.partitionBy(*parts).orderBy(order).rangeBetween(1, distance)
    own = F.struct(*rows.columns)
    return rows.select(own.alias("a"), F.collect_list(own).over(w).alias("_b")).select("a", F.explode("_b").alias("b"))


def numbered(rows: DataFrame, parts: list[str], order: list[str], name: str = "number") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*parts).orderBy(*order)).cast("long"))


def reading_order(rows: DataFrame, parts: list[str], x: str, y: str, band: float = 4.0) -> DataFrame:
    """Rows in reading order, with their line: y in bands (half to even), then x, then all other columns, so that ties have one order."""
    line = F.bround(F.col(y) / band, 0)
    w = Window.partitionBy(*parts).orderBy(line, x, y, *sorted(set(rows.columns) - {x, y, *parts}))
    return rows.withColumns({"place": F.row_number().over(w).cast("long"), "line_no": F.dense_rank().over(Window.partitionBy(*parts).orderBy(line)).cast("long")})


def labels_between(slots: DataFrame, parts: list[str], start: str, end: str, text: str, most: int = 100) -> DataFrame:
    """Each slot's label: the text between the end of the slot before it and its start, the last `most` characters. Places count from 0, ends are exclusive."""
    before = F.coalesce(F.lag(end).over(Window.partitionBy(*parts).orderBy(start)), F.lit(0))
    between = F.trim(F.substr(text, before + 1, F.col(start) - before))
    return slots.withColumn("label", F.when(F.length(between) > most, F.substr(between, F.length(between) - most + 1)).otherwise(between))


def _fillers(least: int) -> str:
    return "|".join(f"{m}(?: *{m}){{{least - 1},}}" for m in ("_", "\\.", "-", "#", "%", "\\*", "\\$", "&"))


#: Runs of one filler character, with blanks in between allowed.
FILLERS = _fillers(4)


def filler_runs(text: Column, least: int = 4) -> Column:
    """Runs of one filler character, with blanks in between allowed."""
    return F.regexp_extract_all(text, F.lit(f"({_fillers(least)})"), F.lit(1))


def phase_times(steps: DataFrame, parts: list[str], at: str, phase: str) -> DataFrame:
    """Time spent in each phase: from a step to the next of the same run."""
    w = Window.partitionBy(*parts).orderBy(at, *sorted(set(steps.columns) - {at, *parts}))
    spent = F.unix_micros(F.lead(F.col(at)).over(w)) - F.unix_micros(F.col(at))
    return steps.withColumn("_us", spent).groupBy(phase).agg(F.coalesce(F.sum("_us"), F.lit(0)).alias("micros"), F.count("*").alias("steps"))


def overlapping_edits(edits: DataFrame, parts: list[str], start: str, end: str) -> DataFrame:
    """Edits that overlap no other of their paragraph, and those that do (`clash`)."""
    w = Window.partitionBy(*parts).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(start).over(w.rowsBetween(1, Window.unboundedFollowing))
    return edits.withColumn("clash", F.coalesce(before > F.col(start), F.lit(False)) | F.coalesce(after < F.col(end), F.lit(False)))


def spliced(text: Column, edits: Column) -> Column:
    """text with edits (array of from, until, value; places from 0) made from right to left."""
    ordered = F.reverse(F.array_sort(edits))
    return F.aggregate(ordered, text, lambda acc, e: F.concat(F.substr(acc, F.lit(1), e["from"]), e["value"], F.substr(acc, e["until"] + 1)))
