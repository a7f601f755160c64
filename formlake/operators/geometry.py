"""Measured pages: rectangles, rules, glyphs and the text beside them.

Spatial joins meet on cells of a grid (`cell`) or with tiles of their page (`tiles`), so no page is joined with itself as a whole; what a cell's neighbours need is
written into every cell it may be asked from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.functions.text import clean_label

CELL = 25.0


def overlap_area(a: Column, b: Column) -> Column:
    """Common area of two rectangles (x0, y0, x1, y1)."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def _cells(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / CELL), F.floor(high / CELL))


def contained(glyphs: DataFrame, rects: DataFrame, margin: float = 0.6) -> DataFrame:
    """page, rect, text: the glyphs (page, x, y, text) whose origin lies in each rectangle (page, rect, x0..y1), in reading order."""
    g = glyphs.withColumns({"_cx": F.floor(F.col("x") / CELL), "_cy": F.floor(F.col("y") / CELL)})
    r = rects.select("*", F.explode(_cells(F.col("x0") - margin, F.col("x1") + margin)).alias("_cx")).select("*", F.explode(_cells(F.col("y0") - margin, F.col("y1") + margin)).alias("_cy"))
    inside = g.join(r, ["page", "_cx", "_cy"]).filter((F.col("x") >= F.col("x0") - margin) & (F.col("x") <= F.col("x1") + margin) & (F.col("y") >= F.col("y0") - margin) & (F.col("y") <= F.col("y1") + margin))
    ordered = F.array_sort(F.collect_list(F.struct(F.bround(F.col("y") / 4).alias("line"), "x", "text")))
    return inside.groupBy("page", "rect").agg(ordered.alias("t")).select("page", "rect", F.array_join(F.transform("t", lambda z: z.text), "").alias("text"))


def left_texts(rects: DataFrame, words: DataFrame, band: float = 4.0) -> DataFrame:
    """page, rect, label: the nearest word (page, x0, x1, y, text) that ends left of a rectangle on its line."""
    line = lambda y: F.floor(y / band)
    w = words.select("page", F.explode(F.array(line(F.col("y")) - 1, line(F.col("y")), line(F.col("y")) + 1)).alias("_l"), F.col("x1").alias("wx"), F.col("y").alias("wy"), "text")
    r = rects.withColumn("_l", line(F.col("y1")))
    near = r.join(w, ["page", "_l"]).filter((F.col("wx") <= F.col("x0")) & (F.abs(F.col("wy") - F.col("y1")) <= band))
    return near.groupBy("page", "rect").agg(F.max_by("text", F.struct("wx", "text")).alias("label"))


def above_texts(rects: DataFrame, words: DataFrame, reach: float = 20.0) -> DataFrame:
    """page, rect, label: the nearest word above a rectangle, within reach, whose span meets its own."""
    w = words.select("page", F.explode(_cells(F.col("y"), F.col("y") + reach)).alias("_c"), "x0", "x1", "y", "text")
    r = rects.select("page", "rect", F.col("x0").alias("rx0"), F.col("x1").alias("rx1"), F.col("y0").alias("ry"), F.floor(F.col("y0") / CELL).alias("_c"))
    near = r.join(w, ["page", "_c"]).filter((F.col("y") <= F.col("ry")) & (F.col("ry") - F.col("y") <= reach) & (F.col("x0") < F.col("rx1")) & (F.col("x1") > F.col("rx0")))
    return near.groupBy("page", "rect").agg(F.min_by("text", F.struct((F.col("ry") - F.col("y")).alias("d"), "x0", "text")).alias("label"))


def nearest_lines(fields: DataFrame, lines: DataFrame, reach: float = 8.0) -> DataFrame:
    """page, field, line: the text line (page, line, base) nearest to a field's base, within reach; of equals the upper."""
    n = lines.select("page", F.explode(_cells(F.col("base") - reach, F.col("base") + reach)).alias("_c"), "line", "base")
    f = fields.withColumn("_c", F.floor(F.col("y") / CELL))
    near = f.join(n, ["page", "_c"]).filter(F.abs(F.col("base") - F.col("y")) <= reach)
    return near.groupBy("page", "field").agg(F.min_by("line", F.struct(F.abs(F.col("base") - F.col("y")).alias("d"), "base")).alias("line"))


def column_headers(cells: DataFrame) -> DataFrame:
    """Every cell with the last text above it in its column (page, column, row, text), its own left out."""
    w = Window.partitionBy("page", "column").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("header", F.last(F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.col("text")), ignorenulls=True).over(w))


def table_headers(cells: DataFrame) -> DataFrame:
    """Every empty cell's label: the text of its row's first cell, else the first row's cell whose span covers its column. span: columns a cell covers."""
    w = Window.partitionBy("page", "row").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("column", F.coalesce(F.sum("span").over(w), F.lit(0)))
    filled = F.trim(F.coalesce("text", F.lit(""))) != ""
    heads = placed.filter("row = 0").filter(filled).select("page", F.explode(F.sequence(F.col("column"), F.col("column") + F.col("span") - 1)).alias("column"), F.col("text").alias("head"))
    firsts = placed.filter("place = 0").filter(filled).select("page", "row", F.col("text").alias("first"))
    empty = placed.filter(~filled)
    return empty.join(firsts, ["page", "row"], "left").join(heads, ["page", "column"], "left").select("page", "row", "column", F.coalesce("first", "head").alias("label"))


def _overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(a1, b1) - F.greatest(a0, b0)


def grid_cells(bars: DataFrame, uprights: DataFrame, margin: float = 0.6, wide: float = 2.0, high: float = 3.5) -> DataFrame:
    """page, x0, y0, x1, y1: cells closed on four sides by bars (page, y, from, to) and uprights (page, x, from, to).

    Two neighbouring uprights make a cell of two levels of bars if they reach from one to the other and stand on a bar of each,
    a bar of each level covers the span between them, and no bar of a level between covers it (a cell may span rows).
    Uprights elsewhere on the page do not divide it. Levels meet through the uprights that reach both, never as all pairs of a page.
    """
    # Bars of a tile are one row, and meet what is asked of them on their page.
    bar = bars.select("page", "y", F.col("from").alias("bf"), F.col("to").alias("bt")).repartition("page").distinct()
    laid = tiles(bar, ("bf", "y"), ("bt", "y"), ["y", "bf", "bt"]).withColumnRenamed("page", "_page")
    within = lambda x0, x1, y0, y1: (F.col("page") == F.col("_page")) & (F.col("_l") <= x0 + margin) & (F.col("_r") >= x1 - margin) & (F.col("_u") <= y1) & (F.col("_d") >= y0)
    # The levels that an upright stands on.
    standing = uprights.select("page", "x", "from", "to").repartition("page").distinct()
    near = standing.join(laid, within(F.col("x"), F.col("x"), F.col("from") - margin, F.col("to") + margin)).select("page", "x", "from", "to", F.explode("_all").alias("_b"))
    on = near.filter((F.col("_b.y") >= F.col("from") - margin) & (F.col("_b.y") <= F.col("to") + margin) & (F.col("_b.bf") <= F.col("x") + margin) & (F.col("_b.bt") >= F.col("x") - margin))
    on = on.groupBy("page", "x", "from", "to").agg(F.array_sort(F.collect_set("_b.y")).alias("ys"))
    tops = on.select("page", "x", F.explode(F.transform("ys", lambda t: F.struct(t.alias("y0"), F.filter("ys", lambda b: b - t >= high).alias("lows")))).alias("p")).select("page", "x", "p.y0", F.explode("p.lows").alias("y1")).distinct()
    sides = tops.withColumn("x1", F.lead("x").over(Window.partitionBy("page", "y0", "y1").orderBy("x"))).filter(F.col("x1") - F.col("x") >= wide).withColumnRenamed("x", "x0")
    y = F.col("_b.y")
    asked = sides.join(laid, within(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"))).select("page", "x0", "y0", "x1", "y1", F.explode("_all").alias("_b"))
    covering = asked.filter((F.col("_b.bf") <= F.col("x0") + margin) & (F.col("_b.bt") >= F.col("x1") - margin) & y.between(F.col("y0"), F.col("y1")))
    found = covering.groupBy("page", "x0", "y0", "x1", "y1").agg(F.max((y == F.col("y0")).cast("int")).alias("top"), F.max((y == F.col("y1")).cast("int")).alias("low"), F.max(((y > F.col("y0")) & (y < F.col("y1"))).cast("int")).alias("inner"))
    return found.filter("top = 1 and low = 1 and inner = 0").select("page", "x0", "y0", "x1", "y1")


def cell_strips(cells: DataFrame, least: int = 3, spread: float = 0.1, gap: float = 1.0) -> DataFrame:
    """Runs of neighbouring empty cells of one width: page, row, x0, x1, many."""
    w = Window.partitionBy("page", "row").orderBy("x0")
    new = F.coalesce((F.col("x0") - F.lag("x1").over(w) > gap) | (F.abs((F.col("x1") - F.col("x0")) / F.lag(F.col("x1") - F.col("x0")).over(w) - 1) > spread), F.lit(True))
    marked = cells.filter("empty").withColumn("_new", new)
    marked = marked.withColumn("_island", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("page", "row", "_island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("many")).filter(F.col("many") >= least).drop("_island")


def checkboxes(rects: DataFrame) -> DataFrame:
    """Near-square hollow boxes of 2 to 16 points, with the text up to the next box on their line as label."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    square = w.between(2, 16) & h.between(2, 16) & (F.abs(w - h) <= 0.25 * F.greatest(w, h)) & (F.col("ink") <= 0.12)
    line = Window.partitionBy("page", F.bround(F.col("y0") / 4)).orderBy("x0")
    return rects.filter(square).withColumn("label_until", F.lead("x0").over(line))


def ruled_fields(lines: DataFrame, cells: DataFrame | None = None, inked: DataFrame | None = None, labels: DataFrame | None = None, least: float = 24.0, apart: float = 22.0, margin: float = 0.6) -> DataFrame:
    """Horizontal rules (page, y, from, to) that are there to be written on.

    Of some length; no other rule within `apart` that meets more than half of its span; not the edge of a cell (page, x0, y0,
    x1, y1) over four fifths of it; no ink (boxes page, x0, y0, x1, y1) in the 11 points above it; and, where labels (page, x0,
    x1, y) are given, one that ends left of it on its line or stands up to 20 points above it. Rules meet in bands of y.
    """
    rules = lines.filter(F.col("to") - F.col("from") >= least)
    length = F.col("to") - F.col("from")
    band = lambda y: F.floor(y / apart)
    other = lines.select("page", F.col("y").alias("oy"), F.col("from").alias("of"), F.col("to").alias("ot"), F.explode(F.array(band(F.col("y")) - 1, band(F.col("y")), band(F.col("y")) + 1)).alias("_b"))
    same = (F.col("oy") == F.col("y")) & (F.col("of") == F.col("from")) & (F.col("ot") == F.col("to"))
    beside = rules.withColumn("_b", band(F.col("y"))).join(other, ["page", "_b"]).filter(~same & (F.abs(F.col("oy") - F.col("y")) <= apart) & (_overlap(F.col("from"), F.col("to"), F.col("of"), F.col("ot")) > 0.5 * length))
    keys = ["page", "y", "from", "to"]
    rules = rules.join(beside.select(*keys).distinct(), keys, "left_anti")
    if cells is not None:
        edges = cells.select("page", "x0", "x1", F.explode(F.array("y0", "y1")).alias("e")).select("page", "x0", "x1", "e", F.explode(F.array(band(F.col("e")) - 1, band(F.col("e")), band(F.col("e")) + 1)).alias("_b"))
        on = rules.withColumn("_b", band(F.col("y"))).join(edges, ["page", "_b"]).filter((F.abs(F.col("e") - F.col("y")) <= margin) & (_overlap(F.col("from"), F.col("to"), F.col("x0"), F.col("x1")) > 0.8 * length))
        rules = rules.join(on.select(*keys).distinct(), keys, "left_anti")
    if inked is not None:
        boxes = inked.select("page", "x0", "x1", "y0", "y1", F.explode(F.sequence(band(F.col("y0")), band(F.col("y1")) + 1)).alias("_b"))
        over = rules.withColumn("_b", band(F.col("y"))).join(boxes, ["page", "_b"]).filter((F.col("y0") < F.col("y") - 0.8) & (F.col("y1") > F.col("y") - 11) & (_overlap(F.col("from") + 0.5, F.col("to") - 0.5, F.col("x0"), F.col("x1")) > 0))
        rules = rules.join(over.select(*keys).distinct(), keys, "left_anti")
    if labels is not None:
        words = labels.select("page", "x0", "x1", F.col("y").alias("wy"), F.explode(F.array(band(F.col("y")), band(F.col("y")) + 1)).alias("_b"))
        left = (F.col("x1") <= F.col("from")) & (F.abs(F.col("wy") - F.col("y")) <= 4)
        above = (F.col("wy") < F.col("y")) & (F.col("y") - F.col("wy") <= 20) & (_overlap(F.col("from"), F.col("to"), F.col("x0"), F.col("x1")) > 0)
        told = rules.withColumn("_b", F.explode(F.array(band(F.col("y")), band(F.col("y")) + 1))).join(words, ["page", "_b"]).filter(left | above)
        rules = rules.join(told.select(*keys).distinct(), keys, "left_semi")
    return rules


def dotted_borders(dots: DataFrame, least: int = 6, spread: float = 0.25) -> DataFrame:
    """Regular rows of dots as lines: page, y, from, to. The step is the median one; at least 80 % are near it; ends reach half a step out."""
    w = Window.partitionBy("page", "y").orderBy("x")
    steps = dots.withColumn("_step", F.col("x") - F.lag("x").over(w))
    rows = steps.groupBy("page", "y").agg(F.count("*").alias("n"), F.median("_step").alias("step"), F.collect_list("_step").alias("all"), F.min("x").alias("a"), F.max("x").alias("b")).filter(F.col("n") >= least)
    regular = F.size(F.filter("all", lambda s: F.abs(s - F.col("step")) <= spread * F.col("step"))) >= 0.8 * F.size("all")
    return rows.filter(regular).select("page", "y", (F.col("a") - F.col("step") / 2).alias("from"), (F.col("b") + F.col("step") / 2).alias("to"))


def capacity(kind: Column, many: Column, width: Column) -> Column:
    """Characters that a place holds."""
    return F.when(kind == "celle", F.coalesce(many, F.greatest(F.lit(1), F.floor(width / 4.2)))).when(kind == "casella", 1).otherwise(F.greatest(F.lit(1), F.floor(width / 4.2)))


def anchor_id(page: Column, kind: Column, x: Column, y: Column) -> Column:
    """p<page>.<kind>.<x>-<y>, places rounded half to even."""
    return F.format_string("p%d.%s.%03d-%03d", page, kind, F.bround(x, 0).cast("int"), F.bround(y, 0).cast("int"))


def spill(cells: DataFrame) -> DataFrame:
    """Ink gained around a written place (id, gain, neighbour_gain of each side of its ring), neighbours' own gains taken off."""
    return cells.groupBy("id").agg(F.sum(F.greatest(F.col("gain") - F.col("neighbour_gain"), F.lit(0))).alias("spill"))


def completed_grid(bars: DataFrame, uprights: DataFrame, least: int = 3, share: float = 0.75, margin: float = 0.6) -> DataFrame:
    """The outer uprights that an open table lacks: page, x, from, to. A table is `least` bars or more of which `share` have one span."""
    spans = bars.groupBy("page", F.bround("from").alias("a"), F.bround("to").alias("b")).agg(F.count("*").alias("n"), F.min("y").alias("top"), F.max("y").alias("low"), F.min("from").alias("x0"), F.max("to").alias("x1"))
    total = bars.groupBy("page").agg(F.count("*").alias("bars"))
    tables = spans.join(total, "page").filter((F.col("n") >= least) & (F.col("n") >= share * F.col("bars")))
    edges = tables.select("page", F.explode(F.array("x0", "x1")).alias("x"), F.col("top").alias("from"), F.col("low").alias("to"))
    near = uprights.select("page", F.bround("x").alias("_x"), F.col("x").alias("ux"))
    return edges.withColumn("_x", F.explode(F.array(F.bround("x") - 1, F.bround("x"), F.bround("x") + 1))).join(near, ["page", "_x"], "left").groupBy("page", "x", "from", "to").agg(F.min(F.abs(F.col("ux") - F.col("x"))).alias("d")).filter(F.coalesce(F.col("d") > margin, F.lit(True))).select("page", "x", "from", "to")


def ink(pixels: DataFrame, dark: int = 160) -> DataFrame:
    """Box and number of the dark pixels of each clip (clip, x, y, value)."""
    return pixels.filter(F.col("value") < dark).groupBy("clip").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))


def fitting_size(text: Column, widths: Column, room: Column, size: float = 10.0, least: float = 4.5) -> Column:
    """The largest size, by quarter points, at which a text fits; null if none does. widths: of characters in ems; others take half an em."""
    ems = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0.0), lambda acc, c: acc + F.coalesce(F.try_element_at(widths, c), F.lit(0.5)))
    sizes = F.transform(F.sequence(F.lit(0), F.lit(int((size - least) * 4))), lambda k: F.lit(size) - k * 0.25)
    return F.get(F.filter(sizes, lambda s: s * ems <= room), F.lit(0))


def sides(rects: DataFrame) -> DataFrame:
    """page, axis, at, from, to: the four sides of rectangles (page, x0, y0, x1, y1) as segments."""
    side = lambda axis, at, a, b: F.struct(F.lit(axis).alias("axis"), F.col(at).alias("at"), F.col(a).alias("from"), F.col(b).alias("to"))
    four = F.array(side("h", "y0", "x0", "x1"), side("h", "y1", "x0", "x1"), side("v", "x0", "y0", "y1"), side("v", "x1", "y0", "y1"))
    return rects.select("page", F.explode(four).alias("s")).select("page", "s.*")


def upright(turn: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """A place (x, y) on a page of a width and height that is turned by 0, 90, 180 or 270 degrees, as if it stood upright."""
    place = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.when(turn == 90, place(height - y, x)).when(turn == 180, place(width - x, height - y)).when(turn == 270, place(y, width - x)).otherwise(place(x, y))


def body_sizes(glyphs: DataFrame) -> DataFrame:
    """page, body: the most frequent rounded size (half to even) of a page's glyphs, the smaller of equals."""
    sizes = glyphs.groupBy("page", F.bround("size", 0).alias("body")).agg(F.count("*").alias("n"))
    return sizes.groupBy("page").agg(F.min_by("body", F.struct(-F.col("n"), "body")).alias("body"))


def row_steps(dots: DataFrame, spread: float = 0.25) -> DataFrame:
    """page, y, n, step (the median distance of neighbours) and regular (how many distances are within `spread` of it, as a share)."""
    w = Window.partitionBy("page", "y").orderBy("x")
    steps = dots.withColumn("_step", F.col("x") - F.lag("x").over(w))
    rows = steps.groupBy("page", "y").agg(F.count("*").alias("n"), F.median("_step").alias("step"), F.collect_list("_step").alias("_all"))
    near = F.size(F.filter("_all", lambda s: F.abs(s - F.col("step")) <= spread * F.col("step"))) / F.size("_all")
    return rows.select("page", "y", "n", "step", F.when(F.size("_all") > 0, near).alias("regular"))


#: Glyphs that are boxes to be ticked, and the longest label.
BOXES, LABEL_CHARS = ("□", "☐", "❏", "❑", "◻"), 90


def line_labels(rects: DataFrame, glyphs: DataFrame, left: bool) -> DataFrame:
    """page, rect, label: the text beside rectangles (page, rect, x0, y0, x1, y1) on their line, from glyphs (page, x, y, size, text).

    Looking left it begins after the rectangle before on the line and after the last box glyph; looking right it ends at the next
    rectangle. Filler runs bound it too. Glyphs meet the rectangles of their band of y.
    """
    base = F.col("y1") if left else (F.col("y0") + F.col("y1")) / 2
    line = Window.partitionBy("page", F.bround(F.col("y0") / 4)).orderBy("x0", "rect")
    edge = F.lag("x1").over(line) if left else F.lead("x0").over(line)
    band = lambda y: F.floor(y / CELL)
    r = rects.withColumns({"_base": base, "_edge": edge}).withColumn("_b", band(F.col("_base")))
    g = glyphs.select("page", F.col("x").alias("gx"), F.col("y").alias("gy"), "size", "text", F.explode(F.array(band(F.col("y")) - 1, band(F.col("y")), band(F.col("y")) + 1)).alias("_b"))
    near = F.abs(F.col("gy") - F.col("_base")) <= (F.greatest(F.lit(2.0), F.col("size") * 0.5) if left else F.greatest(F.lit(3.0), F.col("size") * 0.75))
    if left:
        inside = (F.col("gx") < F.col("x0") - 0.2) & F.coalesce(F.col("gx") >= F.col("_edge") - 0.2, F.lit(True))
    else:
        inside = (F.col("gx") >= F.col("x1") - 0.2) & F.coalesce(F.col("gx") < F.col("_edge") - 0.2, F.lit(True))
    found = r.join(g, ["page", "_b"]).filter(near & inside).groupBy("page", "rect").agg(F.array_sort(F.collect_list(F.struct("gx", "text"))).alias("t"), F.max(F.when(F.col("text").isin(*BOXES), F.col("gx"))).alias("_box"))
    own = F.filter("t", lambda z: F.coalesce(z.gx > F.col("_box"), F.lit(True))) if left else F.col("t")
    label = clean_label(F.array_join(F.transform(own, lambda z: z.text), ""), left)
    cut = F.when(F.length(label) > LABEL_CHARS, F.substr(label, F.length(label) - LABEL_CHARS + 1) if left else F.substring(label, 1, LABEL_CHARS)).otherwise(label)
    return found.select("page", "rect", F.trim(cut).alias("label"))


def verified_cells(cells: DataFrame) -> DataFrame:
    """id, crossed, empty, stray, reason of values written into cells (id, value, place from 0, gain of ink in the cell, divider: gain on its left edge).

    Every character expected left ink, no other cell did, no divider was crossed; null reason: all of it holds.
    """
    expected = (F.col("place") < F.length("value")) & (F.substr("value", F.col("place") + 1, F.lit(1)) != " ")
    out = cells.groupBy("id").agg(
        F.count_if((F.col("place") > 0) & (F.col("divider") > 2)).alias("crossed"),
        F.count_if(expected & (F.col("gain") <= 0)).alias("empty"),
        F.count_if(~expected & (F.col("gain") > 2)).alias("stray"),
    )
    return out.withColumn("reason", F.when(F.col("crossed") > 0, "dividers crossed").when(F.col("empty") > 0, "cells left empty").when(F.col("stray") > 0, "stray ink"))


def box_problem(value: Column, gain: Column, outside: Column, area: Column) -> Column:
    """Why a tick (value yes or no, null: neither) failed, from the ink gained inside and outside of a box of so many pixels; null if it did not."""
    return (
        F.when(value.isNull(), "needs yes or no")
        .when(~value & ((gain > 2) | (outside > 2)), "should be empty")
        .when(value & (gain < area * 0.02), "no mark inside")
        .when(value & (outside > F.greatest(F.lit(6.0), area * 0.01)), "mark outside")
    )


def write_problem(kind: Column, value: Column, room: Column, ems: Column) -> Column:
    """Why a value cannot be written into a place, null if it can: one character a cell; yes or no in a box; on a line or in an area within its width in ems at the least size. Nothing is cut."""
    blank = F.trim(F.coalesce(value, F.lit(""))) == ""
    return (
        F.when((kind == "casella") & ~F.coalesce(value.isin("true", "false"), F.lit(False)), "needs yes or no")
        .when((kind != "casella") & blank, "blank")
        .when((kind == "celle") & (F.length(value) > room), "too many characters")
        .when(kind.isin("riempimento", "tratto", "area") & (ems > room), "too wide")
        .when(kind.isin("riempimento", "tratto") & F.contains(value, F.lit("\n")), "more than a line")
        .when((kind == "widget") & (room > 0) & (F.length(value) > room), "beyond the field's limit")
    )


def text_lines(glyphs: DataFrame, tolerance: float = 3.0, gap: float = 0.3) -> DataFrame:
    """page, line (from 1, from above), text, base, size, x0, x1, words of glyphs (page, x, y, size, text; without blanks).

    Baselines are put together along y: a line ends where the next glyph's base is more than `tolerance` lower. Within a line glyphs stand by x, and
    a word ends where the next glyph begins more than `gap` of the size behind a glyph's advance (half its size). base and size are the
    medians of the line's glyphs.
    """
    down = Window.partitionBy("page").orderBy("y")
    rows = glyphs.filter("page is not null and y is not null").withColumn("_below", F.coalesce(F.col("y") - F.lag("y").over(down) > tolerance, F.lit(True)))
    rows = rows.withColumn("island", F.sum(F.col("_below").cast("long")).over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("_below")
    w = Window.partitionBy("page", "island").orderBy("x", "y", "text")
    behind = F.col("x") - (F.lag("x").over(w) + F.lag("size").over(w) / 2)
    rows = rows.withColumn("_new", F.coalesce(behind > gap * F.col("size"), F.lit(False)))
    shown = F.array_sort(F.collect_list(F.struct("x", "y", "text", "_new")))
    found = rows.groupBy("page", F.col("island").alias("line")).agg(shown.alias("g"), F.median("y").alias("base"), F.median("size").alias("size"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("size") / 2).alias("x1"), (1 + F.count_if("_new")).alias("words"))
    text = F.array_join(F.transform("g", lambda z: F.concat(F.when(z["_new"], F.lit(" ")).otherwise(F.lit("")), z["text"])), "")
    return found.select("page", "line", text.alias("text"), "base", "size", "x0", "x1", "words")


#: The height of a line in sizes, and the width of a blank in ems.
LEADING, BLANK = 1.2, 0.25


def wrapped_lines(words: Column, room: Column) -> Column:
    """Lines that words (array of their widths in ems) take in a room of so many ems, each line filled as far as it goes; null if a word is wider than the room."""
    start = F.struct(F.lit(0).alias("lines"), F.lit(0.0).alias("used"))

    def put(s: Column, w: Column) -> Column:
        fits = (s["lines"] > 0) & (s["used"] + BLANK + w <= room)
        return F.when(fits, F.struct(s["lines"].alias("lines"), (s["used"] + BLANK + w).alias("used"))).otherwise(F.struct((s["lines"] + 1).alias("lines"), w.alias("used")))

    return F.when(~F.exists(words, lambda w: w > room), F.aggregate(words, start, put)["lines"])


def fitting_area_size(words: Column, width: Column, height: Column, size: float = 10.0, least: float = 4.5) -> Column:
    """The largest size, by quarter points, at which words (array of their widths in ems) fit an area, broken into lines; null if none does."""
    sizes = F.transform(F.sequence(F.lit(0), F.lit(int((size - least) * 4))), lambda k: F.lit(size) - k * 0.25)
    return F.get(F.filter(sizes, lambda s: F.coalesce(wrapped_lines(words, width / s) * LEADING * s <= height, F.lit(False))), F.lit(0))


#: Points of a tile's side, and pixels of one of a picture: what lies in a tile of a page is one row.
TILE, DOTS = 64.0, 16


def tiles(rows: DataFrame, low: tuple[str, str], high: tuple[str, str], columns: list[str], side: float = TILE) -> DataFrame:
    """page, _l, _u, _r, _d, _all: the rows of each tile of a page, by their places `low` (names of x and y), with the bounds of all of them up to `high`.

    Partitioned by page, as what is joined with it by page is after a window over pages: then nothing but the rows themselves is shuffled, and once.
    """
    tile = [F.floor(F.col(c) / side).alias(f"_t{k}") for k, c in enumerate(low)]
    bounds = [f(c).alias(n) for f, c, n in ((F.min, low[0], "_l"), (F.min, low[1], "_u"), (F.max, high[0], "_r"), (F.max, high[1], "_d"))]
    return rows.groupBy("page", *tile).agg(*bounds, F.collect_list(F.struct(*columns)).alias("_all")).drop("_t0", "_t1")


def ink_tiles(pixels: DataFrame, dark: int = 160) -> DataFrame:
    """The dark pixels (page, x, y, value) of each tile of a page's picture, each place once with their number n."""
    counts = pixels.filter(F.col("value") < dark).select("page", "x", "y").repartition("page").groupBy("page", "x", "y").agg(F.count("*").alias("n"))
    return tiles(counts, ("x", "y"), ("x", "y"), ["x", "y", "n"], DOTS)


def ink_within(rects: DataFrame, inked: DataFrame) -> DataFrame:
    """page, id, ink: dark pixels in each rectangle (page, id, x0, y0, x1, y1 in whole pixels, ends not included), counted in the tiles that it meets."""
    t = inked.withColumnRenamed("page", "_page")
    meets = (F.col("_l") < F.col("x1")) & (F.col("_r") >= F.col("x0")) & (F.col("_u") < F.col("y1")) & (F.col("_d") >= F.col("y0"))
    inside = F.filter("_all", lambda p: (p["x"] >= F.col("x0")) & (p["x"] < F.col("x1")) & (p["y"] >= F.col("y0")) & (p["y"] < F.col("y1")))
    met = rects.join(t, (F.col("page") == F.col("_page")) & meets, "left").withColumn("_n", F.aggregate(inside, F.lit(0).cast("long"), lambda a, p: a + p["n"]))
    return met.groupBy("page", "id").agg(F.sum(F.coalesce("_n", F.lit(0).cast("long"))).alias("ink"))
