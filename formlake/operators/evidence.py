"""What stands around a field, what a written page shows of its writing, and which occurrence of a value is meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.functions.similarity import common_run_ratio
from formlake.functions.text import clean_label
from formlake.operators.geometry import CELL, checkboxes, line_labels, tiles

#: A field's surroundings to the left, above, right and below, characters of a context, the share of old ink that makes new ink
#: illegible, the least likeness of a context, and open points that a report names.
AROUND, CONTEXT_CHARS, OLD_INK, LIKE, NAMED = (90.0, 34.0, 90.0, 12.0), 200, 0.12, 0.35, 12


def contexts(fields: DataFrame, lines: DataFrame) -> DataFrame:
    """page, id, context: the lines (page, x0, y0, x1, y1, text) that cross a field (page, id, x0, y0, x1, y1), else those in its surroundings, in reading order without filler runs, the first 200 characters."""
    left, up, right, down = AROUND
    text = clean_label(F.col("text"), False)
    at = tiles(lines.select("page", "x0", "y0", "x1", "y1", text.alias("t")).repartition("page"), ("x0", "y0"), ("x1", "y1"), ["y0", "x0", "t", "x1", "y1"]).withColumnRenamed("page", "_page")
    near = (F.col("_l") < F.col("x1") + right) & (F.col("_r") > F.col("x0") - left) & (F.col("_u") < F.col("y1") + down) & (F.col("_d") > F.col("y0") - up)
    meets = lambda l, u, r, d: (F.col("_z.x0") < F.col("x1") + r) & (F.col("_z.x1") > F.col("x0") - l) & (F.col("_z.y0") < F.col("y1") + d) & (F.col("_z.y1") > F.col("y0") - u)  # noqa: E731, E741
    met = fields.select("page", "id", "x0", "y0", "x1", "y1").join(at, (F.col("page") == F.col("_page")) & near).select("page", "id", "x0", "y0", "x1", "y1", F.explode("_all").alias("_z"))
    found = met.filter(meets(left, up, right, down)).select("page", "id", F.struct("_z.y0", "_z.x0", "_z.t", meets(0, 0, 0, 0).alias("on")).alias("z"))
    both = found.groupBy("page", "id").agg(F.array_sort(F.collect_set("z")).alias("b"))
    crossing = F.filter("b", lambda z: z["on"])
    shown = F.filter(F.transform(F.when(F.size(crossing) > 0, crossing).otherwise(F.col("b")), lambda z: z["t"]), lambda t: t != "")
    return both.select("page", "id", F.substring(F.array_join(shown, " "), 1, CONTEXT_CHARS).alias("context"))


def boxes(rects: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Near-square hollow boxes (page, rect, x0, y0, x1, y1, ink) with the text to their right, up to the next box, as label."""
    found = checkboxes(rects).drop("label_until")
    return found.join(line_labels(found.select("page", "rect", "x0", "y0", "x1", "y1"), glyphs, False), ["page", "rect"], "left")


def widget_label(*labels: Column, name: Column) -> Column:
    """The first printed label that is not blank, else the widget's internal name."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in labels], name)


def legibility(pixels: DataFrame) -> DataFrame:
    """id, ratio, illegible: old ink on the pixel rows (id, y, old, now) that gained ink, over the new."""
    gained = pixels.filter("now > old").groupBy("id").agg((F.sum("old") / F.sum(F.col("now") - F.col("old"))).alias("ratio"))
    return gained.withColumn("illegible", F.col("ratio") > OLD_INK)


def rises(fields: DataFrame, ink: DataFrame, most: float = 40.0, margin: float = 1.0) -> DataFrame:
    """page, id, rise: how far a field on a line (page, id, x0, x1, y) may rise before it meets ink (page, x0, x1, y)."""
    band = lambda y: F.floor(y / CELL)
    marks = ink.select("page", F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("y").alias("iy"), band(F.col("y")).alias("_b"))
    near = fields.withColumn("_b", F.explode(F.sequence(band(F.col("y") - most), band(F.col("y"))))).join(marks, ["page", "_b"])
    gap = near.filter((F.col("iy") < F.col("y") - margin) & (F.col("y") - F.col("iy") <= most) & (F.col("a") < F.col("x1")) & (F.col("b") > F.col("x0")))
    least = gap.groupBy("page", "id").agg(F.min(F.col("y") - F.col("iy")).alias("_d"))
    return fields.join(least, ["page", "id"], "left").select("page", "id", F.coalesce("_d", F.lit(most)).alias("rise"))


def best_occurrences(hits: DataFrame, context: str = "context", wanted: str = "wanted") -> DataFrame:
    """id, page: of a value's occurrences the page whose context is most like the wanted one, if like enough; of equals the first page."""
    scored = hits.withColumn("_r", common_run_ratio(F.col(context), F.col(wanted))).filter(F.col("_r") >= LIKE)
    return scored.groupBy("id").agg(F.max_by("page", F.struct("_r", -F.col("page"))).alias("page"))


def settled_proposals(proposals: DataFrame) -> DataFrame:
    """slot, field, state of proposals (slot, round, field): two fields for a slot in one round are a conflict, and a slot that had one never gets a value again; a field proposed twice in its last round is doubtful."""
    per = proposals.groupBy("slot", "round").agg(F.countDistinct(F.coalesce("field", F.lit(""))).alias("fields"), F.count("*").alias("n"), F.min("field").alias("field"))
    last = per.groupBy("slot").agg(F.max("fields").alias("most"), F.max(F.struct("round", "n", "field")).alias("x"))
    state = F.when(F.col("most") > 1, "conflict").when(F.col("x.n") > 1, "dubbio").otherwise("assegna")
    return last.select("slot", F.when(state != "conflict", F.col("x.field")).alias("field"), state.alias("state"))


def suspended(decisions: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """decisions with the state of those on pages (keys) whose reader failed set to sospesa, with the reason."""
    bad = failed.select(*keys).distinct().withColumn("_bad", F.lit(True))
    rows = decisions.join(bad, keys, "left")
    return rows.withColumns({"state": F.when(F.col("_bad"), "sospesa").otherwise(F.col("state")), "why": F.when(F.col("_bad"), "pagina non riletta")}).drop("_bad")


def implicit_slots(lines: DataFrame, taken: DataFrame, keys: list[str], text: str, most: int = 60) -> DataFrame:
    """The lines (keys) of 1 to `most` characters without a place of their own (taken): a value may be added there."""
    return lines.filter(F.length(F.trim(text)).between(1, most)).join(taken.select(*keys).distinct(), keys, "left_anti").select(*keys)


def reviewed(before: DataFrame, after: DataFrame, pages: int = 6) -> DataFrame:
    """id, state, key of the decisions (form, page, id, state, key) on a form's first `pages` pages that a reviewer (id, state, key) changed."""
    seen = before.withColumn("_p", F.dense_rank().over(Window.partitionBy("form").orderBy("page"))).filter(F.col("_p") <= pages)
    both = seen.join(after.select("id", F.col("state").alias("_s"), F.col("key").alias("_k")), "id")
    changed = ~(F.col("state").eqNullSafe(F.col("_s")) & F.col("key").eqNullSafe(F.col("_k")))
    return both.filter(changed).select("id", F.col("_s").alias("state"), F.col("_k").alias("key"))


def report_lines(forms: DataFrame, opened: DataFrame) -> DataFrame:
    """form, report: a form's verdict (form, state, verified) and its open points (form, point), NAMED of them at most and how many more there are."""
    points = opened.groupBy("form").agg(F.array_sort(F.collect_set("point")).alias("p"))
    rows = forms.join(points, "form", "left").withColumn("p", F.coalesce("p", F.array().cast("array<string>")))
    more = F.when(F.size("p") > NAMED, F.concat(F.lit(" e altri "), (F.size("p") - NAMED).cast("string"))).otherwise(F.lit(""))
    named = F.when(F.size("p") > 0, F.concat(F.lit("; punti aperti: "), F.array_join(F.slice("p", 1, NAMED), ", "), more)).otherwise(F.lit(""))
    return rows.select("form", F.concat(F.col("state"), F.lit(": "), F.col("verified").cast("string"), F.lit(" verificate"), named).alias("report"))
