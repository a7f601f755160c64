"""Reports over an archive of forms, their places and what became of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def totals(forms: DataFrame) -> DataFrame:
    return forms.agg(F.count("*").alias("forms"), F.sum("pages").alias("pages"), F.sum("scanned").alias("scanned"))


def coverage(measures: DataFrame) -> DataFrame:
    """Sums over the measures without trouble."""
    return measures.filter(F.col("trouble").isNull()).agg(F.count("*").alias("measured"), *[F.sum(c).alias(c) for c in ("fields", "verified", "failed", "silent")])


def by_kind(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy("kind").agg(F.count("*").alias("fields"), F.countDistinct("form").alias("forms"))


def by_length(anchors: DataFrame, kind: str) -> DataFrame:
    """Places of a kind by their length."""
    return anchors.filter((F.col("kind") == kind) & F.col("many").isNotNull()).groupBy("many").agg(F.count("*").alias("fields"), F.countDistinct("form").alias("forms"))


def by_side(anchors: DataFrame) -> DataFrame:
    return anchors.filter(F.col("kind") == "casella").groupBy(F.round("side", 1).alias("side")).agg(F.count("*").alias("fields"), F.countDistinct("form").alias("forms"))


def troubles(outcomes: DataFrame, width: int = 52) -> DataFrame:
    """Reasons, shortened, of what was not verified; an unknown state is left out."""
    rows = outcomes.filter(F.col("state") != "verificata")
    return rows.groupBy("kind", "state", F.substring("reason", 1, width).alias("reason")).agg(F.count("*").alias("many"), F.countDistinct("form").alias("forms"))


def silent_errors(outcomes: DataFrame, forms: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("state") == "non_segnalata").join(forms, outcomes.form == forms.id).select("id", "sha", "kind", "reason")


def forms_without_places(forms: DataFrame, anchors: DataFrame) -> DataFrame:
    return forms.join(anchors.select(F.col("form").alias("id")), "id", "left_anti").select("id", "pages", "scanned")


def latest(measures: DataFrame, key: str, order: list[str], widths: dict[str, int]) -> DataFrame:
    """The last measure of each key; texts cut to their widths."""
    others = [c for c in measures.columns if c not in (key, *order)]
    last = measures.groupBy(key).agg(F.max(F.struct(*order, *others)).alias("_x"))
    rows = last.select(*[F.col(key) if c == key else F.col(f"_x.{c}") for c in measures.columns])
    return rows.withColumns({c: F.substring(c, 1, n) for c, n in widths.items()})


def first_by_hash(rows: DataFrame, key: str, id_column: str) -> DataFrame:
    """Of rows with equal hashes, the id that came first stands for all."""
    return rows.groupBy(key).agg(F.min(id_column).alias("id"), F.count("*").alias("copies"))


def verdict(outcomes: DataFrame, open_points: DataFrame | None = None) -> DataFrame:
    """One state for each form: silent errors outrank failures, failures outrank missing data; nothing verified is never complete."""
    seen = outcomes.groupBy("form").agg(*[F.max(F.when(F.col("state") == s, 1).otherwise(0)).alias(s) for s in ("non_segnalata", "non_riuscita", "verificata")])
    if open_points is not None:
        seen = seen.join(open_points.groupBy("form").agg(F.count("*").alias("n_open")), "form", "left")
    else:
        seen = seen.withColumn("n_open", F.lit(0))
    state = F.when(F.col("non_segnalata") == 1, "errori_non_segnalati").when(F.col("non_riuscita") == 1, "non_riuscito").when((F.coalesce("n_open", F.lit(0)) > 0) | (F.col("verificata") == 0), "mancano_dati").otherwise("completo")
    return seen.select("form", state.alias("state"))


def histogram(rows: DataFrame, column: str, states: list[str]) -> DataFrame:
    """Rows of each state, zero for the states that no row has."""
    spark = rows.sparkSession
    known = spark.range(1).select(F.explode(F.array(*map(F.lit, states))).alias(column))
    return known.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def open_points(anchors: DataFrame, written: DataFrame, notes: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Open points (places not written and not ruled out, with a note's reason where there is one) and rejected notes (unknown or written places)."""
    kept = anchors.join(written.select(*key), key, "left_anti").join(notes.filter("not applies").select(*key), key, "left_anti")
    reasons = notes.filter("applies").groupBy(*key).agg(F.min("reason").alias("reason"))
    opened = kept.join(reasons, key, "left").select(*key, F.coalesce("reason", F.lit("non compilato")).alias("reason"))
    known = notes.filter("applies").join(anchors.select(*key).withColumn("_known", F.lit(True)), key, "left").join(written.select(*key).distinct().withColumn("_written", F.lit(True)), key, "left")
    why = F.when(F.col("_known").isNull(), "ancora sconosciuta").when(F.col("_written"), "campo gia scritto")
    return opened, known.select(*key, why.alias("reason")).filter("reason is not null")


def snapshot_difference(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys added, removed or changed between two snapshots."""
    a, b = before.select(*key, F.col(value).alias("old")), after.select(*key, F.col(value).alias("new"))
    a, b = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return a.join(b, key, "full").select(*key, "old", "new", change.alias("change")).filter("change is not null")


#: The tables of an archive of measured forms.
TABLES = {
    "moduli": "id bigint, sha string, ente string, pagine int, caratteri bigint, scansione boolean",
    "misure": "modulo bigint, quando timestamp, ancore int, scritte int, verificate int, errori int",
    "ancore": "modulo bigint, id string, tipo string, pagina int, quante int, lato double",
    "esiti": "modulo bigint, ancora string, stato string, motivo string",
}


def opened(spark: SparkSession, folder: str, tables: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables of an archive by name; those that are not there yet are made empty, those that are stay as they are."""
    out = {}
    for name, schema in (tables or TABLES).items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")
        out[name] = spark.read.schema(schema).parquet(f"{folder}/{name}")
    return out
