"""Form-shaped views of the driver tables, for Spark, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.tables import table

RUNS = r"#{3,}|%{3,}|\*{3,}|\${3,}|&{3,}"
DIGITS = r"\b[0-9]{16}\b"
MAIL = r"[A-Za-z0-9.]+@[A-Za-z0-9.]+"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n (from 0), line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n").cast("long"))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, sha, pages, chars, scanned: one row for each distinct text."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("sha")).agg(
        F.min("doc_id").alias("id"),
        F.max(F.size(F.split("text", "\n"))).cast("long").alias("pages"),
        F.max("n_chars").alias("chars"),
        F.max(F.when(F.col("n_chars") < 50, 1).otherwise(0)).cast("long").alias("scanned"),
    )


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """form, n, kind, many, side: places found on lines."""
    rows = lines(spark, sf_dir)
    runs = F.regexp_extract_all("line", F.lit(f"({RUNS})"), F.lit(1))
    digits = F.regexp_extract_all("line", F.lit(f"({DIGITS})"), F.lit(1))
    mail = F.regexp_extract_all("line", F.lit(f"({MAIL})"), F.lit(1))
    none = F.lit(None).cast("double")
    many = lambda name, what, count, side: F.when(count > 0, F.struct(F.lit(name).alias("kind"), what.cast("long").alias("many"), side.alias("side")))
    found = F.array(
        many("riempimento", F.size(runs), F.size(runs), none),
        many("celle", F.length(F.get(digits, F.lit(0))), F.size(digits), none),
        many("area", F.lit(None), F.size(mail), none),
        many("casella", F.lit(None), F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit(""))), F.length("line") * 0.25),
    )
    # Lines without any of the marks make no rows; the test of one byte class keeps most lines out of the four patterns.
    return rows.filter(F.col("line").rlike(r"[#%*$&|@0-9]")).select("doc_id", "n", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(F.col("doc_id").alias("form"), "n", "x.kind", "x.many", "x.side")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """form, kind, state, reason: what became of a form's place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.split("text", "\n")[0].alias("reason"))
    state = F.when(F.col("toxic") == 1, "non_segnalata").when(F.col("quality") == 0, "non_riuscita").otherwise("verificata")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("form"), F.col("lang").alias("kind"), state.alias("state"), "reason")


LINES_SQL = "lines as (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as n, unnest(string_split(text, chr(10))) as line from documents)"
FORMS_SQL = "forms as (select sha256(text) as sha, min(doc_id) as id, max(len(string_split(text, chr(10))))::bigint as pages, max(n_chars) as chars, max(case when n_chars < 50 then 1 else 0 end)::bigint as scanned from documents group by sha256(text))"
ANCHORS_SQL = (
    LINES_SQL
    + rf""",
marks as (select *, len(regexp_extract_all(line, '{RUNS}')) as runs, regexp_extract_all(line, '{DIGITS}') as digits, len(regexp_extract_all(line, '{MAIL}')) as mails, length(line) - length(replace(line, '|', '')) as bars from lines),
anchors as (
  select doc_id as form, n, 'riempimento' as kind, runs::bigint as many, null::double as side from marks where runs > 0
  union all select doc_id, n, 'celle', length(digits[1])::bigint, null from marks where len(digits) > 0
  union all select doc_id, n, 'area', null, null from marks where mails > 0
  union all select doc_id, n, 'casella', null, length(line) * 0.25::double from marks where bars > 0)"""
)
OUTCOMES_SQL = "outcomes as (select doc_id as form, lang as kind, case when toxic = 1 then 'non_segnalata' when quality = 0 then 'non_riuscita' else 'verificata' end as state, string_split(text, chr(10))[1] as reason from labels join documents using (doc_id))"
