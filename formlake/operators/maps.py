"""Maps of documents: pages with numbered places, their prose with holes, and digests that hold for any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rendered_lines(lines: DataFrame, pattern: str) -> DataFrame:
    """lines (doc, page, n, text) with places (array of number, start, length), shown and digest.

    A place is what the pattern finds. Places are numbered from 1 along their page; `shown` has a number in brackets for each. The digest is of
    what is shown and of each place's line, start and length. The marks used between (U+0001, U+0002) are taken out of texts first.
    """
    clean = F.translate(F.coalesce("text", F.lit("")), "\x01\x02", "")
    rows = lines.select("doc", "page", "n", F.split(F.regexp_replace(clean, f"({pattern})", "\x01$1\x02"), "[\x01\x02]").alias("p"))
    before = Window.partitionBy("doc", "page").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("base", F.coalesce(F.sum(F.floor(F.size("p") / 2)).over(before), F.lit(0)).cast("int"))
    number = lambda i: F.col("base") + ((i + 1) / 2).cast("int")
    # One pass over the pieces: what is shown, and where the next piece begins.
    start = F.struct(F.lit("").alias("shown"), F.lit(0).alias("at"), F.array().cast("array<struct<number:int,start:int,length:int>>").alias("places"))
    pieces = F.transform("p", lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def put(s, q):
        odd = q["i"] % 2 == 1
        place = F.struct(number(q["i"]).alias("number"), s["at"].alias("start"), F.length(q["x"]).alias("length"))
        shown = F.concat(s["shown"], F.when(odd, F.concat(F.lit("["), number(q["i"]).cast("string"), F.lit("]"))).otherwise(q["x"]))
        return F.struct(shown.alias("shown"), (s["at"] + F.length(q["x"])).alias("at"), F.when(odd, F.concat(s["places"], F.array(place))).otherwise(s["places"]).alias("places"))

    rows = rows.withColumn("m", F.aggregate(pieces, start, put)).select("doc", "page", "n", "m.shown", "m.places")
    where = F.array_join(F.transform("places", lambda z: F.concat_ws(":", F.col("n").cast("string"), z["start"].cast("string"), z["length"].cast("string"))), ",")
    return rows.withColumn("digest", F.sha2(F.concat("shown", F.lit("\n"), where), 256))


def pages(lines: DataFrame) -> DataFrame:
    """doc, page, lines, places, digest of rendered lines: the digest is of the lines' digests in order."""
    ordered = F.array_sort(F.collect_list(F.struct("n", "digest")))
    found = lines.groupBy("doc", "page").agg(F.count("*").alias("lines"), F.sum(F.size("places")).alias("places"), ordered.alias("o"))
    return found.select("doc", "page", "lines", "places", F.sha2(F.array_join(F.transform("o", lambda x: x["digest"]), "\n"), 256).alias("digest"))


def with_owner(rows: DataFrame) -> DataFrame:
    """rows of pages with owner: the least document that has a page of this digest, whose measures serve all others. A digest that a third of all pages share is put together before it is joined."""
    return rows.join(rows.groupBy("digest").agg(F.min("doc").alias("owner")), "digest")


def maps(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """doc, pages, places, reused (pages that another document owns), digest: of the source's own digest (doc, sha) and the pages' in order."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "digest")))
    found = rows.groupBy("doc").agg(F.count("*").alias("pages"), F.sum("places").alias("places"), F.count_if(F.col("owner") != F.col("doc")).alias("reused"), ordered.alias("o")).join(sources, "doc")
    return found.select("doc", "pages", "places", "reused", F.sha2(F.concat_ws("\n", "sha", F.array_join(F.transform("o", lambda x: x["digest"]), "\n")), 256).alias("digest"))
