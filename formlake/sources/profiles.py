"""Company profiles: JSON files with a few sections, read as facts."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Where a profile's data may stand, the first that is there wins.
SECTIONS = ("profilo", "anagrafica", "azienda", "impresa", "dati")


def read_profiles(spark: SparkSession, path: str, real_only: bool = False) -> DataFrame:
    """file, raw of every JSON file; real_only: without those marked as tests."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw"))
    return real_profiles(rows) if real_only else rows


def facts(profiles: DataFrame, raw: str = "raw") -> DataFrame:
    """The input's other columns, section, key, value, status (ok, empty, nested) of the entries of each profile's section."""
    sections = [F.struct(F.lit(s).alias("section"), F.get_json_object(raw, f"$.{s}").alias("body")) for s in SECTIONS]
    flat = F.struct(F.lit("").alias("section"), F.col(raw).alias("body"))
    chosen = F.get(F.filter(F.array(*sections, flat), lambda x: F.coalesce(x.body, F.lit("")).startswith("{")), F.lit(0))
    rows = profiles.withColumn("_s", chosen).select(*[c for c in profiles.columns if c != raw], "_s.section", F.explode(F.from_json("_s.body", "map<string,string>")).alias("key", "value"))
    status = F.when(F.col("value").rlike(r"^\s*[\[{]"), "nested").when(F.trim(F.coalesce("value", F.lit(""))) == "", "empty").otherwise("ok")
    return rows.withColumns({"status": status, "value": F.when(status == "ok", F.col("value"))})


def path_value(raw: Column, path: str) -> Column:
    """The value at a dotted path, null where there is none."""
    return F.get_json_object(raw, "$." + path)


def with_path(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Facts (keys, path, value) after setting paths: a new value replaces, a new path is added."""
    kept = rows.join(changes.select(*keys, "path"), [*keys, "path"], "left_anti")
    return kept.unionByName(changes.select(*rows.columns))


def _leaves(text: str | None) -> list[tuple[str, str]]:
    """Paths and texts of a JSON value's scalars, in order; numbers as they are written. Nulls have none, nor has a text that is no JSON."""
    try:
        value = json.loads(text or "null", parse_int=str, parse_float=str, parse_constant=str, object_pairs_hook=lambda pairs: pairs)
    except (ValueError, RecursionError):
        return []
    out, todo = [], [("", value, False)]
    while todo:
        path, node, pair = todo.pop()
        if isinstance(node, list):
            # An object came as a list of tuples; names within names are joined by dots, places of a list are numbers.
            items = node if node and isinstance(node[0], tuple) else [(str(k), x) for k, x in enumerate(node)]
            todo += [(f"{path}.{k}" if pair else k, x, True) for k, x in reversed(items)]
        elif node is not None and pair:
            out.append((path, str(node).lower() if isinstance(node, bool) else node))
    return out


def flattened(values: DataFrame, raw: str = "raw") -> DataFrame:
    """The input's other columns, path, value of every scalar below an object or list, list places included.

    One pass with one plan for values of any depth (up to 1,000 levels, as Spark's JSON functions); the other columns go along as they are.
    """
    others = [c for c in values.columns if c != raw]
    place = values.columns.index(raw)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_leaves(x) for x in batch.column(place).to_pylist()]
            own = batch.select(others).take(pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())) if others else None
            flat = [x for rows in found for x in rows]
            columns = [*(own.columns if own is not None else []), pa.array([k for k, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*others, "path", "value"])

    schema = StructType([*(values.schema[c] for c in others), StructField("path", StringType()), StructField("value", StringType())])
    return values.mapInArrow(run, schema)


def seeded(existing: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """What is there, and of what is offered only what is missing."""
    return existing.unionByName(offered.join(existing.select(key), key, "left_anti").select(*existing.columns))


def published(df: DataFrame, path: str) -> None:
    """Writes to a new folder; readers see all of it or nothing, as Spark's committer renames at the end."""
    df.write.mode("errorifexists").parquet(path)


def real_profiles(profiles: DataFrame, raw: str = "raw") -> DataFrame:
    """The profiles not marked as tests."""
    return profiles.filter(F.coalesce(F.get_json_object(raw, "$.prova"), F.lit("false")) != "true")


def cases(profiles: DataFrame, raw: str = "raw") -> DataFrame:
    """The input's other columns, path, label: the cases of a profile that can be chosen, neither empty ones nor names with a dot."""
    others = [c for c in profiles.columns if c != raw]
    filled = lambda v: v.startswith("{") & ~v.rlike(r"^\{\s*\}$")
    own = profiles.filter(filled(F.coalesce(F.get_json_object(raw, "$.lavoro_corrente"), F.lit("")))).select(*others, F.lit("lavoro_corrente").alias("path"), F.lit("Lavoro corrente").alias("label"))
    named = profiles.select(*others, F.explode(F.from_json(F.get_json_object(raw, "$.scenari"), "map<string,string>")).alias("k", "v")).filter(~F.contains("k", F.lit(".")) & filled(F.col("v")))
    return own.unionByName(named.select(*others, F.concat(F.lit("scenari."), "k").alias("path"), F.concat(F.lit("Scenario: "), F.replace("k", F.lit("_"), F.lit(" "))).alias("label")))
