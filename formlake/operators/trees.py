"""Marked-up texts as trees, digests of their subtrees, and what changed between two versions of them."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from formlake.rounds import settled

#: Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Elements whose end tag may be missing. What they hold stands beside them, so a missing end does not put all that follows inside.
OPTIONAL = ("p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "optgroup", "colgroup", "caption", "rp", "rt")
_TOKEN = r"(?s)(<!--.*?-->|<[^>]*>|[^<]+|<)"


def tokens(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 0), token, name (of a tag, in lower case; else empty), kind (open, close, leaf; end: of an element that holds nothing): the tags of a text and what stands between them."""
    rows = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))).alias("pos", "token"))
    name = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9:]*)", 1))
    end = F.col("token").startswith("</")
    leaf = (F.col("name") == "") | F.col("name").isin(*VOID) | F.col("token").endswith("/>")
    kind = F.when(F.col("name").isin(*OPTIONAL), F.when(end, "end").otherwise("leaf")).when(leaf, "leaf").when(end, "close").otherwise("open")
    return rows.withColumn("name", name).withColumn("kind", kind)


def nodes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, depth (from 0), parent (pos, null at the top), label (the token): the tree of each text.

    A running sum over tags gives the depth; an end tag at the top closes nothing. The parent is the last node before, one level up, that was opened: one
    window over the levels of a text, in which children of a level stand among the parents of the level above.
    """
    along = Window.partitionBy(key).orderBy("pos")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    rows = tokens(texts, key, text).withColumn("_sum", F.sum(step).over(along))
    # End tags beyond the open ones lower the sum for good; the lowest sum so far is the ground.
    ground = F.least(F.min("_sum").over(along), F.lit(0))
    rows = rows.withColumn("depth", (F.col("_sum") - ground - F.when(F.col("kind") == "open", 1).otherwise(0)).cast("int")).filter("kind not in ('close', 'end')")
    own = rows.select(key, "pos", "depth", F.col("token").alias("label"), F.col("depth").alias("_level"), F.lit(None).cast("int").alias("_open"))
    above = rows.filter("kind = 'open'").select(key, "pos", "depth", F.col("token").alias("label"), (F.col("depth") + 1).alias("_level"), F.col("pos").alias("_open"))
    w = Window.partitionBy(key, "_level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    found = own.unionByName(above).withColumn("parent", F.last("_open", ignorenulls=True).over(w))
    return found.filter("_open is null").select(key, "pos", "depth", "parent", "label")


def _digest(label: Column, below: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.sha2(label, 256), F.array_join(below, ",")), 256)


def digests(tree: DataFrame, key: str) -> DataFrame:
    """tree with place (number among its parent's children) and digest: of the node's label and its children's digests in order. A round for each level, from the deepest up."""
    place = F.row_number().over(Window.partitionBy(key, "parent").orderBy("pos")).cast("int")
    tree = settled(tree.withColumn("place", place))
    deepest = tree.agg(F.max("depth")).first()[0]
    none = F.array().cast("array<string>")
    done, level = None, None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        own = tree.filter(F.col("depth") == depth)
        if level is not None:
            below = level.groupBy(key, F.col("parent").alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]).alias("_below"))
            own = own.join(below, [key, "pos"], "left")
        else:
            own = own.withColumn("_below", none)
        level = settled(own.withColumn("digest", _digest(F.col("label"), F.coalesce("_below", none))).drop("_below"))
        done = level if done is None else done.unionByName(level)
    return tree.withColumn("digest", F.lit("")) if done is None else done


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, path, pos (before), old, new: labels that differ between two versions of trees with digests; null: not there.

    Level by level, only children of nodes whose digests differ are compared (an outer join by path), so equal subtrees cost nothing. What is
    missing on one side is told by its topmost node.
    """
    cut = lambda t, side: t.select(key, F.col("parent").alias(f"{side}parent"), "place", F.col("pos").alias(side), F.col("label").alias(f"{side}label"), F.col("digest").alias(f"{side}digest"))
    a, b = cut(before, "a"), cut(after, "b")
    top = a.filter("aparent is null").join(b.filter("bparent is null"), [key, "place"], "full")
    level, out = settled(top.withColumn("path", F.col("place").cast("string"))), None
    while True:
        level = settled(level.filter("not (adigest <=> bdigest)"))
        if level.isEmpty():
            break
        told = level.filter("not (alabel <=> blabel)").select(key, "path", F.col("a").alias("pos"), F.col("alabel").alias("old"), F.col("blabel").alias("new"))
        out = told if out is None else out.unionByName(told)
        both = level.filter("a is not null and b is not null").select(key, F.col("a").alias("aparent"), F.col("b").alias("bparent"), F.col("path").alias("_path"))
        left = both.select(key, "aparent", "bparent", "_path").join(a, [key, "aparent"]).drop("aparent")
        right = both.select(key, "aparent", "bparent", "_path").join(b, [key, "bparent"]).drop("bparent", "aparent")
        level = left.drop("bparent").join(right, [key, "_path", "place"], "full").withColumn("path", F.concat_ws("/", "_path", F.col("place").cast("string")))
    return out if out is not None else level.select(key, "path", F.col("a").alias("pos"), F.col("alabel").alias("old"), F.col("blabel").alias("new"))


@lru_cache(4096)
def _kind(tag: str) -> str:
    """As in tokens(), of a tag."""
    found = re.match("</?([A-Za-z][A-Za-z0-9:]*)", tag)
    name, end = found[1].lower() if found else "", tag.startswith("</")
    if name in OPTIONAL:
        return "end" if end else "leaf"
    return "leaf" if not name or name in VOID or tag.endswith("/>") else "close" if end else "open"


def _children(text: str) -> dict[int, list[tuple[int, str]]]:
    """Of each node of a text that may hold others (-1: the top) what it holds, in order: pos and label."""
    below, opened = {-1: []}, [-1]
    for pos, token in enumerate(re.findall(_TOKEN, text)):
        kind = _kind(token) if token[0] == "<" else "leaf"
        if kind == "close":
            if len(opened) > 1:
                opened.pop()
        elif kind != "end":
            below[opened[-1]].append((pos, token))
            if kind == "open":
                opened.append(pos)
                below[pos] = []
    return below


@F.arrow_udf(ArrayType(StructType().add("path", StringType()).add("pos", IntegerType()).add("old", StringType()).add("new", StringType())))
def text_changes(before: pa.Array, after: pa.Array) -> pa.Array:
    """The path, pos, old and new of changes() between two versions of a text that stand in one row: their trees are walked side by side, at any depth."""
    ends, paths, places, olds, news = [0], [], [], [], []
    for one, other in zip(before.to_pylist(), after.to_pylist(), strict=True):
        a, b = (_children(t or "") if one != other else {} for t in (one, other))
        todo = [(-1, -1, "")]
        for p, q, above in todo:
            for place, (x, y) in enumerate(zip_longest(a.get(p, ()), b.get(q, ()), fillvalue=(None, None)), 1):
                if x[1] != y[1]:
                    paths.append(f"{above}{place}")
                    places.append(x[0])
                    olds.append(x[1])
                    news.append(y[1])
                if x[0] in a and y[0] is not None or y[0] in b and x[0] is not None:
                    todo.append((x[0], y[0], f"{above}{place}/"))
        ends.append(len(paths))
    rows = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(places, pa.int32()), pa.array(olds, pa.string()), pa.array(news, pa.string())], ["path", "pos", "old", "new"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def placement_problems(changed: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """changed (key, pos, new) with reason: a change of a node that an edit (key, pos, new) names and that made its label is in order (null); others are not."""
    planned = allowed.select(key, "pos", F.col("new").alias("_new"), F.lit(True).alias("_there"))
    reason = F.when(F.col("_there").isNull(), "change that nobody planned").when(~F.col("new").eqNullSafe(F.col("_new")), "not what was planned")
    return changed.join(planned, [key, "pos"], "left").withColumn("reason", reason).drop("_new", "_there")
