"""Queries over measured pages, profiles and edits that Spark derives from the driver tables.

A derived table is one SELECT that both engines run: {name} stands for a driver table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake.functions import formats
from formlake.functions import text as T
from formlake.functions.similarity import common_run_ratio
from formlake.operators import claims, culprits, evidence, geometry, maps, open_grids, rules, sequences, word_points
from formlake.plans import views
from formlake.plans.registry import query
from formlake.sources import profiles
from formlake.tables import table


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The rows of a SELECT over driver tables."""
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in set(re.findall(r"\{(\w+)\}", text))})


def duck(text: str) -> str:
    """The same SELECT as DuckDB reads it."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


#: Pages of measured boxes, some sixty each: lineitem rows of sixteen orders.
BOXES = """
select page, cast(row_number() over (partition by page order by k, n, p, s, e, d) as bigint) as id, x0, y0, x0 + w as x1, y0 + h as y1, n, p
from (select cast(floor(l_orderkey / 16) as bigint) as page, l_orderkey as k, l_linenumber as n, l_partkey as p, l_suppkey as s, l_extendedprice as e, l_discount as d,
             cast(floor(l_extendedprice % 400) as double) as x0, l_quantity * 4 as y0, 10 + round(l_discount * 100) * 3 as w, 6 + round(l_tax * 100) * 2 as h from {lineitem}) t"""
#: One word for each box, elsewhere on its page.
WORDS = """
select cast(floor(l_orderkey / 16) as bigint) as page, cast((l_suppkey * 7) % 400 as double) as x0, cast((l_suppkey * 7) % 400 + 20 as double) as x1, cast((l_partkey % 52) * 4 as double) + 0.5 as y,
       concat('w', cast(l_partkey as varchar(20))) as text from {lineitem}"""
#: Marks on the pages: orders.
MARKS = """
select cast(floor(o_orderkey / 16) as bigint) as page, o_orderkey as id, cast(floor(o_totalprice % 400) as double) as x, cast(o_custkey % 208 as double) as y, 8.0 + o_custkey % 5 as size, substr(o_orderpriority, 1, 1) as text from {orders}"""


# Claims of space


def _greedy(ranked: str, share: float, columns: str) -> str:
    """SQL for the loop over a page's places by rank: a list of the accepted ones grows place by place."""
    box = "{'rank': rank, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}"
    hit = f"len(list_filter(a.acc, lambda t: greatest(least(t.x1, b.r.x1) - greatest(t.x0, b.r.x0), 0) * greatest(least(t.y1, b.r.y1) - greatest(t.y0, b.r.y0), 0) > {share} * greatest((b.r.x1 - b.r.x0) * (b.r.y1 - b.r.y0), 1e-9))) > 0"
    return f"""
ranked as ({ranked}),
pages as (select page, list({box} order by rank) as rs from ranked group by page),
taken as (select page, unnest(list_reduce(list_transform(list_prepend(rs[1], rs), lambda r, i: {{'acc': case when i = 1 then [r] else list_filter([r], lambda z: false) end, 'r': r}}), lambda a, b: {{'acc': case when a.r = b.r and len(a.acc) = 1 then a.acc when {hit} then a.acc else list_append(a.acc, b.r) end, 'r': b.r}}).acc) as t from pages)
select {columns} from ranked join taken on ranked.page = taken.page and ranked.rank = taken.t.rank"""


@query(f"with boxes as ({duck(BOXES)}), {_greedy('select *, id as rank from boxes', 0.35, 'ranked.page, rank')}")
def jn_overlap_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in order, each free unless an accepted one covers more than 35 % of it."""
    return claims.claim(derived(spark, sf_dir, BOXES).withColumn("rank", F.col("id"))).select("page", "rank")


_FREE = "select * from boxes b where x1 - x0 >= 18 and y1 - y0 >= 6 and not exists (select 1 from marks m where m.page = b.page and m.x between b.x0 and b.x1 and m.y between b.y0 and b.y1)"
_BY_AREA = f"select *, row_number() over (partition by page order by (x1 - x0) * (y1 - y0) desc, id) as rank from ({_FREE})"


@query(f"with boxes as ({duck(BOXES)}), marks as ({duck(MARKS)}), {_greedy(_BY_AREA, 0.5, 'ranked.page, id')}")
def wn_empty_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large boxes without marks, the largest first."""
    return claims.empty_areas(derived(spark, sf_dir, BOXES), derived(spark, sf_dir, MARKS)).select("page", "id")


_KINDS = [*claims.CASCADE, "area"]
_KIND = "case n " + " ".join(f"when {k + 1} then '{v}'" for k, v in enumerate(_KINDS)) + " end"
_CASCADED = f"select *, row_number() over (partition by page order by list_position([{', '.join(repr(k) for k in claims.CASCADE)}], kind), y0, x0, x1, y1, id) as rank from (select *, {_KIND} as kind from boxes)"


@query(f"with boxes as ({duck(BOXES)}), {_greedy(_CASCADED, 0.35, 'ranked.page, id, kind')}")
def wn_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all kinds, each free of what kinds before it have claimed."""
    return claims.cascade(derived(spark, sf_dir, BOXES).withColumn("kind", F.expr(_KIND))).select("page", "id", "kind")


# Lines of text


@query(r"select doc_id as page, row_number() over (partition by doc_id order by n) as line, trim(regexp_replace(line, '[\s\x{00a0}]+', ' ', 'g')) as text, len(string_split(trim(regexp_replace(line, '[\s\x{00a0}]+', ' ', 'g')), ' '))::bigint as words from (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as n, unnest(string_split(text, chr(10))) as line from documents) where trim(regexp_replace(line, '[\s\x{00a0}]+', ' ', 'g')) <> ''")
def io_pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and words from glyphs: each character of each document as a glyph on a page, on bases that are not quite even."""
    # Texts are dealt out by document before they become glyphs, so no glyph is shuffled, and in parts whose glyphs a task can sort.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.repartition(8 * docs.rdd.getNumPartitions(), "doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("doc_id", "n", F.posexplode(F.split("line", "")).alias("k", "text"))
    # A blank is no glyph, but leaves its width; a base is off by up to 0.8.
    glyphs = lines.filter(~F.col("text").rlike(r"^[\s\x{00a0}]*$")).select(F.col("doc_id").alias("page"), (F.col("k") * 5.0).alias("x"), (F.col("n") * 12.0 + (F.col("k") % 5) * 0.2).alias("y"), F.lit(10.0).alias("size"), "text")
    return geometry.text_lines(glyphs).select("page", F.col("line").cast("long").alias("line"), "text", "words")


# Likeness


_GRAMS = "list_transform(range(1, (length({0}) - ({1}) + 2)::bigint), lambda i: substr({0}, i, {1}))"
_MID = "((s.low + s.high + 1) // 2)"


def _run_sql(a: str, b: str) -> str:
    """SQL for the longest common run: halving on its length."""
    state = f"{{'low': 0::bigint, 'high': least(length({a}), length({b}))::bigint}}"
    step = f"case when s.low >= s.high then s when list_has_any({_GRAMS.format(a, _MID)}, {_GRAMS.format(b, _MID)}) then {{'low': {_MID}, 'high': s.high}} else {{'low': s.low, 'high': {_MID} - 1}} end"
    return f"list_reduce(list_transform(range(0, 18), lambda q: {state}), lambda s, q: {step}).low"


@query(
    f"with {views.LINES_SQL}, pairs as (select doc_id, n, line as a, lead(line) over (partition by doc_id order by n) as b from lines) select doc_id, n, case when coalesce(least(length(a), length(b)), 0) > 0 then round({_run_sql('a', 'b')} / least(length(a), length(b)), 6) else 0 end as ratio from pairs"
)
def sc_lcs_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each line of a document shares with the next in one run."""
    pairs = views.lines(spark, sf_dir).withColumn("b", F.lead("line").over(Window.partitionBy("doc_id").orderBy("n")))
    return pairs.select("doc_id", "n", F.round(common_run_ratio(F.col("line"), F.col("b")), 6).alias("ratio"))


_HITS = "select cast(o_custkey as bigint) as id, cast(o_orderkey as bigint) as page, concat(o_orderpriority, ' ', o_orderstatus, ' ', cast(cast(o_totalprice as bigint) as varchar(20))) as context, concat('5-LOW P ', cast(o_custkey * 37 as varchar(20))) as wanted from {orders}"


@query(f"select id, arg_max(page, (r, -page)) as page from (select *, {_run_sql('context', 'wanted')} / least(length(context), length(wanted)) as r from ({duck(_HITS)})) where r >= 0.35 group by id")
def jn_best_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page whose context is nearest to a value's own, if near enough."""
    # DuckDB's cast to a whole number rounds half to even, Spark's cuts.
    return evidence.best_occurrences(derived(spark, sf_dir, _HITS.replace("cast(o_totalprice as bigint)", "cast(rint(o_totalprice) as bigint)")))


# Group tests


@query(
    f"""with {views.LINES_SQL}, bad as (select doc_id, n, regexp_matches(line, '{views.RUNS}') as fails from lines),
top as (select length(bin(max(n)::ubigint)) as k from bad where n > 0), levels as (select unnest(range(0, (select coalesce(max(k), 0) from top) + 1)) as k),
groups as (select doc_id, k, n >> k as g, bool_or(fails) as fails from bad, levels group by all),
tested as (select c.doc_id, c.k from groups c left join groups p on p.doc_id = c.doc_id and p.k = c.k + 1 and p.g = c.g >> 1 where p.fails or c.k = (select max(k) from levels))
select doc_id, count(*)::bigint as tests, count(distinct k)::bigint as rounds, (select coalesce(list_sum(list(n + 1)), 0) from bad b where b.doc_id = tested.doc_id and fails)::bigint as places from tested group by doc_id"""
)
def wr_bisect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of which documents cannot be written, by halving failing groups of all documents at once; places: the culprits' numbers from 1, added up."""
    lines = views.lines(spark, sf_dir)
    test = lambda rows: rows.groupBy("doc_id", "grp").agg(F.bool_or(F.col("line").rlike(views.RUNS)).alias("fails")).filter("fails")
    found, tests = culprits.find_culprits(lines, test, "doc_id", "n")
    places = found.groupBy("doc_id").agg(F.sum(F.col("n") + 1).alias("places"))
    return tests.join(places, "doc_id", "left").select("doc_id", "tests", "rounds", F.coalesce("places", F.lit(0)).cast("long").alias("places"))


# Profiles


_JSON = """select event_id, concat('{{"evento": [', props, ', {{"tipo": "', event_type, '", "valori": [[', cast(user_id as varchar(20)), '], null, true]}}]}}') as raw from {events}"""


@query(f"select event_id, replace(replace(substr(fullkey, 3), '[', '.'), ']', '') as path, case type when 'VARCHAR' then json_extract_string(raw, fullkey) else atom::varchar end as value from ({duck(_JSON).replace('{{', '{').replace('}}', '}')}), json_tree(raw) where atom is not null and type not in ('NULL', 'OBJECT', 'ARRAY')")
def fm_flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar of every event's properties, set into a deeper value."""
    return profiles.flattened(derived(spark, sf_dir, _JSON)).select("event_id", "path", "value")


# Fields, labels and rules of measured pages


@query(f"with g as ({duck(MARKS)}), r as ({duck(BOXES)}) select page, r.id as rect, string_agg(text, '' order by round_even(g.y / 4, 0), g.x, text) as text from g join r using (page) where g.x between x0 - 0.6 and x1 + 0.6 and g.y between y0 - 0.6 and y1 + 0.6 group by page, r.id")
def jn_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The glyphs whose origin lies in each box, in reading order."""
    rects = derived(spark, sf_dir, BOXES).select("page", F.col("id").alias("rect"), "x0", "y0", "x1", "y1")
    return geometry.contained(derived(spark, sf_dir, MARKS).select("page", "x", "y", "text"), rects)


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, BOXES).select("page", F.col("id").alias("rect"), "x0", "y0", "x1", "y1")


@query(f"with f as ({duck(BOXES)}), w as ({duck(WORDS)}) select page, f.id as rect, arg_min(text, (f.y0 - w.y, w.x0, text)) as label from f join w using (page) where w.y <= f.y0 and f.y0 - w.y <= 20 and w.x0 < f.x1 and w.x1 > f.x0 group by page, f.id")
def jn_above_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest word above each box."""
    return geometry.above_texts(_rects(spark, sf_dir), derived(spark, sf_dir, WORDS))


_BASES = "select cast(floor(o_orderkey / 16) as bigint) as page, cast(o_custkey % 208 as double) as base, min(o_orderkey) as line from {orders} group by 1, 2"


@query(f"with f as ({duck(BOXES)}), l as ({duck(_BASES)}) select page, id as field, arg_min(line, (abs(base - y1), base)) as line from f join l using (page) where abs(base - y1) <= 8 group by page, id")
def jn_nearest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text line nearest to each box's base, of equals the upper."""
    fields = derived(spark, sf_dir, BOXES).select("page", F.col("id").alias("field"), F.col("y1").alias("y"))
    return geometry.nearest_lines(fields, derived(spark, sf_dir, _BASES))


def _beside(where: str, own: str) -> str:
    return f"""with g as ({duck(MARKS)}), f as (select page, id as rect, x0, y0, x1, y1 from ({duck(BOXES)})),
e as (select *, lag(x1) over w as before, lead(x0) over w as after from f window w as (partition by page, round_even(y0 / 4, 0) order by x0, rect)),
j as (select e.page, rect, x, text, max(case when text in ('{"', '".join(geometry.BOXES)}') then x end) over (partition by e.page, rect) as box from e join g on g.page = e.page and {where}),
s as (select page, rect, string_agg(text, '' order by x, text) as t from j where {own} group by page, rect)"""


_FILLER = r"(?:_{3,}|\.{3,}|-{3,}|…+)"
_LEFT = _beside("abs(y - y1) <= greatest(2, size * 0.5) and x < x0 - 0.2 and (before is null or x >= before - 0.2)", "box is null or x > box")
_RIGHT = _beside("abs(y - (y0 + y1) / 2) <= greatest(3, size * 0.75) and x >= x1 - 0.2 and (after is null or x < after - 0.2)", "true")


@query(f"{_LEFT} select page, rect, 'left' as side, trim(right(trim(regexp_replace(t, '^.*{_FILLER}', '')), 90)) as label from s union all select * from ({_RIGHT} select page, rect, 'right', trim(left(trim(regexp_replace(t, '{_FILLER}.*$', '')), 90)) from s)")
def jn_left_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text beside each box, to the left and to the right, up to its neighbours."""
    fields, glyphs = _rects(spark, sf_dir), derived(spark, sf_dir, MARKS).select("page", "x", "y", "size", "text")
    side = lambda left: geometry.line_labels(fields, glyphs, left).withColumn("side", F.lit("left" if left else "right"))
    return side(True).unionByName(side(False))


@query(f"select page, u.axis, u.at, u.f as \"from\", u.t as \"to\" from (select page, unnest([{{'axis': 'h', 'at': y0, 'f': x0, 't': x1}}, {{'axis': 'h', 'at': y1, 'f': x0, 't': x1}}, {{'axis': 'v', 'at': x0, 'f': y0, 't': y1}}, {{'axis': 'v', 'at': x1, 'f': y0, 't': y1}}]) as u from ({duck(BOXES)}))")
def io_pdf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides of boxes as segments."""
    return geometry.sides(derived(spark, sf_dir, BOXES).select("page", "x0", "y0", "x1", "y1"))


#: Rules under boxes of two kinds, three boxes long; boxes of one kind are cells, and marks leave ink.
_RULES = f"select distinct page, y1 as y, x0 as f, x0 + 3 * (x1 - x0) as t from ({BOXES}) b where n in (2, 3)"
_RULE_CELLS = f"select page, x0, y0, x1, y1 from ({BOXES}) c where n = 1"
_RULE_INK = f"select page, x as x0, y as y0, x + 6 as x1, y + 5 as y1 from ({MARKS}) k"


@query(
    f"""with r as ({duck(_RULES)}), cells as ({duck(_RULE_CELLS)}), ink as ({duck(_RULE_INK)}), words as ({duck(WORDS)})
select page, y, f as "from", t as "to" from r where t - f >= 24
  and not exists (select 1 from r o where o.page = r.page and (o.y, o.f, o.t) <> (r.y, r.f, r.t) and abs(o.y - r.y) <= 22 and least(o.t, r.t) - greatest(o.f, r.f) > 0.5 * (r.t - r.f))
  and not exists (select 1 from cells c where c.page = r.page and (abs(y0 - r.y) <= 0.6 or abs(y1 - r.y) <= 0.6) and least(x1, r.t) - greatest(x0, r.f) > 0.8 * (r.t - r.f))
  and not exists (select 1 from ink k where k.page = r.page and y0 < r.y - 0.8 and y1 > r.y - 11 and least(x1, r.t - 0.5) - greatest(x0, r.f + 0.5) > 0)
  and exists (select 1 from words w where w.page = r.page and ((x1 <= r.f and abs(w.y - r.y) <= 4) or (w.y < r.y and r.y - w.y <= 20 and least(x1, r.t) - greatest(x0, r.f) > 0)))"""
)
def wn_ruled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that are there to be written on."""
    rules_ = derived(spark, sf_dir, _RULES).withColumnsRenamed({"f": "from", "t": "to"})
    return geometry.ruled_fields(rules_, derived(spark, sf_dir, _RULE_CELLS), derived(spark, sf_dir, _RULE_INK), derived(spark, sf_dir, WORDS).select("page", "x0", "x1", "y"))


#: Small boxes, near squares among them, some with ink.
_SQUARES = f"select page, id as rect, x0, y0, x0 + (x1 - x0) / 2 as x1, y0 + (y1 - y0) / 1.5 as y1, (p % 20) / 100.0 as ink from ({BOXES}) b"


@query(f"""with b as (select * from ({duck(_SQUARES)}) where x1 - x0 between 2 and 16 and y1 - y0 between 2 and 16 and abs((x1 - x0) - (y1 - y0)) <= 0.25 * greatest(x1 - x0, y1 - y0) and ink <= 0.12), g as ({duck(MARKS)}),
e as (select *, lead(x0) over (partition by page, round_even(y0 / 4, 0) order by x0, rect) as after from b),
t as (select e.page, e.rect, string_agg(text, '' order by x, text) as t from e join g on g.page = e.page and abs(y - (y0 + y1) / 2) <= greatest(3, size * 0.75) and x >= x1 - 0.2 and (after is null or x < after - 0.2) group by e.page, e.rect)
select b.page, b.rect, trim(left(trim(regexp_replace(t, '{_FILLER}.*$', '')), 90)) as label from b left join t using (page, rect)""")
def wn_checkbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-square hollow boxes and the text up to the next one."""
    return evidence.boxes(derived(spark, sf_dir, _SQUARES).withColumn("ink", F.col("ink").cast("double")), derived(spark, sf_dir, MARKS).select("page", "x", "y", "size", "text")).select("page", "rect", "label")


_NEAR = f"select page, x0, y - 9 as y0, x1, y as y1, concat(text, case when x0 > 200 then ' ____ resto' else '' end) as text from ({WORDS}) w"


@query(f"""with f as ({duck(BOXES)}), l as (select page, x0, y0, x1, y1, trim(regexp_replace(text, '{_FILLER}.*$', '')) as t from ({duck(_NEAR)})),
j as (select distinct f.page, id, l.x0, l.y0, t, l.x0 < f.x1 and l.x1 > f.x0 and l.y0 < f.y1 and l.y1 > f.y0 as hit from f join l on l.page = f.page and l.x0 < f.x1 + 90 and l.x1 > f.x0 - 90 and l.y0 < f.y1 + 12 and l.y1 > f.y0 - 34),
o as (select *, bool_or(hit) over (partition by page, id) as met from j)
select page, id, left(string_agg(t, ' ' order by y0, x0, t), 200) as context from o where (hit or not met) and t <> '' group by page, id""")
def wn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that cross a box, else those around it, in order, without filler runs."""
    return evidence.contexts(derived(spark, sf_dir, BOXES).select("page", "id", "x0", "y0", "x1", "y1"), derived(spark, sf_dir, _NEAR))


@query(f"with f as ({duck(BOXES)}), i as ({duck(WORDS)}) select f.page, id, coalesce(min(f.y1 - i.y), 40.0)::double as rise from f left join i on i.page = f.page and i.y < f.y1 - 1 and f.y1 - i.y <= 40 and i.x0 < f.x1 and i.x1 > f.x0 group by f.page, id")
def wn_free_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a field on a box's base may rise before it meets a word."""
    fields = derived(spark, sf_dir, BOXES).select("page", "id", "x0", "x1", F.col("y1").alias("y"))
    return evidence.rises(fields, derived(spark, sf_dir, WORDS).select("page", "x0", "x1", "y"))


#: Bars and uprights on a lattice of ten points, and of some length.
_BARS = "select distinct cast(floor(l_orderkey / 16) as bigint) as page, cast((l_partkey % 9) * 10 as double) as y, cast((l_suppkey % 5) * 20 as double) as f, cast((l_suppkey % 5) * 20 + 20 * l_linenumber as double) as t from {lineitem}"
_UPRIGHTS = "select distinct cast(floor(l_orderkey / 16) as bigint) as page, cast((l_partkey % 7) * 20 as double) as x, cast(l_quantity % 8 as double) * 10 as f, cast(l_quantity % 8 as double) * 10 + 10 * l_linenumber as t from {lineitem}"


@query(
    f"""with b as materialized ({duck(_BARS)}), u as materialized ({duck(_UPRIGHTS)}),
p as (select distinct a.page, a.y as y0, c.y as y1 from b a join b c on a.page = c.page and c.y - a.y >= 3.5),
m as (select distinct p.page, y0, y1, x from p join u on u.page = p.page and u.f <= y0 + 0.6 and u.t >= y1 - 0.6
      where exists (select 1 from b where b.page = p.page and b.y = y0 and b.f <= x + 0.6 and b.t >= x - 0.6) and exists (select 1 from b where b.page = p.page and b.y = y1 and b.f <= x + 0.6 and b.t >= x - 0.6)),
s as (select *, lead(x) over (partition by page, y0, y1 order by x) as x1 from m)
select page, x as x0, y0, x1, y1 from s where x1 - x >= 2
  and exists (select 1 from b where b.page = s.page and b.y = y0 and b.f <= x + 0.6 and b.t >= x1 - 0.6) and exists (select 1 from b where b.page = s.page and b.y = y1 and b.f <= x + 0.6 and b.t >= x1 - 0.6)
  and not exists (select 1 from b where b.page = s.page and b.y > y0 and b.y < y1 and b.f <= x + 0.6 and b.t >= x1 - 0.6)"""
)
def wn_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells closed on four sides by bars and uprights."""
    return geometry.grid_cells(derived(spark, sf_dir, _BARS).withColumnsRenamed({"f": "from", "t": "to"}), derived(spark, sf_dir, _UPRIGHTS).withColumnsRenamed({"f": "from", "t": "to"}))


@query(f"select page, id, place, line_no from (select page, id, row_number() over (partition by page order by round_even(y0 / 4, 0), x0, y0, id) as place, dense_rank() over (partition by page order by round_even(y0 / 4, 0)) as line_no from ({duck(BOXES)}))")
def wn_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in reading order, and their line."""
    boxes = derived(spark, sf_dir, BOXES).select("page", "id", "x0", "y0")
    return sequences.reading_order(boxes, ["page"], "x0", "y0").select("page", "id", "place", "line_no")


@query(f"select page, id, (greatest(least(x1, u1) - greatest(x0, u0), 0) * greatest(least(y1, v1) - greatest(y0, v0), 0))::double as area from (select *, lead(x0) over w as u0, lead(y0) over w as v0, lead(x1) over w as u1, lead(y1) over w as v1 from ({duck(BOXES)}) window w as (partition by page order by y0, x0, id)) where u0 is not null")
def fm_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area that each box shares with the next one of its page."""
    own = F.struct("x0", "y0", "x1", "y1")
    pairs = derived(spark, sf_dir, BOXES).withColumns({"_a": own, "_b": F.lead(own).over(Window.partitionBy("page").orderBy("y0", "x0", "id"))}).filter("_b is not null")
    return pairs.select("page", "id", geometry.overlap_area(F.col("_a"), F.col("_b")).alias("area"))


@query(f"select 'p' || page || '.' || kind || '.' || lpad(round_even(x0 + 0.5, 0)::int::varchar, 3, '0') || '-' || lpad(round_even(y0 + 0.5, 0)::int::varchar, 3, '0') as id from (select *, {_KIND} as kind from ({duck(BOXES)}))")
def sc_anchor_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each place: page, kind and rounded origin."""
    boxes = derived(spark, sf_dir, BOXES).withColumn("kind", F.expr(_KIND))
    return boxes.select(geometry.anchor_id(F.col("page"), F.col("kind"), F.col("x0") + 0.5, F.col("y0") + 0.5).alias("id"))


@query(f"select page, id, case when kind = 'celle' then coalesce(many, greatest(1, floor(w / 4.2)))::bigint when kind = 'casella' then 1 else greatest(1, floor(w / 4.2))::bigint end as n from (select page, id, {_KIND} as kind, case when p % 3 > 0 then p % 40 end as many, x1 - x0 as w from ({duck(BOXES)}))")
def wn_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that each place holds."""
    boxes = derived(spark, sf_dir, BOXES).withColumns({"kind": F.expr(_KIND), "many": F.when(F.col("p") % 3 > 0, F.col("p") % 40)})
    return boxes.select("page", "id", geometry.capacity(F.col("kind"), F.col("many"), F.col("x1") - F.col("x0")).cast("long").alias("n"))


#: Dots in rows: the marks of a customer's orders of one month, and rows of even steps.
_DOTS = "select cast(o_custkey as bigint) as page, cast(o_orderkey % 3 as double) as y, case when o_orderstatus = 'P' then o_orderkey * 1.5 else (o_orderkey - o_orderkey % 8) * 2.0 + (o_orderkey % 8) * 4.0 end as x from {orders} union all select floor(l_orderkey / 16), 100.0, cast(l_linenumber * 6 as double) + floor(l_orderkey / 160) from {lineitem} group by 1, 2, 3"


@query(f"with t as (select page::bigint as page, y::double as y, x::double as x from ({duck(_DOTS)})), d as (select *, x - lag(x) over (partition by page, y order by x) as s from t), m as (select page, y, count(*) as n, median(s) as step, min(x) as a, max(x) as b, list(s) filter (s is not null) as steps from d group by page, y) select page, y, a - step / 2 as \"from\", b + step / 2 as \"to\" from m where n >= 6 and len(list_filter(steps, lambda q: abs(q - step) <= 0.25 * step)) >= 0.8 * len(steps)")
def wn_dotted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular rows of dots as lines."""
    dots = derived(spark, sf_dir, _DOTS)
    return geometry.dotted_borders(dots.select(F.col("page").cast("long").alias("page"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")))


#: Cells side by side: each as wide as its kind says, some filled.
_STRIPS = "select page, r, cast(sum(w) over (partition by page, r order by k, id) - w as double) as x0, cast(sum(w) over (partition by page, r order by k, id) as double) as x1, e as empty from (select o_custkey as page, o_orderkey % 2 as r, o_orderkey as k, o_orderkey as id, 10 + 5 * floor((o_orderkey % 1000) / 300) as w, o_orderstatus <> 'F' as e from {orders}) t"


@query(f"""with c as (select * from ({duck(_STRIPS)}) where empty), m as (select *, case when x0 - lag(x1) over w > 1 or abs((x1 - x0) / lag(x1 - x0) over w - 1) > 0.1 or lag(x1) over w is null then 1 else 0 end as new from c window w as (partition by page, r order by x0)),
i as (select *, sum(new) over (partition by page, r order by x0 rows unbounded preceding) as island from m) select page, r, min(x0) as x0, max(x1) as x1, count(*) as many from i group by page, r, island having count(*) >= 3""")
def wn_cell_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring empty cells of one width."""
    cells = derived(spark, sf_dir, _STRIPS).withColumnRenamed("r", "row")
    return geometry.cell_strips(cells).select("page", F.col("row").alias("r"), "x0", "x1", "many")


_CELLS = "select cast(l_orderkey as bigint) as page, l_suppkey % 4 as c, row_number() over (partition by l_orderkey, l_suppkey % 4 order by l_linenumber, l_partkey, l_extendedprice) as r, case when l_returnflag = 'A' then concat('t', cast(l_partkey as varchar(20))) when l_returnflag = 'N' then ' ' end as text from {lineitem}"


@query(f"select page, c as col, r as row_, last_value(case when trim(coalesce(text, '')) <> '' then text end ignore nulls) over (partition by page, c order by r rows between unbounded preceding and 1 preceding) as header from ({duck(_CELLS)})")
def jn_column_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell with the last text above it in its column."""
    cells = derived(spark, sf_dir, _CELLS).withColumnsRenamed({"c": "column", "r": "row"})
    return geometry.column_headers(cells).select("page", F.col("column").alias("col"), F.col("row").alias("row_"), "header")


_ROWS = "select cast(floor(l_orderkey / 4) as bigint) as page, l_orderkey % 4 as r, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) - 1 as place, 1 + l_suppkey % 2 as span, case when l_returnflag <> 'R' then concat('t', cast(l_partkey as varchar(20))) else '' end as text from {lineitem}"


@query(f"""with p as (select *, coalesce(sum(span) over (partition by page, r order by place rows between unbounded preceding and 1 preceding), 0)::bigint as col from ({duck(_ROWS)})),
h as (select page, unnest(range(col, col + span)) as col, text as head from p where r = 0 and text <> ''), f as (select page, r, text as first from p where place = 0 and text <> '')
select p.page, p.r as row_, p.col, coalesce(first, head) as label from p left join f on f.page = p.page and f.r = p.r left join h on h.page = p.page and h.col = p.col where p.text = ''""")
def jn_table_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every empty cell's label: its row's first cell, else the header above it."""
    cells = derived(spark, sf_dir, _ROWS).withColumnRenamed("r", "row")
    return geometry.table_headers(cells).select("page", F.col("row").alias("row_"), F.col("column").cast("long").alias("col"), "label")


@query("select l_orderkey as id, sum(greatest(g - n, 0))::bigint as spill from (select l_orderkey, l_quantity::bigint as g, l_linenumber * 5 as n from lineitem) group by 1")
def au_spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink gained around written places, neighbours' own gains taken off."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("long").alias("gain"), (F.col("l_linenumber") * 5).alias("neighbour_gain"))
    return geometry.spill(cells).select("id", F.col("spill").cast("long").alias("spill"))


_FILES = "select page_id as id, case when page_id % 3 = 0 then concat(html, '/ByteRange [0 1]') when page_id % 3 = 1 then concat(html, '/ Byte') else html end as c from {pages}"


@query(f"select id, regexp_matches(c, '/ByteRange') as signed from ({duck(_FILES)})")
def io_signed_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that an issuer has signed."""
    from formlake.sources import documents

    files = derived(spark, sf_dir, _FILES)
    return files.select("id", documents.signed(F.col("c").cast("binary")).alias("signed"))


# Formats of values


_IBANS = "select c_custkey as id, concat(case when c_custkey % 5 = 0 then 'de' when c_custkey % 50 = 1 then '' else 'IT' end, lpad(cast(c_custkey % 97 + 2 as varchar(20)), 2, '0'), 'X', lpad(cast(c_custkey * 7919 as varchar(20)), 22, '0')) as v from {customer}"


def _iban_sql(v: str) -> str:
    """SQL for the remainder of 97 over the letters as numbers."""
    return f"coalesce(regexp_full_match(upper({v}), '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') and list_reduce(list_prepend(0, list_transform(string_split(substring(upper({v}), 5) || substring(upper({v}), 1, 4), ''), lambda c: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)), lambda a, d: case when d < 10 then (a * 10 + d) % 97 else (a * 100 + d) % 97 end) = 1, false)"


@query(f"select id, {_iban_sql('v')} as valid from ({duck(_IBANS)})")
def fm_iban(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _IBANS).select("id", formats.iban_valid(F.col("v")).alias("valid"))


_LABELS = ("C.A.P.", "CAP", "PEC", "indirizzo e-mail", "codice fiscale", "C.F.", "P. IVA", "partita IVA", "tel.", "telefono", "IBAN", "conto", "nome")
_ASKED = f"select c_custkey as id, case c_custkey % 13 {' '.join(f'when {k} then {v!r}' for k, v in enumerate(_LABELS))} end as label, case floor(c_custkey / 13) % 8 when 0 then lpad(cast(c_custkey as varchar(20)), 5, '0') when 1 then c_name when 2 then concat(c_name, '@b.it') when 3 then lpad(cast(c_custkey as varchar(20)), 11, '0') when 4 then concat('IT', lpad(cast(c_custkey as varchar(20)), 11, '0')) when 5 then 'IT60X0542811101000000123456' when 6 then 'IT60 X054-28111.01000000123457' else concat('06 ', cast(c_custkey as varchar(20)), '0000') end as value from {{customer}}"


@query(f"""with a as (select *, regexp_replace(value, '[-/.\\s]', '', 'g') as bare from ({duck(_ASKED)}))
select id, coalesce(case when label in ('C.A.P.', 'CAP') then case when not regexp_full_match(bare, '[0-9]{{5}}') then 'cap: 5 digits' end when label = 'IBAN' then case when not {_iban_sql('bare')} then 'iban: not valid' end
  when label in ('PEC', 'indirizzo e-mail') then case when not contains(value, '@') then 'mail: no @' end when label in ('codice fiscale', 'C.F.') then case when not regexp_full_match(bare, '[A-Za-z0-9]{{16}}|[0-9]{{11}}') then 'tax code: 16 characters or 11 digits' end
  when label in ('P. IVA', 'partita IVA') then case when not regexp_full_match(bare, '([iI][tT])?[0-9]{{11}}') then 'vat: 11 digits' end
  when label in ('tel.', 'telefono') then case when regexp_matches(value, '[A-Za-z]') or length(regexp_replace(value, '[^0-9]', '', 'g')) < 6 then 'phone: digits' end end,
  case when regexp_full_match(bare, '[A-Za-z]{{2}}[0-9]{{2}}[A-Za-z0-9]{{11,30}}') and not {_iban_sql('bare')} then 'looks like an iban' end) as reason from a""")
def fm_format_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format that each value breaks under its label."""
    return derived(spark, sf_dir, _ASKED).select("id", formats.format_problem(F.col("label"), F.col("value")).alias("reason"))


_DAYS = "select o_orderkey as id, o_orderdate as d, o_orderkey % 6 as form, case floor(o_orderkey / 6) % 5 when 0 then 'dd/MM/yyyy' when 1 then 'd.M.yyyy' when 2 then 'yyyy-MM-dd' when 3 then 'dd/MM-yyyy' else 'yyyy/M/d' end as p from {orders}"


@query(f"""with v as (select *, form not in (4, 5) as ok from ({duck(_DAYS)}))
select id, case when ok then case p when 'dd/MM/yyyy' then strftime(d, '%d/%m/%Y') when 'd.M.yyyy' then strftime(d, '%-d.%-m.%Y') when 'yyyy-MM-dd' then strftime(d, '%Y-%m-%d') when 'yyyy/M/d' then strftime(d, '%Y/%-m/%-d') end end as shown, case when ok then strftime(d, '%Y-%m-%d') || 'T00:00:00Z' end as iso from v""")
def fm_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in four forms, and two that are none, shown by a pattern and in full."""
    d = F.col("d")
    forms = ["yyyy-MM-dd", "d/M/yyyy", "dd-MM-yyyy", "d.M.yyyy", "dd/MM/yy"]
    text = F.coalesce(*[F.when(F.col("form") == k, F.date_format(d, f)) for k, f in enumerate(forms)], F.concat(F.lit("32/"), F.date_format(d, "MM/yyyy")))
    day = formats.strict_date(F.col("v"))
    rows = derived(spark, sf_dir, _DAYS).withColumn("v", text)
    return rows.select("id", formats.shown_date(day, F.col("p")).alias("shown"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("iso"))


_MASKS = "select o_orderkey as id, repeat(concat('nato il ', repeat('_', cast(1 + o_orderkey % 3 as int)), repeat(' ', cast(o_orderkey % 2 as int)), '/', repeat('_', cast(1 + o_custkey % 2 as int)), '/ ', repeat('_', cast(1 + o_custkey % 5 as int)), ' a ___ '), cast(o_orderkey % 4 as int)) as line from {orders}"


@query(f"select id, len(regexp_extract_all(line, '_{{1,2}} */ *_{{1,2}} */ *_{{2,4}}'))::bigint as masks from ({duck(_MASKS)})")
def fm_date_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _MASKS).select("id", F.size(formats.date_masks(F.col("line"))).cast("long").alias("masks"))


_WIDTHS = {"i": 0.25, "l": 0.25, "m": 1.0, "w": 0.75, "t": 0.375}


@query(f"with p as (select p_partkey as id, list_sum(list_transform(string_split(p_name, ''), lambda c: case c {' '.join(f'when {k!r} then {v}' for k, v in _WIDTHS.items())} else 0.5 end))::double as ems, (10 + p_size)::double as room from part) select id, list_filter(list_transform(range(0, 23), lambda k: 10.0::double - k * 0.25::double), lambda s: s * ems <= room)[1] as size from p")
def fm_text_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest size at which each name fits its place."""
    widths = F.create_map(*[F.lit(x) for kv in _WIDTHS.items() for x in kv])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), geometry.fitting_size(F.col("p_name"), widths, (F.col("p_size") + 10).cast("double")).alias("size"))


@query(
    f"""with {views.LINES_SQL}, v as (select doc_id, n, list_transform(list_filter(string_split(line, ' '), lambda x: x <> ''), lambda x: length(x) * 0.5::double) as w, (80 + doc_id % 5 * 40)::double as width, (30 + n % 4 * 30)::double as height from lines),
z as (select *, unnest(list_transform(range(0, 23), lambda k: 10.0::double - k * 0.25::double)) as s from v),
l as (select doc_id, n, s, height, case when len(list_filter(w, lambda x: x > width / s)) > 0 then null when len(w) = 0 then 0 else list_reduce(list_transform(w, lambda x: {{'lines': 1, 'used': x, 'room': width / s}}), lambda a, b: case when a.used + 0.25::double + b.used <= a.room then {{'lines': a.lines, 'used': a.used + 0.25::double + b.used, 'room': a.room}} else {{'lines': a.lines + 1, 'used': b.used, 'room': a.room}} end).lines end as lines from z)
select doc_id, n, max(s) filter (lines * 1.2::double * s <= height) as size from l group by doc_id, n"""
)
def fm_text_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest size at which each line of a document, broken into lines, fits its area."""
    lines = views.lines(spark, sf_dir)
    words = F.transform(F.filter(F.split("line", " "), lambda x: x != ""), lambda x: F.length(x) * F.lit(0.5))
    rows = lines.select("doc_id", "n", words.alias("w"), (F.col("doc_id") % 5 * 40 + 80).cast("double").alias("width"), (F.col("n") % 4 * 30 + 30).cast("double").alias("height"))
    return rows.select("doc_id", "n", geometry.fitting_area_size(F.col("w"), F.col("width"), F.col("height")).alias("size"))


# Profiles


_PROFILES = """select c_custkey as file, case c_custkey % 3 when 0 then concat('{{"profilo": {{"ragione": "', c_name, '", "piva": "", "sedi": ["Roma", "', c_mktsegment, '"], "cap": "', lpad(cast(c_custkey as varchar(20)), 5, '0'), '"}}, "prova": false}}')
  when 1 then concat('{{"azienda": {{"ragione": "', c_name, '", "x": null}}, "prova": true}}') else concat('{{"ragione": "', c_name, '", "n": ', cast(c_nationkey as varchar(20)), '}}') end as raw from {customer}"""


@query(
    """select c_custkey as file, u.section, u.key, u.value, u.status from (select c_custkey, unnest(case c_custkey % 3
  when 0 then [{'section': 'profilo', 'key': 'ragione', 'value': c_name, 'status': 'ok'}, {'section': 'profilo', 'key': 'piva', 'value': null, 'status': 'empty'}, {'section': 'profilo', 'key': 'sedi', 'value': null, 'status': 'nested'}, {'section': 'profilo', 'key': 'cap', 'value': lpad(c_custkey::varchar, 5, '0'), 'status': 'ok'}]
  when 1 then [{'section': 'azienda', 'key': 'ragione', 'value': c_name, 'status': 'ok'}, {'section': 'azienda', 'key': 'x', 'value': null, 'status': 'empty'}]
  else [{'section': '', 'key': 'ragione', 'value': c_name, 'status': 'ok'}, {'section': '', 'key': 'n', 'value': c_nationkey::varchar, 'status': 'ok'}] end) as u from customer)"""
)
def io_profile_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each profile's section, and which of them are facts."""
    return profiles.facts(derived(spark, sf_dir, _PROFILES)).select("file", "section", "key", "value", "status")


@query("select c_custkey as file, case when c_custkey % 3 = 0 then c_name end as name from customer where c_custkey % 3 <> 1")
def io_profile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles that are not marked as tests, and the value at a path."""
    real = profiles.real_profiles(derived(spark, sf_dir, _PROFILES))
    return real.select("file", profiles.path_value(F.col("raw"), "profilo.ragione").alias("name"))


@query("select c_custkey as file, 'a.b' as path, case when c_acctbal < 0 then 'rosso' else c_mktsegment end as value from customer union all select c_custkey, 'a.c', c_name from customer union all select c_custkey, 'z', c_nationkey::varchar from customer where c_acctbal < 0")
def io_path_get_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all customers after setting two paths of those in debt: one replaces, one is new."""
    facts = derived(spark, sf_dir, "select c_custkey as file, 'a.b' as path, c_mktsegment as value from {customer} union all select c_custkey, 'a.c', c_name from {customer}")
    changes = derived(spark, sf_dir, "select c_custkey as file, 'a.b' as path, 'rosso' as value from {customer} where c_acctbal < 0 union all select c_custkey, 'z', cast(c_nationkey as string) from {customer} where c_acctbal < 0")
    return profiles.with_path(facts, changes, ["file"])


@query("with s as (select c_custkey % 100000 as k, c_name as v from customer where c_acctbal > 0) select k, v from s union all select o_custkey, 'new' from (select distinct o_custkey from orders) where o_custkey not in (select k from s)")
def io_profile_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are there stay; of those offered only the missing ones come in."""
    existing = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select((F.col("c_custkey") % 100000).alias("k"), F.col("c_name").alias("v"))
    offered = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("v", F.lit("new"))
    return profiles.seeded(existing, offered, "k")


_CASES = """select c_custkey as file, concat('{{"lavoro_corrente": ', case when c_custkey % 3 = 0 then '{{ }}' else '{{"a": 1}}' end, ', "scenari": {{"gara_', cast(c_custkey as varchar(20)), '": {{"b": 2}}, "x.y": {{"c": 3}}, "vuoto": {{}}, "testo": "t"', case when c_acctbal < 0 then ', "altra_gara": {{"d": {{}}}}' else '' end, '}}}}') as raw from {customer}"""


@query("select c_custkey as file, unnest(list_concat(case when c_custkey % 3 <> 0 then ['lavoro_corrente'] else [] end, ['scenari.gara_' || c_custkey], case when c_acctbal < 0 then ['scenari.altra_gara'] else [] end)) as path, unnest(list_concat(case when c_custkey % 3 <> 0 then ['Lavoro corrente'] else [] end, ['Scenario: gara ' || c_custkey], case when c_acctbal < 0 then ['Scenario: altra gara'] else [] end)) as label from customer")
def fm_path_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of each profile that can be chosen: neither empty ones nor names with a dot."""
    return profiles.cases(derived(spark, sf_dir, _CASES)).select("file", "path", "label")


# Texts of forms


@query(f"with {views.LINES_SQL}, v as (select doc_id, n, line, string_split(line, ' ')[1] as label from lines) select doc_id, n, case when length(label) > 0 and starts_with(lower(line), lower(label) || ' ') and ltrim(substr(line, length(label) + 2), ' ') <> '' then ltrim(substr(line, length(label) + 1), ' ') else line end as out from v")
def sc_strip_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line without the first word, as if that were its label."""
    return views.lines(spark, sf_dir).select("doc_id", "n", T.without_echo(F.substring_index("line", " ", 1), F.col("line")).alias("out"))


_ECHOES = "select o_orderkey as id, concat('sede in via ', o_orderstatus, ' numero ', cast(o_custkey % 7 as varchar(20))) as a, concat(case when o_custkey % 4 > 0 then concat(case when o_custkey % 4 > 1 then concat(case when o_custkey % 4 > 2 then 'P ' else '' end, 'Numero ') else '' end, cast(o_orderkey % 7 as varchar(20))) else 'altro' end, ' resto') as b from {orders}"


@query(f"with w as (select id, string_split(lower(a), ' ') as a, string_split(lower(b), ' ') as b from ({duck(_ECHOES)})) select id, coalesce(list_max(list_filter([1, 2, 3, 4], lambda k: len(a) >= k and len(b) >= k and a[len(a) - k + 1 : len(a)] = b[1 : k])), 0)::bigint as n from w")
def sc_echo_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a value's head repeats of the text before it."""
    return derived(spark, sf_dir, _ECHOES).select("id", T.echo_length(F.col("a"), F.col("b")).cast("long").alias("n"))


@query(f"with {views.LINES_SQL}, v as (select doc_id, n, translate(line, '#%', '_.') as s from lines) select doc_id, n, trim(regexp_replace(s, '^.*{_FILLER}', '')) as left_, trim(regexp_replace(s, '{_FILLER}.*$', '')) as right_ from v")
def sc_label_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands after the last and before the first filler run of each line."""
    s = F.translate("line", "#%", "_.")
    return views.lines(spark, sf_dir).select("doc_id", "n", T.clean_label(s, True).alias("left_"), T.clean_label(s, False).alias("right_"))


_SENTENCES = "select c_custkey as id, concat(c_mktsegment, ' «QUI»  il «', cast(c_nationkey as varchar(20)), ':4» prov ____ ', case when c_acctbal < 0 then '......' else '- - - -' end, ' fine') as line, c_name as v from {customer}"


@query(f"select id, left(trim(c_mktsegment || ' [ ' || v || ' ] il ___ prov ___ ' || '___ ' || 'fine'), 130) as line from ({duck(_SENTENCES)}) join customer on c_custkey = id")
def sc_fill_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each form line as one reads it, its own mark filled in."""
    return derived(spark, sf_dir, _SENTENCES).select("id", T.filled_sentence(F.col("line"), F.col("v")).alias("line"))


_ANSWERS = """select event_id as id, case event_id % 4 when 0 then concat('x ```json ', props, '``` y ```{{"b": ', cast(user_id as varchar(20)), '}}```') when 1 then concat('ecco ', props, ' fine') when 2 then concat('```', chr(10), props, ' ``` e poi') else event_type end as s from {events}"""


@query("""select event_id as id, case event_id % 4 when 0 then '{"b": ' || user_id || '}' when 1 then props when 2 then props else event_type end as block from events""")
def sc_json_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fenced block of each answer, else its braces, else all of it."""
    return derived(spark, sf_dir, _ANSWERS).select("id", T.last_fenced_block(F.col("s")).alias("block"))


# Places in paragraphs, proposals and overflow


@query("select o_orderkey as par, k as id, case k when 1 then o_orderpriority when 2 then 'stato ' || o_orderstatus else 'numero' end as label from orders, (select unnest([1, 2, 3]) as k)")
def wn_prev_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text before each of the three places of each order's paragraph."""
    text = F.concat("o_orderpriority", F.lit(" ____ stato "), "o_orderstatus", F.lit(" ____ numero ____"))
    first = F.length("o_orderpriority") + 1
    starts = F.array(first, first + 12 + F.length("o_orderstatus"), first + 24 + F.length("o_orderstatus"))
    slots = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("par"), text.alias("text"), F.posexplode(starts).alias("k", "start"))
    slots = slots.select("par", (F.col("k") + 1).alias("id"), "text", "start", (F.col("start") + 4).alias("end"))
    return sequences.labels_between(slots, ["par"], "start", "end", "text").select("par", "id", "label")


_COLUMNS = f"select page, id, concat('k', cast(p % 3 as varchar(20))) as key, cast(floor(x0 / 40) * 40 as double) as x0, cast(floor(x0 / 40) * 40 + 30 as double) as x1, y0 from ({BOXES}) b"


@query(f"with f as (select *, round_even(y0, 0) as y from ({duck(_COLUMNS)})), m as (select page, key, x0, x1, count(*) as n from f group by all having count(distinct y) >= 2) select page, id, n from f join m using (page, key, x0, x1)")
def ag_repeated_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a column that repeats on several rows, and how many there are."""
    return rules.repeated_columns(derived(spark, sf_dir, _COLUMNS)).select("page", "id", F.col("rows").alias("n"))


_PROPOSALS = "select c_custkey as id, case c_custkey % 7 when 0 then null when 1 then 'casella' else 'area' end as kind, case when c_custkey % 7 = 2 then 'lavoratori transfrontalieri' else 'dati' end as line, case when c_custkey % 2 = 0 then 'CAP' else 'nome' end as before, case when c_acctbal < 0 then ' ' when c_acctbal < 2000 then 'Bianchi' else c_name end as value, c_name as own from {customer}"


@query(f"select id, case when kind is null then 'unknown slot' when kind = 'casella' then 'checkbox' when trim(value) = '' then 'blank' when line <> 'dati' then 'excluded section' when value <> own then 'provenance' when before = 'CAP' then 'cap: 5 digits' end as reason from ({duck(_PROPOSALS)})")
def vd_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stops each proposal, in the gates' order."""
    return rules.gate(derived(spark, sf_dir, _PROPOSALS).withColumn("sources", F.array("own"))).select("id", "reason")


@query("with w as (select o_custkey as form, o_orderkey as id, o_orderpriority || ' ' || o_orderkey as value, 8 + o_orderkey % 9 as room from orders) select form, id, case when length(value) > room then 'v. all. ' || row_number() over (partition by form, length(value) > room order by id) else value end as shown, case when length(value) > room then value end as appendix from w")
def wr_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values too long for their place, in a numbered appendix of their form."""
    from formlake.operators import plan

    o = table(spark, sf_dir, "orders")
    return plan.overflow(o.select(F.col("o_custkey").alias("form"), F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")).alias("value"), (F.col("o_orderkey") % 9 + 8).alias("room")))


_PIXELS = "select cast(floor(l_orderkey / 16) as bigint) as clip, l_suppkey % 64 as x, l_partkey % 64 as y, cast(floor(l_extendedprice) as bigint) % 256 as value from {lineitem}"


@query(f"select clip, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1, count(*) as n from ({duck(_PIXELS)}) where value < 160 group by clip")
def io_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box and number of the dark pixels of each clip."""
    return geometry.ink(derived(spark, sf_dir, _PIXELS))


_CLIPS = f"select page, id, cast(floor(x0 / 8) as int) as x0, cast(floor(y0 / 4) as int) as y0, cast(floor(x0 / 8) + 3 + n as int) as x1, cast(floor(y0 / 4) + 2 + n as int) as y1 from ({BOXES}) b"


@query(f"with c as ({duck(_CLIPS)}), p as ({duck(_PIXELS)}) select page, id, count(p.x) as ink from c left join p on p.clip = c.page and p.value < 160 and p.x >= c.x0 and p.x < c.x1 and p.y >= c.y0 and p.y < c.y1 group by page, id")
def au_clip_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark pixels in each clip of each page, by tiles of the page's picture."""
    inked = geometry.ink_tiles(derived(spark, sf_dir, _PIXELS).withColumnRenamed("clip", "page"))
    return geometry.ink_within(derived(spark, sf_dir, _CLIPS), inked).select("page", "id", "ink")


#: Tables of bars: those of one customer, most of one width; uprights stand at some ends.
_OPEN_BARS = "select o_custkey as page, cast(row_number() over (partition by o_custkey order by o_orderkey) * 10 as double) as y, 0.0 as f, case when o_orderkey % 11 = 0 then 70.0 else 40.0 end as t from {orders}"
_OPEN_UPRIGHTS = "select c_custkey as page, case when c_acctbal < 0 then 0.25 when c_acctbal < 5000 then 40.25 else 20.0 end as x, 0.0 as f, 90.0 as t from {customer}"


@query(f"""with b as (select page, y, f::double as f, t::double as t from ({duck(_OPEN_BARS)})), u as (select page, x::double as x from ({duck(_OPEN_UPRIGHTS)})),
s as (select page, round_even(f, 0) as a, round_even(t, 0) as z, count(*) as n, min(y) as top, max(y) as low, min(f) as x0, max(t) as x1 from b group by 1, 2, 3), n as (select page, count(*) as bars from b group by 1),
e as (select page, unnest([x0, x1]) as x, top, low from s join n using (page) where s.n >= 3 and s.n >= 0.75 * bars)
select page, x, top, low from e where not exists (select 1 from u where u.page = e.page and abs(u.x - e.x) <= 0.6)""")
def wn_outer_uprights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outer uprights that open tables lack."""
    as_doubles = lambda df, *cs: df.withColumns({c: F.col(c).cast("double") for c in cs}).withColumnsRenamed({"f": "from", "t": "to"})
    found = geometry.completed_grid(as_doubles(derived(spark, sf_dir, _OPEN_BARS), "y", "f", "t"), as_doubles(derived(spark, sf_dir, _OPEN_UPRIGHTS), "x", "f", "t"))
    return found.select("page", "x", F.col("from").alias("top"), F.col("to").alias("low"))


#: Open tables: dividers and some edges of each customer's page, bars and labels of their orders.
_DIVIDERS = """
select c_custkey as page, cast(20 * (n_nationkey + 1) as double) as x, case when n_nationkey = 1 then 0.25 else 0.0 end as f, case when c_custkey % 3 = 0 then 45.0 else 90.0 end as t from {customer} join {nation} on n_nationkey <= c_custkey % 4
union all select c_custkey, case when c_acctbal < 0 then 0.5 when c_acctbal < 3000 then 100.25 else 99.0 end, 0.0, case when c_acctbal < 0 then 90.0 else 80.0 end from {customer} where c_acctbal < 5000"""
_NTH = "cast(row_number() over (partition by o_custkey order by o_orderkey) as double)"
_CROSSBARS = f"select o_custkey as page, {_NTH} * 10 as y, 0.0 as f, case when o_orderkey % 13 = 0 then 70.0 when o_orderkey % 11 = 0 then 120.0 else 100.0 end as t from {{orders}}"
_LABELS = f"""
select o_custkey as page, 2.0 as x0, cast(6 + (o_orderkey % 5) * 6 as double) as x1, {_NTH} * 10 - case when o_orderkey % 4 = 0 then 10 else 4 end as base, 6.0 as size, case when o_orderkey % 6 = 0 then '---' else o_orderpriority end as text from {{orders}}
union all select c_custkey, 30.0, 40.0, 5.0, 6.0, c_mktsegment from {{customer}} where c_custkey % 2 = 0"""


_NEW = "case when {0} - lag({0}) over (partition by {1} order by {0}) > 0.6 then 1 else 0 end"


@query(
    f"""with u0 as (select page, x::double as x, f::double as f, t::double as t from ({duck(_DIVIDERS)})), b as (select page, y::double as y, f::double as f, t::double as t from ({duck(_CROSSBARS)})),
l as (select page, x0::double as x0, x1::double as x1, base::double as base, size::double as size, text from ({duck(_LABELS)})),
u1 as (select *, {_NEW.format('f', 'page')} as s from u0), u2 as (select *, sum(s) over (partition by page order by f) as g from u1), u3 as (select *, {_NEW.format('t', 'page, g')} as s2 from u2), u as (select page, x, f, t, g * 1000 + sum(s2) over (partition by page, g order by t) as g from u3),
ux as (select *, {_NEW.format('x', 'page, g')} as s from u), fr as (select page, g, min(f) as y0, max(t) as y1, min(x) as lo, max(x) as hi, sum(s) + 1 as dividers from ux group by page, g),
c as (select fr.page, g, y, f, t, round(f, 1) as a, round(t, 1) as z from fr join b on b.page = fr.page and y >= y0 - 0.6 and y <= y1 + 0.6 and f <= lo + 0.6 and t >= hi - 0.6),
cs as (select *, {_NEW.format('y', 'page, g')} as s from c), st as (select page, g, count(*) as n, sum(s) + 1 as levels, min(y) as first, min(f) as x0, max(t) as x1 from cs group by page, g),
v as (select page, g, a, z, count(*) as votes from c group by page, g, a, z qualify row_number() over (partition by page, g order by votes desc, a, z) = 1),
h as (select st.page, st.g, count(*) as heads from st join fr using (page, g) join l on l.page = st.page and base >= y0 and base <= first and base <= y1 and l.x0 >= st.x0 and l.x0 <= st.x1 and trim(text) <> '' group by all),
tb as (select *, case when dividers >= 3 and levels = 2 and coalesce(heads, 0) >= 2 then 2 else 3 end as need from fr join st using (page, g) join v using (page, g) left join h using (page, g)),
ok as (select * from tb where levels >= need and votes >= need and votes >= 0.75 * n and a <= lo + 0.6 and z >= hi - 0.6),
dv as (select ok.page, ok.g, min(u.x) as divider from ok join u on u.page = ok.page and u.g = ok.g where u.x > a + 1.2 and u.x < z - 1.2 group by all),
lv as (select distinct page, g, unnest([y0, y1]) as y from ok union select page, g, y from c where exists (select 1 from ok where ok.page = c.page and ok.g = c.g)), bd as (select page, g, y as d, lead(y) over (partition by page, g order by y) as e from lv),
lb as (select ok.page, ok.g, (select count(*) from bd where bd.page = ok.page and bd.g = ok.g and exists (select 1 from l where l.page = ok.page and l.x0 >= a and l.x0 < divider and l.x1 <= divider + greatest(1.0, size) and base between bd.d and bd.e and base between y0 and y1 and regexp_matches(text, '[\\p{{L}}\\p{{N}}]'))) as labelled from ok left join dv using (page, g)),
good as (select ok.* from ok join lb using (page, g) where dividers >= 3 or labelled >= 3),
e as (select distinct page, 'vertical' as axis, unnest([a, z]) as position, y0 as f, y1 as t from good union select page, 'horizontal', unnest([y0, y1]), a, z from good),
dr as (select page, 'vertical' as axis, x as q, f, t from u0 union all select page, 'horizontal', y, f, t from b)
select page, axis, coalesce((select q from dr where dr.page = e.page and dr.axis = e.axis and abs(q - position) <= 0.6 and least(dr.t, e.t) - greatest(dr.f, e.f) >= 0.8 * (e.t - e.f) order by abs(q - position), q limit 1), position) as position, f as low, t as high from e
where not exists (select 1 from dr where dr.page = e.page and dr.axis = e.axis and abs(q - position) <= 0.6 and dr.f <= e.f + 0.6 and dr.t >= e.t - 0.6)"""
)
def wn_grid_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outer edges that open tables lack, by their dividers, crossbars and labelled bands."""
    segments = lambda df, at: df.select("page", F.col(at).cast("double").alias(at), F.col("f").cast("double").alias("from"), F.col("t").cast("double").alias("to"))
    labels = derived(spark, sf_dir, _LABELS)
    labels = labels.withColumns({c: F.col(c).cast("double") for c in ("x0", "x1", "base", "size")})
    found = open_grids.outer_edges(segments(derived(spark, sf_dir, _CROSSBARS), "y"), segments(derived(spark, sf_dir, _DIVIDERS), "x"), labels)
    return found.select("page", "axis", "position", F.col("from").alias("low"), F.col("to").alias("high"))


_FILL_SQL = "(" + "|".join(f"{m}(?: *{m}){{3,}}" for m in ("_", r"\.", "-", "#", "%", r"\*", r"\$", "&")) + ")"


@query(f"with {views.LINES_SQL}, r as (select doc_id, n, unnest(regexp_extract_all(replace(line, '#', '__'), '{_FILL_SQL}')) as run, generate_subscripts(regexp_extract_all(replace(line, '#', '__'), '{_FILL_SQL}'), 1) as k from lines) select doc_id as doc, count(*) as places, sha256(string_agg(n || ':' || run, chr(10) order by n, k)) as digest from r group by doc_id")
def pj_place_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of each document, with a digest of all of them in order."""
    lines = views.lines(spark, sf_dir)
    places = lines.select("doc_id", "n", F.posexplode(sequences.filler_runs(F.replace("line", F.lit("#"), F.lit("__")))).alias("k", "run"))
    found = F.array_sort(F.collect_list(F.struct("n", "k", "run")))
    maps = places.groupBy(F.col("doc_id").alias("doc")).agg(F.count("*").alias("places"), found.alias("p"))
    return maps.select("doc", "places", F.sha2(F.array_join(F.transform("p", lambda z: F.concat(z["n"].cast("string"), F.lit(":"), z["run"])), "\n"), 256).alias("digest"))


@query(
    f"""with {views.LINES_SQL}, p as (select doc_id as doc, n, n // 40 as page, string_split_regex(regexp_replace(replace(line, '#', '__'), '{_FILL_SQL}', chr(1) || '\\1' || chr(2), 'g'), '[\\x01\\x02]') as p from lines),
b as (select *, coalesce(sum(len(p) // 2) over (partition by doc, page order by n rows between unbounded preceding and 1 preceding), 0)::int as base from p),
s as (select doc, page, n, len(p) // 2 as places, array_to_string(list_transform(p, lambda x, i: case when i % 2 = 0 then '[' || (base + i // 2) || ']' else x end), '') as shown,
  array_to_string(list_transform(range(1, len(p) // 2 + 1), lambda k: n || ':' || coalesce(list_sum(list_transform(p[1:(2 * k - 1)::int], lambda y: length(y))), 0)::int || ':' || length(p[(2 * k)::int])), ',') as places_at from b),
g as (select doc, page, sum(places)::bigint as places, sha256(string_agg(sha256(shown || chr(10) || places_at), chr(10) order by n)) as digest from s group by doc, page),
o as (select *, min(doc) over (partition by digest) as owner from g)
select doc, count(*) as pages, sum(places)::bigint as places, count_if(owner <> doc)::bigint as reused, sha256((select sha256(text) from documents d where d.doc_id = doc) || chr(10) || string_agg(digest, chr(10) order by page)) as digest from o group by doc"""
)
def pj_build_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of each document: pages of forty lines with numbered places, bound to the document's digest; equal pages are measured once."""
    lines = views.lines(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.floor(F.col("n") / 40).alias("page"), "n", F.replace("line", F.lit("#"), F.lit("__")).alias("text"))
    found = maps.with_owner(maps.pages(maps.rendered_lines(lines, sequences.FILLERS)))
    return maps.maps(found, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.sha2("text", 256).alias("sha")))


# Edits over runs


@query(
    f"""with {views.LINES_SQL}, runs as (select doc_id, n, k, w || case when k < m then ' ' else '' end as t, w, 'abc'[1 + k % 3] as style from (select doc_id, n, unnest(range(0, len(string_split(line, ' ')))) as k, len(string_split(line, ' ')) - 1 as m, unnest(string_split(line, ' ')) as w from lines)),
placed as (select *, sum(length(t)) over (partition by doc_id, n order by k) - length(t) as b, lead(w) over (partition by doc_id, n order by k) as nxt from runs),
edits as (select doc_id, n, b + 1 as s, b + length(t) + 1 as u, 'V' || k as v, style from placed where k % 5 = 2 and w <> '' and coalesce(nxt, '') <> ''),
chars as (select doc_id, n, b + unnest(range(0, length(t))) as i, unnest(string_split(t, '')) as c, style from placed where t <> ''),
kept as (select c.* from chars c where not exists (select 1 from edits e where e.doc_id = c.doc_id and e.n = c.n and c.i >= e.s and c.i < e.u)),
parts as (select doc_id, n, i as pos, 1 as kept, c as t, style as s from kept union all select doc_id, n, s, 0, v, repeat(case when length(t2) > 1 then style else nst end, length(v)) from (select e.*, p.t as t2, chr(97 + ((ascii(e.style) - 97 + 1) % 3)) as nst from edits e join placed p on p.doc_id = e.doc_id and p.n = e.n and p.b = e.s - 1 and p.t <> ''))
select doc_id, n, sha256(string_agg(t, '' order by pos, kept)) as text_sha, sha256(string_agg(s, '' order by pos, kept)) as style_sha, sum(length(t))::bigint as chars from parts group by doc_id, n"""
)
def wr_docx_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that begin in one run and end in the next, over every line of every document; digests of the new text and of each character's format."""
    from formlake.operators import edits as E

    # Lines are dealt out before they become words: nothing but whole lines is shuffled.
    words = views.lines(spark, sf_dir).repartition("doc_id", "n").select("doc_id", "n", F.posexplode(F.split("line", " ")).alias("run", "w"))
    w = Window.partitionBy("doc_id", "n").orderBy("run")
    next_ = F.lead("w").over(w)
    runs = words.select("doc_id", "n", "run", "w", next_.alias("nxt"), F.concat("w", F.when(next_.isNull(), "").otherwise(" ")).alias("text"), F.substring(F.lit("abc"), (F.col("run") % 3 + 1), F.lit(1)).alias("style"))
    placed = E.placed_runs(runs, ["doc_id", "n"]).filter((F.col("run") % 5 == 2) & (F.col("w") != "") & (F.coalesce("nxt", F.lit("")) != ""))
    edits = placed.select("doc_id", "n", (F.col("begin") + 1).alias("start"), (F.col("end") + 1).alias("until"), F.concat(F.lit("V"), F.col("run").cast("string")).alias("value"))
    pieces = E.edited_runs(runs.select("doc_id", "n", "run", "text", "style"), edits, ["doc_id", "n"])
    found = pieces.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("run", "piece", "text", "style"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    style = F.array_join(F.transform("p", lambda x: F.repeat(x["style"], F.length(x["text"]))), "")
    return found.select("doc_id", "n", F.sha2(text, 256).alias("text_sha"), F.sha2(style, 256).alias("style_sha"), F.length(text).cast("long").alias("chars"))


# Versions of marked-up texts


_WRITTEN = "case pos % 23 when 5 then 'V' || pos when 11 then 'X' || pos when 17 then 'W' || pos end"
_WHY = "case pos % 23 when 11 then 'change that nobody planned' when 17 then 'not what was planned' end"


@query(
    rf"with t as (select page_id, unnest(regexp_extract_all(html, '(?s)(<!--.*?-->|<[^>]*>|[^<]+|<)')) as tok, generate_subscripts(regexp_extract_all(html, '(?s)(<!--.*?-->|<[^>]*>|[^<]+|<)'), 1) - 1 as pos from pages), w as (select page_id as page, pos, tok as old, {_WRITTEN} as new, {_WHY} as reason from t where not starts_with(tok, '<')) select * from w where new is not null and new <> old"
)
def au_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that changed in every page's tree: those that were planned, those that were not, and those written otherwise."""
    from formlake.operators import trees

    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    parts = F.regexp_extract_all("html", F.lit(r"(?s)(<!--.*?-->|<[^>]*>|[^<]+|<)"), F.lit(1))
    new = lambda i: F.when(i % 23 == 5, F.concat(F.lit("V"), i.cast("string"))).when(i % 23 == 11, F.concat(F.lit("X"), i.cast("string"))).when(i % 23 == 17, F.concat(F.lit("W"), i.cast("string")))
    written = F.array_join(F.transform(parts, lambda t, i: F.when(~t.startswith("<"), F.coalesce(new(i), t)).otherwise(t)), "")
    plan = trees.tokens(pages, "page_id", "html").filter(~F.col("token").startswith("<") & (F.col("pos") % 23).isin(5, 17)).select("page_id", "pos", F.concat(F.lit("V"), F.col("pos").cast("string")).alias("new"))
    changed = pages.select("page_id", F.inline(trees.text_changes(F.col("html"), written)))
    return trees.placement_problems(changed, plan, "page_id").select(F.col("page_id").alias("page"), "pos", "old", "new", "reason")


# Points of Word parts

#: A document's line as Word XML, by its shape m; others show the line's text. What each shape's point is stands in the SQL.
_SHAPES = {
    5: "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Only {n}</w:t></w:r></w:p></w:tc></w:tr></w:tbl>",
    6: "<mc:AlternateContent><mc:Choice><w:p><w:r><w:t>{t}</w:t></w:r></w:p></mc:Choice></mc:AlternateContent>",
    7: '<w:p><w:sdt><w:sdtPr><w:text/><w:dataBinding w:xpath="/a"/></w:sdtPr><w:sdtContent><w:r><w:t>____</w:t></w:r></w:sdtContent></w:sdt></w:p>',
    8: '<w:p><w:sdt><w:sdtPr><w14:checkbox><w14:checked w14:val="1"/></w14:checkbox></w:sdtPr><w:sdtContent><w:r><w:t>☒</w:t></w:r></w:sdtContent></w:sdt></w:p>',
    9: "<w:p><w:sdt><w:sdtPr><w:text/><w:showingPlcHdr/></w:sdtPr><w:sdtContent><w:r><w:t>Type ____ here</w:t></w:r></w:sdtContent></w:sdt></w:p>",
    10: "<w:p><w:sdt><w:sdtPr/><w:sdtContent><w:r><w:t>R {n}</w:t></w:r></w:sdtContent></w:sdt></w:p>",
    11: '<w:p><w:r><w:fldChar w:fldCharType="begin"/><w:instrText> FORMTEXT </w:instrText><w:fldChar w:fldCharType="separate"/><w:t>_____</w:t><w:fldChar w:fldCharType="end"/></w:r></w:p>',
    12: '<w:p><w:r><w:fldChar w:fldCharType="begin"><w:ffData><w:checkBox><w:default w:val="1"/></w:checkBox></w:ffData></w:fldChar><w:fldChar w:fldCharType="end"/></w:r></w:p>',
    13: '<w:p><w:fldSimple w:instr=" FORMTEXT "><w:r><w:t>_____</w:t></w:r></w:fldSimple></w:p>',
    14: '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:t>item {n}</w:t></w:r></w:p>',
    15: '<w:p><w:r><w:fldChar w:fldCharType="begin"/><w:instrText> IF </w:instrText><w:fldChar w:fldCharType="begin"/><w:instrText> FORMTEXT </w:instrText><w:fldChar w:fldCharType="separate"/><w:t>_____</w:t><w:fldChar w:fldCharType="end"/><w:fldChar w:fldCharType="end"/></w:r></w:p>',
    16: "<w:p/>",
    17: "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Name {n}</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>",
    18: "<w:ins><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:ins>",
    19: "<w:p><w:r><w:t>Label {n}:</w:t></w:r></w:p>",
}
_POINT_SQL = rf"""with {views.LINES_SQL}, c as (select doc_id, n, (doc_id + n) % 20 as m, replace(regexp_replace(line, '[.…·_]+', '.', 'g'), '#', '_____') as t from lines),
p as (select doc_id, m, t, n as line, (sum(case when m = 17 then 2 else 1 end) over (partition by doc_id order by n) - case when m = 17 then 2 else 1 end)::int as n from c),
plain as (select doc_id, n, t, case m when 6 then 'other representations' when 18 then 'open revisions' end as reason,
  regexp_replace(regexp_replace(t, '{word_points.FILLER}|{word_points.BOX}', chr(3), 'g'), '\[[^\[\]\r\n\x03]+\]', chr(3), 'g') as masked from p where m < 5 or m in (6, 18)),
words as (select *, unnest(regexp_extract_all(masked, '[ \t]+|[^ \t]+')) as w, generate_subscripts(regexp_extract_all(masked, '[ \t]+|[^ \t]+'), 1) as k from plain),
near as (select *, lag(w) over (partition by doc_id, n order by k) as b, lead(w) over (partition by doc_id, n order by k) as a from words),
shown as (select doc_id, n, 'testo' as kind, unnest(regexp_extract_all(t, '{word_points.FILLER}')) as text, null::boolean as checked, false as candidate, reason from plain
  union all select doc_id, n, 'glifo_casella', x, regexp_matches(x, '{word_points.TICKED}'), false, reason from (select *, unnest(regexp_extract_all(t, '{word_points.BOX}')) as x from plain)
  union all select doc_id, n, 'segnaposto_testuale', unnest(list_filter(regexp_extract_all(t, '{word_points.PLACEHOLDER}'), lambda x: not regexp_matches(x, '{word_points.FILLER}|{word_points.BOX}'))), null, true, reason from plain
  union all select doc_id, n, 'spazio_implicito', w, null, true, reason from near where regexp_full_match(w, '{word_points.BLANKS}') and k > 1 and not ends_with(b, chr(3)) and not starts_with(coalesce(a, ''), chr(3)))
select * from shown
union all select doc_id, n, 'paragrafo_vuoto', '', null, true, reason from plain where not regexp_matches(t, '\S')
union all select doc_id, n, 'inserimento_testo', '', null, true, reason from plain where regexp_matches(t, '^[^:\n]{{2,100}}:\s*$') and not exists (select 1 from shown s where s.doc_id = plain.doc_id and s.n = plain.n)
union all select doc_id, case when m = 17 then n + 1 else n end,
  case m when 5 then 'inserimento_testo' when 7 then 'sdt_testo' when 8 then 'sdt_casella' when 9 then 'sdt_testo' when 10 then 'sdt_rich_text' when 11 then 'form_testo' when 12 then 'form_casella' when 13 then 'form_semplice_testo' when 14 then 'elenco_casella' when 15 then 'form_testo' when 16 then 'paragrafo_vuoto' when 17 then 'cella_vuota' else 'inserimento_testo' end,
  case m when 7 then '____' when 8 then '☒' when 9 then 'Type ____ here' when 10 then 'R ' || line when 11 then '_____' when 13 then null when 14 then 'item ' || line when 15 then '_____' else '' end,
  case m when 8 then true when 12 then true when 14 then false end, m in (5, 16, 17, 19),
  case m when 7 then 'bound, locked or of several paragraphs' when 10 then 'already filled' when 12 then 'field without a plain result' when 13 then 'simple field' when 15 then 'field without a plain result' end
  from p where m not in (0, 1, 2, 3, 4, 6, 18)"""


@query(_POINT_SQL)
def wn_word_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of every document's Word part: controls, form fields, lists, texts, cells and empty paragraphs, and why some are not written."""

    def shape(line: Column, n: Column) -> Column:
        text = F.replace(F.regexp_replace(line, "[.…·_]+", "."), F.lit("#"), F.lit("_____"))
        for char, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(char), F.lit(mark))
        filled = lambda s: F.concat(*[text if piece == "{t}" else n.cast("string") if piece == "{n}" else F.lit(piece) for piece in re.split(r"(\{[tn]\})", s)])
        out, kind = F, (F.col("doc_id") + n) % 20
        for m, s in _SHAPES.items():
            out = out.when(kind == m, filled(s))
        return out.otherwise(filled("<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"))

    body = F.array_join(F.transform(F.split("text", "\n"), shape), "")
    parts = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<w:document><w:body>"), body, F.lit("</w:body></w:document>")).alias("xml"))
    levels = spark.sql("select '3' as num, '0' as level, '☐' as glyph")
    return word_points.points(parts, ["doc_id"], "xml", levels).select("doc_id", "n", "kind", "text", "checked", "candidate", "reason")
