"""Queries of projections, Word files, writers and reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.functions import formats, projection
from formlake.operators import evidence, geometry
from formlake.plans.registry import query
from formlake.sources import documents, profiles, word_writer


# Formats


@query("select event_id, round_even(v, 0) + 0.0 as r from (select event_id, floor(value * 2) / 2 - 20 as v from events)")
def fm_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formlake.tables import table

    return table(spark, sf_dir, "events").select("event_id", formats.rounded(F.floor(F.col("value") * 2) / 2 - 20).alias("r"))


_KIND_OF = "case l_linenumber when 1 then 'bool' when 2 then 'int' when 3 then 'float' else 'text' end as kind"
_TEXT_OF = "case l_linenumber when 1 then 'true' when 2 then case when l_tax = 0 then '0' else '7' end when 3 then case when l_discount > 0.05 then 'NaN' when l_discount > 0.02 then 'inf' else '0.0' end else case when l_returnflag = 'R' then ' ' else l_linestatus end end as v"


@query(f"select id, kind, case when kind <> 'bool' and trim(v) <> '' and v not in ('NaN', 'inf') then v end as text from (select l_orderkey as id, {_KIND_OF}, {_TEXT_OF} from lineitem)")
def fm_strip_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a scalar: zero is one, a yes or no and a blank are none."""
    from formlake.tables import table

    t = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as id", _KIND_OF, _TEXT_OF)
    return t.select("id", "kind", formats.scalar_text(F.col("kind"), F.col("v")).alias("text"))


# Text of forms


# Measured pages

@query("select page, round_even(size, 0) as body from (select l_orderkey as page, l_quantity / 4 as size from lineitem) group by page, round_even(size, 0) qualify row_number() over (partition by page order by count(*) desc, round_even(size, 0)) = 1")
def ag_mode_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent rounded size of a page's glyphs, the smaller of equals."""
    from formlake.tables import table

    return geometry.body_sizes(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_quantity") / 4).alias("size")))


@query("with d as (select *, x - lag(x) over (partition by page, y order by x) as s from (select o_custkey as page, month(o_orderdate) as y, floor(o_totalprice / 1000) as x from orders)), m as (select page, y, count(*) as n, median(s) as step from d group by page, y) select m.page, m.y, n, step, round(avg(case when s is null then null when abs(s - step) <= 0.25 * step then 1.0 else 0.0 end), 6) as regular from m join d using (page, y) group by m.page, m.y, n, step")
def ag_median_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step of rows of marks, and how regular it is."""
    from formlake.tables import table

    dots = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.month("o_orderdate").cast("long").alias("y"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("x"))
    return geometry.row_steps(dots).withColumn("regular", F.round("regular", 6))


@query("select o_orderkey as id, case when trim(a) <> '' then trim(a) when trim(b) <> '' then trim(b) else name end as label from (select *, case when o_orderstatus = 'F' then ' ' || o_orderpriority when o_orderstatus = 'P' then '  ' end as a, case when o_orderkey % 3 = 0 then 'sopra' end as b, 'w' || o_custkey as name from orders)")
def wn_widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A widget's printed labels, left then above, before its internal name."""
    from formlake.tables import table

    o = table(spark, sf_dir, "orders")
    left = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), "o_orderpriority")).when(F.col("o_orderstatus") == "P", "  ")
    return o.select(F.col("o_orderkey").alias("id"), evidence.widget_label(left, F.when(F.col("o_orderkey") % 3 == 0, "sopra"), name=F.concat(F.lit("w"), F.col("o_custkey").cast("string"))).alias("label"))


@query("select doc_id, turn, case turn when 90 then 842 - y when 180 then 595 - x when 270 then y else x end as x, case turn when 90 then x when 180 then 842 - y when 270 then 595 - x else y end as y from (select doc_id, doc_id % 4 * 90 as turn, n_chars % 595 * 1.0::double as x, n_chars % 842 * 1.0::double as y from documents)")
def io_pdf_upright(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on turned pages, as if they stood upright."""
    from formlake.tables import table

    t = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4 * 90).alias("turn"), (F.col("n_chars") % 595).cast("double").alias("x"), (F.col("n_chars") % 842).cast("double").alias("y"))
    return t.withColumn("p", geometry.upright(F.col("turn"), F.col("x"), F.col("y"), F.lit(595.0), F.lit(842.0))).select("doc_id", "turn", "p.x", "p.y")


# Rules and writers


_PROGRAM = """
'what a form writes for a customer'
code, level = name[-4:], 'alto' if balance > 5000 and segment not in ['MACHINERY', 'BUILDING'] else 'basso' if 0 < balance else 'rosso'
first = name[0] + name[1:3].upper() + {'AUTOMOBILE': 'a', 'HOUSEHOLD': 'h'}.get(segment, '-')
digit = max(min(int(balance / 1000), 9), -1)
note = segment and not balance == 0 and name.split('#')[-1].replace('0', '') or '?'
return first + code + ':' + level + ':' + str(len(segment)) + ':' + str(digit) + ':' + note
"""


@query(
    """select c_custkey, substr(c_name, 1, 1) || upper(substr(c_name, 2, 2)) || case c_mktsegment when 'AUTOMOBILE' then 'a' when 'HOUSEHOLD' then 'h' else '-' end || right(c_name, 4)
  || ':' || case when c_acctbal > 5000 and c_mktsegment not in ('MACHINERY', 'BUILDING') then 'alto' when c_acctbal > 0 then 'basso' else 'rosso' end || ':' || length(c_mktsegment)
  || ':' || greatest(least(trunc(c_acctbal / 1000)::bigint, 9), -1) || ':' || case when c_acctbal <> 0 and replace(split_part(c_name, '#', -1), '0', '') <> '' then replace(split_part(c_name, '#', -1), '0', '') else '?' end as v
from customer"""
)
def ud_projection_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    from formlake.tables import table

    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return c.select("c_custkey", projection.program(_PROGRAM, c.schema).alias("v"))


# Places, writers and reports


_WRITES = "case l_linenumber when 1 then 'celle' when 2 then 'casella' when 3 then 'riempimento' when 4 then 'tratto' when 5 then 'area' else 'widget' end"


@query(f"""select id, kind, case when kind = 'casella' and not coalesce(v in ('true', 'false'), false) then 'needs yes or no' when kind <> 'casella' and trim(coalesce(v, '')) = '' then 'blank' when kind = 'celle' and length(v) > room then 'too many characters'
  when kind in ('riempimento', 'tratto', 'area') and length(v) * 0.5 > room then 'too wide' when kind in ('riempimento', 'tratto') and contains(v, chr(10)) then 'more than a line' when kind = 'widget' and room > 0 and length(v) > room then 'beyond the field''s limit' end as reason
from (select l_orderkey as id, {_WRITES} as kind, case when l_tax = 0 then ' ' when l_tax = 0.08 then null when l_discount > 0.08 then 'a' || chr(10) || 'b' when l_quantity < 10 then 'true' else repeat('x', (l_quantity / 2)::int) end as v, l_linenumber * 2 - 4 as room from lineitem)""")
def wr_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write into each kind of place succeeds or says why not; nothing is cut."""
    from formlake.tables import table

    value = F.when(F.col("l_tax") == 0, " ").when(F.col("l_tax") == 0.08, F.lit(None)).when(F.col("l_discount") > 0.08, "a\nb").when(F.col("l_quantity") < 10, "true").otherwise(F.expr("repeat('x', cast(bround(l_quantity / 2) as int))"))
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.expr(_WRITES).alias("kind"), value.alias("v"), (F.col("l_linenumber") * 2 - 4).alias("room"))
    return t.select("id", "kind", geometry.write_problem(F.col("kind"), F.col("v"), F.col("room"), F.length("v") * 0.5).alias("reason"))


_CELL_INK = "select l_orderkey as id, substr('ab c d', 1, (1 + l_orderkey % 6)::int) as value, l_linenumber - 1 as place, floor(l_quantity) - 4 as gain, round(l_discount * 100) - 7 as divider from lineitem"


@query(f"""with c as ({_CELL_INK}), e as (select *, place < length(value) and substr(value, (place + 1)::int, 1) <> ' ' as expected from c),
t as (select id, count(*) filter (place > 0 and divider > 2) as crossed, count(*) filter (expected and gain <= 0) as empty, count(*) filter (not expected and gain > 2) as stray from e group by id)
select id, 'celle' as kind, case when crossed > 0 then 'dividers crossed' when empty > 0 then 'cells left empty' when stray > 0 then 'stray ink' end as reason from t
union all select event_id, 'casella', case when v is null then 'needs yes or no' when not v and (gain > 2 or outside > 2) then 'should be empty' when v and gain < 100 * 0.02 then 'no mark inside' when v and outside > 6 then 'mark outside' end
from (select event_id, case event_type when 'error' then null else event_type = 'click' end as v, floor(value) as gain, user_id % 9 as outside from events)""")
def au_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ink gained by written cells and boxes says of the writing."""
    from formlake.tables import table

    text = _CELL_INK.replace("from lineitem", "from {lineitem}").replace("l_linenumber - 1 as", "cast(l_linenumber - 1 as int) as")
    cells = geometry.verified_cells(spark.sql(text, lineitem=table(spark, sf_dir, "lineitem")))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", F.col("event_type") == "click").alias("v"), F.floor("value").alias("gain"), (F.col("user_id") % 9).alias("outside"))
    boxes = e.select("id", F.lit("casella").alias("kind"), geometry.box_problem(F.col("v"), F.col("gain"), F.col("outside"), F.lit(100.0)).alias("reason"))
    return cells.select("id", F.lit("celle").alias("kind"), "reason").unionByName(boxes)


@query("select l_orderkey as id, sum(old) / sum(now - old) as ratio, sum(old) / sum(now - old) > 0.12 as illegible from (select l_orderkey, floor(l_discount * 100) as old, floor(l_quantity / 3) as now from lineitem) where now > old group by l_orderkey")
def wn_new_ink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old ink on the pixel rows that gained ink, over the new: beyond 12 % the text cannot be read."""
    from formlake.tables import table

    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("y"), F.floor(F.col("l_discount") * 100).cast("double").alias("old"), F.floor(F.col("l_quantity") / 3).cast("double").alias("now"))
    return evidence.legibility(li)


@query(
    r"select doc_id, n, case when trim(line) = '' then 'paragrafo_vuoto' when regexp_matches(line, '[☐☑☒□]') then 'glifo_casella' when regexp_matches(line, '_{3,}|\.{5,}|…{2,}') then 'segnaposto_testuale' when regexp_matches(line, ':\s*$') then 'spazio_implicito' end as kind from (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as n, unnest(string_split(text, chr(10))) as line from documents)"
)
def wn_paragraph_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of place each paragraph offers by its text alone."""
    from formlake.plans import views

    return views.lines(spark, sf_dir).select("doc_id", "n", documents.point_kind(F.col("line")).alias("kind"))


#: The paragraphs of the documents' Word files.
_PARAGRAPHS_SQL = "(select doc_id::varchar as path, unnest(range(0, len(string_split(text, chr(10))))) as n, unnest(string_split(text, chr(10))) as text from documents) p"


def _word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: every document as a Word file, its lines as paragraphs in runs of nine characters."""
    from formlake.tables import table

    return documents.new_word_files(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.split("text", "\n").alias("texts")))


@query(f"select path, n, text, '' as warning from {_PARAGRAPHS_SQL} union all select 'page' || page_id, -1, '', 'not a Word file' from pages")
def io_docx_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of every document's Word file; web pages among the files are none."""
    from formlake.tables import table

    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("path"), F.col("html").cast("binary").alias("content"))
    return documents.word_paragraphs(_word_files(spark, sf_dir).unionByName(pages)).select("path", "n", "text", "warning")


@query(f"select path, n, unnest(list_filter(regexp_extract_all(replace(replace(text, '#', '_'), '*', '.'), '[_.…]{{2,}}'), lambda r: length(r) + length(regexp_replace(r, '[^_]', '', 'g')) >= 5)) as run from {_PARAGRAPHS_SQL}")
def io_docx_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filler runs of every document's Word file, symbols taken as fillers."""
    paragraphs = documents.word_paragraphs(_word_files(spark, sf_dir))
    return documents.word_places(paragraphs.withColumn("text", F.translate("text", "#*", "_."))).select("path", "n", "run")


def _word_edits(paragraphs: DataFrame) -> DataFrame:
    """The first four characters of each paragraph, where odd ones expect something else, and its first filler behind them."""
    head = paragraphs.select("path", "part", "n", F.lit(0).alias("start"), F.lit(4).alias("until"), F.when(F.col("n") % 2 == 0, F.substring("text", 1, 4)).otherwise("zzzz").alias("expected"), F.lit("X").alias("value"))
    at = F.instr("text", "###") - 1
    return head.unionByName(paragraphs.filter(at >= 4).select("path", "part", "n", at.alias("start"), (at + 3).alias("until"), F.lit("###").alias("expected"), F.concat(F.lit("V"), F.col("n").cast("string")).alias("value")))


_AT = "instr(text, '###') - 1"


@query(f"select path, n, 0 as start, case when length(text) < 4 then 'beyond the text' when n % 2 = 1 then 'text has changed' end as reason from {_PARAGRAPHS_SQL} union all select path, n, {_AT}, null from {_PARAGRAPHS_SQL} where {_AT} >= 4")
def wr_docx_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of every document's paragraphs, checked against the text they were planned for."""
    paragraphs = documents.word_paragraphs(_word_files(spark, sf_dir)).filter("n >= 0")
    return word_writer.planned_edits(paragraphs, _word_edits(paragraphs)).select("path", "n", "start", "reason")


@query(f"select path, n, case when n % 2 = 0 and length(text) >= 4 then 'X' || substr(t, 5) else t end as text from (select path, n, text, case when {_AT} >= 4 then substr(text, 1, {_AT}) || 'V' || n || substr(text, {_AT} + 4) else text end as t from {_PARAGRAPHS_SQL})")
def io_docx_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of every document's Word file, written and read again."""
    files = _word_files(spark, sf_dir)
    paragraphs = documents.word_paragraphs(files)
    return documents.word_paragraphs(word_writer.saved(files, word_writer.planned_edits(paragraphs, _word_edits(paragraphs)))).select("path", "n", "text")


@query("with b as (select *, dense_rank() over (partition by o_custkey order by month(o_orderdate)) as p from orders) select o_orderkey as id, s as state, k as key from (select *, case when o_totalprice > 200000 then 'dubbio' else o_orderstatus end as s, case when o_totalprice < 50000 then null else o_orderpriority end as k from b) where p <= 6 and o_orderkey % 3 = 0 and (s is distinct from o_orderstatus or k is distinct from o_orderpriority)")
def pl_visual_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that a reviewer of at most six pages of each form changed."""
    from formlake.tables import table

    o = table(spark, sf_dir, "orders")
    before = o.select(F.col("o_custkey").alias("form"), F.month("o_orderdate").alias("page"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("key"))
    seen = o.filter("o_orderkey % 3 = 0")
    after = seen.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") > 200000, "dubbio").otherwise(F.col("o_orderstatus")).alias("state"), F.when(F.col("o_totalprice") >= 50000, F.col("o_orderpriority")).alias("key"))
    return evidence.reviewed(before, after)


@query("with p as (select o_custkey as form, list_sort(list(distinct o_orderpriority || month(o_orderdate))) as p from orders where o_orderstatus <> 'F' group by 1) select c_custkey as form, c_mktsegment || ': ' || (c_custkey % 7) || ' verificate' || case when p is null then '' else '; punti aperti: ' || array_to_string(p[1:12], ', ') || case when len(p) > 12 then ' e altri ' || (len(p) - 12) else '' end end as report from customer left join p on p.form = c_custkey")
def io_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form's verdict as a line; twelve open points are named at most."""
    from formlake.tables import table

    forms = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("form"), F.col("c_mktsegment").alias("state"), (F.col("c_custkey") % 7).alias("verified"))
    opened = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("form"), F.concat("o_orderpriority", F.month("o_orderdate").cast("string")).alias("point"))
    return evidence.report_lines(forms, opened)


@query("select l_returnflag as k, count(*) as n from lineitem group by 1")
def io_atomic_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published to a new folder, all of it or nothing, and read again."""
    import uuid

    from formlake.tables import table

    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n"))
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/published-{uuid.uuid4().hex}"
    profiles.published(counted, path)
    return spark.read.parquet(path)


@query("select * from (values ('ancore', 0), ('esiti', 0), ('misure', 0), ('moduli', 25)) t(name, n)")
def io_archive_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new archive, opened twice: what was written in between stays."""
    import uuid

    from formlake.operators import archive
    from formlake.tables import table

    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/archive-{uuid.uuid4().hex}"
    first = archive.opened(spark, folder)["moduli"]
    forms = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.sha2("n_name", 256).alias("sha"), F.col("n_name").alias("ente"), F.lit(1).alias("pagine"), F.length("n_name").cast("long").alias("caratteri"), F.lit(False).alias("scansione"))
    forms.select(first.columns).write.mode("append").parquet(f"{folder}/moduli")
    out = None
    for name, rows_ in sorted(archive.opened(spark, folder).items()):
        own = rows_.agg(F.count("*").cast("int").alias("n")).select(F.lit(name).alias("name"), "n")
        out = own if out is None else out.unionByName(own)
    return out
