"""Queries of the reporting, matching, sequence and rule operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formlake.functions import text as T
from formlake.operators import archive, evidence, matching, plan, projections, rules, sequences
from formlake.plans import views
from formlake.plans.registry import ORACLE, query
from formlake.plans.views import ANCHORS_SQL, FORMS_SQL, LINES_SQL, OUTCOMES_SQL
from formlake.tables import table

long = lambda c: F.col(c).cast("long")


# Archive reports


@query(f"with {FORMS_SQL} select count(*) as forms, sum(pages)::bigint as pages, sum(scanned)::bigint as scanned from forms")
def ag_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.totals(views.forms(spark, sf_dir))


@query(
    f"""with {ANCHORS_SQL}, {OUTCOMES_SQL},
f as (select form, count(*) as fields from anchors group by form),
m as (select o.form, coalesce(f.fields, 0) as fields, (state = 'verificata')::int as verified, (state = 'non_riuscita')::int as failed, (state = 'non_segnalata')::int as silent, case when kind = 'de' then 'lingua' end as trouble from outcomes o left join f using (form))
select count(*) as measured, sum(fields)::bigint as fields, sum(verified)::bigint as verified, sum(failed)::bigint as failed, sum(silent)::bigint as silent from m where trouble is null"""
)
def ag_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = views.anchors(spark, sf_dir).groupBy("form").agg(F.count("*").alias("fields"))
    states = {"verified": "verificata", "failed": "non_riuscita", "silent": "non_segnalata"}
    measures = views.outcomes(spark, sf_dir).join(fields, "form", "left").select(F.coalesce("fields", F.lit(0)).alias("fields"), *[(F.col("state") == s).cast("int").alias(n) for n, s in states.items()], F.when(F.col("kind") == "de", "lingua").alias("trouble"))
    return archive.coverage(measures)


@query(f"with {ANCHORS_SQL} select kind, count(*) as fields, count(distinct form) as forms from anchors group by kind")
def ag_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.by_kind(views.anchors(spark, sf_dir))


@query(f"with {ANCHORS_SQL} select many, count(*) as fields, count(distinct form) as forms from anchors where kind = 'riempimento' and many is not null group by many")
def ag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.by_length(views.anchors(spark, sf_dir), "riempimento")


@query(f"with {ANCHORS_SQL} select many, count(*) as fields, count(distinct form) as forms from anchors where kind = 'celle' group by many")
def ag_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.by_length(views.anchors(spark, sf_dir), "celle")


@query(f"with {ANCHORS_SQL} select round(side, 1) as side, count(*) as fields, count(distinct form) as forms from anchors where kind = 'casella' group by round(side, 1)")
def ag_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.by_side(views.anchors(spark, sf_dir))


@query(f"with {OUTCOMES_SQL} select kind, state, substring(reason, 1, 52) as reason, count(*) as many, count(distinct form) as forms from outcomes where state <> 'verificata' group by all")
def ag_troubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.troubles(views.outcomes(spark, sf_dir))


@query(f"with {FORMS_SQL}, {OUTCOMES_SQL} select id, sha, kind, reason from outcomes o join forms f on f.id = o.form where state = 'non_segnalata'")
def jn_equi_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.silent_errors(views.outcomes(spark, sf_dir), views.forms(spark, sf_dir))


@query(f"with {FORMS_SQL}, {ANCHORS_SQL} select id, pages, scanned from forms left join anchors on form = id where form is null")
def jn_left_null_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.forms_without_places(views.forms(spark, sf_dir), views.anchors(spark, sf_dir))


@query("select user_id, substring(props, 1, 6) as props, value, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def ag_replace_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], {"props": 6}).select("user_id", "props", "value", "event_id")


@query("select sha256(text) as sha, min(doc_id) as id, count(*) as copies from documents group by 1")
def ag_dedup_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.first_by_hash(table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256)), "sha", "doc_id")


_VERDICT = f"""with {OUTCOMES_SQL}, {ANCHORS_SQL},
op as (select form, count(*) as n from anchors where kind = 'celle' group by form),
s as (select o.form, max((state = 'non_segnalata')::int) as a, max((state = 'non_riuscita')::int) as b, max((state = 'verificata')::int) as c, max(coalesce(n, 0)) as n from outcomes o left join op using (form) group by o.form),
v as (select form, case when a = 1 then 'errori_non_segnalati' when b = 1 then 'non_riuscito' when n > 0 or c = 0 then 'mancano_dati' else 'completo' end as state from s)
"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.verdict(views.outcomes(spark, sf_dir), views.anchors(spark, sf_dir).filter("kind = 'celle'"))


@query(_VERDICT + "select form, state from v")
def ag_verdict_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


@query(_VERDICT + "select state, count(*) as n from v group by state")
def au_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query(_VERDICT + "select form, state from v where state <> 'errori_non_segnalati' and state <> 'non_riuscito'")
def vd_conflict_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms whose result may be kept: no silent error and no failed write."""
    return _verdicts(spark, sf_dir).filter(~F.col("state").isin("errori_non_segnalati", "non_riuscito"))


_STATES = ["assegna", "dato_assente", "dubbio", "manuale", "non_campo", "da_confermare"]
_STATE = "case o_orderstatus when 'F' then 'assegna' when 'O' then 'da_confermare' else case when o_orderpriority = '5-LOW' then 'manuale' else 'dubbio' end end"


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as decisions: id, form, page, state, key, origin, failed, is_choice."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("form"),
        (F.col("o_orderkey") % 9).alias("page"),
        F.expr(_STATE).alias("state"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "utente").alias("origin"),
        (F.col("o_orderkey") % 7 == 0).alias("failed"),
        (F.col("o_orderkey") % 5 == 0).alias("is_choice"),
        "o_orderdate",
        "o_totalprice",
    )


_DECISIONS = f"""d as (select o_orderkey as id, o_custkey as form, o_orderkey % 9 as page, {_STATE} as state, 'c' || o_custkey::varchar as key, case when o_orderpriority = '1-URGENT' then 'utente' end as origin, o_orderkey % 7 = 0 as failed, o_orderkey % 5 = 0 as is_choice, o_orderdate, o_totalprice from orders)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, value: every third is blank, those of a negative balance are missing."""
    n = table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    return n.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("value"))


_FACTS = "facts as (select 'c' || c_custkey::varchar as key, case when c_custkey % 3 = 0 then ' ' else c_name end as value from customer where c_acctbal >= 0)"


@query(f"with {_DECISIONS} select s.state, count(d.id) as n from (select unnest({_STATES}) as state) s left join d using (state) group by s.state")
def ag_decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.histogram(_decisions(spark, sf_dir), "state", _STATES)


@query(f"with {ANCHORS_SQL} select kind as kind, count(*) as n from anchors group by kind")
def pj_map_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.anchors(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    f"""with {ANCHORS_SQL},
w as (select form, n from anchors where kind = 'area'), na as (select doc_id as form, n from lines where line like '%|%'),
notes as (select doc_id as form, n, min(left(line, 20)) as reason from lines where line like '%@%' or n = 3 group by all),
k as (select distinct form, n from anchors)
select a.form, a.n, coalesce(reason, 'non compilato') as reason from k a left join notes using (form, n)
where (a.form, a.n) not in (select form, n from w) and (a.form, a.n) not in (select form, n from na)"""
)
def jn_open_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors, rows = views.anchors(spark, sf_dir), views.lines(spark, sf_dir)
    notes = rows.filter("line like '%|%'").select(F.col("doc_id").alias("form"), "n", F.lit(False).alias("applies"), F.lit(None).cast("string").alias("reason"))
    notes = notes.unionByName(rows.filter("line like '%@%' or n = 3").select(F.col("doc_id").alias("form"), "n", F.lit(True).alias("applies"), F.substring("line", 1, 20).alias("reason")))
    opened, _ = archive.open_points(anchors.select("form", "n").distinct(), anchors.filter("kind = 'area'"), notes, ["form", "n"])
    return opened


@query(f"with {ANCHORS_SQL} select e.doc_id as form, e.toxic, coalesce(a.fields, 0) as fields, case when a.form is null then 'non_segnalata' else 'trovata' end as found from labels e left join (select form, count(*) as fields from anchors group by form) a on a.form = e.doc_id")
def jn_lookup_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.anchors(spark, sf_dir).groupBy("form").agg(F.count("*").alias("fields"))
    rows = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "form").join(found, "form", "left")
    return rows.select("form", "toxic", F.coalesce("fields", F.lit(0)).alias("fields"), F.when(F.col("fields").isNull(), "non_segnalata").otherwise("trovata").alias("found"))


# Keys and labels


def _key_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.translate("p_name", " ", "_").alias("key")).distinct().withColumn("words", T.content_words(F.translate("key", "_", " ")))


_KEYS = "keys as (select distinct replace(p_name, ' ', '_') as key from part), kw as (select key, list_filter(string_split(replace(key, '_', ' '), ' '), lambda w: length(w) > 2) as words from keys), df as (select word, count(*) as keys from (select key, unnest(list_distinct(words)) as word from kw) group by word)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    made = F.explode(F.array(F.lower("p_type"), F.col("p_name"), F.split("p_name", " ")[0], F.concat_ws(" ", F.lower("p_type"), F.split("p_name", " ")[1]), F.concat(F.col("p_name"), F.lit(" del "), F.lower("p_type"), F.lit(" sotto casa"))))
    return part.select(made.alias("label")).distinct().withColumn("words", T.content_words(F.col("label")))


_LABELS = """labels_in as (select distinct unnest([lower(p_type), p_name, string_split(p_name, ' ')[1], lower(p_type) || ' ' || string_split(p_name, ' ')[2], p_name || ' del ' || lower(p_type) || ' sotto casa']) as label from part), lw as (select label, list_filter(string_split(label, ' '), lambda w: length(w) > 2 and w <> 'del') as words from labels_in)"""


@query(f"with {_KEYS} select word, keys from df")
def ag_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.document_frequency(_key_words(spark, sf_dir))


_MATCH = f"""with {_KEYS}, {_LABELS},
l as (select label, unnest(list_distinct(words)) as word from lw), k as (select key, unnest(list_distinct(words)) as word from kw),
few as (select word from df where keys <= LIMIT),
p as (select label, key, count(*) as common, count(few.word) as telling from l join k using (word) left join few using (word) group by all having count(few.word) > 0),
t as (select *, max((common, telling)) over (partition by label) as top from p),
b as (select label, count(*) as ties, min(key) as key from t where (common, telling) = top group by label),
f as (select distinct l.label from l join df using (word) join b on b.label = l.label and ties = 1 where not exists (select 1 from k where k.key = b.key and k.word = l.word))
select lw.label, case when len(words) = 0 then 'senza etichetta' when len(list_distinct(words)) > 3 then 'frase' when b.key is null then 'ignoto' when ties > 1 or f.label is not null then 'ambiguo' else 'assegna' end as state,
  case when len(words) between 1 and 3 and ties = 1 and f.label is null then b.key end as key
from lw left join b using (label) left join f using (label)"""


@query(_MATCH.replace("LIMIT", "3"))
def ag_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_keys(_labels(spark, sf_dir), _key_words(spark, sf_dir))


@query(f"with {_KEYS}, {_LABELS} select l.word, count(distinct l.label) as labels, count(distinct k.key) as keys from (select label, unnest(list_distinct(words)) as word from lw) l join (select key, unnest(list_distinct(words)) as word from kw) k using (word) group by l.word")
def jn_key_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _labels(spark, sf_dir).select("label", F.explode(F.array_distinct("words")).alias("word"))
    b = _key_words(spark, sf_dir).select("key", F.explode(F.array_distinct("words")).alias("word"))
    # Counted on either side before they meet, so a frequent word makes one row.
    return a.groupBy("word").agg(F.countDistinct("label").alias("labels")).join(b.groupBy("word").agg(F.countDistinct("key").alias("keys")), "word").select("word", "labels", "keys")


@query(
    f"""with {_KEYS.split(', kw')[0]},
p as (select key, string_split(key, '_') as w from keys),
a as (select distinct key, unnest(list_concat(list_transform(range(1, len(w) + 1), lambda k: array_to_string(w[len(w) - k + 1 : len(w)], '_')), list_transform(range(1, len(w) + 1), lambda k: array_to_string(w[1 : k], '_')))) as part from p),
s as (select part, count(*) as n from a group by part having count(*) >= 2),
c as (select key, part from (select key, part, row_number() over (partition by key order by n desc, len(string_split(part, '_')) desc, part) as r from a join s using (part)) where r = 1),
g as (select part from c group by part having count(*) >= 2)
select keys.key, c2.part from keys left join (select key, part from c join g using (part)) c2 using (key)"""
)
def ag_group_by_affix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.group_by_affix(_key_words(spark, sf_dir).select("key"))


@query("select doc_id, case when n_chars >= 200 then 1 else 0 end as b, quality as a, case when quality is null then 'only_second' when quality = case when n_chars >= 200 then 1 else 0 end then 'agree' else 'differ' end as outcome from documents left join labels using (doc_id)")
def jn_two_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") >= 200, 1).otherwise(0).alias("quality"))
    return matching.compare_readers(table(spark, sf_dir, "labels"), second, "doc_id", "quality").select("doc_id", "a", "b", "outcome")


@query("select w.o_custkey, w.o_orderstatus, w.o_orderpriority, w.month, p.o_orderkey as plan from (select distinct o_custkey, o_orderstatus, o_orderpriority, month(o_orderdate)::bigint as month from orders where o_totalprice > 400000) w join (select *, row_number() over (partition by o_custkey, o_orderstatus, o_orderpriority, month(o_orderdate) order by o_orderkey) as r from orders where o_totalprice <= 400000) p on p.r = 1 and w.o_custkey = p.o_custkey and w.o_orderstatus = p.o_orderstatus and w.o_orderpriority = p.o_orderpriority and w.month = month(p.o_orderdate)")
def jn_plan_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("month", F.month("o_orderdate").cast("long"))
    identity = ["o_custkey", "o_orderstatus", "o_orderpriority", "month"]
    wanted = o.filter("o_totalprice > 400000").select(*identity).distinct()
    return matching.reuse_plan(wanted, o.filter("o_totalprice <= 400000").select(*identity, F.col("o_orderkey").alias("plan")), identity, "plan")


# Sequences


@query("with g as (select *, case when v - lag(v) over w <= 0.8 then 0 else 1 end as new from (select event_type, value as v from events) window w as (partition by event_type order by v)), i as (select *, sum(new) over (partition by event_type order by v rows unbounded preceding) as island from g) select event_type, island::bigint as island, count(*) as n, round(avg(v), 6) as middle, min(v) as low, max(v) as high from i group by all")
def wn_gap_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.gap_groups(table(spark, sf_dir, "events"), ["event_type"], "value")
    return found.withColumn("middle", F.round("middle", 6))


@query("with e as (select user_id, epoch(ts) as a, epoch(ts) + value * 60 as b from events), r as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as reach from e), i as (select *, sum(case when a - reach <= 1.0 then 0 else 1 end) over (partition by user_id order by a, b rows unbounded preceding) as island from r) select user_id, round(min(a), 3) as low, round(max(b), 3) as high, count(*) as n from i group by user_id, island")
def wn_interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    found = sequences.merged_intervals(e.select("user_id", start.alias("a"), (start + F.col("value") * 60).alias("b")), ["user_id"], "a", "b")
    return found.select("user_id", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"), "n")


_FORMULAS = [("trash|scum", "insult"), ("stupid|moron|idiot", "abuse"), ("licensed under", "license"), ("token =", "secret"), ("@mail", "mail")]
_FORMULA_SQL = "case " + " ".join(f"when regexp_matches(lower(win), '{p}') then '{r}'" for p, r in _FORMULAS) + " end"
_ROLLED = f"{LINES_SQL}, r as (select doc_id, n, line, string_agg(line, ' ') over (partition by doc_id order by n rows between 6 preceding and current row) as win from lines), m as (select doc_id, n, {_FORMULA_SQL} as reason from r)"


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.rolling_text(views.lines(spark, sf_dir), ["doc_id"], "n", "line")
    return rows.select("doc_id", "n", sequences.first_formula(F.col("window"), _FORMULAS).alias("reason"))


@query(f"with {_ROLLED} select doc_id, n, reason from m where reason is not null")
def wn_rolling_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir).filter("reason is not null")


#: Lines of forms that speak of the applicant and of others, with every formula once.
#: Headings of forms that stand on some lines of the documents, by place.
_HEADINGS = ("Soggetti cessati dalla carica", "Impresa ausiliaria", "dati del subappaltatore", "in caso di R.T.I. la mandante", "a seguito di fusione", "NUOVO TITOLARE", "responsabile dell impianto", "il coniuge", "Direttore tecnico", "il progettista", "il proprietario dell immobile", "impresa affidataria", "rete di imprese", "ereditiera", "cooptata")
_FORM_LINE = "case (doc_id * 7 + n * 3) % 60 " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(_HEADINGS)) + " end"
_FORM_WINDOWS = f"{LINES_SQL}, f as (select doc_id as form, n, concat_ws(' ', line, {_FORM_LINE}) as line from lines), r as (select form, n, line, regexp_replace(lower(string_agg(line, ' ') over (partition by form order by n rows between 6 preceding and current row)), '[^\\x00-\\x7F]', 'x', 'g') as win from f)"
#: DuckDB takes only ASCII letters for letters at a word's edge, so the others stand as x there.
_SUBJECT_SQL = "case " + " ".join(f"when regexp_matches(win, '{p}') then '{r}'".replace("dell'impianto'", "dell''impianto'") for p, r in rules.SUBJECT_FORMULAS) + " end"


def _form_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).select(F.col("doc_id").alias("form"), "n", F.concat_ws(" ", "line", F.expr(_FORM_LINE)).alias("line"))


@query(f"with {_FORM_WINDOWS} select form, n, {_SUBJECT_SQL} as reason from r")
def vd_subject_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.subject_alerts(_form_lines(spark, sf_dir), ["form"], "n", "line").select("form", "n", "reason")


@query(f"with {_FORM_WINDOWS} select form, n, false as unknown, coalesce(regexp_matches(win, '{'|'.join(rules.CONDITIONS.values())}'), false) as alone, coalesce(regexp_matches(win, '{rules.CONDITIONS['avvalimento']}|{rules.CONDITIONS['subappalto']}'), false) as grouped from r")
def wn_conditional_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in sections that an answer rules out: none without an answer, all conditional ones for who applies alone, fewer for a group."""
    skipped = lambda active, name: rules.skipped_sections(_form_lines(spark, sf_dir), ["form"], "n", "line", active).select("form", "n", F.coalesce("skipped", F.lit(False)).alias(name))
    return skipped(None, "unknown").join(skipped([], "alone"), ["form", "n"]).join(skipped(["raggruppamento"], "grouped"), ["form", "n"])


@query(f"with {ANCHORS_SQL} select form, n, kind, row_number() over (partition by form order by n, kind) as number from anchors")
def wn_number_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.numbered(views.anchors(spark, sf_dir).select("form", "n", "kind"), ["form"], ["n", "kind"])


@query(rf"with {LINES_SQL}, x as (select doc_id, n, unnest(regexp_extract_all(line, '((?:#(?: *#){{2,}})|(?:%(?: *%){{2,}})|(?:\*(?: *\*){{2,}})|(?:\$(?: *\$){{2,}})|(?:&(?: *&){{2,}})|(?:_(?: *_){{2,}})|(?:\.(?: *\.){{2,}})|(?:-(?: *-){{2,}}))')) as run from lines) select doc_id, n, run, count(*) as times from x group by all")
def wn_fill_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.lines(spark, sf_dir).select("doc_id", "n", F.explode(sequences.filler_runs(F.col("line"), 3)).alias("run"))
    return rows.groupBy("doc_id", "n", "run").agg(F.count("*").alias("times"))


@query("with s as (select *, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts) as us from events) select event_type, coalesce(sum(us), 0)::bigint as micros, count(*) as steps from s group by event_type")
def ag_phase_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sequences.phase_times(e, ["user_id"], "ts", "event_type")


_PAIRS = rf"""with {LINES_SQL},
w as (select doc_id, n, list_distinct(regexp_extract_all(lower(line), '[a-zà-ù]{{4,}}')) as words from lines),
ok as (select * from w where len(words) >= 8),
p as (select a.doc_id, a.n as first, b.n as second, len(list_intersect(a.words, b.words)) / least(len(a.words), len(b.words)) as share from ok a join ok b on a.doc_id = b.doc_id and b.n between a.n + 1 and a.n + 4)
select doc_id, first, second, round(share, 6) as share from p where share >= 0.6"""


@query(_PAIRS)
def jn_line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.lines(spark, sf_dir).withColumn("words", T.long_words(F.col("line"))).filter(F.size("words") >= 8)
    pairs = sequences.near_pairs(rows, ["doc_id"], "n", 4)
    share = T.overlap(F.col("a.words"), F.col("b.words"))
    return pairs.filter(share >= 0.6).select(F.col("a.doc_id").alias("doc_id"), F.col("a.n").alias("first"), F.col("b.n").alias("second"), F.round(share, 6).alias("share"))


_NAMES_SQL = r"list_distinct(list_concat(list_filter(regexp_extract_all(line, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z]{3,}')), list_transform(list_filter(regexp_extract_all(line, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-zà-ù]{3,}')), lambda x: lower(x))))"


@query(rf"""with {LINES_SQL},
w as (select doc_id, n, list_distinct(regexp_extract_all(lower(line), '[a-zà-ù]{{4,}}')) as words, {_NAMES_SQL} as names from lines),
ok as (select * from w where len(words) >= 8),
p as (select a.doc_id, a.n as first, b.n as second, a.names as x, b.names as y, len(list_intersect(a.words, b.words)) / least(len(a.words), len(b.words)) as share from ok a join ok b on a.doc_id = b.doc_id and b.n between a.n + 1 and a.n + 4)
select doc_id, first, second, round(share, 6) as share from p where share >= 0.6 and len(list_filter(x, lambda e: not list_contains(y, e))) = 0 and len(list_filter(y, lambda e: not list_contains(x, e))) = 0""")  # fmt: skip
def vd_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.contradictions(views.lines(spark, sf_dir), ["doc_id"], "n", "line").withColumn("share", F.round("share", 6))


# Text


@query(r"select doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}_]+', ' ', 'g'))) as folded from documents")
def sc_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.folded(F.col("text")).cast("binary")).alias("folded"))


@query(f"with {_LABELS} select label, array_to_string(words, ' ') as words from lw")
def sc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("label", F.array_join("words", " ").alias("words"))


@query(r"select doc_id, length(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g'))::bigint as n from documents")
def sc_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.letters_and_digits(F.col("text"))).cast("long").alias("n"))


@query(rf"with {LINES_SQL} select doc_id, n, len(list_distinct(regexp_extract_all(lower(line), '[a-zà-ù]{{4,}}')))::bigint as words from lines")
def sc_words4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).select("doc_id", "n", F.size(T.long_words(F.col("line"))).cast("long").alias("words"))


@query(rf"with {LINES_SQL} select doc_id, n, len({_NAMES_SQL})::bigint as names from lines")
def sc_named_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).select("doc_id", "n", F.size(T.named(F.col("line"))).cast("long").alias("names"))


_NEXT = rf"with {LINES_SQL}, w as (select doc_id, n, list_distinct(regexp_extract_all(lower(line), '[a-zà-ù]{{4,}}')) as words from lines), p as (select a.doc_id, a.n, a.words as x, b.words as y from w a join w b on a.doc_id = b.doc_id and b.n = a.n + 1) "


def _next_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.lines(spark, sf_dir).select("doc_id", "n", T.long_words(F.col("line")).alias("x"))
    return rows.withColumn("y", F.lead("x").over(Window.partitionBy("doc_id").orderBy("n"))).filter("y is not null")


@query(_NEXT + "select doc_id, n, round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) as share from p where len(x) > 0 and len(y) > 0")
def sc_containment_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_words(spark, sf_dir).select("doc_id", "n", F.round(T.overlap(F.col("x"), F.col("y")), 6).alias("share")).filter("share is not null")


@query(_NEXT + "select doc_id, n, len(x) > 0 and len(y) > 0 and (len(list_filter(x, lambda e: not list_contains(y, e))) = 0 or len(list_filter(y, lambda e: not list_contains(x, e))) = 0) as equal from p")
def sc_subset_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_words(spark, sf_dir).select("doc_id", "n", T.subset_equal(F.col("x"), F.col("y"), F.array().cast("array<string>")).alias("equal"))


@query(_NEXT + "select doc_id, n, len(list_intersect(x, y))::bigint as both_, len(list_filter(x, lambda e: not list_contains(y, e)))::bigint as only_x, len(list_distinct(list_concat(x, y)))::bigint as any_ from p")
def st_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_words(spark, sf_dir).select("doc_id", "n", *[F.size(f("x", "y")).cast("long").alias(c) for c, f in (("both_", F.array_intersect), ("only_x", F.array_except), ("any_", F.array_union))])


@query("select doc_id, case when position('the ' in text) > 0 then (case when greatest(position('the ' in text) - 100, 1) > 1 then '...' else '' end) || substring(text, greatest(position('the ' in text) - 100, 1)::bigint, (position('the ' in text) - greatest(position('the ' in text) - 100, 1) + 64)::bigint) end as around from documents")
def sc_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), F.lit("the ")).alias("around"))


@query("select distinct replace(p_name, ' ', '_') as key, upper(substring(p_name, 1, 1)) || lower(substring(p_name, 2)) as label from part")
def sc_prettify_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key_words(spark, sf_dir).select("key", T.pretty_key(F.col("key")).alias("label"))


@query("select doc_id, sha256(text) as sha, substring(sha256(regexp_replace(text, '[ \\t]+', ' ', 'g')), 1, 24) as form from documents")
def sc_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.sha2(F.regexp_replace("text", r"[ \t]+", " "), 256), 1, 24).alias("form"))


# Projections


@query("select event_id, isfinite(value) and value <> 0 as kept from events")
def pj_scalar_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", (v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v != 0)).alias("kept"))


@query(f"with {_FACTS} select key from facts where trim(coalesce(value, '')) = ''")
def pj_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).filter(F.trim(F.coalesce("value", F.lit(""))) == "").select("key")


_SOURCES = "src as (select 'c' || c_custkey::varchar as key, case c_mktsegment when 'AUTOMOBILE' then 'bool' when 'FURNITURE' then 'list' else 'text' end as kind, case when c_mktsegment = 'AUTOMOBILE' then case when c_acctbal > 4000 then 'true' else 'false' end when c_acctbal < 0 then ' ' else c_name end as value from customer where c_acctbal < 8000)"
_CHOICES = """dec as (select o_orderkey as id, 'c' || o_custkey::varchar as field, 'c' || (o_custkey + 1)::varchar as next, o_orderpriority as how, case o_orderstatus when 'F' then '; ' when 'O' then ' - ' else '+' end as sep,
  case when o_totalprice > 250000 then 'Customer' when o_totalprice > 100000 then 'nobody' end as fragment, case when o_totalprice > 200000 then 'bool' else 'text' end as kind2, case o_orderkey % 4 when 0 then 'casella' when 1 then 'widget' else 'area' end as anchor_kind, case o_orderstatus when 'F' then 'CheckBox' when 'O' then 'Text' else 'Signature' end as widget,
  case when o_totalprice < 60000 then case when o_orderstatus = 'F' then 'bool' else 'text' end end as user_kind, case when o_totalprice < 30000 then 'true' else ' ' end as user_value, case when o_totalprice < 50000 then 'utente' end as origin from orders)"""
_RESOLVED = f"""with {_SOURCES}, {_CHOICES},
j as (select dec.*, a.key is not null as there, a.kind as k1, a.value as v1, b.key is not null as there2, b.kind as k2, b.value as v2 from dec left join src a on a.key = field left join src b on b.key = next),
t as (select *, case when not there then 'no source' when k1 = 'bool' then 'yes or no' when k1 = 'list' or trim(v1) = '' then 'blank' end as r1, case when not there2 then 'no source' when k2 = 'bool' then 'yes or no' when k2 = 'list' or trim(v2) = '' then 'blank' end as r2 from j),
r as (select *, case
    when how = '1-URGENT' then case when not there then 'no source' when k1 <> kind2 or k1 = 'list' then 'kind' end
    when how = '2-HIGH' then case when sep = '+' then 'separator' when r1 is not null then r1 when fragment is not null and not contains(v1, fragment) then 'fragment' else r2 end
    when how = '3-MEDIUM' then 'parts'
    when how = '4-NOT SPECIFIED' then 'no key'
    when there and k1 = 'bool' then null else r1 end as reason0 from t),
p as (select *, case when reason0 is null then case when how = '1-URGENT' or (how = '5-LOW' and k1 = 'bool') then 'bool' else 'text' end end as kind0,
    case when reason0 is null then case when how = '1-URGENT' then (v1 = 'true')::varchar when how = '2-HIGH' then coalesce(fragment, v1) || sep || v2 else v1 end end as value0 from r)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as facts of all kinds."""
    kind = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "bool").when(F.col("c_mktsegment") == "FURNITURE", "list").otherwise("text")
    value = F.when(kind == "bool", (F.col("c_acctbal") > 4000).cast("string")).when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").filter("c_acctbal < 8000").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), kind.alias("kind"), value.alias("value"))


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as decisions: comparisons, fragments, too many of them, none, whole sources."""
    how, price = F.col("o_orderpriority"), F.col("o_totalprice")
    key = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    fragment = F.when(price > 250000, "Customer").when(price > 100000, "nobody")
    part = lambda k, f: F.struct(k.alias("field"), f.cast("string").alias("fragment"))
    two = F.array(part(key, fragment), part(F.concat(F.lit("c"), (F.col("o_custkey") + 1).cast("string")), F.lit(None)))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(how == "5-LOW", key).alias("field"),
        F.when(how == "2-HIGH", two).when(how == "3-MEDIUM", F.array_repeat(part(key, F.lit(None)), 13)).alias("parts"),
        F.when(F.col("o_orderstatus") == "F", "; ").when(F.col("o_orderstatus") == "O", " - ").otherwise("+").alias("separator"),
        F.when(how == "1-URGENT", F.struct(key.alias("field"), F.when(price > 200000, "bool").otherwise("text").alias("kind"), F.lit("true").alias("value"))).alias("compare"),
        F.when(F.col("o_orderkey") % 4 == 0, "casella").when(F.col("o_orderkey") % 4 == 1, "widget").otherwise("area").alias("anchor_kind"),
        F.when(F.col("o_orderstatus") == "F", "CheckBox").when(F.col("o_orderstatus") == "O", "Text").otherwise("Signature").alias("widget"),
        F.when(price < 60000, F.when(F.col("o_orderstatus") == "F", "bool").otherwise("text")).alias("user_kind"),
        F.when(price < 30000, "true").otherwise(" ").alias("user_value"),
        F.when(price < 50000, "utente").alias("origin"),
    )


def _resolved(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    rows = _choices(spark, sf_dir).join(table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin(*how.split(","))).select(F.col("o_orderkey").alias("id")), "id", "left_semi")
    return projections.resolved(rows, _sources(spark, sf_dir)).select("id", "kind", "value", "reason")


@query(_RESOLVED + " select id, kind0 as kind, value0 as value, reason0 as reason from p where how in ('4-NOT SPECIFIED', '5-LOW')")
def pj_resolve_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, "4-NOT SPECIFIED,5-LOW")


@query(_RESOLVED + " select id, kind0 as kind, value0 as value, reason0 as reason from p where how in ('2-HIGH', '3-MEDIUM')")
def pj_resolve_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values put together from one to twelve literal fragments of sources."""
    return _resolved(spark, sf_dir, "2-HIGH,3-MEDIUM")


@query(_RESOLVED + " select id, kind0 as kind, value0 as value, reason0 as reason from p where how = '1-URGENT'")
def pj_resolve_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir, "1-URGENT")


_CHOICE = "(anchor_kind = 'casella' or (anchor_kind = 'widget' and widget = 'CheckBox'))"
_VALUED = f"""{_RESOLVED},
v as (select *, case when anchor_kind = 'widget' and widget = 'Signature' then 'unsupported field'
  when user_kind is not null then case when coalesce(origin, '') <> 'utente' then 'not the user' when {_CHOICE} and user_kind <> 'bool' then 'needs yes or no' when not {_CHOICE} and (user_kind <> 'text' or trim(user_value) = '') then 'blank' end
  when reason0 is not null then reason0 when {_CHOICE} <> (kind0 = 'bool') then 'kind of field' end as reason from p)"""


@query(_VALUED + " select id, case when reason is null then coalesce(user_kind, kind0) end as kind, case when reason is null then case when user_kind is not null then user_value else value0 end end as value, reason from v")
def pj_user_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.valued(_choices(spark, sf_dir), _sources(spark, sf_dir)).select("id", "kind", "value", "reason")


@query(_VALUED + " select id, case when user_kind is not null then user_value else value0 end as value from v where reason is null and coalesce(user_kind, kind0) = 'text'")
def pj_values_from_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts to be written: what users wrote themselves, else what their sources give."""
    return projections.valued(_choices(spark, sf_dir), _sources(spark, sf_dir)).filter("kind = 'text'").select("id", "value")


@query(f"with {_CHOICES} select id, case when how in ('1-URGENT', '3-MEDIUM', '5-LOW') then field when how = '2-HIGH' then least(field, next) || ',' || greatest(field, next) else '' end as keys from dec")
def pj_referenced_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choices(spark, sf_dir).select("id", F.array_join(projections.referenced_keys(), ",").alias("keys"))


@query(f"with {_CHOICES} select id, case how when '1-URGENT' then field || ' confrontato con true' when '5-LOW' then field when '2-HIGH' then field || coalesce(' → ' || fragment, '') || '; ' || next when '3-MEDIUM' then array_to_string(list_transform(range(13), lambda i: field), '; ') else '' end as shown from dec")
def pj_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choices(spark, sf_dir).select("id", projections.described_source().alias("shown"))


@query("select l_orderkey * 10 + l_linenumber as id, case when reason is null then kind end as kind, case when reason is null then value end as value, reason from (select *, case when o_orderkey is null then 'unknown' when kind = 'list' then 'not a text' when kind <> 'bool' and length(value) > 2000 then 'too long' end as reason from (select l.*, o_orderkey, case when l_returnflag = 'R' then 'bool' when l_linenumber = 5 then 'list' else 'text' end as kind, case when l_returnflag = 'R' then case when l_tax > 0.04 then 'true' else 'false' end when l_discount = 0 then '' when l_quantity > 45 then repeat('x', 2001) else l_linestatus end as value from lineitem l left join (select o_orderkey from orders where o_orderstatus <> 'P') o on o_orderkey = l_orderkey) where l_orderkey * 10 + l_linenumber not in (select l_orderkey * 10 + l_linenumber from lineitem where l_tax = 0.01) and (o_orderkey is null or not (value = '' or (kind = 'bool' and value = 'false'))))")
def pj_output_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a program's values are not taken."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "bool").when(F.col("l_linenumber") == 5, "list").otherwise("text")
    value = F.when(kind == "bool", (F.col("l_tax") > 0.04).cast("string")).when(F.col("l_discount") == 0, "").when(F.col("l_quantity") > 45, F.repeat(F.lit("x"), F.lit(2001))).otherwise(F.col("l_linestatus"))
    place = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    slots = li.join(table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select(place)
    return projections.chosen_values(li.select(place, kind.alias("kind"), value.alias("value")), slots, li.filter("l_tax = 0.01").select(place))


_STEPS = "case event_type when 'view' then 'mappa' when 'click' then 'valori' when 'purchase' then 'scrittura' when 'signup' then 'verdetto' when 'error' then 'rifiuto' else 'boh' end"


@query(f"select event_id, case s when 'mappa' then 'lettura' when 'valori' then 'decisione' when 'scrittura' then 'scrittura' when 'verdetto' then 'verifica' end as phase, case s when 'mappa' then 1 when 'valori' then 3 when 'scrittura' then 4 when 'verdetto' then 5 else 0 end::bigint as place from (select event_id, {_STEPS} as s from events)")
def pj_step_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.step_phases(table(spark, sf_dir, "events").select("event_id", F.expr(_STEPS).alias("step"))).select("event_id", "phase", F.col("place").cast("long").alias("place"))


@query("select doc_id as form, case when n > 0 or y is null or y <> s then 'domanda_bloccante' when y then 'pertinenza_ok' else 'rifiuto' end as pertinence from documents left join (select doc_id, bool_and(p) as y, bool_or(p) as s, count(*) filter (p is null) as n from (select doc_id, quality = 1 as p from labels union all select doc_id, case when toxic = 1 then null else n_chars > 300 end from documents join labels using (doc_id) where n_chars % 2 = 0) group by doc_id) using (doc_id)")
def vd_pertinence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a form is the company's own, by readers' answers; where none is known or they differ, a question blocks it."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    second = docs.filter("n_chars % 2 = 0").join(labels, "doc_id").select("doc_id", F.when(F.col("toxic") != 1, F.col("n_chars") > 300).alias("pertinent"))
    answers = labels.select("doc_id", (F.col("quality") == 1).alias("pertinent")).unionByName(second)
    return projections.pertinence(docs.select(F.col("doc_id").alias("form")), answers.withColumnRenamed("doc_id", "form")).select("form", "pertinence")


@query(f"with {_CHOICES} select id, {_CHOICE} as choice, anchor_kind <> 'widget' or widget in ('Text', 'CheckBox') as writable from dec")
def pj_writable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choices(spark, sf_dir).select("id", projections.is_choice().alias("choice"), projections.is_writable().alias("writable"))


@query(f"with {LINES_SQL} select doc_id, n from lines where regexp_matches(translate(lower(line), 'àáâãäåèéêëìíîïòóôõöùúûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy'), 'licensed under|worthless')")
def pj_section_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).filter(T.unmarked(F.col("line")).rlike("licensed under|worthless")).select("doc_id", "n")


@query("select c_custkey from customer where contains(lower(c_name || ' ' || c_mktsegment), '99') and contains(lower(c_name || ' ' || c_mktsegment), 'machin')")
def pj_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "c_name", "c_mktsegment"))
    return table(spark, sf_dir, "customer").filter(F.forall(F.split(F.lit("99 Machin"), " "), lambda n: F.contains(hay, F.lower(n)))).select("c_custkey")


# Plans


_EXECUTED = f"""{_VALUED},
x as (select v.*, o_custkey % 5 <> 0 as same, o_orderstatus <> 'P' or o_orderkey % 2 = 0 as slot, case when o_orderdate < timestamp '1995-01-01' then 'dubbio' else 'assegna' end as state, o_totalprice > 300000 as gone from v join orders on o_orderkey = id),
y as (select *, case when not same then 'another document' when not slot then 'unknown slot' when state <> 'assegna' then 'open' else reason end as stop from x where not gone)"""


@query(_EXECUTED + " select id, case when stop is null then 'written' when stop = 'open' then 'open' else 'unusable' end as status, case when stop is null then coalesce(user_kind, kind0) end as kind, case when stop is null then case when user_kind is not null then user_value else value0 end end as value, case when stop <> 'open' then stop end as reason from y")
def pl_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan carried out: of this document's version only, typed values, nothing removed or unknown."""
    o = table(spark, sf_dir, "orders")
    version = F.concat(F.lit("v"), F.col("o_custkey").cast("string"))
    d = _choices(spark, sf_dir).drop("anchor_kind", "widget").join(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("form"), F.when(F.col("o_custkey") % 5 == 0, "old").otherwise(version).alias("fingerprint"), F.when(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"), "dubbio").otherwise("assegna").alias("state")), "id")
    slots = _choices(spark, sf_dir).join(o.filter("o_orderstatus <> 'P' or o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id")), "id", "left_semi").select("id", "anchor_kind", "widget")
    current = o.select(F.col("o_custkey").alias("form"), version.alias("fingerprint")).distinct()
    return plan.executed_typed(d, _sources(spark, sf_dir), slots, current, o.filter("o_totalprice > 300000").select(F.col("o_orderkey").alias("id")))


@query(f"with {_DECISIONS} select id, state from d where o_totalprice <= 300000")
def pl_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decisions(spark, sf_dir)
    return d.select("id", "state").join(d.filter("o_totalprice > 300000").select("id"), "id", "left_anti")


@query(f"with {_DECISIONS}, {_FACTS} select id, state, value as proposal, value is not null and not failed as confirmable from d left join facts using (key) where not (state in ('assegna', 'non_campo') or (coalesce(origin, '') = 'utente' and state = 'manuale' and not failed))")
def pl_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.questions(_decisions(spark, sf_dir), _facts(spark, sf_dir))


_ANSWERS = "a as (select id, action, new_key, new_text from (select l_orderkey as id, case l_linenumber % 6 when 0 then 'conferma' when 1 then 'fonte' when 2 then 'si' when 3 then 'testo' when 4 then 'manuale' else 'boh' end as action, case when l_quantity > 10 then 'c1' end as new_key, case when l_quantity > 25 then 'x' else ' ' end as new_text, row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) as r from lineitem) where r = 1)"


@query(
    f"""with {_DECISIONS}, {_ANSWERS},
j as (select d.*, coalesce(action, '') as act, new_key, case when action = 'conferma' then state = 'da_confermare' and not failed when action = 'fonte' then new_key is not null when action = 'si' then is_choice when action = 'testo' then not is_choice and trim(new_text) <> '' when action = 'manuale' then true else false end as fits from d left join a using (id))
select id, case when fits and act in ('conferma', 'fonte', 'si', 'testo') then 'assegna' when fits and act = 'manuale' then 'manuale' else state end as state,
  case when fits and act = 'fonte' then new_key when fits and act <> 'conferma' then '' else key end as key, case when fits then 'utente' else origin end as origin from j"""
)
def pl_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    action = F.expr("case l_linenumber % 6 when 0 then 'conferma' when 1 then 'fonte' when 2 then 'si' when 3 then 'testo' when 4 then 'manuale' else 'boh' end")
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    answers = li.select(F.col("l_orderkey").alias("id"), at.alias("at"), action.alias("action"), F.when(F.col("l_quantity") > 10, "c1").alias("key"), F.when(F.col("l_quantity") > 25, "x").otherwise(" ").alias("text"))
    return plan.answered(_decisions(spark, sf_dir), answers)


@query(f"with {_DECISIONS}, f as (select *, dense_rank() over (partition by form order by page) as p from d where failed and coalesce(origin, '') <> 'utente' and form not in (select c_custkey from customer where c_acctbal < 0)) select id, form, page from f where p <= 3")
def pl_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed places on three pages at most, of forms that had no round yet."""
    tried = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("form"))
    return plan.repair_round(_decisions(spark, sf_dir).filter("failed"), tried=tried).select("id", "form", "page")


@query("select l_suppkey as fingerprint, l_partkey as id, action from (select *, case when l_returnflag = 'R' then 'tolto' else 'confermato' end as action, row_number() over (partition by l_suppkey, l_partkey order by l_shipdate desc, l_returnflag = 'R' desc) as r from lineitem) where r = 1")
def pl_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    events = li.select(F.col("l_suppkey").alias("fingerprint"), F.col("l_partkey").alias("id"), F.col("l_shipdate").alias("at"), F.when(F.col("l_returnflag") == "R", "tolto").otherwise("confermato").alias("action"))
    return plan.remembered(events)


_TRACE = f"""with {_DECISIONS},
t as (select d.id, state, origin, case when id % 4 <> 1 then id % 4 <> 2 end as written, case when id % 12 = 0 then 'verificata' when id % 4 <> 1 then 'no' else '' end as result, id % 13 = 1 as vetoed from d),
o as (select id, case when written is not null and not written then 'scrittura_fallita' when written and result = 'verificata' then 'scritto_verificato' when written then 'verifica_fallita' when coalesce(origin, '') = 'utente' and state <> 'assegna' then 'escluso_utente' when coalesce(origin, '') <> 'utente' and vetoed then 'escluso_rilettura' when state = 'da_confermare' then 'attende_risposta' when state = 'assegna' then 'dato_non_utilizzabile' else state end as outcome from t)
"""


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decisions(spark, sf_dir)
    writes = d.filter("id % 4 <> 1").select("id", F.expr("id % 4 <> 2").alias("written"))
    checks = d.filter("id % 4 <> 1").select("id", F.expr("case when id % 12 = 0 then 'verificata' else 'no' end").alias("result"))
    return plan.trace(d.select("id"), d, writes, checks, d.filter("id % 13 = 1").select("id"))


@query(_TRACE + "select id, outcome from o")
def jn_trace_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir)


@query(_TRACE + "select outcome, count(*) as n from o group by outcome")
def ag_trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@query(_TRACE + "select d.page, outcome, count(*) as n from o join d using (id) group by all")
def au_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir).join(_decisions(spark, sf_dir).select("id", "page"), "id").groupBy("page", "outcome").agg(F.count("*").alias("n"))


@query(f"with {_DECISIONS}, r as (select id, state, origin, case when id % 17 = 0 then 'warning' when id % 19 = 0 then 'subject' when is_choice then 'choice' when page = 8 then 'case' end as why from d) select id, case when state = 'assegna' and coalesce(origin, '') <> 'utente' and why is not null then 'da_confermare' else state end as state, case when state = 'assegna' and coalesce(origin, '') <> 'utente' then why end as confirm_reason from r")
def vd_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decisions(spark, sf_dir).withColumns({"warning": F.expr("case when id % 17 = 0 then 'w' end"), "alert": F.expr("case when id % 19 = 0 then 'a' end"), "of_case": F.expr("page = 8")})
    return rules.confirmations(d).select("id", "state", "confirm_reason")


@query("select l_orderkey, l_returnflag, count(*) as n from lineitem group by all having count(*) > 1")
def ag_spread_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.repeated_values(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("with a as (select l_orderkey as slot, case when l_linenumber % 7 = 0 then 'boh' else 'assegna' end as state, l_returnflag as field, case when l_linestatus = 'F' then 'impresa' else '' end as subject, 'perche' as reason from lineitem), one as (select slot, count(distinct coalesce(field, '')) as fields, count(*) as n, min(state) as state, min(field) as field, min(subject) as subject from a group by slot), v as (select o_orderkey as slot, n, fields, state, n is null or fields > 1 or n > 1 or state <> 'assegna' or field not in ('A', 'N') or subject = '' as bad from orders left join one on slot = o_orderkey) select slot, case when bad then 'dubbio' else state end as state, case when n is null then 'missing' when fields > 1 then 'conflict' when bad then 'invalid' else 'ok' end as \"check\" from v")
def vd_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    answers = li.select(F.col("l_orderkey").alias("slot"), F.expr("case when l_linenumber % 7 = 0 then 'boh' else 'assegna' end").alias("state"), F.col("l_returnflag").alias("field"), F.expr("case when l_linestatus = 'F' then 'impresa' else '' end").alias("subject"), F.lit("perche").alias("reason"))
    keys = spark.range(1).select(F.explode(F.array(F.lit("A"), F.lit("N"))).alias("key"))
    return rules.contract_states(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slot")), answers, keys)


@query("with r as (select l_orderkey as slot, l_linenumber as round, count(distinct l_returnflag) as fields, count(*) as n, min(l_returnflag) as field from lineitem group by all), x as (select *, row_number() over (partition by slot order by round desc) as k, max(fields) over (partition by slot) as most from r) select slot, case when most = 1 then field end as field, case when most > 1 then 'conflict' when n > 1 then 'dubbio' else 'assegna' end as state from x where k = 1")
def ag_conflict_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slot"), F.col("l_linenumber").alias("round"), F.col("l_returnflag").alias("field"))
    return evidence.settled_proposals(t)


@query("select doc_id, item_id, case when result = 'errore' and kind in ('soggetto', 'significato', 'fonte') and contains(text, evidence) and (kind <> 'significato' or contains(lower(label), lower(evidence))) then 'veto' else 'warning' end as verdict from (select d.doc_id, d.text, b.item_id, string_split(b.text, ' ')[1] as evidence, case when b.item_id % 3 = 0 then 'dubbio' else 'errore' end as result, case b.item_id % 4 when 0 then 'soggetto' when 1 then 'significato' when 2 then 'fonte' else 'altro' end as kind, string_split(d.text, chr(10))[1] as label from documents d join benchmark b on d.doc_id % 40 = b.item_id) where length(evidence) >= 2")
def vd_evidence_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ")[0].alias("evidence"), F.expr("case when item_id % 3 = 0 then 'dubbio' else 'errore' end").alias("result"), F.expr("case item_id % 4 when 0 then 'soggetto' when 1 then 'significato' when 2 then 'fonte' else 'altro' end").alias("kind"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("page_text"), F.split("text", "\n")[0].alias("label"), (F.col("doc_id") % 40).alias("item_id"))
    return rules.evidence_verdict(d.join(b, "item_id").filter(F.length("evidence") >= 2)).select("doc_id", "item_id", "verdict")


@query(f"with {_DECISIONS}, f as (select distinct form, page from d where failed and page % 3 = 0) select id, case when f.form is not null then 'sospesa' else state end as state from d left join f using (form, page)")
def vd_page_suspend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decisions(spark, sf_dir)
    return evidence.suspended(d.select("id", "form", "page", "state"), d.filter("failed and page % 3 = 0"), ["form", "page"]).select("id", "state")


@query(f"with {LINES_SQL} select doc_id, n from lines where length(trim(line)) between 1 and 60 and not contains(line, '|') and not regexp_matches(line, '[#%*$&@]')")
def vd_add_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines without a place of their own: a value may be added there."""
    rows = views.lines(spark, sf_dir)
    taken = rows.filter(F.col("line").rlike(r"[#%*$&@|]")).select("doc_id", "n")
    return evidence.implicit_slots(rows, taken, ["doc_id", "n"], "line")


@query(f"with {LINES_SQL}, t as (select doc_id, n, line, regexp_extract_all(translate(lower(line), 'àáâãäåèéêëìíîïòóôõöùúûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy'), '[a-z0-9]+') as w from lines), p as (select b.doc_id, b.n, a.w as known, array_to_string(a.w, '') as packed, b.w as asked from t a join t b on a.doc_id = b.doc_id and a.n = 0 and b.n >= 1 where trim(a.line) <> '') select doc_id, n, list_filter(asked, lambda x: not list_contains(known, x) and not list_contains({list(rules.GLUE)}, x) and not (length(x) >= 3 and contains(packed, x)))[1] as stranger from p")
def vd_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every line, the first word that the document's first line does not hold."""
    lines = views.lines(spark, sf_dir)
    sources = lines.filter("n = 0").filter(F.trim("line") != "").select("doc_id", F.col("line").alias("source"))
    found = lines.filter("n >= 1").join(sources, "doc_id")
    return found.select("doc_id", "n", rules.provenance_problem(F.col("line"), F.array("source")).alias("stranger"))


# Orders, sets, snapshots


@query("select kind, fields, row_number() over (order by fields desc, kind) as place from (" + ORACLE["ag_types"] + ")")
def st_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by their number; the table ranked has one row for each kind."""
    return archive.by_kind(views.anchors(spark, sf_dir)).select("kind", "fields", F.row_number().over(Window.orderBy(F.desc("fields"), "kind")).cast("long").alias("place"))


@query(f"with {ANCHORS_SQL} select form, n, kind from (select *, row_number() over (partition by form order by n, kind) as r from anchors) where r <= 12")
def st_topk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve places of each form, as a report lists them."""
    return sequences.numbered(views.anchors(spark, sf_dir), ["form"], ["n", "kind"]).filter("number <= 12").select("form", "n", "kind")


@query("select o_custkey, o_orderkey as best from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) as r from orders) where r = 1")
def st_best_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


@query(f"with {OUTCOMES_SQL} select form, state, reason from outcomes")
def st_union_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.outcomes(spark, sf_dir).select("form", "state", "reason")
    branches = [rows.filter(F.col("state") == s).drop("state").withColumn("state", F.lit(s)) for s in ("verificata", "non_riuscita", "non_segnalata")]
    return branches[0].unionByName(branches[1]).unionByName(branches[2])


@query("with a as (select l_partkey as k, count(*) as v from lineitem where l_returnflag <> 'R' group by 1), b as (select l_partkey as k, count(*) as v from lineitem where l_returnflag <> 'A' group by 1) select k, a.v as old, b.v as new, case when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end as change from a full join b using (k) where a.v is distinct from b.v")
def st_symmetric_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda f: table(spark, sf_dir, "lineitem").filter(f).groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("v"))
    return archive.snapshot_difference(count("l_returnflag <> 'R'"), count("l_returnflag <> 'A'"), ["k"], "v")


@query("with a as (select lang as k, count(*) as v from documents group by 1), b as (select lang as k, count(*) as v from documents where n_chars > 100 group by 1) select k, a.v as old, b.v as new, case when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end as change from a full join b using (k) where a.v is distinct from b.v")
def st_snapshot_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    count = lambda x: x.groupBy(F.col("lang").alias("k")).agg(F.count("*").alias("v"))
    return archive.snapshot_difference(count(d), count(d.filter("n_chars > 100")), ["k"], "v")


@query("with c as (select doc_id as form, sum((quality = 1)::int) as v, max(toxic) as d from labels group by 1) select form, case when v = 0 then 'non_compilato' when d = 1 then 'da_verificare' else 'compilato' end as verdict from c")
def au_word_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.word_verdict(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("form"), (F.col("quality") == 1).alias("verified"), (F.col("toxic") == 1).alias("doubtful")))


@query("select kind, count(*) as n from (" + ORACLE["ag_types"] + ") group by kind")
def io_cli_adhoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free SQL over named views."""
    from formlake.sources.adhoc import ask

    return ask(spark, {"types": archive.by_kind(views.anchors(spark, sf_dir))}, "select kind, count(*) as n from types group by kind")


@query("with w as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from documents), caps as (select distinct lower(w) as w from w where regexp_matches(w, '^[A-Z][a-z]{3,}$')), low as (select distinct w from w where regexp_matches(w, '^[a-z]{4,}$')), v as (select distinct lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as w from benchmark) select w from caps where w not in (select w from low) and w not in (select w from v)")
def jn_proper_noun_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words only ever seen capitalised, and not in the public vocabulary."""
    words = lambda name: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("w")).distinct()
    w = words("documents")
    caps = w.filter(F.col("w").rlike("^[A-Z][a-z]{3,}$")).select(F.lower("w").alias("w")).distinct()
    return caps.join(w.filter(F.col("w").rlike("^[a-z]{4,}$")), "w", "left_anti").join(words("benchmark").select(F.lower("w").alias("w")), "w", "left_anti")
