"""The operators' queries, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.llm import chat_format, decontaminate, license_scan, line_quality, passage_dedup, periodic_runs, quality_rules, secret_scan, simhash_dedup, token_codec, token_count, token_output, whitening
from formlake.llm.durable import stage_folder
from formlake.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of held-out documents are not learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = table(spark, sf_dir, "labels").filter(~held).select("doc_id", F.col("quality").alias("label"))
    found = line_quality.score(docs, *line_quality.learn(docs, labels))
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@_query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram pieces of every whole text."""
    return token_count.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_dedup.group_near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash_dedup.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@_query
def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and their decoding, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_codec.digests(docs)


@_query
def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that every document keeps once the passages of earlier documents are removed."""
    return passage_dedup.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE["op5_passage_dedup"] = r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (
  select doc_id, i, array_to_string(w[i : i + 12], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from w where len(w) >= 13)),
first as (select g, min(doc_id) as low from win group by g),
gone as (
  select doc_id, list(distinct p) as ps
  from (select win.doc_id, unnest(range(i, i + 13)) as p from win join first using (g) where low < win.doc_id) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: ps is null or not list_contains(ps, i)), ' '), '')) as kept_sha256
from w left join gone using (doc_id)
"""


@_query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every whole text and the forest's verdict; values as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    model = secret_scan.learn(secret_scan.labelled_findings(spark), secret_scan.corpus_words(docs))
    found = secret_scan.findings(docs, model, path="source")
    return found.select("doc_id", "word_index", F.sha2("value", 256).alias("value_sha256"), F.length("value").cast("long").alias("n_chars"), F.round("score", 6).alias("score"), "is_secret")


@_query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op7_sql() -> str:
    rules = " and ".join(
        part
        for r in quality_rules.RULES
        for part in ([f"coalesce({r.metric} >= {r.low}, true)"] if r.low is not None else []) + ([f"coalesce({r.metric} <= {r.high}, true)"] if r.high is not None else [])
    )
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    return rf"""
with body as (select doc_id, coalesce(text, '') as t from documents),
base as (
  select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from body),
win as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from base where len(w) >= 3)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c >= 2),
cov as (select doc_id, count(distinct p)::bigint as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) group by doc_id),
m as (
  select b.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (length(t) - length(regexp_replace(t, '[!?]', '', 'g')))::bigint as n_marks,
         len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         len(list_filter(w, lambda x: lower(x) in ({stop})))::bigint as n_stop_words,
         coalesce(c.n, 0)::bigint as n_repeat_words
  from base b left join cov c using (doc_id)),
r as (
  select *, word_chars / nullif(n_words, 0) as mean_word_chars, n_symbols / nullif(n_words, 0) as symbol_ratio,
         n_marks / nullif(n_words, 0) as mark_ratio, n_dup_lines / nullif(n_lines, 0) as dup_line_ratio,
         n_stop_words / nullif(n_words, 0) as stop_ratio,
         (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and {rules}) as kept from r
"""


ORACLE["op7_quality_rules"] = _op7_sql()


@_query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, read back and digested; conversation -7 holds control strings."""
    own = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    chats = chat_format.format_chats(turns)
    chats = chats.select("conv_id", "formatted", "state", "valid", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def _op8_sql() -> str:
    t = chat_format.LLAMA
    count = lambda x, c: f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}"
    grown = lambda x: f"(length({x}) + {count(x, chr(92))} + " + " + ".join(count(f"replace({x}, chr(92), chr(92) || chr(92))", c) for c in t.controls()) + ")"
    marks = "case role " + " ".join(f"when '{k}' then {len(a) + len(b)}" for k, (a, b) in t.marks.items()) + f" else {sum(map(len, t.other))} + {grown('role')} end"
    moves = " ".join(f"when before = '{a}' and role = '{r}' then true" for a, r in (("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")))
    return f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (
  select *, row_number() over w as n, coalesce(lag(role) over w, '') as before,
         lead(role) over w is null as last
  from t window w as (partition by conv_id order by turn nulls first, role, text)),
p as (
  select *, case {moves} else false end as may, {marks} + {grown('text')} as chars from o)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars,
       bool_and(may) and bool_or(last and role = 'assistant') as valid
from p group by conv_id
"""


ORACLE["op8_chat_format"] = _op8_sql()


@_query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the best window."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "first_word", "n_words")


@_query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice of every document, with coverage and spans."""
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("coverage", F.round("coverage", 6))


#: What separates words, as Spark and DuckDB take it.
_GAP = r"[\x20\x09-\x0D]+"


def _with_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document by crc32 repeats its words from a place on with a period (both from the crc32)."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), _GAP), lambda x: x != "")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g, n = F.floor(h / 10), F.size("words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    # Slices instead of a place-by-place lookup: no function of a word would see the whole array.
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int"))), 1, n - a)
    text = F.array_join(F.concat(F.slice("words", 1, a), again), " ")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"))
    return chosen.select("doc_id", F.when(F.size("words") > 0, text).otherwise(F.col("text")).alias("text"))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of them with periods made as the contract says, and what is left without repetitions."""
    return periodic_runs.summaries(_with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _op11_sql(levels: int = 14) -> str:
    """levels: factors up to 2 ** (levels - 1) words, enough for periods of documents of 20,000 words."""
    crc = "xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda x, y: case when y >= 0 then xor(x, y) else xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end) end), 4294967295)"
    level = lambda j, source: f"""
f{j} as materialized (
  select doc_id, i, nm, nx from (
    select doc_id, i, dense_rank() over (order by doc_id, x, y) as nm, lead(i) over (partition by doc_id, x, y order by i) as nx, count(*) over (partition by doc_id, x, y) as c from ({source}))
  where c > 1),"""  # noqa: E731
    factors = level(0, "select doc_id, i, word as x, 0 as y from words") + "".join(level(j, f"select l.doc_id, l.i, l.nm as x, r.nm as y from f{j - 1} l join f{j - 1} r on r.doc_id = l.doc_id and r.i = l.i + {2 ** (j - 1)}") for j in range(1, levels))
    steps = " union all ".join(f"select doc_id, i, nx - i as d, {2**j} as size from f{j} where nx - i <= {2**j} and 2 * (nx - i) > {2**j}" for j in range(levels))
    return f"""
with h as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_GAP}'), lambda x: x <> '') as w, {crc} as h from documents),
ap as (select *, len(w) as n, (h // 10) % nullif(len(w), 0) as a, h // 10 as g from h),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from ap),
texts as (
  select doc_id, case when h % 10 = 0 and n > 0 then list_transform(range(0, n), lambda i: w[(case when i >= a then a + (i - a) % p else i end) + 1]) else w end as w from p),
words as materialized (select doc_id, unnest(range(0, len(w))) as i, unnest(w) as word from texts),
{factors}
steps as ({steps}),
isles as (select *, i - row_number() over (partition by doc_id, size, d order by i) as g from steps),
runs as materialized (
  select * from (select doc_id, min(i) as s, max(i) - min(i) + d + size as l, d as q from isles group by doc_id, size, d, g) where l >= greatest(24, 3 * q)),
best as (select * from (select *, row_number() over (partition by doc_id order by l / q desc, s, q) as k from runs) where k = 1),
told as (select doc_id, count(*) as n, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as t from runs group by doc_id),
gone as (select distinct doc_id, unnest(range(s + q, s + l)) as i from runs),
kept as (select doc_id, string_agg(word, ' ' order by i) as t from words anti join gone using (doc_id, i) group by doc_id)
select doc_id, coalesce(told.n, 0)::bigint as n_runs, s::bigint as start, l::bigint as length, q::bigint as period, (1000 * l // q)::bigint as exponent_milli,
       sha256(coalesce(told.t, '')) as runs_sha256, sha256(coalesce(kept.t, '')) as collapsed_sha256
from texts left join told using (doc_id) left join best using (doc_id) left join kept using (doc_id)
"""


ORACLE["op11_periodic_runs"] = _op11_sql()


@_query
def op12_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text written as coded blocks, and what the files hold of each document."""
    folder = f"{stage_folder(spark)}/ids"
    token_output.write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    return token_output.checksums(spark, folder)


@_query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finite vector on the four leading components of all distinct ones."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
