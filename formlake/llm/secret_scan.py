"""Secret scans with Spark's own functions: candidates by patterns, false positives removed by a random forest compiled into SQL.

A candidate is a run of CANDIDATE characters, with the dotted runs after it, or a value of six characters or more that is
assigned to a name that announces a secret. Its features are its length, the changes between kinds of characters, how much of
it dictionary words cover (a fixed list, and frequent words of the corpus if the caller counts them by `corpus_words`), its path
and the words around it. The forest is fitted to labelled findings (at most SAMPLE of them); `labelled_findings` makes a table
of them, callers may bring their own; `evaluated` counts what a forest gets right of labelled findings held out.

Null and empty texts have no candidates; repeated rows are scanned alike, each on its own; every occurrence is a finding; an
empty table gives no findings. Very long texts are scanned whole, within one row. A score of exactly the bar is a secret; of
overlapping secrets the longer is replaced first, of equally long ones the lesser. A null or missing path says nothing. Other
columns pass through `redact` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formlake.llm import forest
from formlake.llm.durable import checkpointed
from formlake.llm.frequent import most_frequent
from formlake.llm.quality_rules import GAP_CHARS, _without

#: What a candidate is made of, and the shortest; characters of the shortest assigned value.
CANDIDATE = r"[A-Za-z0-9_+/=\-]{16,}(?:\.[A-Za-z0-9_+/=\-]{4,})*"
SHORTEST = 6
REDACTED = "<SECRET>"
#: Labelled findings that the forest is fitted to, and words of the corpus in its dictionary, at most.
SAMPLE, WORDS = 6000, 1000
#: Kinds of labelled findings that are made.
KINDS = 33
#: Words that names and prose are made of, words that announce a secret, and words that announce other digests.
DICTIONARY = "example sample test default config version string number user name value index file path data your here change token secret password account document public image content static build release source python java main class module http https www com html json text field form page item list date time order report system service server client local host admin".split()
ANNOUNCE = "token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private|apikey"
DIGEST = "commit|sha1|sha256|sha512|md5|checksum|uuid|guid|digest|revision|rev|etag|hash|isbn|integrity|blob|tree|parent"
#: Fixed value: a value assigned to an announcing name, up to the end of what is looked at.
ASSIGNED = rf"(?i)(?:{ANNOUNCE})[a-z0-9_\-]*[\"']?\s*(?:=|:)+>?\s*[\"']?([^\s\"',;]{{{SHORTEST},}})"
ASIDE_PATHS = "test|example|sample|doc|fixture|mock|lock|vendor|demo"
FEATURES = ("length", "digits", "uppers", "others", "changes", "variety", "hex", "covered", "announced", "digest", "assigned", "quoted", "aside", "filler")


@dataclass(frozen=True)
class Model:
    """A fitted forest and the words that its features were made with."""

    trees: tuple
    words: tuple[str, ...]


def corpus_words(docs: DataFrame, text: str = "text", limit: int = WORDS) -> list[str]:
    """The words of four to twelve letters that most documents have, counted over all of them."""
    word = F.explode(F.array_distinct(F.split(F.lower(F.col(text)), " "))).alias("word")
    counts = docs.select(word).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("word").rlike("^[a-z]{4,12}$"))
    return sorted(r.word for r in most_frequent(checkpointed(counts), limit).select("word").collect())


def candidates(text: Column, path: Column) -> tuple[Column, Callable[[Column, Column, Column], Column]]:
    """The words of a text with a candidate (else none), and what makes an array of (value, word, before, word_index, path) of a word, its place and all words."""
    words = F.when(text.rlike(f"{CANDIDATE}|{ASSIGNED}"), F.split(_without(text, GAP_CHARS[1:], " "), " ")).otherwise(F.array().cast("array<string>"))

    def of_word(w: Column, i: Column, all_words: Column) -> Column:
        before = F.concat_ws(" ", F.get(all_words, i - 3), F.get(all_words, i - 2), F.get(all_words, i - 1))
        given = F.regexp_extract(F.concat_ws(" ", before, w), ASSIGNED + r"[\"']?[,;.]?$", 1)
        runs = F.regexp_extract_all(w, F.lit(f"({CANDIDATE})"), F.lit(1))
        values = F.when(given != "", F.concat(F.array(given), F.filter(runs, lambda v: ~F.contains(given, v) & ~F.contains(v, F.substring(given, 1, SHORTEST))))).otherwise(runs)
        return F.transform(values, lambda v: F.struct(v.alias("value"), w.alias("word"), before.alias("before"), i.cast("int").alias("word_index"), path.alias("path")))

    return words, of_word


def _free_names(docs: DataFrame) -> tuple[str, str]:
    """Two names that no column of docs has."""
    taken, k = {c.lower() for c in docs.columns}, 0
    while {f"_found{k}", f"_words{k}"} & taken:
        k += 1
    return f"_found{k}", f"_words{k}"


def with_candidates(docs: DataFrame, found: str, words: str, dictionary: Sequence[str], text: str = "text", path: str | None = None) -> DataFrame:
    """docs with a column `found`: candidates and their features. words: a free name for work."""
    body = F.coalesce(F.col(text), F.lit(""))
    own, of_word = candidates(body, F.coalesce(F.col(path), F.lit("")) if path else F.lit(""))
    out = docs.withColumn(words, own)
    long = F.transform(words, lambda w, i: F.when(F.length(w) >= SHORTEST, of_word(w, i, F.col(words))))
    out = out.withColumn(found, F.flatten(F.filter(long, lambda x: x.isNotNull()))).drop(words)
    return out.withColumn(found, F.transform(found, lambda x: with_features(x, dictionary)))


def with_features(x: Column, dictionary: Sequence[str]) -> Column:
    """A candidate's struct and its features as doubles, so that the forest reads each only once made."""
    v = x.value
    n = F.length(v).cast("double")
    kinds = F.translate(F.translate(F.translate(v, "bcdefghijklmnopqrstuvwxyz", "a" * 25), "BCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 25), "123456789", "0" * 9)
    share = lambda pattern: F.length(F.regexp_replace(v, pattern, "")) / n
    lead = F.lower(F.concat_ws(" ", x.before, F.element_at(F.split(x.word, F.concat(F.lit("\\Q"), v, F.lit("\\E")), 2), 1)))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    made = {
        "length": n,
        "digits": share("[^0-9]"),
        "uppers": share("[^A-Z]"),
        "others": share("[A-Za-z0-9]"),
        "changes": (F.length(F.regexp_replace(kinds, r"(.)\1*", "$1")) - 1) / n,
        "variety": F.size(F.array_distinct(F.split(v, ""))) / n,
        "hex": flag(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "covered": 1 - F.length(F.regexp_replace(F.lower(v), "|".join(sorted(set(dictionary), key=lambda w: (-len(w), w))) or "$^", "")) / n,
        "announced": flag(lead.rlike(ANNOUNCE)),
        "digest": flag(lead.rlike(DIGEST)),
        "assigned": flag(lead.rlike(r"[=:]>?\s*[\"']?$")),
        "quoted": flag(x.word.rlike("[\"']")),
        "aside": flag(F.lower(x.path).rlike(ASIDE_PATHS)),
        "filler": flag(F.lower(v).rlike(r"(.)\1{5}|12345678|abcdefgh|your|example|changeme|xxxx")),
    }
    return F.struct(*[x[k].alias(k) for k in ("value", "word", "before", "word_index", "path")], *[made[k].alias(k) for k in FEATURES])


def labelled_findings(spark: SparkSession, rows: int = 6000, series: str = "finding") -> DataFrame:
    """value, word, before, path, label: true and false findings in contexts of many kinds, the same on every run. series: other names give other findings."""
    # In steps, so that no expression is made again for each kind: digests of the row, what is made of them, then the kinds.
    base = spark.range(0, rows, 1, 2).select(
        "id",
        F.expr(f"cast(id div {KINDS} as int)").alias("i"),
        F.sha1(F.concat(F.lit(series), F.col("id").cast("string")).cast("binary")).alias("sha"),
        F.md5(F.concat(F.lit("other " + series), F.col("id").cast("string")).cast("binary")).alias("md"),
    )
    one_of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    hexed = lambda k: F.conv(F.substring("md", k, 3), 16, 10).cast("int")
    # Letters as words have them: the digits of both digests are consonants and vowels in turn.
    syllable = lambda k: F.concat(F.translate(F.substring("md", k, 1), "0123456789abcdef", "bdfgklmnprstvzhw"), F.translate(F.substring("sha", k, 1), "0123456789abcdef", "aeiouaeiouaeioue"))
    base = base.select(
        "*",
        F.regexp_replace(F.base64(F.unhex(F.concat("sha", "md"))), "[+/=]", "").alias("b64"),
        F.lpad(F.regexp_replace(F.conv(F.substring("md", 1, 15), 16, 10), "^-", ""), 16, "4").alias("number"),
        *[one_of(DICTIONARY, hexed(k)).alias(f"name{k}") for k in (1, 4, 7, 10, 13)],
        F.concat(*[syllable(k) for k in range(1, 13)]).alias("letters"),
        one_of(("as seen in", "the value of", "and then the", "in der alten", "de la otra", "et puis le", "see also this", "number is then"), F.col("i")).alias("prose"),
        one_of(("src/app/settings.py", "tests/test_login.py", "docs/guide.md", "web", "config/prod.yaml", "yarn.lock"), F.crc32("sha")).alias("path"),
        one_of(("token", "secret", "password", "api_key", "auth_token", "access_key", "private_key", "TOKEN", "client_secret"), F.crc32("md")).alias("key"),
        one_of(("required", "enabled", "optional", "undefined", "changeme", "disabled", "Bearer", "<value>", "default", "missing", "expired", "********"), F.crc32(F.concat("md", "sha"))).alias("filler"),
    )
    base = base.select("*", F.concat_ws(" ", F.split("prose", " ")[0], "key", one_of(("=", ":", "="), F.col("i"))).alias("assigned"))
    i, sha, md, b64, number, prose, path, key, filler, assigned = (F.col(k) for k in ("i", "sha", "md", "b64", "number", "prose", "path", "key", "filler", "assigned"))
    name = lambda k: F.col(f"name{k}")
    letters = lambda k, n: F.substring("letters", k, n)
    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    kinds = [  # value, word, before, label
        (sha, quoted(sha), assigned, 1),
        (F.upper(sha), quoted(F.upper(sha)), assigned, 1),
        (b64, quoted(b64), assigned, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(md, 1, 16))), F.concat(F.lit("AKIA"), F.upper(F.substring(md, 1, 16))), F.concat_ws(" ", prose, F.lit("key")), 1),
        (F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), prose, 1),
        (md, F.concat(key, F.lit("="), md), prose, 1),
        (F.substring(b64, 1, 24), F.concat(key, F.lit(":"), quoted(F.substring(b64, 1, 24))), prose, 1),
        (F.concat_ws(".", F.concat(F.lit("eyJ"), F.substring(b64, 1, 30)), F.concat(F.lit("eyJ"), F.substring(b64, 20, 24)), F.substring(b64, 8, 36)), F.concat_ws(".", F.concat(F.lit("eyJ"), F.substring(b64, 1, 30)), F.concat(F.lit("eyJ"), F.substring(b64, 20, 24)), F.substring(b64, 8, 36)), F.concat_ws(" ", prose, F.lit("bearer")), 1),
        (F.concat(name(1), F.substring(md, 1, 3), name(4)), quoted(F.concat(name(1), F.substring(md, 1, 3), name(4))), assigned, 1),
        (F.substring(b64, 1, 10), quoted(F.substring(b64, 1, 10)), assigned, 1),
        (F.concat(F.initcap(name(1)), F.lit("!"), F.substring(number, 1, 4)), F.concat(key, F.lit("="), F.initcap(name(1)), F.lit("!"), F.substring(number, 1, 4)), prose, 1),
        (letters(1, 20), quoted(letters(1, 20)), assigned, 1),
        (letters(1, 9), quoted(letters(1, 9)), assigned, 1),
        (F.concat(name(1), name(4), name(7)), F.concat(name(1), name(4), name(7)), prose, 0),
        (letters(1, 18), letters(1, 18), prose, 0),
        (F.upper(letters(2, 17)), F.upper(letters(2, 17)), F.upper(prose), 0),
        (F.concat(F.initcap(letters(3, 19)), F.lit("s")), F.concat(F.initcap(letters(3, 19)), F.lit("s")), prose, 0),
        (F.concat_ws("-", letters(1, 7), name(1), letters(9, 6)), F.concat_ws("-", letters(1, 7), name(1), letters(9, 6)), prose, 0),
        (filler, filler, assigned, 0),
        (filler, F.concat(key, F.lit(":"), filler), prose, 0),
        (F.concat_ws(".", name(1), name(4), name(7)), F.concat_ws(".", name(1), name(4), name(7)), assigned, 0),
        (F.concat(F.lit("get_"), name(1), F.lit("()")), F.concat(F.lit("get_"), name(1), F.lit("()")), assigned, 0),
        (F.concat(F.lit("${"), F.upper(name(1)), F.lit("}")), quoted(F.concat(F.lit("${"), F.upper(name(1)), F.lit("}"))), assigned, 0),
        (sha, sha, F.concat_ws(" ", F.split(prose, " ")[0], F.lit("commit")), 0),
        (md, F.concat(F.lit("md5:"), md), prose, 0),
        (F.sha2(sha, 256), F.sha2(sha, 256), F.concat_ws(" ", prose, F.lit("sha256:")), 0),
        (F.concat_ws("-", F.substring(md, 1, 8), F.substring(md, 9, 4), F.substring(md, 13, 4), F.substring(md, 17, 4), F.substring(md, 21, 12)), F.concat_ws("-", F.substring(md, 1, 8), F.substring(md, 9, 4), F.substring(md, 13, 4), F.substring(md, 17, 4), F.substring(md, 21, 12)), F.concat_ws(" ", prose, F.lit("uuid")), 0),
        (number, number, prose, 0),
        (F.concat_ws("_", name(1), name(4), name(7), (i % 10).cast("string"), name(10), name(13)), F.concat_ws("_", name(1), name(4), name(7), (i % 10).cast("string"), name(10), name(13)), prose, 0),
        (F.concat_ws("/", name(1), name(4), name(7), (i % 2000).cast("string"), name(10)), quoted(F.concat_ws("/", name(1), name(4), name(7), (i % 2000).cast("string"), name(10))), F.concat_ws(" ", prose, F.lit("=")), 0),
        (F.concat(F.lit("your_"), key, F.lit("_here_123456")), quoted(F.concat(F.lit("your_"), key, F.lit("_here_123456"))), assigned, 0),
        (F.concat(F.repeat(F.lit("x"), 16), (i % 10).cast("string")), quoted(F.concat(F.repeat(F.lit("x"), 16), (i % 10).cast("string"))), assigned, 0),
        (F.concat_ws("-", name(1), name(4), F.lit("2024"), name(7)), F.concat_ws("-", name(1), name(4), F.lit("2024"), name(7)), F.concat_ws(" ", prose, F.lit("page")), 0),
    ]
    assert len(kinds) == KINDS
    made = F.array(*[F.struct(value.alias("value"), word.alias("word"), before.alias("before"), path.alias("path"), F.lit(label).alias("label")) for value, word, before, label in kinds])
    return checkpointed(base.select(F.get(made, (F.col("id") % KINDS).cast("int")).alias("x")).select("x.*"), SAMPLE)


def _features_of(labelled: DataFrame, dictionary: Sequence[str]) -> DataFrame:
    x = F.struct("value", F.coalesce("word", F.lit("")).alias("word"), F.coalesce("before", F.lit("")).alias("before"), F.lit(0).alias("word_index"), F.coalesce("path", F.lit("")).alias("path"))
    rows = labelled.filter("label is not null and value is not null").select(x.alias("x"), "label")
    return checkpointed(rows.select(with_features(F.col("x"), dictionary).alias("x"), "label"), SAMPLE)


def learn(labelled: DataFrame, words: Sequence[str] = (), sample: int = SAMPLE) -> Model:
    """The forest of at most `sample` labelled findings, chosen by a hash of them. words: of the corpus, besides the fixed ones."""
    dictionary = tuple(sorted({*DICTIONARY, *words}))
    rows = _features_of(labelled, dictionary)
    rows = rows.orderBy(F.xxhash64("x.value", "x.word"), "x.value", "x.word", "x.before", "x.path", "label").limit(sample).select(*[f"x.{k}" for k in FEATURES], F.col("label").cast("double")).collect()
    data = np.array([tuple(r) for r in rows], float).reshape(len(rows), len(FEATURES) + 1)
    return Model(tuple(forest.fit(data[:, :-1], data[:, -1])), dictionary)


def _judged(model: Model, x: Column) -> Column:
    return forest.compiled(list(model.trees), lambda f: x[FEATURES[f]])


def evaluated(labelled: DataFrame, model: Model, bar: float = 0.5) -> DataFrame:
    """precision, recall, n: of labelled findings that the forest was not fitted to, in one row."""
    rows = _features_of(labelled, model.words).select((_judged(model, F.col("x")) >= bar).alias("told"), (F.col("label") == 1).alias("true"))
    return rows.agg((F.count_if(F.expr("told and true")) / F.count_if("told")).alias("precision"), (F.count_if(F.expr("told and true")) / F.count_if("true")).alias("recall"), F.count("*").alias("n"))


def scored(docs: DataFrame, model: Model, found: str, words: str, text: str = "text", path: str | None = None) -> DataFrame:
    """docs with a column `found`: array of (value, word, before, word_index, score)."""
    keep = ("value", "word", "before", "word_index")
    judge = lambda x: F.struct(*[x[k].alias(k) for k in keep], _judged(model, x).alias("score"))
    return with_candidates(docs, found, words, model.words, text, path).withColumn(found, F.transform(found, judge))


def findings(docs: DataFrame, model: Model, text: str = "text", path: str | None = None, bar: float = 0.5) -> DataFrame:
    """doc_id, word_index, value, before, score, is_secret of every candidate."""
    found, words = _free_names(docs)
    # explode() would add a filter that, pushed below the words, splits the text again for each word.
    rows = scored(docs, model, found, words, text, path).select("doc_id", F.explode_outer(found).alias("x")).filter("x is not null")
    return rows.select("doc_id", "x.word_index", "x.value", "x.before", "x.score", (F.col("x.score") >= bar).alias("is_secret"))


def redact(docs: DataFrame, model: Model, text: str = "text", path: str | None = None, bar: float = 0.5) -> DataFrame:
    """docs with every secret in their text replaced, longest first; texts without one stay as they are."""
    found, words = _free_names(docs)
    rows = scored(docs, model, found, words, text, path)
    secrets = F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x.score >= bar), lambda x: x.value)), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    rows = rows.withColumn(found, secrets)
    clean = F.aggregate(found, F.col(text), lambda acc, s: F.replace(acc, s, F.lit(REDACTED)))
    return rows.withColumn(text, F.when(F.size(found) > 0, clean).otherwise(F.col(text))).drop(found)
