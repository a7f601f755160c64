"""The registered queries against their SQL, and the pipeline against its stages written in Python."""

import hashlib
from collections import Counter

import duckdb
import pytest
from test_llm_operators import jaccard_heads
from tokenizers import Tokenizer

from formlake.llm import quality_rules, secret_scan, token_codec
from formlake.llm.registry import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(cols).collect())) == sorted(con.sql(f"select {', '.join(cols)} from ({ORACLE[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    n = df.count()
    # Queries of one row a document have one for each; the others find something in these tables.
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all("(" not in c for c in df.columns) and (n == docs if name.split("_")[0] in ("op1", "op2", "op3", "op4", "op12") else n > 0)


def test_held_out_accuracy(spark):
    found = QUERIES["op1_line_quality"](spark, DATA).toPandas().merge(duckdb.sql(f"select * from '{DATA}/labels.parquet'").df(), on="doc_id")
    held = found[found.held_out]
    assert (held.predicted == held.quality).mean() > 0.9


def words_of(text):
    return (text or "").encode().split()


def passes_rules(text):
    w, t = words_of(text), text or ""
    if len(w) < 50:
        return False
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    if 100 * len({p for i, g in enumerate(windows) if many[g] > 1 for p in (i, i + 1, i + 2)}) > 50 * len(w):
        return False
    lines = [x for x in t.split("\n") if words_of(x)]
    metrics = {
        "mean_word_chars": sum(len(x.decode()) for x in w) / len(w),
        "symbol_ratio": sum(t.count(c) for c in "#*$%&|<>") / len(w),
        "mark_ratio": (t.count("!") + t.count("?")) / len(w),
        "dup_line_ratio": (len(lines) - len(set(lines))) / len(lines),
        "stop_ratio": sum(x.decode().lower() in quality_rules.STOP_WORDS for x in w) / len(w),
    }
    return all((r.low is None or metrics[r.metric] >= r.low) and (r.high is None or metrics[r.metric] <= r.high) for r in quality_rules.RULES)


def leaks(text, items):
    w = [x.lower() for x in words_of(text)]
    own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    def similar(x, y):
        x, y = (Counter(tuple(v[k : k + 5]) for k in range(len(v) - 4)) for v in (x, y))
        return sum((x & y).values()) >= 0.8 * sum((x | y).values())

    for item in items:
        if not any(tuple(item[k : k + 5]) in own for k in range(len(item) - 4)):
            continue
        n = len(item)
        if any(similar(item, w[k : k + n]) for k in range(max(1, len(w) - n + 1))):
            return True
    return False


def test_pipeline_equals_python(spark, tmp_path):
    """run() against the stages written again in Python; what is a secret is the forest's verdict, replaced here by hand."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    secret = " ".join(f"the n{i} of" for i in range(40)) + ' token = "9a8b99b6f89edc9746a2ef7e89e21f68bcb4543d" and'
    table.unionByName(spark.createDataFrame([(10_000, secret, "en", "web", len(secret))], table.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    docs = {i: t for i, t in docs.items() if passes_rules(t)}
    docs = {i: docs[i] for i in jaccard_heads(docs)}
    items = [[x.lower() for x in words_of(r.text)] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if not leaks(t, items)}
    left = table.join(spark.createDataFrame([(i,) for i in docs], "doc_id long"), "doc_id")
    model = secret_scan.learn(secret_scan.labelled_findings(spark), secret_scan.corpus_words(left))
    found = {}
    for r in secret_scan.findings(left, model, path="source").filter("is_secret").collect():
        found.setdefault(r.doc_id, set()).add(r.value)
    library = Tokenizer.from_file(token_codec.default_path())
    expected = []
    for i, t in docs.items():
        for v in sorted(found.get(i, ()), key=lambda v: (-len(v), v)):
            t = t.replace(v, secret_scan.REDACTED)
        ids = library.encode(t, add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(expected) and 10_000 in found and len(expected) > 50


def test_pipeline_on_odd_inputs(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text = " ".join(f"the a{i} of b{i} c{i}" for i in range(40))
    schema = "doc_id long, text string, lang string, source string, n_chars long, _found0 int, k1 string"
    rows = [(1, text, "en", None, None, 1, "x"), (1, text, "en", None, None, 1, "x"), (2, text.upper(), None, "s", 3, None, None), (None, text, "en", "s", 3, 2, "y"), (3, None, None, None, None, None, None), (4, "", "en", "s", 0, 1, ""), (5, "the long text and " * 3 + " ".join(f"the w{i} of" for i in range(60_000)), "en", "s", 9, 1, "")]
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()) == ["1", "1", "5", "None"]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
