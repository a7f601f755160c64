"""Operators that SQL over the tables cannot check."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from formlake.functions import projection
from formlake.operators import archive, matching
from formlake.sources import documents, profiles, word_writer


def word_file(*paragraphs, prefix=b""):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", prefix + f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>'.encode())
        z.writestr("word/styles.xml", "<x/>")
    return bytearray(out.getvalue())


def test_word_paragraphs_and_places(spark):
    files = spark.createDataFrame([("a", word_file("nome ___ il ..", "firma …… e ....")), ("b", bytearray(b"no")), ("c", word_file("x", prefix=b"<!DOCTYPE a []>"))], "path string, content binary")
    rows = documents.word_paragraphs(files)
    assert {(r.path, r.n, r.warning) for r in rows.collect()} == {("a", 0, ""), ("a", 1, ""), ("b", -1, "not a Word file"), ("c", -1, "entities")}
    assert {(r.n, r.run) for r in documents.word_places(rows).collect()} == {(0, "___"), (1, "……")}


def test_word_files_are_written(spark):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = '<w:p><w:r><w:t>nome __</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">__ e &amp; città</w:t></w:r></w:p><w:p><w:r><w:t>due ....</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cella</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("word/document.xml", (2020, 1, 2, 3, 4, 6)), f'<?xml version="1.0"?><w:document xmlns:w="{space}" xmlns:x="urn:x" w:Ignorable="x"><w:body>{body}</w:body></w:document>')
        z.writestr("word/media/a.bin", b"\x00\x01same")
    files = spark.createDataFrame([("a", bytearray(out.getvalue()))], "path string, content binary")
    part = "word/document.xml"
    edits = spark.createDataFrame(
        [("a", part, 0, 5, 9, "____", "Rossi & <figli>"), ("a", part, 0, 10, 11, "e", "ed"), ("a", part, 1, 4, 8, "....", "3"), ("a", part, 1, 5, 7, "..", "x"), ("a", part, 2, 0, 0, "", "y"), ("a", part, 3, 5, 5, "", " 4"), ("a", part, 3, 0, 2, "zz", "q"), ("a", part, 9, 0, 1, "q", "q"), ("a", part, 3, 3, 99, "la", "q")],
        "path string, part string, n int, start int, until int, expected string, value string",
    )
    planned = word_writer.planned_edits(documents.word_paragraphs(files), edits)
    assert {(r.n, r.start): r.reason for r in planned.collect()} == {(0, 5): None, (0, 10): None, (1, 4): "overlaps another edit", (1, 5): "overlaps another edit", (2, 0): None, (3, 5): None, (3, 0): "text has changed", (9, 0): "no such paragraph", (3, 3): "beyond the text"}
    new = word_writer.saved(files, planned)
    r = new.first()
    assert (r.written, list(r.failed)) == (3, [f"{part}:2: no text of its own"])
    assert [x.text for x in documents.word_paragraphs(new).orderBy("n").collect()] == ["nome Rossi & <figli> ed & città", "due ....", "", "cella 4"]
    with zipfile.ZipFile(io.BytesIO(bytes(r.content))) as z:
        assert z.read("word/media/a.bin") == b"\x00\x01same" and z.getinfo(part).date_time == (2020, 1, 2, 3, 4, 6)
        assert b'xmlns:x="urn:x" w:Ignorable="x"' in z.read(part) and b"<w:rPr><w:b/></w:rPr>" in z.read(part)


def test_profiles_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"profilo": {"x": "1"}}')
    (tmp_path / "b.json").write_text('{"azienda": {"y": "2"}, "prova": true}')
    assert {(r.file, r.key, r.value) for r in profiles.facts(profiles.read_profiles(spark, str(tmp_path))).collect()} == {("a.json", "x", "1"), ("b.json", "y", "2")}
    assert [r.file for r in profiles.read_profiles(spark, str(tmp_path), real_only=True).collect()] == ["a.json"]
    profiles.published(spark.range(3), str(tmp_path / "out"))
    with pytest.raises(Exception, match="exist"):
        profiles.published(spark.range(3), str(tmp_path / "out"))
    files = documents.read_files(spark, str(tmp_path / "*.json"))
    assert files.filter(documents.signed(F.col("content"))).count() == 0


@pytest.mark.parametrize("text", ["__import__('os')", "name.format(1)", "[x for x in name]", "other", "lambda: 1", "name ** 2", "name.__class__", "f'{name}'", "name[::2]", "len(1)", "-'a'", "1 + 'a'", "print(name)", "{**name}", "'a' if name else 1", "+".join(["1"] * 400)])
def test_projection_refuses(spark, text):
    with pytest.raises(projection.Refused):
        projection.compiled(text, {"name"})


@pytest.mark.parametrize("text", ["x = 1", "import os\nreturn 1", "_x = 1\nreturn 1", "name[0] = 1\nreturn name", "for a in name:\n    pass\nreturn 1", "return"])
def test_programs_refused(spark, text):
    with pytest.raises(projection.Refused):
        projection.program(text, {"name"})


EXPRESSIONS = """name[0] | name[-1] | name[1:3] | name[:-2] | name[-3:] | name[2:] | name[5:2] | 'a' in name | 'zz' not in name | n in [1, 2, 7] | n not in [1, 2] | not name | not n | not empty | not words | n and name == 'x'
empty or name | name and empty | empty and name | n or 5 | zero or 5 | words[0] | words[-1] | words[1:] | len(words) | len(name) | len(facts) | facts['a'] | facts.get('b') | facts.get('z', 'none') | 'a' in facts | n / 2 | n * 2 - 1 | -n | +n | 'ab' * 2 | name + '!' | [1, 2] + [3]
1 < n < 9 | 1 < n < 3 | n == 7.0 | name == 7 | nothing == None | nothing is None | name is not None | str(n) | str(True) | str(nothing) | int('12') | int(2.9) | float('1.5') | bool(name) | bool(zero) | list('ab') | tuple([1]) | round(2.5) | round(3.5) | round(2.345, 1)
min(n, 3) | max(1, n, 2) | min([3, 1, 2]) | max(words) | abs(-n) | name.strip() | ' a b '.strip() | 'xaxx'.strip('x') | name.split() | name.split('o') | name.upper() | name.lower() | name.replace('o', '0') | 'si' if words else 'no' | {'k': n}['k'] | {n: name}[7] | (1, 2)[1] | n > 3 or zero > 3 | n and zero == 0 and name or '?' | zero and name or '?'"""


def test_projection_equals_python(spark):
    data = {"name": "Rosso Mario", "n": 7, "zero": 0, "empty": "", "words": ["uno", "due", "tre"], "facts": {"a": "1", "b": "2"}, "nothing": None}
    row = spark.createDataFrame([tuple(data.values())], "name string, n long, zero long, empty string, words array<string>, facts map<string,string>, nothing string")
    texts = [t.strip() for line in EXPRESSIONS.split("\n") for t in line.split(" | ")]
    got = row.select(*[projection.compiled(t, row.schema).alias(f"c{i}") for i, t in enumerate(texts)]).first()
    for t, value in zip(texts, got, strict=True):
        expected = eval(t, {}, dict(data))  # noqa: S307  expressions of this file
        assert value == (list(expected) if isinstance(expected, tuple) else expected), t


def test_projection_where_python_raises(spark):
    row = spark.createDataFrame([("ab", 0, {"a": "1"})], "name string, n long, facts map<string,string>")
    texts = ["name[5]", "1 / n", "facts['z']", "int('x')", "[1][3]", "'ab' * 100000"]
    assert list(row.select(*[projection.compiled(t, row.schema).alias(f"c{i}") for i, t in enumerate(texts)]).first()) == [None] * len(texts)


def test_gap_groups_over_ranges(spark, monkeypatch):
    import random

    from formlake.operators import sequences

    r = random.Random(4)
    rows = [(k, r.uniform(0, 60)) for k in ("a", "b", None) for _ in range(80)]
    df = spark.createDataFrame(rows, "k string, v double")

    def plain(k):
        out, last = [], None
        for v in sorted(v for x, v in rows if x == k):
            if last is None or v - last > 0.8:
                out.append([])
            out[-1].append(v)
            last = v
        return {(k, i + 1, len(g), round(sum(g) / len(g), 9), g[0], g[-1]) for i, g in enumerate(out)}

    for size in (2, 4096):
        monkeypatch.setattr(sequences, "RANGE", size)
        got = {(x.k, x.island, x.n, round(x.middle, 9), x.low, x.high) for x in sequences.gap_groups(df, ["k"], "v").collect()}
        assert got == plain("a") | plain("b") | plain(None)


def test_labels_without_words_and_ties(spark):
    keys = spark.createDataFrame([("via_sede", ["via", "sede"]), ("via_casa", ["via", "casa"]), ("cap", ["cap"])], "key string, words array<string>")
    labels = spark.createDataFrame([("Via", ["via"]), ("CAP", ["cap"]), ("", []), ("cap sede", ["cap", "sede"]), ("a b c d", ["aa", "bb", "cc", "dd"]), ("boh", ["boh"])], "label string, words array<string>")
    got = {r.label: (r.state, r.key) for r in matching.match_keys(labels, keys).collect()}
    assert got == {"Via": ("ambiguo", None), "CAP": ("assegna", "cap"), "": ("senza etichetta", None), "cap sede": ("ambiguo", None), "a b c d": ("frase", None), "boh": ("ignoto", None)}


def test_rejected_notes(spark):
    anchors = spark.createDataFrame([(1,), (2,)], "id int")
    notes = spark.createDataFrame([(1, True, "manca"), (9, True, "x"), (2, True, "y")], "id int, applies boolean, reason string")
    opened, rejected = archive.open_points(anchors, spark.createDataFrame([(2,)], "id int"), notes, ["id"])
    assert [tuple(r) for r in opened.collect()] == [(1, "manca")]
    assert {tuple(r) for r in rejected.collect()} == {(9, "ancora sconosciuta"), (2, "campo gia scritto")}


def test_common_runs_equal_brute_force(spark):
    from difflib import SequenceMatcher

    from formlake.functions.similarity import common_run, common_run_ratio

    rng = random.Random(2)
    pairs = [("", ""), ("", "a"), ("abc", "xabcx"), ("a" * 300, "a" * 299 + "b"), ("è€漢" * 40, "漢è" * 50), ("x" * 70 + "y" * 70, "y" * 70 + "x" * 70)]
    pairs += [("".join(rng.choices("abè ", k=rng.randint(0, 200))), "".join(rng.choices("abè ", k=rng.randint(0, 200)))) for _ in range(40)]
    rows = spark.createDataFrame([*pairs, (None, "a")], "a string, b string").select("a", "b", common_run(F.col("a"), F.col("b")).alias("n"), common_run_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in rows:
        n = SequenceMatcher(None, r.a, r.b, autojunk=False).find_longest_match().size if r.a is not None else None
        assert r.n == n and r.r == (n / min(len(r.a), len(r.b)) if n else 0)


def test_common_runs_of_long_texts(spark):
    from difflib import SequenceMatcher
    from time import perf_counter

    from formlake.functions import similarity

    rng = random.Random(7)
    for alphabet, most in (("ab", 40), ("abcè漢😀", 60), ("a", 30)):
        for _ in range(150):
            a, b = sorted(("".join(rng.choices(alphabet, k=rng.randint(0, most))) for _ in range(2)), key=len)
            n = SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size
            assert similarity._digested(a, b) == similarity._searched(a, b) == n
    # Lines of 60,000 characters, one of them with the other's middle, and one character throughout.
    a, b = ("".join(rng.choices("abcdefgh ", k=60_000)) for _ in range(2))
    rows = [(a, b[:30_000] + a[20_000:25_000] + b[30_000:]), ("a" * 60_000, "a" * 59_000 + "b"), (a, b)]
    began = perf_counter()
    got = spark.createDataFrame(rows, "a string, b string").select(similarity.common_run(F.col("a"), F.col("b")).alias("n")).collect()
    # (Two texts of nine characters at random share some ten to twelve.)
    assert 5_000 <= got[0].n <= 5_010 and got[1].n == 59_000 and 8 <= got[2].n <= 16 and perf_counter() - began < 60


def test_flattened_at_any_depth(spark):
    deep = '{"k": [' * 30 + '"x"' + "]}" * 30
    rows = spark.createDataFrame([(1, deep), (2, '{"a": {"b": 1.50, "c": [], "d": {}, "e": "q\\"\\u00e8", "f": [true, null, 1e5]}}'), (3, "no"), (4, None), (5, "7"), (6, '{"a' )], "id int, raw string")
    found = profiles.flattened(rows)
    assert {(r.id, r.path, r.value) for r in found.collect()} == {(1, ".".join(["k.0"] * 30), "x"), (2, "a.b", "1.50"), (2, "a.e", 'q"è'), (2, "a.f.0", "true"), (2, "a.f.2", "1e5")}
    assert profiles.flattened(rows.limit(0)).count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\n") < 5


def greedy(rects, share):
    taken = []
    for r, x0, y0, x1, y1 in sorted(rects):
        area = max((x1 - x0) * (y1 - y0), 1e-9)
        if not any(max(0, min(x1, t[3]) - max(x0, t[1])) * max(0, min(y1, t[4]) - max(y0, t[2])) > share * area for t in taken):
            taken.append((r, x0, y0, x1, y1))
    return {t[0] for t in taken}


def test_claims_equal_the_loop(spark):
    from formlake.operators import claims

    rng = random.Random(3)
    pages = {}
    for page in range(4):
        some = []
        for k in range(150):
            x, y = rng.uniform(-20, 150), rng.uniform(-20, 150)
            some.append((k, x, y, x + rng.choice([0, 5, 30, 90]), y + rng.choice([4, 25, 60])))
        # Copies of one rectangle, and a chain in which each waits for the one before.
        some += [(200 + k, 1.0, 1.0, 9.0, 9.0) for k in range(20)] + [(300 + k, 500.0 + 5 * k, 0.0, 510.0 + 5 * k, 8.0) for k in range(9)]
        pages[page] = some
    df = spark.createDataFrame([(p, *r) for p, rs in pages.items() for r in rs], "page int, rank int, x0 double, y0 double, x1 double, y1 double")
    for share in (0.35, 0.5, 0.0):
        got = {(r.page, r["rank"]) for r in claims.claim(df, share).collect()}
        assert got == {(p, k) for p, rs in pages.items() for k in greedy(rs, share)}
    assert claims.claim(df.limit(0)).count() == 0


def test_claims_of_crowded_pages(spark, monkeypatch):
    from formlake.operators import claims

    monkeypatch.setattr(claims, "MANY", 30)
    rng = random.Random(13)
    rects = [(page, k, x, y, x + rng.choice([0.0, 20.0, 60.0]), y + 15.0) for page, size in ((1, 90), (2, 30), (None, 40), (4, 31)) for k in range(size) for x, y in [(rng.uniform(0, 90), rng.uniform(0, 90))]]
    df = spark.createDataFrame(rects, "page int, rank int, x0 double, y0 double, x1 double, y1 double")
    pages = {p: [r[1:] for r in rects if r[0] == p] for p in (1, 2, None, 4)}
    got = [(r.page, r["rank"]) for r in claims.claim(df).collect() if r.page is not None]
    assert len(got) == len(set(got)) and set(got) == {(p, k) for p, rs in pages.items() if p for k in greedy(rs, 0.35)}
    marks = spark.createDataFrame([(1, 50.0, 50.0), (2, 10.0, 5.0), (2, 400.0, 5.0)], "page int, x double, y double")
    free = {(r.page, r.id) for r in claims.blank(df.withColumnRenamed("rank", "id"), marks).collect()}
    assert free == {(p, k) for p, k, x0, y0, x1, y1 in rects if not any(q == p and x0 <= x <= x1 and y0 <= y <= y1 for q, x, y in [(1, 50, 50), (2, 10, 5), (2, 400, 5)])}


def test_lines_from_shuffled_glyphs(spark):
    from formlake.operators import geometry

    rng = random.Random(4)
    texts = ["Nome e cognome", "x", "", "nato a Roma il 3/4/1990", "fine"]
    glyphs = [(1, 5.0 * k, 20.0 * n + rng.uniform(-1, 1), 10.0, c) for n, t in enumerate(texts) for k, c in enumerate(t) if c != " "]
    rng.shuffle(glyphs)
    rows = geometry.text_lines(spark.createDataFrame(glyphs, "page int, x double, y double, size double, text string")).orderBy("line").collect()
    assert [r.text for r in rows] == [t for t in texts if t] and [r.words for r in rows] == [len(t.split()) for t in texts if t]
    assert rows[0].x0 == 0 and rows[0].x1 == 5.0 * len(texts[0]) and abs(rows[0].base) <= 1


def test_glyphs_are_not_shuffled(spark):
    from formlake.plans.registry import QUERIES

    plan = QUERIES["io_pdf_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # The one exchange is of whole texts.
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan, plan


def test_gap_groups_over_ranges(spark):
    from formlake.operators import sequences

    rng = random.Random(5)
    values = [rng.choice([0, 5000, 9000]) + rng.uniform(0, 400) for _ in range(600)] + [0.5 * k for k in range(20_000)]
    got = sorted((r.n, r.low, r.high) for r in sequences.gap_groups(spark.createDataFrame([("a", v) for v in values], "t string, v double"), ["t"], "v", 0.8).collect())
    expected, own = [], []
    for v in sorted(values):
        if own and v - own[-1] > 0.8:
            expected.append((len(own), own[0], own[-1]))
            own = []
        own.append(v)
    assert got == sorted([*expected, (len(own), own[0], own[-1])])


def test_culprits_by_halves(spark):
    from formlake.operators import culprits

    bad = {("a", 0), ("a", 6), ("c", 12), ("c", 11)}
    items = spark.createDataFrame([(d, n, (d, n) in bad) for d, size in (("a", 7), ("b", 5), ("c", 13), ("d", 1)) for n in range(size)], "doc string, n int, bad boolean")
    found, tests = culprits.find_culprits(items, lambda rows: rows.groupBy("doc", "grp").agg(F.bool_or("bad").alias("f")).filter("f"))
    assert {(r.doc, r.n) for r in found.collect()} == bad
    counts = {r.doc: (r.tests, r.rounds) for r in tests.collect()}
    assert counts["b"] == (1, 1) and counts["a"][1] == 5 and counts["d"] == (1, 1) and sum(t for t, _ in counts.values()) < 26
    found, tests = culprits.find_culprits(items.limit(0), lambda rows: rows)
    assert found.count() == 0 and tests.count() == 0


def test_trees_tell_what_changed(spark):
    from formlake.operators import trees

    old = spark.createDataFrame([(1, "<a><b>x</b><br>y</a>"), (2, "<p>one<i>two</i></p>tail"), (3, "</z>q<u>"), (4, ""), (5, "<p>same</p>")], "id int, t string")
    new = spark.createDataFrame([(1, "<a><b>x2</b><br>y</a>"), (2, "<p>one<i>two</i><b>new</b></p>"), (3, "</z>q<u>"), (5, "<p>same</p>")], "id int, t string")
    tree = trees.nodes(old, "id", "t")
    assert {(r.id, r.pos, r.depth, r.parent, r.label) for r in tree.filter("id in (1, 3)").collect()} == {(1, 0, 0, None, "<a>"), (1, 1, 1, 0, "<b>"), (1, 2, 2, 1, "x"), (1, 4, 1, 0, "<br>"), (1, 5, 1, 0, "y"), (3, 1, 0, None, "q"), (3, 2, 0, None, "<u>")}
    changed = trees.changes(trees.digests(tree, "id"), trees.digests(trees.nodes(new, "id", "t"), "id"), "id")
    assert {(r.id, r.path, r.old, r.new) for r in changed.collect()} == {(1, "1/1/1", "x", "x2"), (2, "4", "tail", "<b>"), (2, "4/1", None, "new")}
    allowed = spark.createDataFrame([(1, 2, "x2"), (2, 6, "other")], "id int, pos int, new string")
    assert {(r.id, r.path, r.reason) for r in trees.placement_problems(changed, allowed, "id").collect()} == {(1, "1/1/1", None), (2, "4/1", "change that nobody planned"), (2, "4", "not what was planned")}
    same = trees.digests(tree, "id")
    assert trees.changes(same, same, "id").count() == 0 and trees.digests(trees.nodes(old.limit(0), "id", "t"), "id").count() == 0


def test_trees_of_texts_side_by_side(spark):
    from formlake.operators import trees

    rng = random.Random(8)
    marks = ["<a>", "</a>", "<B x='1'>", "</b>", "<p>", "</P>", "<br>", "</br>", "<i/>", "x", "y<", "<!-- <a> -->", "<"]
    rows = []
    for k in range(60):
        one = rng.choices(marks, k=rng.randint(0, 25))
        rows.append((k, "".join(one), "".join(rng.choice(marks) if rng.random() < 0.1 else m for m in one)))
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {tuple(r) for r in df.select("id", F.inline(trees.text_changes(F.col("a"), F.col("b")))).collect()}
    tree = lambda c: trees.digests(trees.nodes(df, "id", c), "id")
    assert got == {(r.id, r.path, r.pos, r.old, r.new) for r in trees.changes(tree("a"), tree("b"), "id").collect()} and len(got) > 50
    # No depth costs a round of its own.
    deep = spark.createDataFrame([(1, "<a>" * 3000 + "x" + "</a>" * 3000, "<a>" * 3000 + "y"), (2, None, None), (3, None, "z")], "id int, a string, b string")
    found = deep.select("id", F.inline(trees.text_changes(F.col("a"), F.col("b"))))
    assert [(r.id, r.pos, r.old, r.new) for r in found.orderBy("id").collect()] == [(1, 3000, "x", "y"), (3, None, None, "z")]


def test_ink_by_tiles(spark):
    from formlake.operators import geometry

    rng = random.Random(9)
    # A picture of 100,000 places a side; sums of all of them would be as many rows.
    pixels = [(p, rng.choice([0, 70_000]) + rng.randint(0, 150), rng.randint(-70, 150), rng.choice([10, 200])) for p in (1, 2) for _ in range(600)]
    rects = [(p, k, x, y, x + rng.randint(0, 120), y + rng.randint(0, 90)) for p in (1, 2, 3) for k in range(40) for x, y in [(rng.choice([0, 70_000]) + rng.randint(-5, 150), rng.randint(-80, 150))]]
    rects.append((1, 99, -100, -100, 100_000, 100_000))
    found = geometry.ink_within(spark.createDataFrame(rects, "page int, id int, x0 int, y0 int, x1 int, y1 int"), geometry.ink_tiles(spark.createDataFrame(pixels, "page int, x int, y int, value int")))
    assert {tuple(r) for r in found.collect()} == {(p, k, sum(q == p and v < 160 and x0 <= x < x1 and y0 <= y < y1 for q, x, y, v in pixels)) for p, k, x0, y0, x1, y1 in rects}


def test_pages_are_shuffled_once(spark, tmp_path):
    import duckdb

    from formlake.plans.registry import QUERIES

    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"copy (select * from '/root/testdata/sf0.001/{t}.parquet') to '{tmp_path}/{t}.parquet' (format parquet)")
    # An exchange for each table read, none for the pairs that meet on a page.
    for name, tables in PAGEWISE.items():
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= tables and "NestedLoop" not in plan, (name, plan)


#: Queries and how many tables of pages they read.
PAGEWISE = {"au_clip_ink": 2, "jn_overlap_claim": 1, "wn_cascade": 1, "wn_empty_areas": 2, "wn_context": 2, "wn_grid_cells": 6}


def test_provenance_of_long_values(spark):
    from time import perf_counter

    from formlake.operators import rules

    many = [f"w{k}q" for k in range(6000)]
    rows = [(1, " ".join(many * 2) + " zz9", [" ".join(many)]), (2, "Rossi di rom xy", ["Mario Rossi", "Roma"]), (3, "a", [" "]), (4, None, ["a"]), (5, "a", None)]
    began = perf_counter()
    got = {r.id: r.p for r in spark.createDataFrame(rows, "id int, v string, s array<string>").select("id", rules.provenance_problem(F.col("v"), F.col("s")).alias("p")).collect()}
    # Finding the sources' words for each word of the value took minutes.
    assert got[1] == "zz9" and got[2] == "xy" and got[3] == "no source" and got[4] is None and perf_counter() - began < 40


def test_edits_cross_runs(spark):
    from formlake.operators import edits

    runs = spark.createDataFrame([(1, 0, "nome ", "a"), (1, 1, "___", "b"), (1, 2, "", "c"), (1, 3, "__ fine", "d"), (2, 0, "x" * 700, "a"), (2, 1, "y", "b"), (3, 0, "intatto", "a")], "par int, run int, text string, style string")
    some = spark.createDataFrame([(1, 5, 10, "Rossi"), (1, 0, 0, "> "), (1, 15, 15, "!"), (2, 10, 690, "-"), (2, 701, 701, "z")], "par int, start int, until int, value string")
    got = edits.edited_runs(runs, some, ["par"]).orderBy("par", "run", "piece").collect()
    by = {}
    for r in got:
        by.setdefault(r.par, []).append((r.style, r.text))
    assert by == {1: [("a", "> "), ("a", "nome "), ("b", "Rossi"), ("d", " fine"), ("d", "!")], 2: [("a", "x" * 10), ("a", "-"), ("a", "x" * 10), ("b", "y"), ("b", "z")], 3: [("a", "intatto")]}


def test_words_of_edits_are_not_shuffled(spark):
    from formlake.plans.registry import QUERIES

    plan = QUERIES["wr_docx_apply"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Lines for the runs, and lines for the edits.
    assert plan.count("Exchange hashpartitioning") == 2, plan


def test_grids_at_any_scale_and_place(spark):
    from formlake.operators import geometry

    bars, uprights, expected = [], [], set()

    def grid(page, xs, ys, skip=()):
        bars.extend((page, y, a, b) for y in ys for a, b in zip(xs, xs[1:], strict=False))
        uprights.extend((page, x, a, b) for c, x in enumerate(xs) for r, (a, b) in enumerate(zip(ys, ys[1:], strict=False)) if (r, c) not in skip)

    five = [0.0, 20.0, 40.0, 60.0, 80.0]
    for page, (scale, shift) in enumerate([(1, 0), (0.5, 3), (2, 17), (1, 7000)]):
        own = [shift + scale * v for v in five]
        grid(page, own, own)
        expected |= {(page, a, c, b, d) for a, b in zip(own, own[1:], strict=False) for c, d in zip(own, own[1:], strict=False)}
    # Two tables of other heights side by side, and one that lacks its right side.
    grid(10, [0.0, 20.0, 40.0], [0.0, 10.0, 20.0, 30.0])
    grid(10, [60.0, 90.0], [0.0, 15.0, 30.0])
    expected |= {(10, x, y, x + 20, y + 10) for x in (0.0, 20.0) for y in (0.0, 10.0, 20.0)} | {(10, 60.0, y, 90.0, y + 15) for y in (0.0, 15.0)}
    grid(11, [0.0, 20.0, 40.0], [0.0, 10.0], skip=((0, 2),))
    expected.add((11, 0.0, 0.0, 20.0, 10.0))
    # A bar that closes two columns at once makes a cell over two rows beside it.
    bars.extend([(12, 0.0, 0.0, 60.0), (12, 30.0, 0.0, 60.0), (12, 15.0, 20.0, 60.0)])
    uprights.extend((12, x, 0.0, 30.0) for x in (0.0, 20.0, 60.0))
    expected |= {(12, 0.0, 0.0, 20.0, 30.0), (12, 20.0, 0.0, 60.0, 15.0), (12, 20.0, 15.0, 60.0, 30.0)}
    found = geometry.grid_cells(spark.createDataFrame(bars, "page int, y double, `from` double, `to` double"), spark.createDataFrame(uprights, "page int, x double, `from` double, `to` double"))
    assert {tuple(r) for r in found.select("page", "x0", "y0", "x1", "y1").collect()} == expected


def test_text_fits_an_area(spark):
    from formlake.operators import geometry

    def lines(words, room):
        n, used = 0, 0.0
        for w in words:
            if w > room:
                return None
            n, used = (n, used + 0.25 + w) if n and used + 0.25 + w <= room else (n + 1, w)
        return n

    rng = random.Random(6)
    rows = [(k, [rng.randint(1, 12) * 0.5 for _ in range(rng.randint(0, 30))], rng.uniform(20, 200), rng.uniform(5, 80)) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, w array<double>, width double, height double")
    got = {r.id: r.s for r in df.select("id", geometry.fitting_area_size(F.col("w"), F.col("width"), F.col("height")).alias("s")).collect()}
    for k, w, width, height in rows:
        sizes = [10.0 - q * 0.25 for q in range(23)]
        fits = [s for s in sizes if lines(w, width / s) is not None and lines(w, width / s) * 1.2 * s <= height]
        assert got[k] == (fits[0] if fits else None)
    assert len(set(got.values())) > 5


def test_points_of_word_parts(spark):
    from formlake.operators import word_points

    run = "<w:r><w:t>{}</w:t></w:r>"
    control = "<w:sdt><w:sdtPr>{}</w:sdtPr><w:sdtContent>{}</w:sdtContent></w:sdt>"
    field = '<w:fldChar w:fldCharType="{}"/>'
    typed = f"<w:r>{field.format('begin')}<w:instrText> FORMTEXT </w:instrText>{field.format('separate')}<w:t>____</w:t>{field.format('end')}</w:r>"
    inside = f"<w:r>{field.format('begin')}<w:instrText>IF</w:instrText></w:r>{typed}<w:r>{field.format('end')}</w:r>"
    paragraphs = [
        run.format("Name _____ [x y] [ ] a&amp;b  end"),
        control.format('<w14:checkbox><w14:checked w14:val="1"/></w14:checkbox>', run.format("☒")),
        inside,
        run.format("Born ") + run.format("   ") + run.format("in"),
        f"<w:r>{field.format('begin')}<w:t>_______</w:t></w:r>",
        "<w:r><w:t>out</w:t><w:pict><w:txbxContent><w:p>" + run.format("in _____") + "</w:p></w:txbxContent></w:pict></w:r>",
        control.format('<w:lock w:val="contentLocked"/>', control.format("<w:text/>", run.format("____"))),
        run.format("who?  ") + typed,
        run.format("odd " + field.format("end")) + run.format("fine: "),
    ]
    xml = "<w:document>" + "".join(f"<w:p>{p}</w:p>" for p in paragraphs) + "</w:document>"
    parts = spark.createDataFrame([(1, xml), (2, None), (3, "")], "id int, xml string")
    got = {(r.n, r.kind, r.start, r.end, r.checked, r.reason) for r in word_points.points(parts, ["id"], "xml").collect()}
    assert got == {
        (0, "testo", 5, 10, None, None), (0, "segnaposto_testuale", 11, 16, None, None), (0, "glifo_casella", 17, 20, False, None), (0, "spazio_implicito", 24, 26, None, None),
        (1, "sdt_casella", None, None, True, None),
        (2, "form_testo", None, None, None, "field without a plain result"),
        (3, "spazio_implicito", 5, 8, None, None),
        (6, "testo", 3, 8, None, None),
        (7, "sdt_rich_text", None, None, None, "bound, locked or of several paragraphs"), (7, "sdt_testo", None, None, None, "inside a guarded control"),
        (8, "form_testo", None, None, None, None), (8, "spazio_implicito", 4, 6, None, None),
        (9, "inserimento_testo", 10, 10, None, None),
    }


def test_maps_do_not_depend_on_partitions(spark):
    from formlake.operators import maps, sequences

    rows = [(d, n // 3, n, f"name ____ line {n % 4} .... {'-----' if n % 5 == 0 else ''}") for d in (1, 2) for n in range(10)] + [(3, 0, 0, None), (4, 0, 0, "a\x01b ____")]
    df = spark.createDataFrame(rows, "doc int, page int, n int, text string")
    found = [maps.rendered_lines(df.repartition(k, "n"), sequences.FILLERS) for k in (1, 7)]
    one, two = ({(r.doc, r.n): (r.shown, r.places, r.digest) for r in f.collect()} for f in found)
    assert one == two and len(one) == 22
    assert one[1, 0][0] == "name [1] line 0 [2] [3]" and one[1, 1][0] == "name [4] line 1 [5] " and one[1, 3][0] == "name [1] line 3 [2] "
    assert [tuple(p) for p in one[1, 1][1]] == [(4, 5, 4), (5, 17, 4)] and one[3, 0][:2] == ("", []) and one[4, 0][0] == "ab [1]"
    pages = maps.with_owner(maps.pages(found[1]))
    sources = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "doc int, sha string")
    got = {r.doc: r for r in maps.maps(pages, sources).collect()}
    assert got[1].digest == got[2].digest and (got[1].reused, got[2].reused, got[2].pages) == (0, 4, 4) and len({r.digest for r in got.values()}) == 3
