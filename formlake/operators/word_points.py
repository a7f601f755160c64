"""The writable points of Word parts: an automaton over the tags of their XML, as running sums and windows.

How deep a tag lies in elements of a kind is a running sum over the part; the innermost element of a kind is the last one opened at the same depth.
Fields (begin, separate, end, nested at will) are the same inside a paragraph. What an element holds is the difference of running counts between its two tags.
So nothing recurs, and no part meets in a Python function. Names are told with the prefixes that Word writes (w, w14, mc).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.rounds import settled

_TOKEN = r"""(?s)(<!--.*?-->|<\?.*?\?>|<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++)"""
#: What counts as a filler, as a box and as a placeholder, and boxes that are ticked.
FILLER = r"[_.…·]{2,}|[-–—]{3,}|[\x{2002}\x{2003}]{3,}|\(\s*\)"
BOX = r"[□☐❑☒☑\x{f06f}\x{f0a8}\x{f071}\x{f0fe}\x{f0fc}]|\[ *\]"
TICKED = "[☒☑]"
PLACEHOLDER = r"\[[^\[\]\r\n]+\]"
BLANKS = r"[ \t]{2,}|\t"
EMPTY_RESULT = r"[\s_.…·/:()\[\]\-–—]{2,}"
#: What Word shows in a control nobody has filled.
PROMPTS = ("fare clic qui per immettere testo.", "fare clic qui per immettere una data.", "click or tap here to enter text.", "click or tap to enter a date.")
#: How deep: names of the elements.
_DEPTHS = {
    "p": ("p",), "r": ("r",), "t": ("t",), "i": ("instrText",), "tc": ("tc",), "tr": ("tr",), "sdt": ("sdt",), "pr": ("sdtPr",), "fs": ("fldSimple",), "fc": ("fldChar",),
    "revised": ("del", "ins", "moveFrom", "moveTo"), "other": ("mc:AlternateContent", "mc:Choice", "mc:Fallback"),
}
#: How many so far: names of the elements.
_COUNTS = {"sdts": ("sdt",), "ps": ("p",), "tables": ("tbl",), "things": ("drawing", "pict", "object"), "chars": ("fldChar",), "simples": ("fldSimple",), "symbols": ("sym",), "sections": ("sectPr",)}
_OFF = ("0", "false", "off")


def _value(tag: Column, name: str = "val") -> Column:
    """An attribute of a tag; null if it has none."""
    found = F.regexp_extract(tag, rf'\b{name}="([^"]*)"', 1)
    return F.when(tag.rlike(rf'\b{name}="'), found)


def _plain(text: Column) -> Column:
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def tags(parts: DataFrame, key: list[str], xml: str) -> DataFrame:
    """One row for each tag and text of each part: key, pos, tag, name, step (1 opens, -1 closes, 0 text), depths (d_*), counts (c_*), what each element holds
    (h_*), the innermost paragraph, cell, row, control and simple field (in_*, the pos of their opening tags), n (number of the paragraph) and value (text that a run shows).
    """
    raw = F.filter(F.regexp_extract_all(xml, F.lit(_TOKEN), F.lit(1)), lambda t: ~t.startswith("<!") & ~t.startswith("<?"))
    # An element without content is opened and closed at once.
    both = lambda t: F.when(t.endswith("/>") & t.startswith("<"), F.array(t, F.concat(F.lit("</"), F.regexp_extract(t, r"^<([\w:.-]+)", 1), F.lit(">")))).otherwise(F.array(t))
    rows = parts.select(*key, F.posexplode(F.flatten(F.transform(raw, both))).alias("pos", "tag"))
    rows = rows.withColumn("name", F.regexp_extract("tag", r"^</?(?:w:)?([\w:.-]+)", 1))
    rows = rows.withColumn("step", F.when(F.col("tag").startswith("</"), -1).when(F.col("tag").startswith("<"), 1).otherwise(0))
    along = Window.partitionBy(*key).orderBy("pos")
    sums = {f"d_{k}": F.sum(F.when(F.col("name").isin(*v), F.col("step")).otherwise(0)).over(along) for k, v in _DEPTHS.items()}
    sums |= {f"c_{k}": F.sum(F.when(F.col("name").isin(*v) & (F.col("step") == 1), 1).otherwise(0)).over(along) for k, v in _COUNTS.items()}
    rows = rows.withColumns(sums | {"_sum": F.sum("step").over(along)})
    in_run = F.col("d_r") > 0
    symbol = F.decode(F.unhex(F.lpad(F.coalesce(_value(F.col("tag"), "char"), F.lit("FFFD")), 4, "0")), "UTF-16BE")
    value = F.when(in_run & (F.col("d_t") > 0) & (F.col("step") == 0), _plain(F.col("tag"))).when(in_run & (F.col("step") == 1), F.when(F.col("name") == "sym", symbol).when(F.col("name") == "tab", "\t").when(F.col("name").isin("br", "cr"), "\n"))
    rows = rows.withColumn("value", F.coalesce(value, F.lit("")))
    rows = rows.withColumn("c_ink", F.sum(F.when(F.col("value").rlike(r"\S"), 1).otherwise(0)).over(along))
    # The closing tag is the next row of an opening tag's depth.
    counts = [f"c_{k}" for k in (*_COUNTS, "ink")]
    level = F.col("_sum") - F.when(F.col("step") == 1, 1).otherwise(0)
    same = Window.partitionBy(*key, "_level").orderBy("pos")
    rows = rows.withColumn("_level", F.when(F.col("step") != 0, level)).withColumn("_end", F.when(F.col("step") == 1, F.lead(F.struct(*counts)).over(same)))
    rows = rows.withColumns({f"h_{c[2:]}": F.col(f"_end.{c}") - F.col(c) for c in counts})
    for k, name in (("p", "p"), ("tc", "tc"), ("tr", "tr"), ("sdt", "sdt"), ("fs", "fldSimple")):
        last = F.last(F.when((F.col("name") == name) & (F.col("step") == 1), F.col("pos")), ignorenulls=True).over(Window.partitionBy(*key, f"d_{k}").orderBy("pos"))
        rows = rows.withColumn(f"in_{k}", F.when(F.col(f"d_{k}") > 0, last))
    number = F.max(F.when((F.col("name") == "p") & (F.col("step") == 1), F.col("c_ps") - 1)).over(Window.partitionBy(*key, "in_p"))
    return rows.withColumn("n", F.when(F.col("in_p").isNotNull(), number).cast("int")).drop("_sum", "_level", "_end")


def _settled(rows: DataFrame) -> DataFrame:
    """rows, checkpointed without what only led to them; what elements hold is kept for the few that are asked."""
    held = [c for c in rows.columns if c.startswith("h_")]
    asked = (F.col("step") == 1) & F.col("name").isin("p", "tc", "sdt")
    spent = [c for c in rows.columns if c.startswith("c_") or c in ("d_p", "d_r", "d_tc", "d_tr", "d_fs", "d_fc")]
    packed = settled(rows.withColumn("_h", F.when(asked, F.struct(*held))).drop(*held, *spent))
    return packed.withColumns({c: F.col(f"_h.{c}") for c in held}).drop("_h")


def _joined(when: Column, what: Column) -> Column:
    """Texts of a group in their order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", what.alias("x"))))), lambda s: s["x"]), "")


def _context(rows: DataFrame) -> Column:
    """Why nothing is written at a row whatever its kind; null if nothing speaks against it."""
    return F.when(F.col("d_other") > 0, "other representations").when(F.col("d_revised") > 0, "open revisions")


def _controls(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, pos: controls with kind, checked, reason, n, plain (it holds no other control)."""
    opened, name = F.col("step") == 1, F.col("name")
    in_pr = F.col("d_pr") > 0
    has = lambda *names: F.max(F.when(in_pr & opened & name.isin(*names), 1).otherwise(0)) == 1
    attr = lambda n: F.max(F.when(in_pr & opened & (name == n), F.coalesce(_value(F.col("tag")), F.lit("1"))))
    own = F.max_by(F.struct("n", "in_p", "d_other", "d_revised", "h_sdts", "h_ps", "h_tables", "h_things", "h_chars", "h_simples"), F.when(opened & (name == "sdt"), 1))
    told = rows.filter("in_sdt is not null").groupBy(*key, F.col("in_sdt").alias("pos")).agg(
        own.alias("o"), has("w14:checkbox").alias("box"), has("text", "date", "dropDownList", "comboBox").alias("typed"), has("date", "dropDownList", "comboBox").alias("listed"), has("dataBinding").alias("bound"),
        attr("lock").alias("lock"), attr("showingPlcHdr").alias("showing"), attr("w14:checked").alias("ticked"), (F.max(F.when(opened & (name == "sdtContent"), 1)) == 1).alias("filled"), (F.max(F.when(opened & (name == "sdtPr"), 1)) == 1).alias("known"),
        F.min(F.when(opened & (name == "p") & ~in_pr, F.col("n"))).alias("first"), F.trim(_joined((F.col("d_t") > 0) & (F.col("step") == 0) & ~in_pr, F.col("value"))).alias("content"),
    ).filter("known and filled")
    locked = F.col("bound") | F.coalesce(~F.col("lock").isin("sdtLocked", "unlocked"), F.lit(False))
    told = told.withColumn("guarded", locked)
    # Guarded controls around a control: those opened before it and not yet closed.
    ends = rows.filter("name = 'sdt'").select(*key, F.col("in_sdt"), "pos", "step", "d_sdt")
    starts = ends.filter("step = 1").join(told.filter("guarded").select(*key, "pos", F.lit(1).alias("g")), [*key, "pos"], "left")
    # A closing tag belongs to the last control opened one level below the depth it leaves.
    close = ends.filter("step = -1").withColumn("d_sdt", F.col("d_sdt") + 1).withColumn("g", F.lit(None).cast("int"))
    pairs = starts.unionByName(close).withColumn("g", F.coalesce(F.when(F.col("step") == 1, F.col("g")).otherwise(F.lag("g").over(Window.partitionBy(*key, "d_sdt").orderBy("pos"))), F.lit(0)))
    around = pairs.withColumn("around", F.sum(F.col("g") * F.col("step")).over(Window.partitionBy(*key).orderBy("pos")) - F.col("g")).filter("step = 1").select(*key, "pos", "around")
    told = told.join(around, [*key, "pos"], "left").select(*key, "pos", "o.*", "box", "typed", "listed", "guarded", "showing", "ticked", "first", "content", "around")
    kind = F.when(F.col("box"), "sdt_casella").when(F.col("typed"), "sdt_testo").otherwise("sdt_rich_text")
    written = ~F.col("box") & (F.col("h_sdts") == 0) & (F.col("content") != "") & F.coalesce(F.col("showing").isin(*_OFF), F.lit(True)) & ~F.lower("content").isin(*PROMPTS) & ~F.col("content").rlike(f"^(?:{FILLER})$")
    reason = (
        F.coalesce(_context(told), F.when(F.col("around") > 0, "inside a guarded control").when(F.col("guarded") | (F.col("h_ps") > 1), "bound, locked or of several paragraphs").when(written, "already filled")
        .when(F.col("listed"), "list or date: state to be kept by Word").when((F.col("h_sdts") > 0) | (F.col("h_tables") + F.col("h_things") + F.col("h_chars") + F.col("h_simples") > 0), "structured control"))
    )
    checked = F.when(F.col("box"), F.coalesce(~F.col("ticked").isin(*_OFF), F.lit(False)))
    return told.select(*key, "pos", kind.alias("kind"), F.coalesce("n", "first").alias("n"), F.col("content").alias("text"), checked.alias("checked"), reason.alias("reason"), (F.col("h_sdts") == 0).alias("plain"))


def _fields(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows of paragraphs with field: the pos of the innermost field's beginning (null: outside), and closed, whether it ends in its paragraph."""
    step = F.when((F.col("name") == "fldChar") & (F.col("step") == 1), F.when(_value(F.col("tag"), "fldCharType") == "begin", 1).when(_value(F.col("tag"), "fldCharType") == "end", -1)).otherwise(0)
    along = Window.partitionBy(*key, "in_p").orderBy("pos")
    rows = rows.filter("in_p is not null").withColumn("_mark", F.coalesce(step, F.lit(0))).withColumn("_run", F.sum("_mark").over(along))
    # Ends without a beginning lower the sum for good: the lowest sum so far is the ground.
    rows = rows.withColumn("flevel", F.col("_run") - F.least(F.min("_run").over(along), F.lit(0)))
    last = F.last(F.when(F.col("_mark") == 1, F.col("pos")), ignorenulls=True)
    rows = rows.withColumn("field", F.when(F.col("flevel") > 0, last.over(Window.partitionBy(*key, "in_p", "flevel").orderBy("pos"))))
    # An end one level up closes the last field of the level below it.
    ends = rows.filter("_mark = -1").select(*key, "in_p", (F.col("flevel") + 1).alias("flevel"), "pos", F.lit(None).cast("int").alias("b"))
    begins = rows.filter("_mark = 1").select(*key, "in_p", "flevel", "pos", F.col("pos").alias("b"))
    closed = ends.unionByName(begins).withColumn("nxt", F.lead(F.coalesce("b", F.lit(-1))).over(Window.partitionBy(*key, "in_p", "flevel").orderBy("pos"))).filter("b is not null").select(*key, F.col("b").alias("field"), (F.col("nxt") == -1).alias("closed"))
    return rows.join(closed, [*key, "field"], "left").drop("_mark", "_run")


def _form_fields(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, pos: form fields that end in their paragraph, with kind, checked, reason, n; and fields that do not (kind null)."""
    opened, name, tag = F.col("step") == 1, F.col("name"), F.col("tag")
    seen = lambda n: F.max(F.when(opened & (name == n), 1).otherwise(0)) == 1
    state = lambda n: F.max(F.when(opened & (name == n), F.coalesce(_value(tag), F.lit("1"))))
    first = F.min_by(F.struct("n", "d_other", "d_revised", "flevel", "closed"), "pos")
    got = rows.filter("field is not null").groupBy(*key, F.col("field").alias("pos")).agg(
        first.alias("o"), seen("checkBox").alias("box"), seen("textInput").alias("typed"), state("checked").alias("a"), state("default").alias("b"),
        (F.max(F.when(opened & (name == "fldChar") & (_value(tag, "fldCharType") == "separate"), 1).otherwise(0)) == 1).alias("cut"),
        _joined((F.col("d_i") > 0) & (F.col("step") == 0), tag).alias("instr"), F.trim(_joined((F.col("d_t") > 0) & (F.col("step") == 0), F.col("value"))).alias("text"),
    ).select(*key, "pos", "o.*", "box", "typed", "a", "b", "cut", "instr", "text")
    form = F.col("box") | F.col("typed") | F.col("instr").contains("FORMTEXT")
    ended = F.coalesce("closed", F.lit(False))
    kind = F.when(ended & form, F.when(F.col("box"), "form_casella").otherwise("form_testo"))
    filled = ~F.col("box") & (F.col("text") != "") & ~F.col("text").rlike(f"^(?:{EMPTY_RESULT})$")
    reason = F.coalesce(_context(got), F.when(filled, "already filled").when(~F.col("cut") | (F.col("flevel") > 1), "field without a plain result"))
    checked = F.when(F.col("box"), F.coalesce(~F.coalesce("a", "b").isin(*_OFF), F.lit(False)))
    return got.select(*key, "pos", kind.alias("kind"), "n", "text", checked.alias("checked"), reason.alias("reason"), ended.alias("ended"))


def _text_points(rows: DataFrame, key: list[str]) -> DataFrame:
    """Points that paragraphs show in their text: fillers, boxes, placeholders in brackets, blanks between words. rows: with taken (inside a control or a field)."""
    par = [*key, "in_p"]
    w = Window.partitionBy(*par).orderBy("pos")
    shown = rows.withColumn("end", F.sum(F.length("value")).over(w).cast("int")).withColumn("start", (F.col("end") - F.length("value")).cast("int"))
    paragraph = shown.groupBy(*par).agg(F.first("n").alias("n"), _joined(F.col("value") != "", F.col("value")).alias("text"))
    found = None
    for rank, pattern in ((1, FILLER), (2, BOX), (3, PLACEHOLDER), (4, BLANKS)):
        pieces = F.split(F.regexp_replace("text", f"({pattern})", "\x01$1\x02"), "[\x01\x02]")
        part = paragraph.filter(F.col("text").rlike(pattern)).select(*par, "n", "text", F.lit(rank).alias("rank"), F.posexplode(pieces).alias("k", "piece"))
        found = part if found is None else found.unionByName(part)
    found = found.withColumn("end", F.sum(F.length("piece")).over(Window.partitionBy(*par, "rank").orderBy("k")).cast("int")).filter("k % 2 = 1").withColumn("start", (F.col("end") - F.length("piece")).cast("int"))
    only = F.regexp_replace("piece", "_", "__")
    weight = F.length(F.replace(only, F.lit("…"), F.lit("………")))
    found = found.filter((F.col("rank") != 1) | ~F.col("piece").rlike("^[_.…·]+$") | (weight >= 5))
    found = found.filter((F.col("rank") != 4) | F.expr("substring(text, 1, start)").rlike(r"\S")).drop("text", "k")
    # Texts of runs (0; taken ones -2) and marks of fields (-1) stand among the matches.
    runs = shown.filter("value <> ''").select(*par, "n", F.when(F.col("taken"), -2).otherwise(0).alias("rank"), "start", "end", F.col("value").alias("piece"))
    marks = shown.filter("name = 'fldChar' and step = 1").select(*par, "n", F.lit(-1).alias("rank"), "start", F.col("start").alias("end"), F.lit("").alias("piece"))
    all_ = found.unionByName(runs).unionByName(marks).dropDuplicates([*par, "rank", "start", "end"])
    order = Window.partitionBy(*par).orderBy("start", "end", "rank")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    begin, end = F.col("start"), F.col("end")

    def meets(which: Column, touch: bool = False) -> Column:
        before, after = F.max(F.when(which, end)).over(back), F.min(F.when(which, begin)).over(ahead)
        return F.coalesce(before >= begin if touch else before > begin, F.lit(False)) | F.coalesce(after <= end if touch else after < end, F.lit(False))

    rank = F.col("rank")
    into = F.coalesce(F.min(F.when((rank == -1), begin)).over(ahead) < end, F.lit(False))
    holder = F.last(F.when(rank.isin(0, -2), F.struct(begin.alias("s"), end.alias("e"), F.col("piece").alias("t"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    same = F.first(F.when(rank.isin(0, -2), F.struct(begin.alias("s"), end.alias("e"), F.col("piece").alias("t"))), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    all_ = all_.withColumns({"_taken": meets(rank == -2), "_into": into, "_last": holder, "_next": same})
    live = all_.filter("rank > 0 and not _taken")
    live = live.withColumn("_hit", (rank == 3) & meets(rank.isin(1, 2))).filter("not _hit")
    live = live.withColumn("_hit", (rank == 4) & (meets(rank.isin(1, 2, 3), touch=True) | F.col("_into"))).filter("not _hit")
    # Blanks that begin in a run of words and go on in others belong to those.
    own = F.when(F.col("_next.s") == begin, F.col("_next")).otherwise(F.col("_last"))
    later = (rank == 4) & (own["e"] < end) & F.expr("substring(own.t, 1, start - own.s)").rlike(r"\S")
    live = live.withColumn("own", own).withColumn("_later", F.coalesce(later, F.lit(False)))
    start = F.when(F.col("_later"), F.col("own.e")).otherwise(begin)
    piece = F.expr("substring(piece, start - start0 + 1)")
    live = live.withColumnRenamed("start", "start0").withColumn("own_e", F.col("own.e")).withColumn("start", F.when(F.col("_later"), F.col("own_e")).otherwise(F.col("start0")))
    kind = F.when(rank == 1, "testo").when(rank == 2, "glifo_casella").when(rank == 3, "segnaposto_testuale").otherwise("spazio_implicito")
    return live.select(*par, "n", kind.alias("kind"), "start", "end", piece.alias("text"), F.when(rank == 2, F.col("piece").rlike(TICKED)).alias("checked")), paragraph


def points(parts: DataFrame, key: list[str], xml: str, levels: DataFrame | None = None) -> DataFrame:
    """The points of Word parts.

    parts: key columns and the XML of a part (null: no points). levels: num, level, glyph of list numbering, alike for all parts, if there is any.
    Returns key, n (paragraph, from 0), kind, start, end (in the paragraph's text; null for controls, fields, lists and cells), text, checked (of boxes),
    candidate (only evidence: whoever reads decides), reason (why nothing is written; null: writable). Of several reasons the outermost is told.
    A paragraph in a text box is one by itself. Entities other than the five of XML stay as they are, and styles hand no numbering down.
    """
    rows = _settled(tags(parts, key, xml))
    controls = _controls(rows, key)
    plain = controls.filter("plain").select(*key, F.col("pos").alias("in_sdt"), F.lit(True).alias("_c"))
    rows = rows.join(plain, [*key, "in_sdt"], "left")
    simple = rows.filter("name = 'fldSimple' and step = 1").filter(F.upper(F.trim(F.coalesce(_value(F.col("tag"), "instr"), F.lit("")))).startswith("FORMTEXT"))
    rows = rows.join(simple.select(*key, F.col("pos").alias("in_fs"), F.lit(True).alias("_s")), [*key, "in_fs"], "left")
    inside = _fields(rows, key)
    forms = _form_fields(inside, key)
    held = forms.filter("kind is not null or not ended").select(*key, F.col("pos").alias("field"), F.lit(True).alias("_f"))
    inside = inside.join(held, [*key, "field"], "left").withColumn("taken", F.coalesce((F.col("_c") & (F.col("d_pr") == 0)) | F.col("_s") | F.col("_f"), F.lit(False)))
    inside = _settled(inside)
    shown, paragraph = _text_points(inside, key)
    none, no = F.lit(None), F.lit(False)
    out = lambda df, kind, text, checked, candidate, reason, start=none, end=none: df.select(*key, "n", kind.alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), text.cast("string").alias("text"), checked.cast("boolean").alias("checked"), candidate.alias("candidate"), reason.cast("string").alias("reason"))
    opened = rows.filter("step = 1")
    heads = inside.filter("name = 'p' and step = 1").select(*key, "in_p", "in_tc", "d_other", "d_revised", *[c for c in inside.columns if c.startswith("h_")])
    why = _context(heads)
    told = [out(controls, F.col("kind"), F.col("text"), F.col("checked"), no, F.col("reason")), out(forms.filter("kind is not null"), F.col("kind"), F.col("text"), F.col("checked"), no, F.col("reason"))]
    told.append(out(simple, F.lit("form_semplice_testo"), none, none, no, F.coalesce(_context(simple), F.lit("simple field"))))
    texts = shown.join(heads.select(*key, "in_p", why.alias("reason")), [*key, "in_p"])
    told.append(out(texts, F.col("kind"), F.col("text"), F.col("checked"), F.col("kind").isin("segnaposto_testuale", "spazio_implicito"), F.col("reason"), F.col("start"), F.col("end")))
    facts = inside.groupBy(*key, "in_p").agg(F.max("taken").alias("taken"), F.max(F.when((F.col("name") == "numId") & (F.col("step") == 1), _value(F.col("tag")))).alias("num"), F.max(F.when((F.col("name") == "ilvl") & (F.col("step") == 1), _value(F.col("tag")))).alias("level"))
    state = paragraph.join(facts, [*key, "in_p"]).join(heads.withColumn("reason", why), [*key, "in_p"])
    listed = None
    if levels is not None:
        boxes = levels.filter(F.col("glyph").rlike(f"^(?:{BOX})$")).select("num", "level", "glyph")
        listed = state.filter("num is not null").withColumn("level", F.coalesce("level", F.lit("0"))).join(boxes, ["num", "level"])
        told.append(out(listed, F.lit("elenco_casella"), F.col("text"), F.col("glyph").rlike(TICKED), no, F.col("reason")))
    # A row of one cell with nothing but a printed label asks as a label with a colon does.
    cells = opened.filter("name = 'tc'").withColumn("_many", F.count("*").over(Window.partitionBy(*key, "in_tr")))
    nothing = (F.col("h_tables") + F.col("h_things") + F.col("h_chars") == 0)
    merged = rows.filter("name in ('vMerge', 'hMerge') and step = 1").groupBy(*key, "in_tc").agg(F.max(F.when(F.coalesce(_value(F.col("tag")), F.lit("")) != "restart", 1).otherwise(0)).alias("merged"))
    lone = cells.filter((F.col("_many") == 1) & (F.col("h_ps") == 1) & nothing & (F.col("h_simples") + F.col("h_sdts") == 0)).join(merged, [*key, "in_tc"], "left_anti").select(*key, "in_tc", F.lit(True).alias("_lone"))
    busy = shown.select(*key, "in_p").distinct()
    if listed is not None:
        busy = busy.unionByName(listed.select(*key, "in_p")).distinct()
    asks = state.filter("not taken").join(busy, [*key, "in_p"], "left_anti").join(lone, [*key, "in_tc"], "left")
    label = F.col("text").rlike(r"^[^:\n]{2,100}:\s*$") | (F.coalesce("_lone", no) & F.trim("text").rlike(r"^[^:\n\t]{2,100}$"))
    told.append(out(asks.filter(label), F.lit("inserimento_testo"), F.lit(""), none, F.lit(True), F.col("reason"), F.length("text"), F.length("text")))
    used = rows.filter("_c or _s").select(*key, "in_tc").filter("in_tc is not null").distinct()
    first = opened.filter("name = 'p' and in_tc is not null").groupBy(*key, "in_tc").agg(F.min("n").alias("n"))
    blank = cells.drop("n").filter(nothing & (F.col("h_symbols") + F.col("h_ink") == 0) & (F.col("h_ps") > 0)).join(used, [*key, "in_tc"], "left_anti").join(merged, [*key, "in_tc"], "left").join(first, [*key, "in_tc"])
    told.append(out(blank, F.lit("cella_vuota"), F.lit(""), none, F.lit(True), F.coalesce(_context(blank), F.when(F.col("merged") == 1, "continued cell"))))
    bare = state.filter("not taken and in_tc is null").filter(~F.col("text").rlike(r"\S") & nothing & (F.col("h_simples") + F.col("h_sdts") + F.col("h_sections") == 0))
    told.append(out(bare, F.lit("paragrafo_vuoto"), F.lit(""), none, F.lit(True), F.col("reason")))
    result = told[0]
    for part in told[1:]:
        result = result.unionByName(part)
    return result
