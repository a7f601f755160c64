"""Values of decisions from evidence: whole sources, fragments put together, comparisons, users' answers, programs' choices.

A decision names its sources by key: `field`; `parts`, an array of (field, fragment), a null fragment standing for all of its
source; or `compare` (field, kind, value). Facts are key, kind (text, bool, int, float), value. Nothing is invented: what has no
source, or not one of the right kind, gets a reason instead of a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What fragments may be joined by, how many there may be, and the longest value of a program.
SEPARATORS, MOST_PARTS, LONGEST = (" ", ", ", "; ", "\n", "", " - "), 12, 2000
#: The phases of a form's work, in order, and the steps of each; a refused form has none.
PHASES = {
    "lettura": ("misura", "mappa"),
    "pertinenza": ("pertinenza", "pertinenza_ok", "domanda_bloccante"),
    "decisione": ("riuso", "valori", "guardia", "correzione"),
    "scrittura": ("esecuzione", "scrittura", "errore"),
    "verifica": ("controllo", "verdetto"),
}
SCALARS = ("text", "bool", "int", "float")


def step_phases(steps: DataFrame, step: str = "step") -> DataFrame:
    """steps with `phase` and its `place` from 1; unknown and refused steps have none and 0."""
    of = F.create_map(*[F.lit(x) for phase, names in PHASES.items() for name in names for x in (name, phase)])
    phase = F.try_element_at(of, F.col(step))
    return steps.withColumns({"phase": phase, "place": F.coalesce(F.array_position(F.array(*map(F.lit, PHASES)), phase), F.lit(0))})


def referenced_keys() -> Column:
    """The distinct keys that a decision names, in order."""
    keys = F.concat(F.array("field"), F.coalesce(F.transform("parts", lambda p: p.field), F.array().cast("array<string>")), F.array("compare.field"))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: F.coalesce(k, F.lit("")) != "")))


def _shown_key(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("_"), F.lit(" ")), F.lit("."), F.lit(" / "))


def described_source() -> Column:
    """What a decision takes its value from, for readers."""
    part = lambda p: F.concat(_shown_key(F.coalesce(p.field, F.lit(""))), F.coalesce(F.concat(F.lit(" → "), p.fragment), F.lit("")))
    return (
        F.when(F.col("compare").isNotNull(), F.concat(_shown_key(F.col("compare.field")), F.lit(" confrontato con "), F.coalesce("compare.value", F.lit(""))))
        .when(F.col("parts").isNotNull(), F.array_join(F.transform("parts", part), "; "))
        .otherwise(F.coalesce(_shown_key(F.col("field")), F.lit("")))
    )


def described_value(kind: Column, value: Column) -> Column:
    return F.when(kind == "bool", F.when(value == "true", "Casella selezionata").otherwise("Casella vuota")).otherwise(value)


def resolved(decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """decisions with kind, value and reason: the projection of their sources. One join on keys for all that a decision names."""
    named = decisions.select("id", F.explode(referenced_keys()).alias("key")).join(facts.select("key", F.struct("kind", "value").alias("f")), "key")
    found = named.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "f"))).alias("_found"))
    rows = decisions.join(found, "id", "left")
    source = lambda key: F.try_element_at("_found", F.coalesce(key, F.lit("")))
    # Why a source gives no text.
    no_text = lambda s: F.when(s.isNull(), "no source").when(s.kind == "bool", "yes or no").when(~s.kind.isin(*SCALARS) | (F.trim(F.coalesce(s.value, F.lit(""))) == ""), "blank")
    # A comparison.
    c = source(F.col("compare.field"))
    c_reason = F.when(c.isNull(), "no source").when((c.kind != F.col("compare.kind")) | ~c.kind.isin(*SCALARS), "kind")
    # Fragments.
    parts = F.transform("parts", lambda p: F.struct(source(p.field).alias("s"), p.fragment.alias("fragment")))
    parts = F.transform(parts, lambda p: F.struct(F.coalesce(p.fragment, p.s.value).alias("text"), no_text(p.s).alias("none"), p.s.value.alias("all")))
    bad = F.filter(F.transform(parts, lambda p: F.coalesce(p.none, F.when((F.trim(F.coalesce(p.text, F.lit(""))) == "") | ~F.contains(p.all, p.text), "fragment"))), lambda r: r.isNotNull())
    p_reason = F.when(~F.size("parts").between(1, MOST_PARTS), "parts").when(~F.coalesce("separator", F.lit(" ")).isin(*SEPARATORS), "separator").otherwise(F.get(bad, F.lit(0)))
    joined = F.concat_ws("", F.transform(parts, lambda p, i: F.concat(F.when(i > 0, F.coalesce(F.col("separator"), F.lit(" "))).otherwise(""), p.text)))
    # A whole source.
    w = source(F.col("field"))
    w_reason = F.when(F.col("field").isNull(), "no key").when((w.kind == "bool") & w.value.isNotNull(), F.lit(None)).otherwise(no_text(w))
    reason = F.when(F.col("compare").isNotNull(), c_reason).when(F.col("parts").isNotNull(), p_reason).otherwise(w_reason)
    kind = F.when(F.col("compare").isNotNull(), "bool").when(F.col("parts").isNotNull(), "text").otherwise(F.when(w.kind == "bool", "bool").otherwise("text"))
    value = F.when(F.col("compare").isNotNull(), (c.value == F.col("compare.value")).cast("string")).when(F.col("parts").isNotNull(), joined).otherwise(w.value)
    rows = rows.withColumn("_reason", reason)
    return rows.withColumns({"kind": F.when(F.col("_reason").isNull(), kind), "value": F.when(F.col("_reason").isNull(), value), "reason": F.col("_reason")}).drop("_found", "_reason")


def is_choice() -> Column:
    """Whether a place (anchor_kind, widget) is ticked, not written."""
    return (F.col("anchor_kind") == "casella") | ((F.col("anchor_kind") == "widget") & F.coalesce(F.col("widget") == "CheckBox", F.lit(False)))


def is_writable() -> Column:
    return (F.col("anchor_kind") != "widget") | F.coalesce(F.col("widget").isin("Text", "CheckBox"), F.lit(False))


def valued(decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """decisions (with anchor_kind, widget, origin, user_kind, user_value) with kind, value, reason: the user's own answer where there is one, else the projection; of the kind that the place takes."""
    rows = resolved(decisions, facts)
    own = F.col("user_kind").isNotNull()
    blank = F.trim(F.coalesce("user_value", F.lit(""))) == ""
    answer = F.when(F.coalesce("origin", F.lit("")) != "utente", "not the user").when(is_choice() & (F.col("user_kind") != "bool"), "needs yes or no").when(~is_choice() & ((F.col("user_kind") != "text") | blank), "blank")
    unlike = F.when(is_choice() != (F.col("kind") == "bool"), "kind of field")
    reason = F.when(~is_writable(), "unsupported field").when(own, answer).otherwise(F.coalesce("reason", unlike))
    rows = rows.withColumn("reason", reason)
    kept = F.col("reason").isNull()
    return rows.withColumns({"kind": F.when(kept, F.when(own, F.col("user_kind")).otherwise(F.col("kind"))), "value": F.when(kept, F.when(own, F.col("user_value")).otherwise(F.col("value")))})


def chosen_values(offered: DataFrame, slots: DataFrame, excluded: DataFrame) -> DataFrame:
    """id, kind, value, reason of what a program offers (id, kind, value) for slots (id): excluded ids, blanks and plain no are left out, what cannot be written has a reason."""
    rows = offered.join(excluded.select("id"), "id", "left_anti").join(slots.select("id").distinct().withColumn("_slot", F.lit(True)), "id", "left")
    rows = rows.filter(F.col("_slot").isNull() | ~(F.col("value").isNull() | (F.col("value") == "") | ((F.col("kind") == "bool") & (F.col("value") == "false"))))
    reason = F.when(F.col("_slot").isNull(), "unknown").when(~F.coalesce(F.col("kind").isin(*SCALARS), F.lit(False)), "not a text").when((F.col("kind") != "bool") & (F.length("value") > LONGEST), "too long")
    return rows.select("id", F.when(reason.isNull(), F.col("kind")).alias("kind"), F.when(reason.isNull(), F.col("value")).alias("value"), reason.alias("reason"))


def pertinence(forms: DataFrame, answers: DataFrame, form: str = "form") -> DataFrame:
    """forms with `pertinence`: yes, no, or a question that blocks the form where the reader (form, pertinent) does not know, or says both."""
    told = answers.groupBy(form).agg(F.bool_and("pertinent").alias("_all"), F.bool_or("pertinent").alias("_some"), F.count_if(F.col("pertinent").isNull()).alias("_open"))
    state = F.when((F.col("_open") > 0) | F.col("_all").isNull() | (F.col("_all") != F.col("_some")), "domanda_bloccante").when(F.col("_all"), "pertinenza_ok").otherwise("rifiuto")
    return forms.join(told, form, "left").withColumn("pertinence", state).drop("_all", "_some", "_open")
