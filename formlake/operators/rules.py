"""Rules on proposed values, as column expressions and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.functions.formats import format_problem
from formlake.functions.text import ascii_words, long_words, named, overlap, unmarked
from formlake.operators.sequences import first_formula, near_pairs, rolling_text

#: Words that join data without being data.
GLUE = tuple("a al alla allo ai agli alle il lo la i gli le di del dello della dei degli delle da dal dalla e ed in nel nella con presso per n nr num numero via viale piazza piazzale corso vicolo largo localita loc c f cf cod codice fiscale p iva piva partita nato nata nati residente residenti sede legale operativa prov provincia cap tel telefono cell cellulare fax email mail pec iban banca filiale agenzia conto corrente snc civico frazione fraz comune qualita quale sig sigra dott ing geom arch rag gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split())
#: Fixed value: sections that this kind of applicant never fills in.
EXCLUDED_SECTION = r"transfrontalier|non stabilit\w* in italia"


#: What shows that a field is about somebody else, and who; the first that is found is reported.
SUBJECT_FORMULAS = [
    (r"cessat[oi] dalla carica", "soggetto cessato dalla carica"),
    (r"impresa ausiliaria|avvalimento|ausiliari[ae]\b", "impresa ausiliaria"),
    (r"subappaltator|subappalt", "subappaltatore"),
    (r"mandante|mandatari[ao]|raggruppament|\br\.?t\.?i\.?\b|consorziat", "altro membro del raggruppamento"),
    (r"incorporazione|a seguito di fusione|acquisizione, totale", "impresa incorporata o acquisita"),
    (r"nuovo titolare|precedente titolare|subentrante", "altra parte della voltura"),
    (r"responsabile dell.impianto|terzo responsabile", "responsabile dell'impianto"),
    (r"coniuge|convivente|\berede\b|familiar", "familiare"),
    (r"direttore tecnico", "direttore tecnico"),
    (r"progettista|direttore dei lavori|collaudator", "progettista o direzione lavori"),
    (r"proprietari[oa] dell|committente|amministratore di condominio", "proprietario o committente"),
    (r"impresa esecutrice|impresa affidataria", "impresa esecutrice"),
]
#: Sections that hold only under a condition of the tender.
CONDITIONS = {
    "raggruppamento": r"raggruppament|\br\.?t\.?i\.?\b|consorz|mandant|mandatari|rete di imprese|aggregazion|\bg\.?e\.?i\.?e\.?\b|cooptat",
    "avvalimento": r"avvaliment|ausiliari",
    "subappalto": r"subappalt",
}


def subject_alerts(lines: DataFrame, parts: list[str], order: str, text: str, above: int = 6) -> DataFrame:
    """lines with `reason`: whom a field on the line or in the lines above it speaks of, by SUBJECT_FORMULAS; null if nobody else."""
    rows = rolling_text(lines, parts, order, text, above)
    return rows.withColumn("reason", first_formula(F.col("window"), SUBJECT_FORMULAS)).drop("window")


def skipped_sections(lines: DataFrame, parts: list[str], order: str, text: str, active: list[str] | None, above: int = 6) -> DataFrame:
    """lines with `skipped`: whether they stand under a condition that is not active. No answer (None) skips nothing; none active ([]) skips all conditional ones."""
    off = [] if active is None else [p for k, p in CONDITIONS.items() if k not in active]
    rows = rolling_text(lines, parts, order, text, above)
    return rows.withColumn("skipped", F.lower("window").rlike("|".join(off)) if off else F.lit(False)).drop("window")


def provenance_problem(value: Column, sources: Column) -> Column:
    """The first word of a value that comes from no source (array of texts); null if all do."""
    known = F.flatten(F.transform(sources, ascii_words))
    # As an element of an array the sources' words are found once for a value, not for each of its words.
    once = F.array(F.struct(F.array_distinct(known).alias("known"), F.array_join(known, "").alias("packed"), F.array_distinct(ascii_words(value)).alias("words")))
    strange = F.transform(once, lambda s: F.get(F.filter(s["words"], lambda w: ~F.array_contains(s["known"], w) & ~w.isin(*GLUE) & ~((F.length(w) >= 3) & F.contains(s["packed"], w))), F.lit(0)))
    return F.when(F.size(F.filter(sources, lambda s: F.trim(F.coalesce(s, F.lit(""))) != "")) < F.greatest(F.size(sources), F.lit(1)), F.lit("no source")).otherwise(F.get(strange, F.lit(0)))


def excluded_section(line: Column) -> Column:
    return unmarked(line).rlike(EXCLUDED_SECTION)


def gate(proposals: DataFrame) -> DataFrame:
    """The first reason that stops a proposal (slot, kind, line, before, value, sources); null kind: unknown slot."""
    value = F.trim(F.coalesce("value", F.lit("")))
    reason = (
        F.when(F.col("kind").isNull(), "unknown slot")
        .when(F.col("kind") == "casella", "checkbox")
        .when(value == "", "blank")
        .when(excluded_section(F.col("line")), "excluded section")
        .when(provenance_problem(value, F.col("sources")).isNotNull(), "provenance")
        .otherwise(format_problem(F.col("before"), value))
    )
    return proposals.withColumn("reason", reason)


def evidence_verdict(notes: DataFrame) -> DataFrame:
    """veto or warning of review notes (result, kind, evidence, page_text, label): a veto needs an error of an allowed kind and evidence in the page, for meaning in the slot's own label too."""
    meant = (F.col("kind") != "significato") | ((F.trim(F.coalesce("label", F.lit(""))) != "") & F.contains(F.lower("label"), F.lower("evidence")))
    veto = (F.col("result") == "errore") & F.col("kind").isin("soggetto", "significato", "fonte") & (F.length(F.trim("evidence")) >= 2) & F.contains(F.col("page_text"), F.col("evidence")) & meant
    return notes.withColumn("verdict", F.when(F.coalesce(veto, F.lit(False)), "veto").otherwise("warning"))


def contract_states(slots: DataFrame, answers: DataFrame, keys: DataFrame, key: str = "slot") -> DataFrame:
    """Every slot's state after the reader's contract: one valid answer, else dubbio; an assigned slot needs a known key, a subject and a reason; contradicting answers drop each other."""
    states = ("assegna", "dato_assente", "dubbio", "manuale", "non_campo")
    one = answers.groupBy(key).agg(F.countDistinct(F.coalesce("field", F.lit(""))).alias("fields"), F.count("*").alias("n"), F.min("state").alias("state"), F.min("field").alias("field"), F.min("subject").alias("subject"), F.min("reason").alias("reason"))
    known = one.join(keys.select(F.col("key").alias("field")).distinct().withColumn("_known", F.lit(True)), "field", "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    bad = (F.col("fields") > 1) | (F.col("n") > 1) | ~F.coalesce(F.col("state").isin(*states), F.lit(False)) | ((F.col("state") == "assegna") & (F.col("_known").isNull() | blank("subject") | blank("reason")))
    out = slots.join(known, key, "left")
    return out.select(key, F.when(F.col("n").isNull() | bad, "dubbio").otherwise(F.col("state")).alias("state"), F.when(F.col("n").isNull(), "missing").when(F.col("fields") > 1, "conflict").when(bad, "invalid").otherwise("ok").alias("check"))


def contradictions(lines: DataFrame, parts: list[str], order: str, text: str, declares: str | None = None, distance: int = 4, least_words: int = 8, least_overlap: float = 0.6) -> DataFrame:
    """Pairs of near lines that say nearly the same of the same parties: declarations of which one holds."""
    if declares:
        lines = lines.filter(F.lower(text).rlike(declares))
    rows = lines.select(*parts, order, long_words(F.col(text)).alias("words"), named(F.col(text)).alias("names")).filter(F.size("words") >= least_words)
    pairs = near_pairs(rows, parts, order, distance)
    share = overlap(F.col("a.words"), F.col("b.words"))
    same = (F.size(F.array_except("a.names", "b.names")) == 0) & (F.size(F.array_except("b.names", "a.names")) == 0)
    return pairs.filter((share >= least_overlap) & same).select(*[F.col(f"a.{p}").alias(p) for p in parts], F.col(f"a.{order}").alias("first"), F.col(f"b.{order}").alias("second"), share.alias("share"))


def confirmations(decisions: DataFrame) -> DataFrame:
    """Why an assigned decision needs a confirmation: a review's warning, a subject alert, a checkbox, a source of the active case, in this order."""
    reason = F.when(F.col("warning").isNotNull(), "warning").when(F.col("alert").isNotNull(), "subject").when(F.col("is_choice"), "choice").when(F.col("of_case"), "case")
    asks = (F.col("state") == "assegna") & (F.coalesce("origin", F.lit("")) != "utente") & reason.isNotNull()
    return decisions.withColumns({"state": F.when(asks, "da_confermare").otherwise(F.col("state")), "confirm_reason": F.when(asks, reason)})


def repeated_values(writes: DataFrame, paragraph: list[str], value: str) -> DataFrame:
    """Values written more than once in a paragraph."""
    return writes.groupBy(*paragraph, value).agg(F.count("*").alias("n")).filter("n > 1")


def repeated_columns(fields: DataFrame) -> DataFrame:
    """Fields (page, key, x0, x1, y0) of a table column that repeats on several rows: none of them is filled. Places round half to even."""
    rounded = fields.withColumns({"_x0": F.bround("x0", 0), "_x1": F.bround("x1", 0), "_y0": F.bround("y0", 0)})
    many = rounded.groupBy("page", "key", "_x0", "_x1").agg(F.countDistinct("_y0").alias("rows"), F.count("*").alias("members")).filter("rows >= 2")
    return rounded.join(many, ["page", "key", "_x0", "_x1"]).select("id", "page", "key", F.col("members").alias("rows"))
