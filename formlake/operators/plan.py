"""Plans: decisions for places, answers to questions, repair, memory and the trace of each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlake.operators.projections import valued


def confirm_policy(decisions: DataFrame, policy: str = "scrivi") -> DataFrame:
    """By default what waits for a confirmation is written and marked for checking; with `chiedi` it stays open. Users' own decisions do not change."""
    write = (F.coalesce("origin", F.lit("")) != "utente") & (F.col("state") == "da_confermare") & F.lit(policy == "scrivi")
    return decisions.withColumns({"state": F.when(write, "assegna").otherwise(F.col("state")), "to_check": write})


def executed(decisions: DataFrame, facts: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """id, value, status of every decision: written where it is assigned and its source has a value."""
    rows = decisions if removed is None else decisions.join(removed.select("id"), "id", "left_anti")
    found = rows.join(facts, "key", "left")
    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    status = F.when(F.col("state") != "assegna", "open").when(blank, "unusable").otherwise("written")
    return found.select("id", "state", F.when(status == "written", F.col("value")).alias("value"), status.alias("status"))


def executed_typed(decisions: DataFrame, facts: DataFrame, slots: DataFrame, current: DataFrame, removed: DataFrame) -> DataFrame:
    """id, status, kind, value, reason of a plan's decisions: nothing of a plan made for another document (form, fingerprint against `current`), no removed or unknown place (slots: id, anchor_kind, widget), values by `valued`, checked against what the place takes."""
    rows = decisions.join(removed.select("id"), "id", "left_anti").join(current.select("form", F.col("fingerprint").alias("_now")), "form", "left")
    same = F.col("fingerprint").eqNullSafe(F.col("_now"))
    rows = rows.withColumn("_same", same).drop("_now", "fingerprint").join(slots.withColumn("_slot", F.lit(True)), "id", "left")
    found = valued(rows.withColumn("anchor_kind", F.coalesce("anchor_kind", F.lit("area"))), facts)
    stop = F.when(~F.col("_same"), "another document").when(F.col("_slot").isNull(), "unknown slot").when(F.col("state") != "assegna", "open").otherwise(F.col("reason"))
    kept = stop.isNull()
    status = F.when(kept, "written").when(stop == "open", "open").otherwise("unusable")
    return found.select("id", status.alias("status"), F.when(kept, F.col("kind")).alias("kind"), F.when(kept, F.col("value")).alias("value"), F.when(~kept & (stop != "open"), stop).alias("reason"))


def answered(decisions: DataFrame, answers: DataFrame) -> DataFrame:
    """Decisions after the users' last answers: confirm, source, yes, no, text, not_applicable, manual. An answer that does not fit changes nothing."""
    # Of answers at one time the greatest holds, so the outcome is the same on every run.
    last = answers.groupBy("id").agg(F.max(F.struct("at", "action", "key", "text")).alias("x")).select("id", "x.action", F.col("x.key").alias("new_key"), F.col("x.text").alias("new_text"))
    rows = decisions.join(last, "id", "left")
    act = F.coalesce("action", F.lit(""))
    fits = F.when(act == "conferma", (F.col("state") == "da_confermare") & ~F.col("failed")).when(act == "fonte", F.col("new_key").isNotNull()).when(act.isin("si", "no"), F.col("is_choice")).when(act == "testo", ~F.col("is_choice") & (F.trim(F.coalesce("new_text", F.lit(""))) != "")).when(act.isin("non_applicabile", "manuale"), F.lit(True)).otherwise(F.lit(False))
    state = F.when(fits & act.isin("conferma", "fonte", "si", "no", "testo"), "assegna").when(fits & (act == "non_applicabile"), "non_campo").when(fits & (act == "manuale"), "manuale").otherwise(F.col("state"))
    key = F.when(fits & (act == "fonte"), F.col("new_key")).when(fits & ~act.isin("conferma"), F.lit("")).otherwise(F.col("key"))
    return rows.select("id", state.alias("state"), key.alias("key"), F.when(fits, "utente").otherwise(F.col("origin")).alias("origin"))


def questions(decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """What is still to be asked, with the proposal and whether it can be confirmed."""
    settled = (F.col("state").isin("assegna", "non_campo")) | ((F.coalesce("origin", F.lit("")) == "utente") & (F.col("state") == "manuale") & ~F.col("failed"))
    rows = decisions.filter(~settled).join(facts, "key", "left")
    return rows.select("id", "state", F.col("value").alias("proposal"), (F.col("value").isNotNull() & ~F.col("failed")).alias("confirmable"))


def repair_round(failed: DataFrame, pages: int = 3, tried: DataFrame | None = None) -> DataFrame:
    """Failed places that are not the user's own, on the first `pages` pages that have any. tried: form of the forms that had their one round."""
    rows = failed.filter(F.coalesce("origin", F.lit("")) != "utente")
    if tried is not None:
        rows = rows.join(tried.select("form").distinct(), "form", "left_anti")
    return rows.withColumn("_p", F.dense_rank().over(Window.partitionBy("form").orderBy("page"))).filter(F.col("_p") <= pages).drop("_p")


def remembered(events: DataFrame) -> DataFrame:
    """What a form's memory holds for each place: the last action; of actions at one time, removal beats confirmation."""
    others = [c for c in events.columns if c not in ("fingerprint", "id", "at", "action")]
    last = F.max(F.struct(F.col("at"), (F.col("action") == "tolto").alias("removed"), F.col("action"), *others)).alias("x")
    return events.groupBy("fingerprint", "id").agg(last).select("fingerprint", "id", "x.action", *[f"x.{c}" for c in others])


def outcome(written: Column, check: Column, by_user: Column, state: Column, vetoed: Column) -> Column:
    """What became of a field, the later stage first. written: null where nothing was tried."""
    return (
        F.when(written.isNotNull() & ~written, "scrittura_fallita")
        .when(written & (check == "verificata"), "scritto_verificato")
        .when(written, "verifica_fallita")
        .when(by_user & (F.coalesce(state, F.lit("")) != "assegna"), "escluso_utente")
        .when(~by_user & vetoed, "escluso_rilettura")
        .when(state == "da_confermare", "attende_risposta")
        .when(state == "assegna", "dato_non_utilizzabile")
        .otherwise(F.coalesce(state, F.lit("non_documentato")))
    )


def trace(anchors: DataFrame, decisions: DataFrame, writes: DataFrame, checks: DataFrame, vetoes: DataFrame, key: str = "id") -> DataFrame:
    """One row for each anchor, with what each stage made of it."""
    rows = anchors.select(key).join(decisions.select(key, "state", "origin"), key, "left").join(writes.select(key, "written"), key, "left").join(checks.select(key, "result"), key, "left").join(vetoes.select(key).distinct().withColumn("vetoed", F.lit(True)), key, "left")
    user = F.coalesce(F.col("origin") == "utente", F.lit(False))
    return rows.select(key, outcome(F.col("written"), F.coalesce("result", F.lit("")), user, F.col("state"), F.coalesce("vetoed", F.lit(False))).alias("outcome"))


def overflow(writes: DataFrame, room: str = "room") -> DataFrame:
    """Values too long for their place go to a numbered appendix; the place gets the reference. Nothing is cut."""
    long = F.length("value") > F.col(room)
    w = Window.partitionBy("form", long).orderBy("id")
    number = F.row_number().over(w)
    return writes.select("form", "id", F.when(long, F.concat(F.lit("v. all. "), number.cast("string"))).otherwise(F.col("value")).alias("shown"), F.when(long, F.col("value")).alias("appendix"))


def word_verdict(checks: DataFrame) -> DataFrame:
    """non_compilato without a verified place, da_verificare with an open question or failure, else compilato."""
    return checks.groupBy("form").agg(F.sum(F.col("verified").cast("int")).alias("v"), F.max(F.col("doubtful").cast("int")).alias("d")).select("form", F.when(F.col("v") == 0, "non_compilato").when(F.col("d") == 1, "da_verificare").otherwise("compilato").alias("verdict"))
