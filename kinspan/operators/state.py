"""State as append-only logs: the current value is the last decision, and a rejected one stays visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspan.operators.validators import missing_consents


def latest(log: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. A maximum of a struct, which is combined before the shuffle."""
    rest = [c for c in log.columns if c not in by]
    last = log.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return last.select(*by, "_x.*")


def apply_answers(claims: DataFrame, answers: DataFrame) -> DataFrame:
    """Claims after the last answer (case_id, claim_id, confirmed, corrected_text, answered_by, ord) to each."""
    a = latest(answers, ["case_id", "claim_id"], ["ord"]).select("case_id", F.col("claim_id").alias("id"), "confirmed", "corrected_text", "answered_by")
    j = claims.join(a, ["case_id", "id"], "left")
    corrected = F.coalesce("corrected_text", F.lit("")) != ""
    answered = F.col("answered_by").isNotNull()
    return j.withColumns(
        {
            "status": F.when(answered & F.col("confirmed"), "confirmed_by_family").when(answered, "conflicting").otherwise(F.col("status")),
            "text": F.when(answered & corrected, F.col("corrected_text")).otherwise(F.col("text")),
            "confirmed_by": F.coalesce("answered_by", "confirmed_by"),
        }
    ).select(*claims.columns)


def reword(claims: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, refused) after edits (case_id, id, new_text): confirmed claims keep their text; old texts go to the notes."""
    e = edits.join(claims.select("case_id", "id", "status"), ["case_id", "id"], "left")
    refused = e.where(F.col("status").isNull() | (F.col("status") == "confirmed_by_family")).select(*edits.columns)
    ok = e.where("status <> 'confirmed_by_family'").select("case_id", "id", "new_text")
    j = claims.join(ok, ["case_id", "id"], "left")
    hit = F.col("new_text").isNotNull()
    note = F.concat_ws("\n", F.nullif("notes", F.lit("")), F.concat(F.lit("reworded from: "), F.col("text")))
    return j.withColumns({"notes": F.when(hit, note).otherwise(F.col("notes")), "text": F.coalesce("new_text", "text")}).select(*claims.columns), refused


def checked(rows: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a check as a filter, where null counts as a failure."""
    ok = F.coalesce(rule, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def consent_rule(assisted: Column) -> Column:
    """A consent of an assisted case names who assessed the person's capacity."""
    return F.col("scope").isNotNull() & (~assisted | (F.coalesce("capacity_assessed_by", F.lit("")) != ""))


def decade(year: Column) -> Column:
    return F.floor(year / 10).cast("int") * 10


def keep_revisions(revisions: DataFrame, by: list[str], revision: str = "revision", keep: int = 30) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(revision))
    return revisions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


# What may be sent away needs all three.
FIRST_CONSENTS = ("recording", "ai_processing", "third_party_services")


def next_step(cases: DataFrame, consents: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """(case_id, step): the first stage of a case that is not done.

    facts: case_id, waiting, sessions, unextracted, undecided, usable, unanswered, has_direction, chapters.
    """
    missing = missing_consents(consents, cases, list(FIRST_CONSENTS), now).groupBy("case_id").agg(F.collect_set("scope").alias("missing"))
    f = cases.select(F.col("id").alias("case_id")).join(facts, "case_id", "left").join(missing, "case_id", "left")
    lack = F.coalesce("missing", F.array().cast("array<string>"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    step = (
        F.when(F.array_contains(lack, "recording"), "consent")
        .when(n("waiting") > 0, "ingest")
        .when(n("sessions") == 0, "transcribe")
        .when((n("unextracted") > 0) & (F.size(lack) > 0), "consent")
        .when(n("unextracted") > 0, "extract")
        .when((n("undecided") > 0) & (n("usable") == 0), "review")
        .when(n("unanswered") > 0, "confirm")
        .when(~F.coalesce("has_direction", F.lit(False)), "direct")
        .when(n("chapters") == 0, "draft")
        .otherwise("check")
    )
    return f.select("case_id", step.alias("step"))


def review_order() -> list:
    """Order in which cards are gone through: by year, undated last, stronger ones first."""
    return [F.coalesce(F.nullif("year", F.lit(0)), F.lit(9999)), F.desc("strength"), F.col("ord")]


def append_labour(log: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log, rejected): entries with minutes and a known stage are added in their order after what is there."""
    from kinspan.schema import STAGES

    ok, bad = checked(entries, (F.col("minutes") >= 0) & F.col("stage").isin(*STAGES))
    after = log.groupBy("case_id").agg(F.max("ord").alias("_last"))
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("at"))
    ok = ok.join(after, "case_id", "left").withColumn("ord", (F.coalesce("_last", F.lit(-1)) + n).cast(log.schema["ord"].dataType))
    return log.unionByName(ok.select(*log.columns)), bad


def tag_questions(questions: DataFrame, tags: DataFrame) -> DataFrame:
    """Questions with the last outcome (case_id, id, outcome, ord) given to each."""
    t = latest(tags, ["case_id", "id"], ["ord"]).select("case_id", "id", F.col("outcome").alias("_outcome"))
    j = questions.join(t, ["case_id", "id"], "left")
    return j.withColumn("outcome", F.coalesce("_outcome", "outcome")).select(*questions.columns)


def pending_cards(cards: DataFrame) -> DataFrame:
    """Cards that nobody has decided on, in the order in which they are gone through."""
    from kinspan.schema import ACCESS, rank

    return cards.where((rank(F.col("access"), ACCESS) < 2) & (F.col("sensitivity") != "restricted")).orderBy("case_id", *review_order())


def card_listing(cards: DataFrame, weak: bool = False, restricted: bool = False) -> DataFrame:
    """Cards in review order; only those that are no scenes, or only restricted ones, if asked for."""
    from kinspan.operators.visibility import is_scene

    c = cards.where(~F.coalesce(is_scene(), F.lit(False))) if weak else cards
    return (c.where("sensitivity = 'restricted'") if restricted else c).orderBy("case_id", *review_order())
