"""Yield and labour reports across cases, and counts over sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspan.functions.text import strip, units
from kinspan.schema import TARGET_HOURS


def labour_by_stage(labour: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, stage, minutes, first): stages by minutes, ties in the order in which they first came."""
    return labour.groupBy(case, "stage").agg(F.sum("minutes").alias("minutes"), F.min("ord").alias("first"))


def hours(minutes: Column) -> Column:
    """Hours to one decimal, for display."""
    return F.bround(minutes / 60, 1)


def labour_summary(labour: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, total_minutes, target_hours, dominant_stage, dominant_minutes, over_target) for every case."""
    stages = labour_by_stage(labour)
    per = stages.groupBy("case_id").agg(F.sum("minutes").alias("total_minutes"), F.max_by("stage", F.struct("minutes", -F.col("first"))).alias("dominant_stage"), F.max("minutes").alias("dominant_minutes"))
    target = F.create_map(*[F.lit(x) for pair in TARGET_HOURS.items() for x in pair])
    c = cases.select(F.col("id").alias("case_id"), F.element_at(target, F.col("package")).alias("target_hours")).join(per, "case_id", "left")
    total = F.coalesce("total_minutes", F.lit(0))
    return c.select("case_id", total.alias("total_minutes"), "target_hours", "dominant_stage", "dominant_minutes", (hours(total) > F.col("target_hours")).alias("over_target"))


def verdict(total: Column, stage: Column, minutes: Column) -> Column:
    share = F.coalesce(F.try_divide(minutes, total), F.lit(0.0))
    line = F.format_string("%.1fh total; '%s' dominates at %.1fh (%.0f%%).", hours(total).cast("double"), stage, hours(minutes).cast("double"), share * 100)
    return F.when(stage.isNull(), "No labour recorded. This case cannot inform the Phase 1 decision.").otherwise(line)


def portfolio_labour(labour: DataFrame, case: str = "case_id") -> DataFrame:
    """(stage, minutes, share, cases): stages over all cases, with their share of all minutes."""
    by = labour.groupBy("stage").agg(F.sum("minutes").alias("minutes"), F.countDistinct(case).alias("cases"))
    return by.withColumn("share", F.coalesce(F.try_divide("minutes", F.sum("minutes").over(Window.partitionBy())), F.lit(0.0)))


def portfolio_totals(labour: DataFrame, target_hours: int | None = None) -> DataFrame:
    """(cases, minutes, hours, mean_hours, over_target) of all cases with labour: one row, also for none.

    A case is over its package's target, or over target_hours if given. hours() rounds them for display.
    """
    target = F.lit(target_hours) if target_hours is not None else F.element_at(F.create_map(*[F.lit(x) for pair in TARGET_HOURS.items() for x in pair]), F.col("package"))
    per = labour.groupBy("case_id").agg(F.sum("minutes").alias("m"), F.max(target).alias("target"))
    total = F.coalesce(F.sum("m"), F.lit(0))
    return per.agg(F.count("*").alias("cases"), total.alias("minutes"), (total / 60).alias("hours"), F.coalesce(F.try_divide(total / 60, F.count("*")), F.lit(0.0)).alias("mean_hours"), F.count_if(F.col("m") > F.col("target") * 60).alias("over_target"))


def question_yield(questions: DataFrame, order: tuple = ("case_id", "ord")) -> DataFrame:
    """Questions by text across cases: text and topic as first seen, times asked, and what came of them."""
    first = F.struct(*order)
    of = lambda outcome: F.count_if(F.col("outcome") == outcome)
    out = questions.groupBy(F.lower(strip(F.col("text"))).alias("key")).agg(
        F.min_by(strip(F.col("text")), first).alias("text"), F.min_by("topic", first).alias("topic"), F.count("*").alias("asked"),
        of("scene").alias("scenes"), of("detail").alias("details"), of("declined").alias("declined"), of("no_memory").alias("no_memory"), F.min(first).alias("first"),
    )
    return out.withColumns({"scene_rate": rate(F.col("scenes"), F.col("asked")), "any_yield_rate": rate(F.col("scenes") + F.col("details"), F.col("asked"))}).drop("key")


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def refresh_bank(bank: DataFrame, questions: DataFrame) -> DataFrame:
    """The question bank with times asked and scenes counted anew; 0 for questions never asked."""
    n = questions.where(F.coalesce("bank_id", F.lit("")) != "").groupBy("bank_id").agg(F.count("*").alias("asked"), F.count_if(F.col("outcome") == "scene").alias("scenes"))
    old = bank.drop("asked", "scenes")
    return old.join(n, old["id"] == n["bank_id"], "left").select(*[old[c] for c in old.columns], F.coalesce("asked", F.lit(0)).alias("asked"), F.coalesce("scenes", F.lit(0)).alias("scenes"))


def seed_rate(scenes: Column, asked: Column) -> Column:
    return F.try_divide(scenes, asked)


def untagged(questions: DataFrame) -> DataFrame:
    return questions.where("outcome = 'untagged'")


def ingest_report(utterances: DataFrame, by: list[str], long_at: int = 120) -> DataFrame:
    """Turns, turns by role, owner's units, longest turn, whether any time is known, and whether all fell into one turn."""
    u = utterances.withColumn("_units", units(F.col("text")))
    roles = ("owner", "interviewer", "family", "unknown")
    return u.groupBy(*by).agg(
        F.count("*").alias("turns"), *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in roles],
        F.coalesce(F.sum(F.when(F.col("role") == "owner", F.col("_units"))), F.lit(0)).alias("owner_units"), F.max("_units").alias("longest"),
        F.bool_or(F.coalesce(F.col("t_start"), F.lit("")) != "").alias("has_times"), ((F.count("*") <= 2) & (F.max("_units") > long_at)).alias("suspect_collapse"),
    )


def speaker_counts(turns: DataFrame, by: list[str]) -> DataFrame:
    return turns.groupBy(*by, "speaker").agg(F.count("*").alias("turns"))


def fingerprint(rows: DataFrame, by: list[str], seq: str, parts: Column) -> DataFrame:
    """SHA-256 over a group's lines in order. A group is one session, which bounds the list."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("n"), parts.alias("s")))), lambda x: x["s"])
    return rows.groupBy(*by).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"), F.count("*").alias("n"))


def already_there(new: DataFrame, known: DataFrame) -> DataFrame:
    """New groups with the fingerprint of a known one."""
    return new.join(known.select("fingerprint", F.col("session_id").alias("known_session_id")), "fingerprint")


def pages(chapters: DataFrame, page: int) -> DataFrame:
    return chapters.groupBy("case_id").agg((F.bround(F.sum(units(F.col("prose"))) / page + 1.5 * F.count("*")) + 6).cast("int").alias("pages"))


def name_recall(gold: DataFrame, heard: DataFrame) -> DataFrame:
    """Which names of a gold list occur in what was heard, by recording."""
    return gold.join(heard, "recording_id", "left").select("recording_id", "name", F.coalesce(F.contains("text", F.col("name")), F.lit(False)).alias("hit"))


def severity_summary(findings: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy("case_id").agg(n("block").alias("blocking"), n("warn").alias("warnings"), n("info").alias("notes"), (n("block") == 0).alias("ok"))
