"""Streaming counterparts: an addition, the batch operators are the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and minutes per window and stage, with a watermark. events: ts, stage, minutes."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "stage")
    return w.agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes")).select(F.col("window.start").alias("start"), "stage", "n", "minutes")


def pauses(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per user, closed by a pause. events: ts, user_id."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_copies(utterances: DataFrame, late: str = "1 day") -> DataFrame:
    """Utterances without ones that arrive again. utterances: ts, case_id, session_id, seq."""
    return utterances.withWatermark("ts", late).dropDuplicatesWithinWatermark(["case_id", "session_id", "seq"])
