"""What is shown of cases: status, sessions, and one record with what it refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspan.operators import reports, visibility
from kinspan.schema import ACCESS, CLAIM_KINDS, rank

COUNTED = ("sessions", "utterances", "people", "places", "claims", "quotes")


def status(a: dict[str, DataFrame]) -> DataFrame:
    """A row per case: records of each kind there is, cards that are scenes, released or restricted, and labour against target.

    Counts are combined before the shuffle and joined by case; a case without records has zeros.
    """
    out, numbers = a["cases"].select(F.col("id").alias("case_id")), []
    for name in COUNTED:
        if name in a:
            out = out.join(a[name].groupBy("case_id").agg(F.count("*").alias(name)), "case_id", "left")
            numbers.append(name)
    released = (rank(F.col("access"), ACCESS) >= 2) & (F.col("sensitivity") != "restricted")
    cards = a["story_cards"].groupBy("case_id").agg(
        F.count("*").alias("cards"), F.count_if(visibility.is_scene()).alias("scenes"), F.count_if(released).alias("released"), F.count_if(F.col("sensitivity") == "restricted").alias("restricted")
    )
    out = out.join(cards, "case_id", "left").select("case_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*numbers, "cards", "scenes", "released", "restricted")])
    if "labour" in a:
        out = out.join(reports.labour_summary(a["labour"], a["cases"]).select("case_id", "total_minutes", "target_hours", "over_target"), "case_id")
    return out


def sessions(a: dict[str, DataFrame]) -> DataFrame:
    """Sessions by number, with their utterances and how many of them the owner spoke."""
    n = a["utterances"].groupBy("case_id", F.col("session_id").alias("id")).agg(F.count("*").alias("utterances"), F.count_if(F.col("role") == "owner").alias("by_owner"))
    s = a["sessions"].join(n, ["case_id", "id"], "left")
    return s.select("case_id", "number", "id", "held_on", "mode", F.coalesce("utterances", F.lit(0)).alias("utterances"), F.coalesce("by_owner", F.lit(0)).alias("by_owner")).orderBy("case_id", "number")


def card(a: dict[str, DataFrame], case_id: str, card_id: str) -> DataFrame:
    """One card with the names of its people and places, its quotes and claims, and the words it rests on, each in order."""
    one = a["story_cards"].where((F.col("case_id") == case_id) & (F.col("id") == card_id))
    for ids, table, text, out in (("person_ids", "people", "name", "people"), ("place_ids", "places", "name", "places"), ("quote_ids", "quotes", "text", "quotes"), ("claim_ids", "claims", "text", "claims")):
        found = visibility.names_in_order(one, ids, a[table].select("case_id", "id", F.col(text).alias("name")), out)
        one = one.join(found, ["case_id", "id"], "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))
    words = visibility.cited(visibility.citations(one), a["utterances"]).where("not missing")
    words = words.groupBy("case_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("words"))
    one = one.join(words, ["case_id", "id"], "left")
    return one.select("case_id", "id", "title", "year", "access", "sensitivity", "people", "places", "quotes", "claims", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def claims(a: dict[str, DataFrame], status_: str | None = None) -> DataFrame:
    """Claims, of one status if given, by kind in its fixed order, most important first."""
    c = a["claims"] if status_ is None else a["claims"].where(F.col("status") == status_)
    return c.orderBy("case_id", rank(F.col("kind"), CLAIM_KINDS), F.desc("importance"), "ord").select("case_id", "id", "kind", "status", "importance", "text")
