"""Conversations taken as interviews: drafts quote them, and the library looks the quotations up. Twenty conversations are a case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspan.operators import merge, quotations, validators, windows
from kinspan.plans.catalogue import _UNITS, query, table


def interviews(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as an utterance."""
    c = table(spark, d, "conversations")
    case = F.floor(F.col("conv_id") / 20).cast("string").alias("case_id")
    return c.select(case, F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("seq"), F.concat_ws("-", "conv_id", "turn").alias("id"), "role", F.translate("text", '"', "").alias("text"))


def drafts(said: DataFrame) -> DataFrame:
    """A draft for each conversation, which quotes every turn right, over two turns, with one letter wrong, and backwards."""
    nxt = F.lead("text").over(Window.partitionBy("session_id").orderBy("seq"))
    part = F.substring("text", 3, 70)
    wrong = F.concat(F.substring(part, 1, 19), F.lit("x"), F.substring(part, 21, 70))
    quotes = F.array_compact(F.array(part, F.concat(F.right("text", F.lit(25)), F.left("_next", F.lit(25))), wrong, F.reverse(part)))
    lines = said.withColumn("_next", nxt).select("case_id", "session_id", "seq", F.array_join(F.transform(quotes, lambda q: F.concat(F.lit('"'), q, F.lit('"'))), ", then ").alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "line")))
    return lines.groupBy("case_id", "session_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), ", and ").alias("text"))


def _cases(said: DataFrame) -> DataFrame:
    return said.select(F.col("case_id").alias("id")).distinct().withColumn("language", F.lit("en"))


@query()
def draft_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Findings of quotations that no transcript of their case has, by shared runs of characters."""
    said = interviews(spark, d)
    return validators.draft_quotes(drafts(said), said, _cases(said))


_SQUASH = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\p{{M}}_]', '', 'g')"
_VERBATIM = rf"""
with u as (select cast(floor(conv_id / 20.0) as bigint) case_id, conv_id, turn, replace("text", '"', '') t, replace(lead("text") over (partition by conv_id order by turn), '"', '') nx from conversations),
q as (select case_id, unnest([substr(t, 3, 70), right(t, 25) || left(nx, 25), substr(substr(t, 3, 70), 1, 19) || 'x' || substr(substr(t, 3, 70), 21, 70), reverse(substr(t, 3, 70))]) as "text" from u),
s as (select distinct case_id, {_SQUASH.format('"text"')} needle from q where "text" is not null and length("text") between 2 and 400 and {_UNITS} >= 5),
c as (select case_id, string_agg({_SQUASH.format("t")}, '' order by cast(conv_id as varchar), turn) corpus from u group by 1)
select cast(s.case_id as varchar) case_id, needle, contains(corpus, needle) verbatim from s join c using (case_id) where needle <> ''
"""


@query(_VERBATIM)
def quotes_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Each quoted passage, and whether the case's transcripts have it word for word, over as many lines as it takes."""
    said = interviews(spark, d)
    needles = validators.quoted_passages(drafts(said), _cases(said)).select("case_id", "needle").distinct()
    found = quotations.verbatim(needles, validators.transcript_lines(said)).withColumn("_there", F.lit(True))
    return needles.join(found, ["case_id", "needle"], "left").select("case_id", "needle", F.col("_there").isNotNull().alias("verbatim"))


def scene_cards(said: DataFrame) -> DataFrame:
    """A card for every four turns of a conversation, three of them shared with the next, titled by the first word."""
    w = windows.count_windows(said, ["case_id", "session_id"], ["seq"], 4, 3)
    cards = w.groupBy("case_id", "session_id", "window").agg(F.collect_set("id").alias("sources"), F.min_by(F.element_at(F.split("text", r"\s+"), 1), "seq").alias("title"), (F.sum(F.length("text")) % 5).cast("int").alias("strength"))
    return cards.withColumn("ord", F.col("session_id").cast("long") * 1_000_000 + F.col("window"))


@query()
def scene_moments(spark: SparkSession, d: str) -> DataFrame:
    """The moment that each card tells: cards of overlapping windows are the same scene where they share enough."""
    return merge.moments_by_joins(scene_cards(interviews(spark, d))).select("case_id", "ord", "title", "moment")
