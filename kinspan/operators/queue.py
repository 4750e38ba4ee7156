"""The confirmation queue: open claims that the family may see, ranked by what an error would cost in print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspan.functions.text import strip, wording_problem
from kinspan.operators.visibility import citations, cited, utterance_ok, visible_to
from kinspan.schema import CONFIRMABLE, OPEN_STATUS

MOST = 25
CONTEXT = 180
QUESTIONS = {
    "name": "Have we spelled this name correctly?",
    "date": "Is this date right, or near enough?",
    "relationship": "Have we got this relationship right?",
    "place": "Is this the right place name?",
    "photo_subject": "Is this the right person in the photograph?",
}


def score(importance: Column, status: Column, kind: Column, uses: Column) -> Column:
    return (
        importance.cast("double")
        + F.when(status == "conflicting", 3.0).when(status == "unresolved", 1.5).otherwise(0.0)
        + F.least(F.coalesce(uses, F.lit(0)), F.lit(3)) * 0.5
        + F.when(kind.isin("name", "relationship"), 1.0).otherwise(0.0)
    )


def top(candidates: DataFrame, order: list, most: int = MOST, by: tuple = ("case_id",)) -> DataFrame:
    """The first `most` rows of each group, with their place and how many are left for later."""
    w = Window.partitionBy(*by)
    n = min(most, MOST)
    ranked = candidates.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("deferred", F.greatest(F.count("*").over(w) - n, F.lit(0)))
    return ranked.where(F.col("place") <= n)


def chosen(claims: DataFrame, cards: DataFrame, utterances: DataFrame, audience: str = "family", most: int = MOST) -> DataFrame:
    """The claims that the queue has, with place and deferred."""
    open_ = visible_to(claims.where(F.col("kind").isin(*CONFIRMABLE) & F.col("status").isin(*OPEN_STATUS)), utterances, audience)
    uses = cards.select("case_id", F.col("id").alias("card_id"), F.explode(F.array_distinct("claim_ids")).alias("id")).groupBy("case_id", "id").agg(F.count("*").alias("uses"))
    ranked = open_.join(uses, ["case_id", "id"], "left").withColumn("score", score(F.col("importance"), F.col("status"), F.col("kind"), F.col("uses")))
    return top(ranked, [F.desc("score"), F.col("ord")], most)


def build(claims: DataFrame, cards: DataFrame, utterances: DataFrame, audience: str = "family", most: int = MOST) -> DataFrame:
    """case_id, place, claim_id, kind, question, current_value, context, importance, conflicting, deferred."""
    items = chosen(claims, cards, utterances, audience, most)
    # claims chosen are few: contexts and conflicts are fetched for them alone
    seen = cited(citations(items), utterances).where(utterance_ok(audience))
    text = strip(F.col("text"))
    context = seen.groupBy("case_id", "id").agg(F.min_by(F.when(F.length(text) <= CONTEXT, text).otherwise(F.concat(F.left(text, F.lit(CONTEXT - 3)), F.lit("..."))), F.col("pos")).alias("context"))
    other = items.select("case_id", "id", F.posexplode("conflicting_with").alias("pos", "_ref")).join(claims.select("case_id", F.col("id").alias("_ref"), F.col("text").alias("_text")), ["case_id", "_ref"])
    other = other.groupBy("case_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_text"))), lambda s: s["_text"]).alias("conflicting"))
    table = F.create_map(*[F.lit(x) for pair in QUESTIONS.items() for x in pair])
    out = items.join(context, ["case_id", "id"], "left").join(other, ["case_id", "id"], "left")
    return out.select(
        "case_id", "place", F.col("id").alias("claim_id"), "kind",
        F.coalesce(F.try_element_at(table, F.col("kind")), F.lit("Is this right?")).alias("question"),
        F.col("text").alias("current_value"), "context", "importance",
        F.coalesce("conflicting", F.array().cast("array<string>")).alias("conflicting"), "deferred",
    )


def minutes(n: int) -> int:
    """Time that a sheet of n items takes."""
    return max(1, round(n * 0.6))


def wording(queue: DataFrame, cases: DataFrame) -> DataFrame:
    """Findings for items whose text doesn't name the owner. Not part of the full check."""
    problem = wording_problem(F.col("current_value"), F.startswith(F.coalesce("language", F.lit("en")), F.lit("zh")))
    q = queue.join(cases.select(F.col("id").alias("case_id"), "language"), "case_id").withColumn("problem", problem).where("problem is not null")
    return q.select("case_id", F.lit("wording").alias("check"), F.lit("warn").alias("severity"), F.concat(F.lit("the family will read this as written: it "), F.col("problem")).alias("message"), F.col("claim_id").alias("ref_id"), F.left("current_value", F.lit(70)).alias("detail"))


def render(queue: DataFrame) -> DataFrame:
    """(case_id, text): items grouped by kind, kinds in the order in which they first come."""
    w = Window.partitionBy("case_id", "kind")
    q = queue.withColumn("first", F.min("place").over(w))
    line = F.concat_ws("\n", F.concat(F.lit("- "), F.col("current_value")), F.concat(F.lit("  > "), F.col("context")))
    lines = F.array_sort(F.collect_list(F.struct("first", "place", F.when(F.col("first") == F.col("place"), F.concat(F.lit("## "), F.col("question"), F.lit("\n"), line)).otherwise(line).alias("line"))))
    return q.groupBy("case_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
