"""What a book is made from: briefs of cards, quotes, and the prompts for direction and chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspan.functions.text import reader_constant
from kinspan.operators.state import review_order
from kinspan.operators.visibility import names_in_order, usable_cards
from kinspan.schema import filled, year


def briefs(cards: DataFrame, people: DataFrame, places: DataFrame) -> DataFrame:
    """Cards with a text that tells a writer all there is in them; ids that stand for nothing are left out."""
    c = cards.join(names_in_order(cards, "person_ids", people, "_people"), ["case_id", "id"], "left").join(names_in_order(cards, "place_ids", places, "_places"), ["case_id", "id"], "left")
    part = lambda label, value: F.when(filled(value), F.concat(F.lit(f"  {label}: "), value))
    when = F.when(year(F.col("year")).isNotNull(), F.concat(F.lit(" ("), F.concat_ws("-", F.col("year").cast("string"), year(F.col("year_end")).cast("string")), F.when(F.col("approximate"), ", approximate)").otherwise(")"))).otherwise("")
    head = F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("title"), when, F.format_string(" -- strength %d/5", F.coalesce("strength", F.lit(0))))
    beats = [part(b, F.col(b)) for b in ("conflict", "choice", "consequence", "reflection")]
    text = F.concat_ws("\n", head, part("period", F.col("period")), F.concat(F.lit("  setup: "), F.coalesce("setup", F.lit(""))), *beats, part("people", F.array_join("_people", ", ")), part("places", F.array_join("_places", ", ")), F.when(F.col("sensitivity") != "routine", F.concat(F.lit("  sensitivity: "), F.col("sensitivity"))))
    return c.withColumn("brief", text).drop("_people", "_places")


def quotes_for(quotes: DataFrame, cards: DataFrame) -> DataFrame:
    """Quotes that any of the cards uses, in the order of the archive."""
    used = cards.select("case_id", F.explode("quote_ids").alias("id")).distinct()
    return quotes.join(used, ["case_id", "id"], "left_semi").orderBy("case_id", "ord")


def owner() -> Column:
    return F.when(filled(F.col("owner_preferred_name")), F.col("owner_preferred_name")).otherwise(F.col("owner_name"))


def direction_prompts(cases: DataFrame, briefed: DataFrame) -> DataFrame:
    """(case_id, prompt): all cards that may be used, by year, undated last. Cases without such a card have no row."""
    c = usable_cards(briefed).withColumn("_at", F.struct(F.coalesce(year(F.col("year")), F.lit(9999)), -F.col("strength"), "ord"))
    texts = c.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "brief"))), lambda x: x["brief"]), "\n\n").alias("briefs"), F.count("*").alias("n"))
    who = cases.select(F.col("id").alias("case_id"), owner().alias("owner"))
    return texts.join(who, "case_id").select("case_id", F.format_string("A memoir of %s is to be made from %d story cards:\n\n%s\n\nPropose its theme, its voice and its chapters.", "owner", "n", "briefs").alias("prompt"))


def chapter_prompts(cases: DataFrame, chapters: DataFrame, briefed: DataFrame, quotes: DataFrame) -> DataFrame:
    """(case_id, number, prompt, provenance) for each planned chapter (case_id, number, title, covers, story_card_ids).

    Only cards that may be used count, in the order of the plan; a chapter without one has no row. Provenance is what the
    archive says, whatever a model may answer.
    """
    each = chapters.select("case_id", "number", "title", "covers", F.posexplode("story_card_ids").alias("pos", "card_id"))
    cards = usable_cards(briefed).select("case_id", F.col("id").alias("card_id"), "brief", "quote_ids")
    each = each.join(cards, ["case_id", "card_id"])
    rows = F.array_sort(F.collect_list(F.struct("pos", "card_id", "brief")))
    text = each.groupBy("case_id", "number", "title", "covers").agg(F.array_join(F.transform(rows, lambda x: x["brief"]), "\n\n").alias("briefs"), F.transform(rows, lambda x: x["card_id"]).alias("provenance"))
    said = each.select("case_id", "number", F.explode("quote_ids").alias("id")).distinct().join(quotes.select("case_id", "id", "ord", "text"), ["case_id", "id"])
    line = F.concat(F.lit("- ["), F.col("id"), F.lit("] “"), F.col("text"), F.lit("”"))
    said = said.groupBy("case_id", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("quotes"))
    who = cases.select(F.col("id").alias("case_id"), owner().alias("owner"), reader_constant(F.col("language"), "chapter").alias("target"))
    j = text.join(said, ["case_id", "number"], "left").join(who, "case_id")
    prompt = F.format_string("Chapter %d of a memoir of %s: %s\nIt covers: %s\nAbout %d units long.\n\nThe only facts:\n%s\n\nQuotes, word for word:\n%s", "number", "owner", "title", F.coalesce("covers", F.lit("")), "target", "briefs", F.coalesce("quotes", F.lit("none")))
    return j.select("case_id", "number", prompt.alias("prompt"), "provenance")


def ordered(cards: DataFrame) -> DataFrame:
    return usable_cards(cards).orderBy("case_id", *review_order())
