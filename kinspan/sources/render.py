"""Text of the documents a case ends in: one row per case, lines put together in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspan.functions.text import chinese_numeral, clock

# Printing.
SPINE_PER_PAGE, SPINE_BASE, HARDCOVER_FROM = 0.0043, 0.08, 32
#: Fixed texts for families, by language.
MESSAGES = {
    "en": {"chapter": "Chapter {n}", "sources": "Sources", "contributors": "With {names}", "pages": "About {n} pages"},
    "zh-Hans": {"chapter": "第{n}章", "sources": "来源", "contributors": "与{names}一起", "pages": "约 {n} 页"},
    "zh-Hant": {"chapter": "第{n}章", "sources": "來源", "contributors": "與{names}一起", "pages": "約 {n} 頁"},
}


def t(key: str, language: str, **values: object) -> str:
    """A message in a language; English where that has none."""
    return MESSAGES.get(language, MESSAGES["en"]).get(key, MESSAGES["en"][key]).format(**values)


def format_date(day: Column, chinese: Column) -> Column:
    return F.when(chinese, F.date_format(day, "yyyy年M月d日")).otherwise(F.date_format(day, "d MMMM yyyy"))


def join_names(names: Column, chinese: Column) -> Column:
    """A sorted set of names as one text."""
    each = F.array_sort(F.array_distinct(names))
    return F.when(chinese, F.array_join(each, "、")).otherwise(F.array_join(each, ", "))


def in_order(lines: DataFrame, order: list[str], sep: str = "\n") -> DataFrame:
    """(case_id, text) of lines (case_id, order, line)."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "line")))
    return lines.groupBy("case_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), sep).alias("text"))


def manuscript(chapters: DataFrame, chinese: bool = False) -> DataFrame:
    n = chinese_numeral(F.col("number")) if chinese else F.col("number").cast("string")
    head = F.concat(F.lit("## 第"), n, F.lit("章 "), F.col("title")) if chinese else F.concat(F.lit("## Chapter "), n, F.lit(": "), F.col("title"))
    return in_order(chapters.select("case_id", "number", F.concat_ws("\n\n", head, F.col("prose")).alias("line")), ["number"], "\n\n")


def provenance(chapters: DataFrame, sources: DataFrame) -> DataFrame:
    """For each chapter the cards it rests on and their citations. sources: case_id, card_id, title, cites."""
    each = chapters.select("case_id", "number", F.posexplode("provenance").alias("pos", "card_id")).join(sources, ["case_id", "card_id"], "left")
    line = F.format_string("Chapter %d: %s (%s)", "number", F.coalesce("title", "card_id"), F.coalesce("cites", F.lit("unknown")))
    return in_order(each.select("case_id", "number", "pos", line.alias("line")), ["number", "pos"])


def printer_spec(pages: DataFrame) -> DataFrame:
    """Page count, spine and binding. pages: case_id, pages."""
    spine = F.format_string("%.2f", F.col("pages") * SPINE_PER_PAGE + SPINE_BASE)
    binding = F.when(F.col("pages") >= HARDCOVER_FROM, "hardcover").otherwise("softcover")
    return pages.select("case_id", F.concat(F.format_string("pages: %d\nspine: ", "pages"), spine, F.lit(" in\nbinding: "), binding).alias("text"))


def transcript(turns: DataFrame) -> DataFrame:
    """(recording_id, text): [time] speaker: text, a line per turn."""
    line = F.concat(F.lit("["), clock(F.col("start")), F.lit("] "), F.col("speaker"), F.lit(": "), F.col("text"))
    return in_order(turns.select(F.col("recording_id").alias("case_id"), "ord", line.alias("line")), ["ord"]).withColumnRenamed("case_id", "recording_id")


def checklist_lines(checklist: DataFrame) -> DataFrame:
    also = F.when(F.size("heard_also") > 0, F.concat(F.lit(" (also heard: "), F.array_join("heard_also", ", "), F.lit(")"))).otherwise("")
    hint = F.when(F.col("hinted"), " [hinted]").otherwise("")
    return checklist.select("recording_id", F.concat(F.col("first_at"), F.lit("  "), F.col("term"), also, F.format_string(" x%d", "count"), hint).alias("line"))
