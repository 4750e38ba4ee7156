"""Ordered operators: windows, turn folding, repeated passages, support of sentences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspan.functions import chinese
from kinspan.functions.text import CLOSERS, clock, dates, ends_sentence, has_cjk, looks_like_question, plausible_speaker, pronunciation_key, role_for, split_sentences, strip, units

# Sizes and limits.
SIZE, OVERLAP = 60, 8
GAP, CAP, CAP_ZH = 0.3, 80, 120
BREATH = 0.25
KIND_ORDER = ("person", "place", "organisation", "name", "date")


def count_windows(rows: DataFrame, by: list[str], order: list[str], size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Adds window (from 0): overlapping windows of `size` rows per group, the last one the first to reach the end.

    Each row knows its windows from its number alone, so nothing is joined: window w holds rows w*step+1 to w*step+size.
    A size of 0 or less is one window.
    """
    w = Window.partitionBy(*by)
    r = rows.withColumns({"_n": F.row_number().over(w.orderBy(*order)), "_all": F.count("*").over(w)})
    if size <= 0:
        return r.withColumn("window", F.lit(0)).drop("_n", "_all")
    step = max(1, size - overlap)
    last = F.when(F.col("_all") <= size, 0).otherwise(F.ceil((F.col("_all") - size) / step)).cast("int")
    low = F.greatest(F.ceil((F.col("_n") - size) / step), F.lit(0)).cast("int")
    high = F.least(F.floor((F.col("_n") - 1) / step).cast("int"), last)
    return r.withColumn("window", F.explode(F.sequence(low, high))).drop("_n", "_all")


# ---- transcripts --------------------------------------------------------------------------------------------------

_TS = r"\[?(\d{1,2}:\d{2}(?::\d{2})?)\]?"
_WHO = r"([^:：\n\[\]]{1,40}?)"
LINE_FORMS = ((rf"^\s*{_TS}\s*{_WHO}\s*[:：]\s*(.*)$", 2, 3, 1), (rf"^\s*{_WHO}\s*\(\s*{_TS}\s*\)\s*[:：]\s*(.*)$", 1, 3, 2), (rf"^\s*{_WHO}\s*[:：]\s*(.*)$", 1, 2, 0))
NOT_SPEECH = r"^\s*(?:#|//|WEBVTT|\d+\s*$|\d{1,2}:\d{2}:\d{2}[.,]\d{3}\s*-->)"


def parse_transcript(lines: DataFrame, by: list[str], number: str = "line_no", owners: list[str] | None = None, interviewers: list[str] | None = None) -> DataFrame:
    """Lines (by, line_no, line) to turns (by, seq, speaker, role, t_start, text).

    A line with a plausible speaker and some text starts a turn; a label without text is left out; other lines continue the
    turn before them, and lines before the first turn are left out. Lines are joined by a space, but not after Chinese.
    """
    text = F.regexp_replace("line", r"(?U)\s+$", "")
    d = lines.withColumn("_t", text).where((strip(F.col("_t")) != "") & ~F.rlike("_t", F.lit(NOT_SPEECH)))
    found = None
    for pattern, who, what, ts in LINE_FORMS:
        part = lambda g, p=pattern: F.regexp_extract("_t", p, g)
        hit = F.rlike("_t", F.lit(pattern)) & plausible_speaker(part(who))
        x = F.struct(strip(part(who)).alias("speaker"), strip(part(what)).alias("body"), (part(ts) if ts else F.lit(None).cast("string")).alias("ts"))
        found = F.when(hit, x) if found is None else found.when(hit, x)
    d = d.withColumn("_m", found).where(F.col("_m").isNull() | (F.col("_m.body") != ""))
    w = Window.partitionBy(*by).orderBy(number)
    d = d.withColumn("seq", F.count_if(F.col("_m").isNotNull()).over(w)).where("seq > 0")
    piece = F.coalesce("_m.body", strip(F.col("_t")))
    folded = d.groupBy(*by, "seq").agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), piece.alias("s")))).alias("_p"), F.min_by("_m", F.col(number)).alias("_m"))
    glue = lambda a, s: F.when(F.rlike(a, F.lit("[㐀-䶿一-鿿豈-﫿，。！？、]$")), F.concat(a, s)).otherwise(F.concat_ws(" ", a, s))
    out = F.aggregate(F.slice("_p", 2, 1_000_000_000), F.get("_p", 0)["s"], lambda a, x: strip(glue(a, x["s"])))
    return folded.select(*by, F.col("seq").cast("int").alias("seq"), F.col("_m.speaker").alias("speaker"), role_for(F.col("_m.speaker"), owners or [], interviewers or []).alias("role"), F.col("_m.ts").alias("t_start"), out.alias("text"))


TURN = "ord int, start double, end double, text string"
#: What is carried from segment to segment: the turn that is open, with its length and whether it ends a sentence.
OPEN = "ord int, start double, end double, text string, units int, ends boolean"
_WORD_END, _WORD_START = re.compile(r"[A-Za-z0-9]['’\-]?$"), re.compile(r"['’\-]?[A-Za-z0-9]")


def _measured(segments: DataFrame, chinese: bool) -> DataFrame:
    """Segments with what the fold asks of their texts, so that the fold itself looks at numbers only."""
    s = segments.select("recording_id", "ord", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), strip(F.col("text")).alias("text"))
    closing = F.lit(chinese) & F.rlike("text", F.lit(f"^[{CLOSERS}]+$"))  # ends a sentence if what it closes does
    lower = F.lit(not chinese) & F.rlike("text", F.lit(r"^\p{Ll}"))
    return s.withColumns({"units": units(F.col("text")).cast("int"), "ends": F.when(~closing, ends_sentence(F.col("text"))), "lower": lower})


def _folded(rows: Iterable[tuple], open_: tuple | None, chinese: bool, gap: float) -> tuple[list[tuple], tuple | None]:
    """(turns that ended, the one that is open) after segments (start, end, text, units, ends, lower) in order."""
    cap, joiner = (CAP_ZH, "") if chinese else (CAP, " ")
    done, pieces = [], [open_[3]] if open_ else []
    turn = list(open_) if open_ else None

    def closed() -> tuple:
        return (turn[0], turn[1], turn[2], joiner.join(pieces).strip())

    for start, end, text, size, ends, lower in rows:
        if turn and start - turn[2] <= gap and (not turn[5] or lower) and turn[4] < cap:
            last = pieces[-1]
            glued = chinese and _WORD_END.search(last) and _WORD_START.match(text) and not (last[-1] in "'’-" and text[0] in "'’-")
            pieces.append(text)
            turn[2], turn[4], turn[5] = end, turn[4] + size - bool(glued), turn[5] if ends is None else ends
        else:
            if turn:
                done.append(closed())
            turn, pieces = [turn[0] + 1 if turn else 0, start, end, text, size, bool(ends)], [text]
    if turn:
        turn[3] = joiner.join(pieces).strip()
    return done, tuple(turn) if turn else None


_SEGMENT = ("start", "end", "text", "units", "ends", "lower")


def _rows(x: pd.DataFrame) -> Iterator[tuple]:
    return zip(x["start"].tolist(), x["end"].tolist(), x["text"], x["units"].tolist(), (None if e is None or e != e else bool(e) for e in x["ends"]), x["lower"].tolist())


def assemble_turns(segments: DataFrame, chinese: bool = False, gap: float = GAP) -> DataFrame:
    """Segments (recording_id, ord, start, end, text) to turns.

    A segment runs on if the pause is short, the turn so far doesn't end a sentence (Latin: or the segment starts in lower
    case) and is not yet as long as the cap. Recordings are sorted by Spark and read once; only the open turn is held.
    """
    kind = segments.schema["recording_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["recording_id", "ord", "start", "end", "text"]
        current = open_ = None
        for x in batches:
            out = []
            for key, rows in x.groupby("recording_id", sort=False, dropna=False):
                if open_ and key != current:
                    out.append((current, *open_[:4]))
                    open_ = None
                current = key
                done, open_ = _folded(_rows(rows), open_, chinese, gap)
                out += [(key, *t) for t in done]
            yield pd.DataFrame(out, columns=columns)
        if open_:
            yield pd.DataFrame([(current, *open_[:4])], columns=columns)

    s = _measured(segments, chinese).where("text <> '' and recording_id is not null")
    return s.repartition("recording_id").sortWithinPartitions("recording_id", "ord").select("recording_id", *_SEGMENT).mapInPandas(run, f"recording_id {kind}, {TURN}")


def live_turns(segments: DataFrame, chinese: bool = False, gap: float = GAP, wait: str | None = "10 minutes") -> DataFrame:
    """assemble_turns() for a stream: turns are emitted when they end, only the open turn of a recording is kept as state.

    Segments of a recording arrive in order from batch to batch; within a batch they are sorted. A segment without a text
    ends its recording, and so does a time `wait` of the machine's clock without any; ords then go on from 0 if more come.
    A query that is to end by itself (availableNow) takes no `wait`, as Spark goes on making batches to look at the clock.
    """
    kind = segments.schema["recording_id"].dataType.simpleString()
    limit = int(pd.Timedelta(wait).total_seconds() * 1000) if wait else None

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        open_, out = state.get if state.exists else None, []
        ended = state.hasTimedOut
        if not ended:
            x = pd.concat(list(batches)).sort_values("ord", kind="stable")
            ended = bool(x["text"].isna().any())
            done, open_ = _folded(_rows(x[x["text"].notna() & (x["text"] != "")]), open_, chinese, gap)
            out += done
        if ended and open_:
            out.append(open_[:4])
            open_ = None
        if open_:
            state.update(open_)
            if limit:
                state.setTimeoutDuration(limit)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *t) for t in out], columns=["recording_id", "ord", "start", "end", "text"])

    s = _measured(segments, chinese).where("recording_id is not null").select("recording_id", "ord", *_SEGMENT)
    return s.groupBy("recording_id").applyInPandasWithState(run, f"recording_id {kind}, {TURN}", OPEN, "append", "ProcessingTimeTimeout" if wait else "NoTimeout")


def guess_speakers(turns: DataFrame, owner: str, interviewer: str, chinese: bool = False) -> DataFrame:
    """Adds speaker: short questions after a pause are the interviewer's.

    Each turn either says by itself whether it asks, or takes that over from the turn before, or turns it round; such steps
    compose, so running values over windows label a recording without a loop: the last turn that said by itself, and how many
    turned it round since.
    """
    floor, top = (12, 30) if chinese else (10, 25)
    by, t = Window.partitionBy("recording_id"), F.col("text")
    at = by.orderBy("ord")
    d = turns.withColumns({"_u": units(t), "_q": looks_like_question(t, F.lit(chinese)), "_mark": F.rlike(strip(t), F.lit("[?？]$")), "_i": F.row_number().over(at)})
    d = d.withColumn("_rank", F.row_number().over(by.orderBy("_u", "ord")))
    d = d.withColumn("_half", F.count("*").over(by)).withColumn("_typical", F.max(F.when(F.col("_rank") == F.floor(F.col("_half") / 2) + 1, F.col("_u"))).over(by))
    asks = F.col("_q") & (F.col("_u") <= F.least(2 * F.greatest(F.lit(floor), "_typical"), F.lit(top)))
    # a question in the same breath as the turn before asks only if that does
    same_breath = (F.col("_i") > 1) & (F.col("start") - F.lag("end").over(at) < BREATH)
    d = d.withColumn("_said", F.when(~(asks & same_breath), asks))
    d = d.withColumn("_asks", F.last("_said", ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    # without a question mark, it doesn't ask if the turn before does
    d = d.withColumn("_since", F.sum(F.when(F.col("_asks") & ~F.col("_mark") & (F.col("_i") > 1), 0).otherwise(1)).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("recording_id", "_since").orderBy("ord")
    d = d.withColumns({"_first": F.first("_asks").over(run), "_turned": F.row_number().over(run) - 1})
    d = d.withColumn("speaker", F.when(F.col("_first") != (F.col("_turned") % 2 == 1), interviewer).otherwise(owner))
    return d.select(*[c for c in turns.columns if c != "speaker"], "speaker")


# Capitalised words that are not names.
NOT_NAMES = (
    "The And But That This These Those There Then They We You He She It Its My His Her Our Their What When Where Who Whose Why "
    "How Which Not Yes Well Oh Thank Thanks Always Never Just Because After Before Once Only Some All Both One Two Three Four "
    "Five Six Seven Eight Nine Ten First Last Next Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February "
    "March April June July August September October November December"
).split()


def capitalised_runs(text: Column) -> Column:
    """Runs of capitalised words within a sentence, without ordinary words: candidates for names in Latin script."""
    token = lambda t: F.regexp_extract(F.regexp_replace(t, r"^[.,;:!?\"'()]+|[.,;:!?\"'()]+$", ""), r"^([A-Z][a-zA-Z'\-]{2,})$", 1)
    keep = lambda t: F.when((t != "") & ~F.regexp_replace(t, r"(?i)'(?:s|d|ll|ve|re|m|t)$", "").isin(NOT_NAMES), t).otherwise("|")
    runs = lambda s: F.split(F.array_join(F.transform(F.split(s, r"\s+"), lambda t: keep(token(t))), " "), r"\s*\|\s*")
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(split_sentences(text), runs)), F.trim), lambda r: r != ""))


def checklist(turns: DataFrame, hints: list[str] | None = None, nouns: Callable[[Column], Column] | None = None, readings: DataFrame | None = None) -> DataFrame:
    """(recording_id, term, kind, first_at, count, heard_also, hinted): names and dates to check against the audio.

    Terms are counted per turn; spellings that sound alike fold into the first; a hinted term is counted by occurrence.
    nouns finds the names of Chinese turns (chinese.proper_nouns), readings tell how their characters sound.
    """
    named = F.transform(capitalised_runs(F.col("text")), lambda t: F.struct(t.alias("term"), F.lit("name").alias("kind")))
    if nouns is not None:
        named = nouns(F.col("text"))
    dated = F.transform(dates(F.col("text"), nouns is not None), lambda t: F.struct(t.alias("term"), F.lit("date").alias("kind")))
    each = turns.select("recording_id", "ord", "start", F.posexplode(F.concat(named, dated)).alias("pos", "x")).select("recording_id", "ord", "start", "pos", "x.*")
    first = F.struct("ord", "pos")
    terms = each.groupBy("recording_id", "term").agg(F.min_by("kind", first).alias("kind"), F.min_by(clock(F.col("start")), first).alias("first_at"), F.count("*").alias("n"), F.min(first).alias("at"))
    heard = pronunciation_key(F.col("term"))
    if readings is not None:
        terms, heard = chinese.usual_sound(terms, "term", readings), F.coalesce(F.when(has_cjk(F.col("term")), F.col("sound")), heard)
    sound = F.when(F.col("kind") == "date", F.concat(F.lit("date:"), F.col("term"))).otherwise(heard)
    folded = terms.withColumn("_sound", sound).groupBy("recording_id", "_sound").agg(F.array_sort(F.collect_list(F.struct("at", "term", "kind", "first_at", "n"))).alias("v"))
    head = F.get("v", 0)
    out = folded.select("recording_id", head["term"].alias("term"), head["kind"].alias("kind"), head["first_at"].alias("first_at"), F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("count"), F.transform(F.slice("v", 2, 1_000_000_000), lambda x: x["term"]).alias("heard_also"))
    primed = [h.strip() for h in hints or [] if h and h.strip()]
    if primed:
        times = turns.select("recording_id", "ord", "start", "text", F.explode(F.array(*[F.lit(h) for h in primed])).alias("term")).where(F.contains("text", F.col("term")))
        count = F.floor((F.length("text") - F.length(F.replace("text", F.col("term"), F.lit("")))) / F.length("term"))
        said = times.groupBy("recording_id", "term").agg(F.sum(count).alias("said"), F.min_by(clock(F.col("start")), F.col("ord")).alias("said_at"))
        listed = out.select("recording_id", F.explode(F.concat(F.array("term"), "heard_also")).alias("term"))
        extra = said.join(listed, ["recording_id", "term"], "left_anti").select("recording_id", "term", F.lit("name").alias("kind"), F.col("said_at").alias("first_at"), F.lit(0).cast("long").alias("count"), F.array().cast("array<string>").alias("heard_also"))
        out = out.unionByName(extra).join(said.drop("said_at"), ["recording_id", "term"], "left")
        out = out.withColumn("hinted", F.col("term").isin(primed)).withColumn("count", F.when(F.col("hinted"), F.coalesce(F.nullif("said", F.lit(0)), "count")).otherwise(F.col("count"))).drop("said")
    else:
        out = out.withColumn("hinted", F.lit(False))
    place = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    return out.orderBy("recording_id", place, "first_at", "term")


# ---- the drafted book ---------------------------------------------------------------------------------------------


def word_runs(rows: DataFrame, text: str, size: int, keep: list[str]) -> DataFrame:
    """(keep, pos, h) for each run of `size` words of a cleaned text: its place from 0 and its hash.

    Each word is hashed once, in a projection of its own, and a run by the hashes of its words.
    """
    words = F.transform(F.filter(F.split(F.col(text), " "), lambda x: x != ""), lambda x: F.xxhash64(x))
    d = rows.select(*keep, words.alias("_w")).where(F.size("_w") >= size)
    return d.select(*keep, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_w") - size + 1), lambda i: F.xxhash64(F.slice(F.col("_w"), i, F.lit(size))))).alias("pos", "h"))


def repeated_passages(chapters: DataFrame, size: int = 12, by: list[str] | None = None, chapter: str = "chapter") -> DataFrame:
    """(by, earlier, later, run): chapters that tell a passage that an earlier one has told first, with its first run.

    The first chapter of a run is its minimum, which is combined before the shuffle, so a run that very many chapters have
    makes no large group. Only hashes move; the words of the runs reported are taken from the chapters at the end.
    """
    by = by or []
    each = word_runs(chapters.withColumn("later", F.col(chapter)), "text", size, [*by, "later"])
    first = each.groupBy(*by, "h").agg(F.min("later").alias("earlier"), F.max("later").alias("_last")).where("earlier <> _last").drop("_last")
    hits = each.join(first, [*by, "h"]).where("later <> earlier").groupBy(*by, "earlier", "later").agg(F.min("pos").alias("pos"))
    words = F.filter(F.split("text", " "), lambda x: x != "")
    told = chapters.select(*by, F.col(chapter).alias("later"), words.alias("_w"))
    return hits.join(told, [*by, "later"]).select(*by, "earlier", "later", F.array_join(F.slice("_w", F.col("pos") + F.lit(1), F.lit(size)), " ").alias("run"))


def least_supported(sentences: DataFrame, vocabulary: DataFrame, units_of: str = "units", per_chapter: int = 5, below: float = 0.5, least: int = 3) -> DataFrame:
    """(chapter, pos, sentence, support): of each chapter the sentences whose words the recordings have least.

    sentences: chapter, pos, sentence and an array of comparison units, which count with repeats; vocabulary: unit.
    """
    each = sentences.where(F.size(units_of) >= least).select("chapter", "pos", F.explode(units_of).alias("unit"))
    heard = vocabulary.select("unit").distinct().withColumn("_in", F.lit(1))
    s = each.join(heard, "unit", "left").groupBy("chapter", "pos").agg((F.count("_in") / F.count("*")).alias("support")).where(F.col("support") < below)
    w = Window.partitionBy("chapter").orderBy("support", "pos")
    few = s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_chapter)
    # sentences are moved once, not with each of their words
    return few.join(sentences.select("chapter", "pos", "sentence"), ["chapter", "pos"]).select("chapter", "pos", "sentence", "support", "place")


def sentences_of(chapters: DataFrame) -> DataFrame:
    """(case_id, chapter, pos, sentence) over the paragraphs of each chapter's prose."""
    every = F.flatten(F.transform(F.split("prose", r"\R"), lambda p: split_sentences(strip(p))))
    return chapters.select("case_id", F.col("number").alias("chapter"), F.posexplode(every).alias("pos", "sentence"))


def gap_sessions(rows: DataFrame, by: list[str], at: str, seconds: float) -> DataFrame:
    """Adds session (from 1): a new one after a pause longer than `seconds`. The pause rule of turns alone."""
    w = Window.partitionBy(*by).orderBy(at)
    new = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")) - F.lag(F.unix_micros(F.col(at).cast("timestamp"))).over(w) > int(seconds * 1e6), F.lit(True))
    return rows.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w)).drop("_new")
