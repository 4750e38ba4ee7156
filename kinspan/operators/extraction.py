"""Extraction of sessions: consent, windows, a provider's answers, resumption, and the fold into a case."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.operators import merge, windows
from kinspan.operators.state import FIRST_CONSENTS
from kinspan.operators.validators import missing_consents
from kinspan.sources.stage import kept

# A window under LEAST rows, or halved DEEP times, is not halved again; halves share ROWS rows on each side.
LEAST, DEEP, ROWS = 8, 3, 2


class Truncated(Exception):
    """Raised by a provider whose answer did not fit."""


def allowed(utterances: DataFrame, consents: DataFrame, cases: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(allowed, withheld) utterances: a case needs all three consents before anything is sent."""
    lacking = missing_consents(consents, cases, list(FIRST_CONSENTS), now).select("case_id").distinct()
    return utterances.join(lacking, "case_id", "left_anti"), utterances.join(lacking, "case_id", "left_semi")


def planned(utterances: DataFrame, size: int = windows.SIZE, overlap: int = windows.OVERLAP, speakers_only: bool = True) -> DataFrame:
    """Rows of each window with the plan `size/overlap/rows` that it belongs to; the interviewer's turns stay as context."""
    u = utterances.where("role in ('owner', 'interviewer')") if speakers_only else utterances
    n = u.groupBy("case_id", "session_id").agg(F.concat(F.lit(f"{size}/{overlap}/"), F.count("*")).alias("plan"))
    return windows.count_windows(u.join(n, ["case_id", "session_id"]), ["case_id", "session_id"], ["seq"], size, overlap)


def outstanding(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Windows without a result under the same plan. done: case_id, session_id, plan, window."""
    return rows.join(done, ["case_id", "session_id", "plan", "window"], "left_anti")


def answers(rows: DataFrame, provider: Callable[[str], str], keep_errors: bool = False) -> DataFrame:
    """(case_id, session_id, plan, window, part, ids, result[, error]): the provider's answer to each window.

    Windows don't depend on each other, so they are asked in parallel; one whose answer doesn't fit is halved. A window is
    one group, of the window's size. An error of the provider ends the job, or with keep_errors is the window's only row.
    """
    key = ["case_id", "session_id", "plan", "window"]

    def told(x: pd.DataFrame, depth: int) -> Iterator[tuple[list[str], str]]:
        prompt = "\n".join(f"[{i}] {s}: {t}" for i, s, t in zip(x["id"], x["speaker"], x["text"], strict=True))
        try:
            yield x["id"].tolist(), provider(prompt)
        except Truncated:
            if len(x) < LEAST or depth == DEEP:
                raise
            middle = len(x) // 2
            yield from told(x.iloc[: middle + ROWS], depth + 1)
            yield from told(x.iloc[max(0, middle - ROWS) :], depth + 1)

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("seq")
        try:
            found = [(part, ids, text, None) for part, (ids, text) in enumerate(told(x, 0))]
        except Exception as e:
            if not keep_errors:
                raise
            found = [(0, [], None, f"{type(e).__name__}: {e}"[:200])]
        return pd.DataFrame([(*x[key].iloc[0], *f) for f in found], columns=[*key, "part", "ids", "result", "error"])[[*key, "part", "ids", "result", *["error"] * keep_errors]]

    rows = rows.select(*key, "id", "seq", "speaker", "text")
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key)
    return rows.groupBy(*key).applyInPandas(run, f"{types}, part int, ids array<string>, result string" + ", error string" * keep_errors)


def folded(results: DataFrame, utterances: DataFrame, existing: DataFrame | None = None, owners: DataFrame | None = None) -> DataFrame:
    """Records of each case from all its answers, in the order of session, window and part, after the records there are.

    existing: records as merge.OUT has them; owners: (case_id, name). See merge.merge_results.
    """
    r = results.withColumn("_at", F.struct("session_id", "window", "part"))
    n = windows.Window.partitionBy("case_id").orderBy("_at")
    r = r.withColumn("window", F.row_number().over(n)).select("case_id", "window", "ids", "result")
    return merge.merge_results(r.drop("ids"), utterances, r.select("case_id", "window", F.explode("ids").alias("id")), owners, existing)


# ---- a log of answers, and runs that resume ------------------------------------------------------------------------

KEY = ("case_id", "session_id", "plan", "window")
LOG = "case_id string, session_id string, plan string, window int, part int, ids array<string>, result string, error string"


class Unanswered(RuntimeError):
    """Windows that a run got no answer to; those that it got are in the log."""


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The answers given so far, under any plan. A window that two attempts answered has the answers of one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LOG).drop("error")
    rows = spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(path).where("error is null").drop("error").withColumn("_file", F.col("_metadata.file_path"))
    one = F.min("_file").over(windows.Window.partitionBy(*KEY))
    return rows.withColumn("_one", one).where("_file = _one").drop("_file", "_one")


def ask(rows: DataFrame, provider: Callable[[str], str], path: str, per_task: int = 1) -> None:
    """Asks for those windows that the log lacks and adds them to it.

    A task asks for about per_task windows, and what it was told is in the log when it ends, whatever becomes of the others
    or of the run; so windows are not asked for again. Each run has a folder of its own, so two don't disturb each other.
    A provider's error keeps no other window from being asked; Unanswered is raised when all have been.
    """
    spark, run = rows.sparkSession, f"{path}/run-{uuid.uuid4().hex}"
    todo = outstanding(rows, read_log(spark, path).select(*KEY).distinct())
    n = todo.select(*KEY).distinct().count()
    if n:
        told = answers(todo.repartition(-(-n // per_task), *KEY), provider, keep_errors=True)
        # version 2 of the committer moves a task's file to its place when the task ends, not when all have
        told.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(run)
        failed = spark.read.schema(LOG).parquet(run).where("error is not null").agg(F.count("*").alias("n"), F.min("error").alias("error")).first()
        if failed["n"]:
            raise Unanswered(f"{failed['n']} of {n} windows have no answer: {failed['error']}")


def progress(rows: DataFrame, told: DataFrame, sessions: DataFrame) -> DataFrame:
    """(case_id, session_id, plan, done, upto, total): windows folded before, and those answered without a gap after them.

    A session that was begun under another plan begins anew; one that was finished under this plan is done.
    """
    s = sessions.select("case_id", F.col("id").alias("session_id"), F.col("extract_plan").alias("plan"), F.col("extract_windows_done").alias("_done"), F.col("extracted_at").isNotNull().alias("_whole"))
    w = rows.select(*KEY).distinct().join(told.select(*KEY, F.lit(True).alias("_told")).distinct(), list(KEY), "left")
    w = w.groupBy("case_id", "session_id", "plan").agg(F.count("*").alias("total"), F.min(F.when(F.col("_told").isNull(), F.col("window"))).alias("_gap"))
    done = F.when(F.col("_whole"), F.col("total")).otherwise(F.least(F.coalesce("_done", F.lit(0)), "total"))
    return w.join(s, ["case_id", "session_id", "plan"], "left").select("case_id", "session_id", "plan", done.cast("int").alias("done"), F.coalesce("_gap", "total").cast("int").alias("upto"), F.col("total").cast("int").alias("total"))


#: Fields of records that a fold may set; those of a row that is there stay as they are otherwise.
FIELDS = {
    "people": "name string, relationship string, sources array<string>",
    "places": "name string, region string, sources array<string>",
    "claims": "text string, kind string, status string, importance int, sources array<string>",
    "quotes": "text string, source string, locator string",
    "story_cards": "title string, period string, year int, year_end int, approximate boolean, setup string, conflict string, choice string, consequence string, reflection string, "
    "person_ids array<string>, place_ids array<string>, sources array<string>, quote_ids array<string>, claim_ids array<string>, strength int, access string, sensitivity string, operator_note string",
}


def records_of(tables: dict[str, DataFrame]) -> DataFrame:
    """The records of cases that are there, as merge.OUT has them: sources by the ids of utterances."""

    def one(name: str) -> DataFrame:
        t = tables[name]
        ids = {"sources": F.transform(F.filter("sources", lambda x: x["kind"] == "utterance"), lambda x: x["ref_id"])} if "sources" in t.columns else {"source": F.col("source.ref_id"), "locator": F.col("source.locator")}
        t = t.withColumns(ids)
        return t.select("case_id", F.lit(name).alias("collection"), "id", F.col("ord").cast("int").alias("ord"), F.to_json(F.struct(*[c for c in t.columns if c not in ("case_id", "ord")])).alias("record"))

    return reduce(DataFrame.unionByName, [one(name) for name in FIELDS])


def applied(tables: dict[str, DataFrame], records: DataFrame) -> dict[str, DataFrame]:
    """The tables after a fold: rows that are there take over what it set, new ones follow, private words are restricted."""
    out = dict(tables)
    source = lambda x, locator=None: F.struct(F.lit("utterance").alias("kind"), x.alias("ref_id"), F.lit(None).cast("string").alias("locator") if locator is None else locator.alias("locator"), F.lit(None).cast("string").alias("note"))
    for name, fields in FIELDS.items():
        t, keys = tables[name], ["case_id", "id"]
        r = records.where(F.col("collection") == name).select("case_id", "id", F.col("ord").alias("_ord"), F.from_json("record", fields, {"mode": "FAILFAST"}).alias("_r"))
        given = [f.split()[0] for f in fields.split(", ")]
        j = t.join(r, keys, "left")
        for f in (f for f in given if f in t.columns and f not in ("source", "access", "status")):
            if f == "sources":
                had = F.coalesce("sources", F.array().cast(t.schema[f].dataType))
                more = F.transform(F.array_except(F.col("_r.sources"), F.transform(had, lambda x: x["ref_id"])), lambda x: source(x))
                new = F.concat(had, more.cast(t.schema[f].dataType))
            else:
                new = F.coalesce(F.col(f"_r.{f}"), F.col(f))
            j = j.withColumn(f, F.when(F.col("_r").isNull(), F.col(f)).otherwise(new.cast(t.schema[f].dataType)))
        last = t.groupBy("case_id").agg((F.max("ord") + 1).alias("_from"))
        fresh = r.join(t.select(*keys), keys, "left_anti").join(last, "case_id", "left").withColumn("ord", (F.coalesce("_from", F.lit(0)) + F.col("_ord")).cast(t.schema["ord"].dataType))
        made = {"sources": F.transform(F.array_distinct("_r.sources"), lambda x: source(x)), "source": source(F.col("_r.source"), F.col("_r.locator"))}
        columns = [made.get(f, F.col(f"_r.{f}")).cast(t.schema[f].dataType).alias(f) for f in given if f in t.columns]
        out[name] = j.select(*t.columns).unionByName(fresh.select("case_id", "id", "ord", *columns), allowMissingColumns=True).select(*t.columns)
    private = records.where("collection = 'restricted'").select("case_id", "id", F.lit(True).alias("_private")).distinct()
    u = tables["utterances"]
    out["utterances"] = u.join(private, ["case_id", "id"], "left").withColumn("sensitivity", F.when(F.col("_private"), F.lit("restricted")).otherwise(F.col("sensitivity"))).select(*u.columns)
    return out


def extract(tables: dict[str, DataFrame], provider: Callable[[str], str], path: str, now: Column, size: int = windows.SIZE, overlap: int = windows.OVERLAP) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, records): the cases with all sessions extracted as far as answers go, and what was folded.

    Only cases with the consents are asked about. Answers are in the log at `path` before anything is folded; windows folded
    in an earlier run, as the sessions tell, are not folded again, and nothing is asked twice under one plan. A provider that
    fails ends the run; the next goes on from the log. What is returned is to be saved by the caller; until then the sessions
    don't tell of it, so a run that ends in between folds the same windows again and into the same records.
    """
    said, _ = allowed(tables["utterances"], tables["consents"], tables["cases"].select("id"), now)
    rows = kept(planned(said, size, overlap).select(*KEY, "id", "seq", "speaker", "text"))
    ask(rows, provider, path)
    told = read_log(rows.sparkSession, path)
    at = kept(progress(rows, told, tables["sessions"]))
    new = told.join(at, ["case_id", "session_id", "plan"]).where("window >= done and window < upto").select(*told.columns)
    touched = new.select("case_id").distinct()
    there = records_of(tables).join(touched, "case_id", "left_semi")
    owners = tables["cases"].select(F.col("id").alias("case_id"), F.coalesce(F.nullif("owner_preferred_name", F.lit("")), "owner_name").alias("name"))
    records = kept(folded(new, tables["utterances"], there, owners))
    out = applied(tables, records)
    s = tables["sessions"]
    state = at.select("case_id", F.col("session_id").alias("id"), F.col("plan").alias("_plan"), F.greatest("done", "upto").alias("_upto"), "total")
    j = s.join(state, ["case_id", "id"], "left")
    ended = F.coalesce(F.when(F.col("extract_plan") == F.col("_plan"), F.col("extracted_at")), F.when(F.col("_upto") == F.col("total"), now))
    j = j.withColumn("extracted_at", F.when(F.col("_plan").isNull(), F.col("extracted_at")).otherwise(ended))
    j = j.withColumns({"extract_plan": F.coalesce("_plan", "extract_plan"), "extract_windows_done": F.coalesce("_upto", "extract_windows_done")})
    out["sessions"] = j.select(*s.columns)
    return out, records
