"""Archives as JSON documents, with revisions; transcripts, question banks, checkpoints and chapters."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.schema import COLLECTIONS, archive_type

# Fixed value: revisions kept of a case.
KEEP = 30


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """One row per case under root/cases/*/archive.json, checked against the full schema; a broken document is an error."""
    path = posixpath.join(root, "cases", "*", "archive.json")
    return spark.read.schema(archive_type()).option("multiLine", True).option("mode", "FAILFAST").json(path)


def collection(archives: DataFrame, name: str) -> DataFrame:
    """One collection over all cases, as a table with case_id and ord."""
    if name not in COLLECTIONS:
        raise ValueError(f"no collection {name}; there are {', '.join(COLLECTIONS)}")
    x = archives.select(F.col("meta.id").alias("_case"), F.posexplode(name).alias("ord", "_x"))
    fields = [f for f in archives.schema[name].dataType.elementType.names if f != "case_id"]
    return x.select(F.col("_case").alias("case_id"), "ord", *[F.col(f"_x.{f}").alias(f) for f in fields])


def tables(archives: DataFrame) -> dict[str, DataFrame]:
    return {"cases": archives.select("meta.*"), **{name: collection(archives, name) for name in COLLECTIONS}}


def list_cases(spark: SparkSession, root: str) -> DataFrame:
    """(case_id): folders that hold an archive, by name. Only file names are read."""
    files = spark.read.format("binaryFile").load(posixpath.join(root, "cases", "*", "archive.json")).select("path")
    return files.select(F.regexp_extract("path", r"/cases/([^/]+)/archive\.json$", 1).alias("case_id")).orderBy("case_id")


def new_cases(metas: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, refused): an id that exists already is refused."""
    ids = known.select("case_id")
    return metas.join(ids, metas["id"] == ids["case_id"], "left_anti"), metas.join(ids, metas["id"] == ids["case_id"], "left_semi")


def content_key(archives: DataFrame, volatile: tuple = ("revision", "updated_at")) -> Column:
    """Hash of a document without what changes on every write; fields by name, nulls kept."""
    columns = sorted(c for c in archives.columns if c not in volatile)
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def changed(archives: DataFrame, saved: DataFrame) -> DataFrame:
    """Documents whose content differs from the last saved revision, with the next revision number. saved: case_id, revision, content."""
    last = saved.groupBy("case_id").agg(F.max("revision").alias("_rev"), F.max_by("content", "revision").alias("_old"))
    a = archives.withColumns({"case_id": F.col("meta.id"), "content": content_key(archives)}).join(last, "case_id", "left")
    a = a.where(F.col("_old").isNull() | (F.col("_old") != F.col("content")))
    return a.withColumn("revision", F.coalesce("_rev", F.lit(0)) + 1).drop("_rev", "_old")


def save(archives: DataFrame, saved: DataFrame, path: str) -> None:
    """Appends changed documents, partitioned by case and revision."""
    changed(archives, saved).write.partitionBy("case_id", "revision").mode("append").json(path)


def prune(spark: SparkSession, revisions: DataFrame, path: str, keep: int = KEEP) -> int:
    """Deletes the folders of revisions past the newest `keep` of each case; how many. Their names alone are read by the driver."""
    jvm, n = spark.sparkContext._jvm, 0
    for r in expired(revisions, keep).toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/case_id={r['case_id']}/revision={r['revision']}")
        n += bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))
    return n


def require_case(archives: DataFrame, case_id: str) -> DataFrame:
    """One case's document; an unknown id is an error that names the cases there are."""
    found = archives.where(F.col("meta.id") == case_id)
    if found.isEmpty():
        known = [r[0] for r in archives.select("meta.id").orderBy("id").limit(50).collect()]
        raise ValueError(f"no case {case_id}; there are {', '.join(known)}")
    return found


def current(revisions: DataFrame) -> DataFrame:
    last = revisions.groupBy("case_id").agg(F.max("revision").alias("revision"))
    return revisions.join(last, ["case_id", "revision"], "left_semi")


def expired(revisions: DataFrame, keep: int = KEEP) -> DataFrame:
    """(case_id, revision) past the newest `keep`, by number."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("revision")))
    return revisions.select("case_id", "revision").distinct().withColumn("_n", n).where(F.col("_n") > keep).drop("_n")


def export_portable(archives: DataFrame, path: str) -> None:
    """A JSON line per case, in a folder by case and revision; other cases' and revisions' exports stay."""
    out = archives.select(F.col("meta.id").alias("case_id"), "revision", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    out.write.partitionBy("case_id", "revision").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


# ---- other files --------------------------------------------------------------------------------------------------


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): a file is read whole, which keeps its lines in order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\R")).alias("line_no", "line"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list of names, without comments and empty lines."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' and not startswith(name, '#')")


def spoken_text(lines: DataFrame) -> DataFrame:
    """Reference text of transcript lines: without comments, times and labels."""
    line = F.regexp_replace("line", r"^\s*\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s*[^:：]{1,40}[:：]\s*", "")
    return lines.where("not startswith(ltrim(line), '#')").withColumn("line", F.trim(line)).where("line <> ''")


def waiting(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Transcript files of which no session was made: neither by name nor by a session file whose stem they continue.

    files: case_id, stem; sessions: case_id, stem. A prefix has no equi-join of its own, so each file's possible stems, one
    for each dot in its name, are exploded and joined on equality.
    """
    parts = F.split("stem", r"\.")
    stems = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")))
    taken = files.select("case_id", F.col("stem").alias("_file"), stems.alias("stem")).join(sessions.select("case_id", "stem"), ["case_id", "stem"], "left_semi")
    taken = taken.select("case_id", F.col("_file").alias("stem")).distinct()
    return files.join(taken, ["case_id", "stem"], "left_anti")


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Segments of an append-only log up to its first torn line."""
    schema = "key string, ord int, start double, end double, text string, _corrupt string"
    log = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    # a line's place is that of its split in its file; a log is one file, and only the place of the first torn line is shared
    log = log.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))})
    torn = log.where(F.col("_corrupt").isNotNull() | F.col("ord").isNull()).groupBy("_file").agg(F.min("_at").alias("_torn"))
    log = log.join(F.broadcast(torn), "_file", "left")  # a row for each torn file at most
    return log.where(F.col("_torn").isNull() | (F.col("_at") < F.col("_torn"))).drop("_file", "_torn", "_at", "_corrupt")


def append_checkpoint(segments: DataFrame, path: str, key: str) -> None:
    """Adds segments (ord, start, end, text) of one run to a log, as files of their own beside those there."""
    segments.select(F.lit(key).alias("key"), "ord", "start", "end", "text").sortWithinPartitions("ord").write.mode("append").json(path)


def checkpoint_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def read_chapters(spark: SparkSession, root: str) -> DataFrame:
    schema = "number int, title string, prose string, provenance array<string>, quotes_used array<string>, editor_notes array<string>"
    c = spark.read.schema(schema).option("multiLine", True).json(posixpath.join(root, "cases", "*", "drafts", "chapter-*.json"))
    return c.withColumn("case_id", F.regexp_extract("_metadata.file_path", r"/cases/([^/]+)/drafts/", 1))


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """A question bank from YAML: a small list that the driver reads through Spark, so any file system serves."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    found = yaml.safe_load(text) or []
    found = found["questions"] if isinstance(found, dict) else found
    rows = [(q.get("id"), q.get("text"), q.get("zh"), q.get("topic"), q.get("mode"), q.get("note"), int(q.get("asked") or 0), int(q.get("scenes") or 0)) for q in found]
    return spark.createDataFrame(rows, "id string, text string, zh string, topic string, mode string, note string, asked int, scenes int")


def bank_yaml(bank: DataFrame, comment: str = "") -> str:
    """The bank as YAML, empty fields left out, under its leading comment."""
    import yaml

    rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in bank.orderBy("id").toLocalIterator()]
    return comment + yaml.safe_dump({"questions": rows}, allow_unicode=True, sort_keys=False)
