"""Revisions of archives under optimistic concurrency.

A save writes its documents as a batch that nobody sees, then a manifest with the next number that names all live batches.
The manifest is written aside and moved to its name in one step that fails if the name is taken, so readers see whole saves
only and one of two racing writers finds out. It looks at what was saved meanwhile: if none of its cases was touched it takes
the next number, else it fails with StaleCases and nothing of it is seen. What reaches the driver are manifests and the few
case ids of an error. The move is one step on HDFS and on local disks; a store without such a move needs one manifest writer.

    cases/manifests/000000000007.json   {"version": 7, "batches": [...]}
    cases/batches/<id>/part-*.parquet   case_id, revision, content, document
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspan.sources.archive import KEEP, changed
from kinspan.sources.stage import kept

BATCH = "case_id string, revision long, content string, document string"
TRIES = 100


class StaleCases(RuntimeError):
    """Cases of a save were saved by somebody else since its snapshot was taken."""


class Revisions:
    """What was saved under a folder as of one manifest; later saves don't change it."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.version = self._newest() if version is None else version
        self.batches: list[str] = json.loads(self._read(self._manifest(self.version)))["batches"] if self.version else []

    # ---- files, by Hadoop's interface, so any store that Spark reads serves

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"manifests/{version:012d}.json"

    def _newest(self) -> int:
        folder = self._path("manifests")
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)] if self._fs().exists(folder) else []
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), default=0)

    def _read(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _taken(self, version: int, text: str) -> bool:
        """Puts a manifest under its number; False if the number is taken."""
        aside, name = self._path(f"manifests/_{uuid.uuid4().hex}"), self._path(self._manifest(version))
        out = self._fs().create(aside)
        out.write(text.encode())
        out.close()
        try:
            if self._fs().getUri().getScheme() == "file":  # its rename would replace the other file
                folder = self._fs().resolvePath(self._path("manifests")).toUri().getPath()
                os.link(f"{folder}/{aside.getName()}", f"{folder}/{name.getName()}")
                return True
            jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(name.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(self._fs().makeQualified(aside), self._fs().makeQualified(name), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except FileExistsError:
            return False
        except Exception as e:  # Java's FileAlreadyExistsException
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        finally:
            self._fs().delete(aside, False)

    def _commit(self, batches: Callable[[Revisions], list[str]]) -> Revisions:
        """Commits the live batches that follow from the newest manifest, as often as it takes."""
        for _ in range(TRIES):
            newest = Revisions(self.spark, self.root)
            live = batches(newest)
            if self._taken(newest.version + 1, json.dumps({"version": newest.version + 1, "batches": live})):
                return Revisions(self.spark, self.root, newest.version + 1)
        raise RuntimeError(f"no manifest could be committed in {TRIES} tries")

    def _rows(self, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], BATCH)
        return self.spark.read.schema(BATCH).parquet(*[f"{self.root}/batches/{b}" for b in batches])

    def _write(self, rows: DataFrame) -> str:
        batch = uuid.uuid4().hex
        rows.select("case_id", F.col("revision").cast("long").alias("revision"), "content", "document").write.parquet(f"{self.root}/batches/{batch}")
        return batch

    # ---- reading

    def all(self) -> DataFrame:
        """case_id, revision, content (a hash), document (JSON) of every revision that is kept."""
        return self._rows(self.batches)

    def current(self) -> DataFrame:
        """The newest revision of each case. A maximum, not a join: no case's revisions meet in a sort."""
        newest = F.max_by(F.struct("content", "document"), "revision")
        return self.all().groupBy("case_id").agg(F.max("revision").alias("revision"), newest.alias("_x")).select("case_id", "revision", "_x.*")

    def archives(self, schema) -> DataFrame:
        """Current documents as archives of the schema; one that doesn't fit is an error."""
        d = self.current().select("revision", F.from_json("document", schema, {"mode": "FAILFAST"}).alias("d"))
        return d.select(*[(F.col("revision") if f == "revision" else F.col(f"d.{f}")).alias(f) for f in schema.names])

    # ---- writing

    def save(self, archives: DataFrame) -> Revisions:
        """The state with the documents whose content differs from this snapshot's, each as its case's next revision.

        Documents without a change write nothing, and if there are no others the state stays as it is. StaleCases if a case
        that is to be written was saved since this snapshot.
        """
        new = changed(archives, self.all().select("case_id", "revision", "content"))
        batch = self._write(new.withColumn("document", F.to_json(F.struct(*archives.columns), {"ignoreNullFields": "false"})))
        mine = self._rows([batch]).select("case_id")
        if mine.isEmpty():
            self._drop(batch)
            return self

        def live(newest: Revisions) -> list[str]:
            since = newest._rows([b for b in newest.batches if b not in self.batches])
            theirs = since.join(mine, "case_id", "left_semi").join(self.all().select("case_id", "revision"), ["case_id", "revision"], "left_anti")
            stale = [r[0] for r in theirs.select("case_id").distinct().orderBy("case_id").limit(20).collect()]
            if stale:
                self._drop(batch)
                raise StaleCases(f"saved since revision list {self.version}: {', '.join(stale)}")
            return [*newest.batches, batch]

        return self._commit(live)

    def prune(self, keep: int = KEEP) -> Revisions:
        """The state with the newest `keep` revisions of each case, as one batch; saves meanwhile stay beside it."""
        n = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("revision")))
        stay = kept(self.all().select("case_id", "revision").withColumn("_n", n).where(F.col("_n") <= keep).drop("_n"))
        if stay.count() == self.all().count() and len(self.batches) <= 1:
            return self
        batch = self._write(self.all().join(stay, ["case_id", "revision"], "left_semi"))

        def live(newest: Revisions) -> list[str]:
            if not set(self.batches) <= set(newest.batches):
                self._drop(batch)
                raise StaleCases("pruned by somebody else")
            return [batch, *[b for b in newest.batches if b not in self.batches]]

        return self._commit(live)

    def _drop(self, batch: str) -> None:
        self._fs().delete(self._path(f"batches/{batch}"), True)

    def orphans(self) -> list[str]:
        """Batches that the manifests kept don't name: of saves that failed or run just now, and of pruned states."""
        folder = self._path("batches")
        there = [s.getPath().getName() for s in self._fs().listStatus(folder)] if self._fs().exists(folder) else []
        return sorted(set(there) - set(self.batches))
