"""An append-only store of facts and claims on Parquet, published by numbered versions.

A table is a folder of parts, each a Parquet folder that is never changed. A version is one file that lists the parts of every
table; the highest one counts. A change, of one table or of several, writes its parts and then the next version, so a reader sees
all of it or nothing, and a writer that dies leaves nothing but parts that no version lists. A version is written aside
and takes its number in one step that fails if the number is taken; a writer then looks again, and is refused if another one has
changed a table that it read. Adding rows costs the new rows; changing some rewrites the parts that have them.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.graphs import reachable
from factloom.operators.order import numbered


class Refused(ValueError):
    """A change that would break a rule of the store."""


def _refuse_any(rows: DataFrame, why: str) -> None:
    some = rows.limit(5).collect()
    if some:
        raise Refused(f"{why}: {[tuple(r) for r in some]}")


@dataclass
class Change:
    """A table's parts as they were read (None: no table), those that stay, and rows that come as a new part."""

    table: str
    seen: list[str] | None
    keep: list[str]
    fresh: DataFrame | None


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _state(self) -> tuple[int, dict[str, list[str]]]:
        """The highest number that is taken, and the parts of each table in the version that counts."""
        fs, folder = self._fs(f"{self.path}/_versions")
        if not fs.exists(folder):
            return 0, {}
        names = sorted((f.getPath().getName() for f in fs.listStatus(folder) if not f.getPath().getName().startswith(".") and f.getPath().getName().endswith(".json")), reverse=True)
        for name in names:
            stream = fs.open(self._fs(f"{self.path}/_versions/{name}")[1])
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text.endswith("\n"):  # damaged ones don't count, but their numbers are taken
                return int(names[0].removesuffix(".json")), json.loads(text)
        return int(names[0].removesuffix(".json")) if names else 0, {}

    def current(self, table: str) -> list[str] | None:
        """The parts of a table, None if nothing is published."""
        return self._state()[1].get(table)

    def parts(self, table: str) -> list[str]:
        return self.current(table) or []

    def _rows(self, table: str, parts: list[str]) -> DataFrame:
        reader = self.spark.read.option("mergeSchema", str(len(parts) > 1).lower())
        return reader.parquet(*[f"{self.path}/{table}/{part}" for part in parts])

    def read(self, table: str) -> DataFrame:
        now = self.current(table)
        if now is None:
            raise Refused(f"{table}: nothing published")
        return self._rows(table, now)

    def _take(self, number: int, text: str) -> bool:
        """Give a version its number; whether that was free. The file is whole before it has its name."""
        name, aside = f"{self.path}/_versions/{number:012d}.json", f"{self.path}/_versions/.{number:012d}-{uuid.uuid4().hex}"
        fs, source = self._fs(aside)
        out = fs.create(source, True)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._fs(name)[1]
        if fs.getUri().getScheme() == "file":
            # renaming would replace a file on a local disk; a link never does
            local = lambda path: path.toUri().getPath()
            try:
                os.link(local(source), local(target))
            except FileExistsError:
                return False
            finally:
                os.remove(local(source))
            return True
        jvm = self.spark.sparkContext._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, none)
        except Exception:
            if not fs.exists(target):
                raise
            fs.delete(source, False)
            return False
        return True

    def _publish(self, *changes: Change) -> None:
        """One version with all of the changes, if the tables that they change are what they were when they were read."""
        parts = {}
        for c in changes:
            parts[c.table] = list(c.keep)
            if c.fresh is not None:
                parts[c.table].append(f"part-{uuid.uuid4().hex}")
                c.fresh.write.parquet(f"{self.path}/{c.table}/{parts[c.table][-1]}")
        while True:
            number, tables = self._state()
            for c in changes:
                if tables.get(c.table) != c.seen:
                    raise Refused(f"{c.table}: another writer has changed it")
            if self._take(number + 1, json.dumps(tables | parts) + "\n"):
                return

    def publish(self, table: str, df: DataFrame) -> None:
        """``df`` is the table from now on."""
        self._publish(Change(table, self.current(table), [], df))

    def _added(self, table: str, rows: DataFrame, key: list[str]) -> Change:
        _refuse_any(rows.groupBy(*key).count().filter("count > 1").select(*key), f"{table}: keys given twice")
        now = self.current(table)
        if now is not None:
            _refuse_any(rows.join(self._rows(table, now).select(*key), key, "left_semi").select(*key), f"{table}: keys that exist")
        return Change(table, now, now or [], rows)

    def append(self, table: str, rows: DataFrame, key: list[str]) -> None:
        """Add rows; a key that is there already, or twice among the new ones, is refused, so nothing is overwritten."""
        self._publish(self._added(table, rows, key))

    def append_all(self, tables: dict[str, tuple[DataFrame, list[str]]]) -> None:
        """:meth:`append` to several tables in one version: all of it or nothing."""
        self._publish(*[self._added(table, rows, key) for table, (rows, key) in tables.items()])

    def _missing(self, table: str, rows: DataFrame, key: list[str]) -> Change:
        rows, now = rows.dropDuplicates(key), self.current(table)
        if now is not None:
            rows = rows.join(self._rows(table, now).select(*key), key, "left_anti")
        return Change(table, now, now or [], rows)

    def append_missing(self, table: str, rows: DataFrame, key: list[str]) -> None:
        """Add the rows whose key isn't there; of new rows with one key any stays."""
        self._publish(self._missing(table, rows, key))

    def _touched(self, table: str, parts: list[str], keys: DataFrame, key: list[str]) -> list[str]:
        """Those of ``parts`` that have a row with one of the keys, by one job over all of them."""
        named = self._rows(table, parts).select(*key, F.regexp_extract("_metadata.file_path", "(part-[0-9a-f]{32})/[^/]*$", 1).alias("_part"))
        found = {r["_part"] for r in named.join(keys, key, "left_semi").select("_part").distinct().collect()}
        return [part for part in parts if part in found]

    def upsert(self, table: str, rows: DataFrame, key: list[str]) -> None:
        """Last write wins."""
        now = self.current(table)
        if now is None:
            self._publish(Change(table, None, [], rows))
            return
        keys = rows.select(*key)
        touched = self._touched(table, now, keys, key)
        fresh = rows
        if touched:
            fresh = self._rows(table, touched).join(keys, key, "left_anti").unionByName(rows, allowMissingColumns=True)
        self._publish(Change(table, now, [p for p in now if p not in touched], fresh))

    def assert_claims(self, claims: DataFrame, support: DataFrame) -> None:
        """Add claims (id, kind, subject, value, origin) with their citations (inference_id, evidence_id), in one version. A claim that
        cites nothing is refused unless a human made it, and so is a citation of evidence that isn't there."""
        cited = support.select(F.col("inference_id").alias("id"))
        _refuse_any(claims.filter("origin <> 'human'").join(cited, "id", "left_anti").select("id"), "claims without citation")
        evidence = self.read("evidence").select(F.col("id").alias("evidence_id"))
        _refuse_any(support.join(evidence, "evidence_id", "left_anti"), "citations of missing evidence")
        marked = claims.withColumn("status", F.lit("active")).withColumn("reason", F.lit(None).cast("string"))
        self._publish(self._added("inference", marked, ["id"]), self._missing("inference_support", support, ["inference_id", "evidence_id"]))

    def retract(self, seeds: DataFrame, reason: str) -> DataFrame:
        """Retract claims (node) and all that depend on them; they stay, with status and reason. Returns the retracted ids."""
        now = self.current("inference")
        if now is None:
            raise Refused("inference: nothing published")
        edges = self.read("inference_depends").select(F.col("depends_on_id").alias("src"), F.col("inference_id").alias("dst"))
        gone = reachable(edges, seeds).withColumnRenamed("node", "id")
        touched = self._touched("inference", now, gone, ["id"])
        if touched:
            claims = self._rows("inference", touched)
            marked = claims.join(gone.withColumn("_gone", F.lit(True)), "id", "left")
            hit = F.col("_gone") & (F.col("status") == "active")
            out = marked.withColumn("reason", F.when(hit, reason).otherwise(F.col("reason"))).withColumn("status", F.when(hit, "retracted").otherwise(F.col("status")))
            self._publish(Change("inference", now, [p for p in now if p not in touched], out.select(*claims.columns)))
        return gone.select("id")

    def ratchet(self, table: str, candidate: DataFrame, matched: str) -> bool:
        """Publish a candidate only if it has no fewer rows that fulfil ``matched``."""
        before = self.read(table).filter(matched).count() if self.current(table) else 0
        if candidate.filter(matched).count() < before:
            return False
        self.publish(table, candidate)
        return True

    def commit(self, rows: DataFrame, name: str, payload: str, commit_id: int, parent: int | None) -> None:
        """Save objects by their SHA-256, new ones only, and a manifest (name, hash) of all, in one version."""
        hashed = rows.select(F.col(name).alias("name"), F.sha2(payload, 256).alias("hash"), F.col(payload).alias("payload"))
        manifest = hashed.select(F.lit(commit_id).cast("long").alias("commit_id"), F.lit(parent).cast("long").alias("parent"), "name", "hash")
        self._publish(self._missing("objects", hashed.select("hash", "payload"), ["hash"]), self._added("manifests", manifest, ["commit_id", "name"]))

    def hydrate(self, commit_id: int) -> DataFrame:
        """name, payload of a commit; a missing object or a payload that isn't its hash raises."""
        rows = self.read("manifests").filter(F.col("commit_id") == commit_id).join(self.read("objects"), "hash", "left")
        _refuse_any(rows.filter("payload IS NULL OR sha2(payload, 256) <> hash").select("name"), "objects missing or damaged")
        return rows.select("name", "payload")

    def compact(self, keep: DataFrame) -> int:
        """Drop commits that aren't in ``keep`` (commit_id) and objects that no other commit needs. Returns the objects left."""
        seen = {table: self.current(table) for table in ("objects", "manifests")}
        manifests, objects = self.read("manifests").join(keep, "commit_id", "left_semi"), self.read("objects")
        used = objects.join(manifests.select("hash").distinct(), "hash", "left_semi")
        _refuse_any(manifests.join(used, "hash", "left_anti").select("name"), "kept commits would lose objects")
        self._publish(Change("objects", seen["objects"], [], used), Change("manifests", seen["manifests"], [], manifests))
        return self.read("objects").count()

    def import_job(self, table: str, rows: DataFrame, id_col: str, job: str) -> bool:
        """Append a worker's rows under new ids, once for each job; returns whether it was new. Rows and receipt are one
        version, so a writer that dies has left both or neither, and of two that import a job at once one is refused."""
        receipt = self._missing("receipts", self.spark.createDataFrame([(job,)], "job string"), ["job"])
        if receipt.fresh.isEmpty():
            return False
        now = self.current(table)
        top = self._rows(table, now).agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0] if now else 0
        ranked = numbered(rows, [F.asc(id_col)], "_n")
        self._publish(Change(table, now, now or [], ranked.withColumn(id_col, F.col("_n") + top + 1).select(*rows.columns)), receipt)
        return True

    def import_jobs(self, table: str, rows: DataFrame, id_col: str, job_col: str) -> None:
        """Append what many workers made, under new ids in the order of jobs and of ids within a job, whatever the order in
        which the workers ended. A job is imported once: the table itself, which keeps the job of each row, is the receipt."""
        now = self.current(table)
        top = 0
        if now is not None:
            old = self._rows(table, now)
            rows = rows.join(old.select(job_col).distinct(), job_col, "left_anti")
            top = old.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
        ranked = numbered(rows, [F.asc(job_col), F.asc(id_col)], "_n")
        self._publish(Change(table, now, now or [], ranked.withColumn(id_col, F.col("_n") + top + 1).drop("_n")))


def new_rows(log: DataFrame, mark: int, id_col: str = "id") -> DataFrame:
    """Rows beyond a high-water mark."""
    return log.filter(F.col(id_col) > mark)


def retained(commits: DataFrame, newest: int, pinned: DataFrame) -> DataFrame:
    """commit_id of the newest commits, the last of each day (id, created timestamp) and pinned ones."""
    top = commits.orderBy(F.desc("commit_id")).limit(newest).select("commit_id")
    daily = commits.groupBy(F.to_date("created").alias("day")).agg(F.max_by("commit_id", F.struct("created", "commit_id")).alias("commit_id")).select("commit_id")
    return top.union(daily).union(commits.join(pinned, "commit_id", "left_semi").select("commit_id")).distinct()
