"""Keeping a corpus of code up to date: only new and changed files are parsed again.

A snapshot holds the files, what extraction found in each, and the edges. A refresh takes over what belongs to unchanged
files and parses the rest. If no file came or went and what the changed ones offer to others (definitions, exports,
imports) is as before, only their own names are resolved again; else names are resolved over the whole, as a new
definition may change what any file's names mean. Either way a refresh equals a rebuild.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.corpus import Corpus
from quillgraph.operators.java_types import packages
from quillgraph.operators.workspace import MANIFEST
from quillgraph.plans.shared import cut, fresh_path
from quillgraph.sources import code

#: Files whose text other files' names depend on, beyond what is extracted.
FAR_TEXT = MANIFEST + r"|\.d\.ts$|\.go$|\.rs$"


@dataclass(frozen=True)
class Snapshot:
    """``edges``: those that are known already (resolved with the corpus if None)."""

    files: DataFrame
    nested: DataFrame
    edges: DataFrame | None = None

    @cached_property
    def corpus(self) -> Corpus:
        return code.corpus(self.files, self.nested, self.edges)


def snapshot(files: DataFrame) -> Snapshot:
    """Parses everything."""
    files = cut(files)
    return Snapshot(files, cut(code.extracted(files)))


def _offered(nested: DataFrame, files: DataFrame) -> DataFrame:
    """(path, offers): what others may take from a file: definitions, exports, imports, the package of Java, and whether it parsed cleanly."""
    imports = F.array_sort(F.transform(F.filter("raw", lambda x: x["kind"] == "imports"), lambda x: x["to_name"]))
    p = packages(files).withColumnRenamed("file", "path")
    return nested.join(p, "path", "left").select("path", F.to_json(F.struct("symbols", "exports", imports.alias("imports"), "package", "diagnostics")).alias("offers"))


def applied(before: Snapshot, files: DataFrame) -> Snapshot:
    """The snapshot of ``files``, with unchanged files taken over from the one before (by path, language and hash)."""
    files = cut(files)
    keys = ["path", "language", "hash"]
    same = cut(files.select(*keys).join(before.files.select(*keys), keys, "left_semi").select("path"))
    if same.isEmpty():
        return Snapshot(files, cut(code.extracted(files)))
    kept = before.nested.join(same, "path", "left_semi")
    fresh = files.join(same, "path", "left_anti")
    nested = cut(kept.unionByName(code.extracted(fresh)))
    touched = cut(fresh.select("path"))
    moved = files.select("path").join(before.files.select("path"), "path", "left_anti").unionAll(before.files.select("path").join(files.select("path"), "path", "left_anti"))
    if not touched.filter(F.col("path").rlike(FAR_TEXT)).isEmpty() or not moved.isEmpty():
        return Snapshot(files, nested)
    old, new = (_offered(n.join(touched, "path", "left_semi"), f.join(touched, "path", "left_semi")) for n, f in ((before.nested, before.files), (nested, files)))
    if not old.join(new, ["path", "offers"], "left_anti").unionByName(new.join(old, ["path", "offers"], "left_anti")).isEmpty():
        return Snapshot(files, nested)
    from quillgraph.operators import resolve

    again = touched.withColumnRenamed("path", "file")
    rest = before.corpus.edges.join(again.withColumnRenamed("file", "from_file"), "from_file", "left_anti").select(before.corpus.edges.columns)
    own = resolve.resolved(code.parsed(files, nested), again)
    return Snapshot(files, nested, cut(rest.unionByName(own)))


TABLES = ("files", "symbols", "edges", "routes")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def saved(corpus: Corpus, folder: str, keep: int = 2) -> str:
    """Publishes the tables below ``folder`` and returns the folder of this version.

    Tables go to a folder of their own, their counts and digest with them; then a pointer of one small file is written
    beside the others. The greatest pointer counts, so readers see the old version or the new one, whatever fails in
    between. Of published versions the last ``keep`` stay."""
    spark = corpus.spark
    pointers = f"{folder}/pointers"
    old = sorted(r["version"] for r in spark.read.schema("version string").json(pointers).distinct().collect()) if _there(spark, pointers) else []
    number = int(old[-1].split("-")[0]) + 1 if old else 1
    version = f"{number:012d}-{uuid.uuid4().hex}"
    place = f"{folder}/versions/{version}"
    for name in TABLES:
        df = getattr(corpus, name)
        if df is not None:
            df.write.parquet(f"{place}/{name}")
    # The digest is of what was written, not of the plan that it came from.
    written(spark, place).generation().write.parquet(f"{place}/generation")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(pointers)
    for gone in old[: len(old) + 1 - keep]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions/{gone}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return place


def written(spark: SparkSession, place: str) -> Corpus:
    """The tables of one version."""
    return Corpus(*(spark.read.parquet(f"{place}/{name}") for name in TABLES[:3]), spark.read.parquet(f"{place}/routes") if _there(spark, f"{place}/routes") else None)


def loaded(spark: SparkSession, folder: str) -> Corpus:
    """The version that was published last; fails if its tables don't have the digest they were published with."""
    if not _there(spark, f"{folder}/pointers"):
        raise FileNotFoundError(f"{folder} holds no snapshot")
    version = spark.read.schema("version string").json(f"{folder}/pointers").agg(F.max("version")).first()[0]
    place = f"{folder}/versions/{version}"
    c = written(spark, place)
    if c.generation().first() != spark.read.parquet(f"{place}/generation").first():
        raise ValueError(f"{place} isn't what was published")
    return c


def latest(batch: DataFrame) -> DataFrame:
    """(path, content, deleted): of each path the row with the greatest ``sequence``; of equal ones a deletion, then the greatest content."""
    gone = F.coalesce("deleted", F.lit(False))
    one = batch.filter("path is not null").groupBy("path").agg(F.max_by(F.struct("content", gone.alias("deleted")), F.struct("sequence", gone, F.coalesce("content", F.lit(b"")))).alias("x"))
    return one.select("path", "x.content", "x.deleted")


def followed(contents: DataFrame, publish: Callable[[Corpus, int], None], state: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Follows a stream of contents (path, content, deleted, sequence): after each batch ``publish`` gets the corpus.

    Of a path's rows in a batch the one with the greatest ``sequence`` counts; batches come in order. The state between
    batches is written to ``state`` in the shared folder, so a restarted query goes on from there; a batch that is run
    again writes its own state anew from the one before."""
    spark = contents.sparkSession
    state = state or fresh_path(spark, "refresh")

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new = cut(latest(batch))
        files = code.files_of(new.filter("not deleted").select("path", "content"))
        before = f"{state}/{number - 1}"
        if number == 0:
            now = snapshot(files)
        else:
            old = Snapshot(*(session.read.parquet(f"{before}/{name}") for name in ("files", "nested", "edges")))
            now = applied(old, old.files.join(new.select("path"), "path", "left_anti").unionByName(files))
        for name, table in (("files", now.files), ("nested", now.nested), ("edges", now.corpus.edges)):
            table.write.mode("overwrite").parquet(f"{state}/{number}/{name}")
        publish(now.corpus, number)

    return contents.writeStream.foreachBatch(step).option("checkpointLocation", f"{state}/progress").trigger(**(trigger or {"availableNow": True})).start()
