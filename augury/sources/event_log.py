"""Append-only logs: rows become visible by a manifest, never by lying in a folder.

A commit writes its rows to a folder of its own and then a manifest that names the folder.  Readers follow
the manifests alone, so rows of a job that died half way are invisible, and nothing that was visible is
ever overwritten.  A commit has an id given by its writer; doing it again changes nothing, which makes
replayed micro-batches and repeated jobs safe.  Should two writers race for one id, the smaller folder name
counts for every reader.

The driver holds one short row for each live commit.  ``compact`` replaces all live commits by one, whose
manifest names what it replaces, so their number stays bounded under a long stream.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

MANIFEST = "commit string, folder string, schema string, replaces array<string>"


@dataclass(frozen=True)
class EventLog:
    spark: SparkSession
    path: str
    schema: StructType | str  # of the rows, extra columns of a commit are left out

    @property
    def fields(self) -> StructType:
        return StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema

    def manifests(self) -> DataFrame:
        """(commit, folder, schema, replaces), one row for each commit that counts."""
        try:
            stored = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifests/*")
        except AnalysisException:  # no commit yet
            return self.spark.createDataFrame([], MANIFEST)
        return stored.groupBy("commit").agg(F.min_by(F.struct("folder", "schema", "replaces"), "folder").alias("m")).select("commit", "m.*")

    def live(self) -> dict[str, str]:
        """Folder of each commit that no other one replaces."""
        rows = self.manifests().select("commit", "folder", "replaces").collect()
        gone = {c for r in rows for c in r["replaces"] or ()}
        return {r["commit"]: r["folder"] for r in rows if r["commit"] not in gone}

    def knows(self, commit: str) -> bool:
        """Whether a commit was made, replaced ones included."""
        return not self.manifests().filter(F.col("commit") == commit).isEmpty()

    def stage(self, rows: DataFrame) -> str:
        """Write rows to a folder no reader looks at yet."""
        folder = f"rows/{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.fields]).write.parquet(f"{self.path}/{folder}")
        return folder

    def publish(self, commit: str, folder: str, replaces: list[str] | None = None) -> None:
        """Make a staged folder visible."""
        row = [(commit, folder, self.fields.simpleString(), replaces or [])]
        # The manifest's file appears as a whole when its one task commits.
        manifest = self.spark.createDataFrame(row, MANIFEST).coalesce(1)
        manifest.write.json(f"{self.path}/manifests/{uuid.uuid4().hex}")

    def commit(self, rows: DataFrame, commit: str) -> bool:
        """Append rows under an id; False, and no change, if the id was committed before."""
        if self.knows(commit):
            return False
        self.publish(commit, self.stage(rows))
        return True

    def read(self) -> DataFrame:
        """All visible rows with ``commit``, the id that brought them (a compaction's own id after one)."""
        live = self.live()
        none = self.spark.createDataFrame([], self.schema).withColumn("commit", F.lit(""))
        if not live:
            return none
        names = self.spark.createDataFrame([(f.removeprefix("rows/"), c) for c, f in live.items()], "folder string, commit string")
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in live.values()])
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        return rows.withColumn("folder", folder).join(F.broadcast(names), "folder").drop("folder")

    def compact(self, files: int | None = None) -> None:
        """Put all live commits in one; readers see the same rows before, meanwhile and after."""
        live = self.live()
        if len(live) < 2:
            return
        rows = self.read().drop("commit")
        folder = self.stage(rows.coalesce(files) if files else rows)
        self.publish(f"compacted-{uuid.uuid4().hex}", folder, sorted(live))


def append_stream(frame: DataFrame, log: EventLog, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Every micro-batch is a commit named by its checkpoint and number.

    A batch replayed after a crash is found committed.  A query started anew from a lost checkpoint is
    another writer: its batches may have other borders, so its rows come again and readers keep one row
    for each key (``tables.dedupe_receipts`` and the like); no border loses a row.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        log.commit(batch, f"{run}-{number}")

    writer = frame.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


REGISTRY = "kind string, version string, body string"


def register_model(registry: EventLog, version: str, model: DataFrame, evaluations: DataFrame) -> bool:
    """Register a model (one row) together with its evaluation runs: readers see all of it or nothing.

    False, and no change, if the version is registered with the same description; another one is an error.
    """
    body = F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body")
    described = model.select(F.lit("model").alias("kind"), F.lit(version).alias("version"), body)
    known = registry.read().filter((F.col("kind") == "model") & (F.col("version") == version)).select("body").first()
    if known is not None:
        if known["body"] != described.first()["body"]:
            raise ValueError(f"version differs from its registration: {version}")
        return False
    runs = evaluations.select(F.lit("evaluation").alias("kind"), F.lit(version).alias("version"), body)
    return registry.commit(described.unionByName(runs), f"model-{version}")


def registered(registry: EventLog, kind: str, schema: str) -> DataFrame:
    """Rows of one kind ('model', 'evaluation') with their version, parsed."""
    rows = registry.read().filter(F.col("kind") == kind)
    return rows.select(F.col("version").alias("registered_version"), F.from_json("body", schema).alias("b")).select("registered_version", "b.*")
