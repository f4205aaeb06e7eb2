"""Reading range-query documents, and keeping tables: upsert, insert-once, partitioned, datasets."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.functions.clock import micros
from augury.functions.cut import shared_folder
from augury.functions.ranked import latest_per_key

MATRIX_SCHEMA = (
    "status string, data struct<resultType:string, result:array<struct<"
    "metric:map<string,string>, `values`:array<array<string>>>>>"
)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def parse_matrix(docs: DataFrame, column: str = "document") -> DataFrame:
    return docs.withColumn("__d", F.from_json(F.col(column), MATRIX_SCHEMA))


def matrix_valid() -> Column:
    d = F.col("__d")
    return F.coalesce(
        (d["status"] == "success") & (d["data"]["resultType"] == "matrix") & d["data"]["result"].isNotNull()
        & F.forall(d["data"]["result"], lambda s: s.isNotNull()),
        F.lit(False),
    )


def matrix_flatten(docs: DataFrame, column: str = "document") -> DataFrame:
    """Range-query documents to rows; rejected documents contribute nothing here."""
    parsed = parse_matrix(docs, column).filter(matrix_valid())
    series = parsed.select(F.explode("__d.data.result").alias("s"))
    points = series.select(F.col("s.metric").alias("labels"), F.explode("s.values").alias("v"))
    at = F.col("v")[0].try_cast("double")
    return points.select(
        "labels",
        F.timestamp_micros(F.round(at * 1_000_000).cast("bigint")).alias("ts"),
        F.col("v")[1].try_cast("double").alias("value"),
    )


def matrix_rejected(docs: DataFrame, column: str = "document") -> DataFrame:
    """Documents that are no successful range query."""
    return parse_matrix(docs, column).filter(~matrix_valid()).drop("__d")


def service_map_join(frame: DataFrame, service_map: DataFrame) -> DataFrame:
    """Attach the service job; Spark broadcasts the dimension only while it is small."""
    return frame.join(service_map, "host_id", "left")


def host_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge host rows: newest description, widest seen span."""
    both = existing.unionByName(incoming)
    return (
        both.groupBy("host_id")
        .agg(
            F.max_by(F.struct("name", "environment", "service_job"), "last_seen").alias("d"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
        )
        .select("host_id", "d.*", "first_seen", "last_seen")
    )


def append_once(existing: DataFrame, incoming: DataFrame, keys: list[str], prefer: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is new; of equal keys within the batch the smallest wins."""
    fresh = incoming.join(existing.select(*keys), keys, "left_anti")
    rest = [c for c in fresh.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), F.struct(*prefer)).alias("__row")
    return fresh.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def write_partitioned(frame: DataFrame, path: str, ts: str) -> None:
    """One folder per day; rows of a day are written by several tasks."""
    frame.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def snapshot_as_of(frames: list[tuple[DataFrame, str]], as_of: Column) -> list[DataFrame]:
    """The same cutoff for every input, so later rows stay invisible everywhere."""
    return [frame.filter(F.col(ts) <= as_of) for frame, ts in frames]


def canonical_rows(frame: DataFrame) -> DataFrame:
    """One JSON text per row: sorted keys, UTC micros for instants, nulls kept."""
    fields = []
    for name in sorted(frame.columns):
        kind = dict(frame.dtypes)[name]
        fields.append(micros(name).alias(name) if kind == "timestamp" else F.col(name))
    return frame.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def content_digest(frame: DataFrame, text: Column) -> DataFrame:
    """Order-independent digest of a table.

    Row hashes are cut into lanes and summed, which combines partially on every task; the digest
    is the hash of row count and lane sums.  Equal multisets of rows give equal digests.
    """
    hashed = frame.select(F.sha2(text, 256).alias("h"))
    lanes = [
        F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(4)
    ]
    total = hashed.agg(F.count(F.lit(1)).alias("n"), *lanes)
    zero = F.lit(0).cast("decimal(38,0)")
    parts = [F.coalesce(F.col(f"l{i}"), zero).cast("string") for i in range(4)]
    return total.select(F.col("n").alias("row_count"), F.sha2(F.concat_ws("~", F.col("n"), *parts), 256).alias("digest"))


def dataset_digest(samples: DataFrame, healthy: DataFrame, identity: str) -> str:
    """Digest over both parts and the build identity, each kept apart by a name."""
    parts = [
        content_digest(canonical_rows(frame), F.concat(F.lit(f"{name}~"), F.col("value")))
        for name, frame in (("samples", samples), ("healthy", healthy))
    ]
    digests = reduce(DataFrame.unionByName, [d.withColumn("part", F.lit(i)) for i, d in enumerate(parts)])
    rows = sorted((r["part"], r["digest"]) for r in digests.collect())  # two rows
    spark = samples.sparkSession
    joined = "~".join([d for _, d in rows] + [identity])
    return spark.range(1).select(F.sha2(F.lit(joined), 256)).first()[0]


def write_dataset(samples: DataFrame, healthy: DataFrame, identity: str, root: str) -> str:
    """Write both parts below a folder named by their digest; an existing folder must agree."""
    spark = samples.sparkSession
    digest = dataset_digest(samples, healthy, identity)
    target = f"{root.rstrip('/')}/{digest[:16]}"
    try:
        stored = spark.read.text(f"{target}/report").first()["value"]
    except AnalysisException:
        stored = None
    report = f'{{"digest": "{digest}", "identity": "{identity}"}}'
    if stored is not None:
        if stored != report:
            raise ValueError("dataset folder holds another identity")
        return target
    # The report is written last: a folder without it is incomplete, never read, and written again.
    canonical_rows(samples).write.mode("overwrite").text(f"{target}/samples")
    canonical_rows(healthy).write.mode("overwrite").text(f"{target}/healthy")
    spark.range(1).select(F.lit(report).alias("value")).coalesce(1).write.mode("overwrite").text(f"{target}/report")
    return target


def read_dataset(spark: SparkSession, path: str, part: str, schema) -> DataFrame:
    """Read a part back; instants were stored as micros."""
    stored = [(f.name, "bigint" if f.dataType.typeName() == "timestamp" else f.dataType.simpleString()) for f in schema]
    ddl = ", ".join(f"`{n}` {t}" for n, t in stored)
    parsed = spark.read.text(f"{path}/{part}").select(F.from_json("value", ddl).alias("r")).select("r.*")
    return parsed.select(
        *[
            F.timestamp_micros(f.name).alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name)
            for f in schema
        ]
    )


def registry_append(registry: DataFrame, candidates: DataFrame, describing: list[str]) -> DataFrame:
    """Registry plus new versions; a known version with another description fails the job."""
    known = registry.select("version", F.struct(*describing).alias("__known"))
    message = F.concat(F.lit("version differs from its registration: "), F.col("version"))
    # Decided after the join, where both descriptions are present.
    is_new = (
        F.when(F.col("__known").isNull(), F.lit(True))
        .when(F.col("__known").eqNullSafe(F.struct(*describing)), F.lit(False))
        .otherwise(F.raise_error(message).cast("boolean"))
    )
    fresh = candidates.join(known, "version", "left").filter(is_new)
    return registry.unionByName(fresh.select(*registry.columns))


def registry_conflicts(registry: DataFrame, candidates: DataFrame, describing: list[str]) -> DataFrame:
    known = registry.select("version", F.struct(*describing).alias("__known"))
    return (
        candidates.withColumn("__new", F.struct(*describing))
        .join(known, "version")
        .filter(~F.col("__known").eqNullSafe(F.col("__new")))
        .drop("__known", "__new")
    )


def dedupe_receipts(receipts: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """First receipt per usable idempotency key, unless history has the key already."""
    usable = receipts.filter(F.length("idempotency_key").between(1, 128))
    rest = [c for c in receipts.columns if c != "idempotency_key"]
    first = (
        usable.groupBy("idempotency_key")
        .agg(F.min_by(F.struct(*rest), F.struct("received_at", "receipt_id")).alias("r"))
        .select("idempotency_key", *[F.col(f"r.{c}").alias(c) for c in rest])
    )
    if history is not None:
        first = first.join(history.select("idempotency_key"), "idempotency_key", "left_anti")
    return first


def retention_prune(frame: DataFrame, ts: str, newest: Column, days: int = 7) -> DataFrame:
    return frame.filter(micros(ts) > micros(newest) - F.lit(days * 86_400_000_000))


def recent(frame: DataFrame, created: str, key: str, limit: int = 100, **equals) -> DataFrame:
    """Newest rows, ties by descending key; a top-n, not a full sort."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    for name, value in equals.items():
        frame = frame.filter(F.col(name) == value)
    return frame.orderBy(F.col(created).desc(), F.col(key).desc()).limit(limit)


def redact(frame: DataFrame, *private: str) -> DataFrame:
    return frame.drop(*private)

