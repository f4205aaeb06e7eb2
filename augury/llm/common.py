"""Reading tables, writing intermediate ones, and the shared text rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.functions.cut import shared_folder

BLANKS = " \t\n\x0b\x0c\r"  # x20 and x09 to x0D; bytes.split() without argument splits at exactly these

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a query of this subpackage and, where SQL can express it, its SQL."""

    def add(fn):
        QUERIES[name] = fn
        if check is not None:
            ORACLES[name] = check
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh name below the folder all executors share."""
    return f"{shared_folder(spark)}/llm-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write rows once as Parquet in the shared folder and go on from the files: cuts lineage, keeps
    column pruning, survives lost executors."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """Rows dealt by ranges of the columns, a million or so to a partition however many there are."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // 1_000_000))
    return df.repartitionByRange(parts, *columns)


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; such rows never teach a model. Null ids: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def clear_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): one row per labelled document; ids whose rows contradict each other, and null
    ids or labels, are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
        .where(F.col("label") == F.col("other"))
        .drop("other")
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], seed: int) -> DataFrame:
    """(doc_id, text, label, draw): at most per_class[label] labelled documents of each class that are not
    held out, taken in the order of a hash of the id, with their whole texts. draw, the hash, lies in [0, 1).

    The ids are few by parameter, so they are broadcast; the texts never pass through the driver."""
    rows = clear_labels(labels, label).where(~held_out(F.col("doc_id")))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    rows = rows.withColumn("draw", draw)
    picked = None
    for value, n in per_class.items():
        own = rows.where(F.col("label") == value).orderBy("draw", "doc_id").limit(n)
        picked = own if picked is None else picked.unionByName(own)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return written(texts.join(F.broadcast(picked), "doc_id"), "sample")
