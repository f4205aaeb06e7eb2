"""Running totals and positions over one global order without a single-task window."""

from __future__ import annotations

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.functions.cut import checkpointed


def _buckets(df: DataFrame, value: str, count: int) -> DataFrame:
    """Equal-depth ranges of ``value``; their limits are the only thing the driver sees."""
    finder = QuantileDiscretizer(
        numBuckets=count, inputCol=value, outputCol="__b", relativeError=0.01, handleInvalid="keep"
    )
    return finder.fit(df).transform(df)


def running_totals(
    df: DataFrame,
    value: str,
    sums: dict[str, str],
    *,
    groups: list[str] | None = None,
    descending: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """Running sums by distinct ``value``; ``df`` holds one row per (group, value).

    Rows are spread over value ranges, summed within each range and shifted by the totals of the
    ranges before it; the per-range totals are ``buckets`` rows per group.
    """
    groups = groups or []
    count = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The ranges are found with an extra pass, so the input is kept instead of computed again.
    ranged = _buckets(checkpointed(df), value, count)
    order = F.col(value).desc() if descending else F.col(value).asc()
    range_order = F.col("__b").desc() if descending else F.col("__b").asc()
    local = Window.partitionBy(*groups, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = (
        Window.partitionBy(*(groups or [F.lit(0)]))
        .orderBy(range_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = ranged.groupBy(*groups, "__b").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    shifts = totals.select(
        *groups, "__b", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in sums]
    )
    scanned = ranged
    for n, c in sums.items():
        scanned = scanned.withColumn(f"__s_{n}", F.sum(c).over(local))
    out = scanned.join(shifts, [*groups, "__b"])
    for n in sums:
        out = out.withColumn(n, F.col(f"__s_{n}") + F.col(f"__c_{n}"))
    return out.drop("__b", *[f"__s_{n}" for n in sums], *[f"__c_{n}" for n in sums])


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Position of every row in one global order (from 1), without a single-task window.

    The sorted rows are written once; a row's position is its offset in its own partition plus
    the sizes of the partitions before it.
    """
    placed = checkpointed(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    # monotonically_increasing_id: partition in the upper bits, offset in the lower 33.
    part, offset = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("__p", part).withColumn("__o", offset)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy("__p")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    )
    return (
        placed.join(shifts, "__p")
        .withColumn(name, F.col("__shift") + F.col("__o") + 1)
        .drop("__m", "__p", "__o", "__shift")
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts each map task to ``n`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """Newest row of each key as one partial aggregate instead of a sort."""
    rest = [c for c in (columns or df.columns) if c not in keys]
    packed = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])
