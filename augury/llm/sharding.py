"""Sharding by a consistent-hash ring with bounded loads.

Every shard owns points on a ring; a key starts at the first point clockwise of its hash.  Keys come in
the order of a second hash.  A shard takes rows until it is full, and a key that finds it full continues
clockwise.  Capacities add up to the rows (each shard floor(n / shards), and the first few one more), so
row counts differ by one at most, while most keys stay where the plain ring puts them.

Nothing is placed one by one.  A shard that fills up does so at one moment in the order of keys;
before that moment it takes all rows that reach it, afterwards none.  All keys of one arc of the ring walk
through the same shards.  The moments follow from counts per (arc, slice of the order): a table of bounded
size, whatever the number of rows.  The slice in which a shard fills up is counted again in finer
slices until it holds so few rows that they can be placed one by one (or until the moment is exact).

Rows only, no Python in the tasks.  Defined cases: the text of a null counts no bytes, so its size is 1 and its
checksum 0; a null doc_id is a key like any other; rows with one doc_id start at one point and follow each
other in the order; a text of any length counts its bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.llm.common import query, table, written

ORDER_BITS = 62  # the order of keys is a number of so many bits
SLICE_BITS = 6  # a count splits a range of the order into 64 slices, so 65,536 counts for 1,024 arcs
AT_ONCE = 65_536  # rows of a slice that are placed one by one on the driver


@dataclass(frozen=True)
class Params:
    shards: int = 16
    points: int = 64  # ring points of a shard: more of them move fewer rows when a shard is added


def _hash(seed: int, *cols) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 2)


def ring(spark, params: Params) -> list[tuple[int, int]]:
    """(position, shard) of all ring points, in order."""
    points = spark.range(params.shards * params.points)
    shard = (F.col("id") / params.points).cast("int")
    rows = points.select(_hash(7, F.col("id")).alias("at"), shard.alias("shard")).collect()
    return sorted((r["at"], r["shard"]) for r in rows)


def walks(points: list[tuple[int, int]]) -> list[list[int]]:
    """For the arc that ends at each point, the shards clockwise from there, each once."""
    out = []
    for i in range(len(points)):
        around = [s for _, s in points[i:] + points[:i]]
        out.append(list(dict.fromkeys(around)))
    return out


def numbers(values) -> Column:
    """A constant array of longs, written as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def arc_of(position: Column, points: list[tuple[int, int]]) -> Column:
    """Number of the first point at or after a position, by halving steps through the sorted points."""
    at, n = numbers(p for p, _ in points), len(points)
    steps = numbers(1 << i for i in reversed(range(n.bit_length())))
    further = lambda low, step: F.when(F.get(at, (low + step - 1).cast("int")) < position, low + step).otherwise(low)
    return F.aggregate(steps, F.lit(0).cast("long"), further) % n


class Filling:
    """The moment each shard is full, found slice by slice.

    A moment is a pair (order, row): rows before it were accepted."""

    def __init__(self, keys: DataFrame, walks: list[list[int]], room: list[int]):
        self.keys, self.walks, self.room = keys, walks, list(room)
        self.full: dict[int, tuple[int, int]] = {s: (0, 0) for s, r in enumerate(room) if r == 0}
        self.value = 0  # the place in the order whose rows are being counted

    def target(self, arc: int) -> int:
        return next(s for s in self.walks[arc] if s not in self.full)

    def run(self) -> dict[int, tuple[int, int]]:
        self._range("order", 0, ORDER_BITS, None)
        return self.full

    def _range(self, column: str, start: int, bits: int, within: Column | None) -> None:
        """Go through a range of the order in slices; refine those in which a shard fills up."""
        step = max(0, bits - SLICE_BITS)
        rows = self.keys if within is None else self.keys.where(within)
        mine = rows.where((F.col(column) >= start) & (F.col(column) < start + (1 << bits)))
        counts = mine.groupBy("arc", F.shiftright(F.col(column) - start, step).alias("slice")).count().collect()
        by_slice: dict[int, dict[int, int]] = {}
        for r in counts:
            by_slice.setdefault(r["slice"], {})[r["arc"]] = r["count"]
        for number in sorted(by_slice):
            self._slice(column, start + (number << step), step, within, by_slice[number])

    def _slice(self, column: str, start: int, bits: int, within: Column | None, arcs: dict[int, int]) -> None:
        need: dict[int, int] = {}  # by shard
        for arc, n in arcs.items():
            need[self.target(arc)] = need.get(self.target(arc), 0) + n
        if all(n <= self.room[s] for s, n in need.items()):
            for s, n in need.items():
                self.room[s] -= n
                if self.room[s] == 0:
                    end = start + (1 << bits)
                    self.full[s] = (end, 0) if column == "order" else (self.value, end)
        elif sum(arcs.values()) <= AT_ONCE:
            self._one_by_one(column, start, bits, within)
        elif bits > 0:
            self._range(column, start, bits, within)
        else:  # rows of one place in the order follow each other by row number
            self.value = start
            self._range("row", 0, ORDER_BITS, F.col("order") == start)

    def _one_by_one(self, column: str, start: int, bits: int, within: Column | None) -> None:
        rows = self.keys if within is None else self.keys.where(within)
        mine = rows.where((F.col(column) >= start) & (F.col(column) < start + (1 << bits)))
        for order, row, arc in sorted(tuple(r) for r in mine.select("order", "row", "arc").collect()):
            shard = self.target(arc)
            self.room[shard] -= 1
            if self.room[shard] == 0:
                self.full[shard] = (order, row + 1)


def shard_of(arc: Column, order: Column, row: Column, walks: list[list[int]], full: dict[int, tuple[int, int]]) -> Column:
    """The first shard of the arc's walk that is not yet full at the key's turn."""
    shards = sorted(walks[0])
    orders, rows = (numbers(full[s][i] for s in shards) for i in (0, 1))
    way = F.slice(numbers(s for w in walks for s in w), (arc * len(shards) + 1).cast("int"), len(shards))
    moment = lambda s: (F.get(orders, s.cast("int")), F.get(rows, s.cast("int")))
    is_open = lambda s: (order < moment(s)[0]) | ((order == moment(s)[0]) & (row < moment(s)[1]))
    return F.get(F.filter(way, is_open), F.lit(0)).cast("int")


def bounded_shards(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs."""
    spark = docs.sparkSession
    points = ring(spark, params)
    around = walks(points)
    text = F.coalesce("text", F.lit(""))
    keys = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        arc_of(_hash(11, F.col("doc_id")), points).alias("arc"),
        _hash(13, F.col("doc_id")).alias("order"),
        F.monotonically_increasing_id().alias("row"),
    )
    keys = written(keys, "keys")
    n = keys.count()
    room = [n // params.shards + (s < n % params.shards) for s in range(params.shards)]
    if n == 0:
        return keys.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    full = Filling(keys, around, room).run()
    placed = keys.withColumn("shard", shard_of(F.col("arc"), F.col("order"), F.col("row"), around, full))
    return numbered(placed)


def numbered(placed: DataFrame) -> DataFrame:
    """Slots of a shard: the rows of each input partition are numbered on their own and start where
    those of the partitions before end, so no task sees more of a shard than one partition held."""
    placed = placed.withColumn("part", F.shiftright("row", 33))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("k"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("row")
    rows = placed.withColumn("inside", F.row_number().over(inside) - 1).join(starts, ["shard", "part"])
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"))


@query("op4_bounded_ring")
def op4_bounded_ring(spark, sf_dir):
    placed = bounded_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
