"""Near-duplicate documents by HyperMinHash.

A document's shingle hashes fall into buckets; of each bucket the smallest value is kept as a 16-bit
register: its number of leading zeros (6 bits) and the 10 bits that follow.  Equal texts are one class.
Bands of seven registers propose candidates; registers also estimate the similarity of a candidate pair,
corrected for registers that agree by chance, and pairs far below the limit go no further.  What remains
is confirmed on the full sets.

A group of copies is not expanded into its pairs.  In each bucket the most central member (the one that
shares most buckets with others) stands for it, and a document is compared with the few centres it
meets most often, which links most of a group.  Then only members of one bucket that lie in different
components are left.  Exact upper bounds on the shingles two of them can share remove nearly all of
these before they become pairs, and no link is lost by it:

- shingles of a document that no other candidate has (``n - most``) are in no intersection;
- of documents x and y compared with one centre, at most the smaller of their overlaps with it can be
  shared inside the centre, and outside it at most the smaller of their other shared shingles.

Defined cases: null or blank texts have no shingle and are linked with nothing; a document with fewer
words than a shingle has one; rows with one doc_id are one document; rows without doc_id are linked with nothing
and kept; a very long text's set is built whole in one task; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm.common import query, table, written
from augury.llm.components import components
from augury.llm.shingles import SIZE, Words, mixed, shingle_set

MANTISSA = 10


@dataclass(frozen=True)
class Params:
    """limit: percent of similarity.  A pair at 80 % shares none of 40 bands of 7 registers once in
    12,000 times, at 85 % once in 5,000,000 times; one at 40 % shares a band once in 15 times.
    spread: standard deviations below the limit at which the estimate alone rejects a pair.  centres: how
    many central members a document is compared with first; any number gives the same result."""

    limit: int = 80
    size: int = SIZE
    bands: int = 40
    rows: int = 7
    spread: float = 6.0
    centres: int = 3

    @property
    def registers(self) -> int:
        return self.bands * self.rows


EMPTY = np.uint64(2**64 - 1)


def minima(hashes: np.ndarray, m: int) -> np.ndarray:
    """Smallest value of each bucket."""
    low = np.full(m, EMPTY)
    bucket = ((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
    np.minimum.at(low, bucket.astype(np.int64), mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)))
    return low


def registers(low: np.ndarray) -> np.ndarray:
    """16-bit registers of bucket minima; 0 is an empty bucket."""
    zeros = np.clip(64 - np.frexp(low.astype(np.float64))[1], 0, 62).astype(np.uint64)
    after = (low << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return np.where(low == EMPTY, 0, (zeros << np.uint64(MANTISSA)) + after + np.uint64(1)).astype("<u2")


def filled(regs: np.ndarray) -> np.ndarray:
    """Register rows in which every empty register borrows from a filled one.

    Register i tries the same pseudo-random places in every document, so short documents agree on a
    register as often as their sets agree.  Rows without any filled register stay empty."""
    out, m = regs.copy(), regs.shape[1]
    row, column = np.nonzero((regs == 0) & (regs > 0).any(axis=1)[:, None])
    start = column.astype(np.uint64)
    while len(row):
        start = mixed(start + np.uint64(0x9E3779B97F4A7C15))
        place = (start % np.uint64(m)).astype(np.int64)
        lent = regs[row, place]
        out[row, column] = lent
        left = lent == 0
        row, column, start = row[left], column[left], start[left]
    return out


def band_keys(regs: np.ndarray, params: Params) -> np.ndarray:
    """A key for each band of register rows."""
    parts = filled(regs).reshape(len(regs), params.bands, params.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(params.bands, dtype=np.uint64), parts.shape[:2])
    for k in range(params.rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimate of register rows, less the agreements to expect by chance, and the number of
    registers it rests on.  Two unrelated minima agree with probability about 0.17 / 2**MANTISSA,
    most for sets of equal size."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * na * nb / np.maximum((na + nb) ** 2, 1)
    return np.clip((same / np.maximum(used, 1) - chance) / (1 - chance), 0, 1), used


def sketches(docs: DataFrame, params: Params) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, registers, bands): hi and lo are a 128-bit fingerprint of the set."""
    def rows(batches):
        words = Words()
        for batch in batches:
            for start in range(0, len(batch), 500):
                yield sketch(batch.iloc[start : start + 500], words)

    def sketch(part: pd.DataFrame, words: Words) -> pd.DataFrame:
        sets = [shingle_set(t, words, params.size) for t in part["text"]]
        regs = registers(np.array([minima(s, params.registers) for s in sets]))
        keys = band_keys(regs, params)
        marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        return pd.DataFrame(
            {
                "doc_id": part["doc_id"].to_numpy(),
                "n_shingles": [len(s) for s in sets],
                "hi": marks[:, 0],
                "lo": marks[:, 1],
                "registers": [r.tobytes() for r in regs],
                "bands": [k if len(s) else k[:0] for s, k in zip(sets, keys)],
            }
        )

    kind = "doc_id long, n_shingles long, hi long, lo long, registers binary, bands array<long>"
    return _with_ids(docs).mapInPandas(rows, kind)


def _with_ids(docs: DataFrame) -> DataFrame:
    """Batches carry ids as whole numbers, null ids as the lowest one, which no document has."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


NO_ID = -(2**63)


def shingle_sets(docs: DataFrame, params: Params) -> DataFrame:
    """(doc, n, shingles)"""

    def rows(batches):
        words = Words()
        for whole in batches:
            for start in range(0, len(whole), 500):
                batch = whole.iloc[start : start + 500]
                sets = [shingle_set(t, words, params.size).view(np.int64) for t in batch["text"]]
                yield pd.DataFrame({"doc": batch["doc_id"].to_numpy(), "n": [len(s) for s in sets], "shingles": sets})

    return _with_ids(docs).mapInPandas(rows, "doc long, n long, shingles array<long>")


def plausible(pairs: DataFrame, known: DataFrame, params: Params) -> DataFrame:
    """Pairs (a, b) whose registers do not rule out the limit."""
    limit = params.limit / 100

    @F.pandas_udf("boolean")
    def possible(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        a = np.frombuffer(b"".join(ra), "<u2").reshape(len(ra), -1)
        b = np.frombuffer(b"".join(rb), "<u2").reshape(len(rb), -1)
        j, used = estimate(a, b, na.to_numpy(float), nb.to_numpy(float))
        return pd.Series(j >= limit - params.spread * np.sqrt(limit * (1 - limit) / np.maximum(used, 1)))

    for side in ("a", "b"):
        own = known.select(F.col("doc_id").alias(side), F.col("registers").alias(f"r{side}"), F.col("n_shingles").alias(f"n{side}"))
        pairs = pairs.join(own, side)
    return pairs.where(possible("ra", "rb", "na", "nb")).select("a", "b")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of their full sets and of the intersection: na, nb, both."""
    for side in ("a", "b"):
        own = sets.select(F.col("doc").alias(side), F.col("n").alias(f"n{side}"), F.col("shingles").alias(f"s{side}"))
        pairs = pairs.join(own, side)
    return pairs.withColumn("both", F.size(F.array_intersect("sa", "sb")).cast("long")).drop("sa", "sb")


def linked(pairs: DataFrame, params: Params) -> DataFrame:
    return pairs.where(100 * F.col("both") >= params.limit * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def buckets(known: DataFrame) -> DataFrame:
    """(band, doc, size): the bands that several classes share."""
    rows = known.select("doc_id", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(sizes, "band").select("band", F.col("doc_id").alias("doc"), "size")


def central_members(shared: DataFrame, params: Params) -> DataFrame:
    """(doc, centre): of the most central members of a document's buckets, those it meets most often."""
    weight = shared.groupBy("doc").agg(F.sum("size").alias("weight"))
    ranked = shared.join(weight, "doc").groupBy("band").agg(F.max(F.struct("weight", (-F.col("doc")).alias("doc"))).alias("top"))
    centre = ranked.select("band", (-F.col("top.doc")).alias("centre"))
    met = shared.join(centre, "band").where(F.col("doc") != F.col("centre")).groupBy("doc", "centre").agg(F.count("*").alias("times"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("times", (-F.col("centre")).alias("centre"))), asc=False), 1, params.centres)
    met = met.groupBy("doc").agg(best.alias("best"))  # at most params.bands entries before the slice
    return met.select("doc", F.explode("best").alias("x")).select("doc", (-F.col("x.centre")).alias("centre"))


def as_pairs(members: DataFrame) -> DataFrame:
    return members.select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct()


def views(seen: DataFrame, members: DataFrame) -> DataFrame:
    """(doc, views): how many shingles a document has in common with each centre it was compared with."""
    rows = members.join(seen, (F.least("doc", "centre") == F.col("a")) & (F.greatest("doc", "centre") == F.col("b")))
    own = rows.select(F.col("centre").alias("doc"), "centre", F.when(F.col("centre") == F.col("a"), F.col("na")).otherwise(F.col("nb")).alias("both"))
    rows = rows.select("doc", "centre", "both").union(own).distinct()
    return rows.groupBy("doc").agg(F.collect_list(F.struct("centre", "both")).alias("views"))


def remaining_pairs(shared: DataFrame, roots: DataFrame, seen: DataFrame, members: DataFrame, sets: DataFrame, params: Params) -> DataFrame:
    """Pairs of members of one bucket that lie in different components and may still be linked."""
    placed = shared.select("band", "doc").join(roots.withColumnRenamed("node", "doc"), "doc", "left")
    placed = placed.withColumn("root", F.coalesce("root", "doc"))
    mixed_bands = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    left = written(placed.join(mixed_bands, "band"), "left")
    docs = left.select("doc").distinct()
    counted = docs.union(members.join(docs, "doc").select("centre")).distinct()  # a centre's shingles count as shared
    own = sets.join(counted, "doc")
    alone = own.select("doc", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("k"), F.min("doc").alias("doc"))
    alone = alone.where("k = 1").groupBy("doc").agg(F.count("*").alias("unshared"))
    facts = own.select("doc", "n").join(alone, "doc", "left").select("doc", "n", (F.col("n") - F.coalesce("unshared", F.lit(0))).alias("most"))
    facts = facts.where(100 * F.col("most") >= params.limit * F.col("n"))
    bands = left.groupBy("doc").agg(F.sort_array(F.collect_list("band")).alias("bands"))  # at most params.bands
    rows = written(left.join(facts, "doc").join(bands, "doc").join(views(seen, members), "doc", "left"), "rows")
    limit = f"{params.limit} * (a.n + b.n - {{0}})"
    by_all = "least(a.most, b.most)"
    by_view = "(least(v.both, w.both) + greatest(0, least(a.most - v.both, b.most - w.both)))"
    can = f"""
        a.band = b.band AND a.doc < b.doc AND a.root <> b.root AND 100 * {by_all} >= {limit.format(by_all)}
        AND NOT coalesce(exists(a.views, v -> exists(b.views, w ->
            v.centre = w.centre AND 100 * {by_view} < {limit.format(by_view)})), false)
        AND array_min(array_intersect(a.bands, b.bands)) = a.band"""
    return rows.alias("a").join(rows.alias("b"), F.expr(can)).select(F.col("a.doc").alias("a"), F.col("b.doc").alias("b"))


def near_duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    known = written(sketches(docs, params), "sketches")
    real = known.where((F.col("n_shingles") > 0) & (F.col("doc_id") != NO_ID))
    classes = written(real.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "classes")
    reps = known.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").where("n_shingles > 0")
    shared = written(buckets(reps), "buckets")
    members = written(shared.select(F.col("doc").alias("doc_id")).distinct(), "members")
    sets = written(shingle_sets(docs.join(members, "doc_id", "left_semi"), params).where("n > 0"), "sets")
    one_each = known.join(members, "doc_id", "left_semi").where("n_shingles > 0").select("doc_id", "registers", "n_shingles")
    one_each = written(one_each, "registers")

    centres = written(central_members(shared, params), "centres")
    seen = written(measured(plausible(as_pairs(centres), one_each, params), sets), "seen")
    near = linked(seen, params)
    roots = components(near)
    rest = plausible(remaining_pairs(shared, roots, seen, centres, sets, params), one_each, params)
    more = written(linked(measured(rest, sets), params), "links")
    roots = components(near.union(more))
    placed = (
        known.join(classes, ["hi", "lo"], "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component_id", F.coalesce("root", "rep", "doc_id"))
    )
    no_id = F.col("doc_id") == NO_ID
    return placed.select(
        F.when(~no_id, F.col("doc_id")).alias("doc_id"),
        "n_shingles",
        F.when(~no_id, F.col("component_id")).alias("component_id"),
        (no_id | (F.col("doc_id") == F.col("component_id"))).alias("kept"),
    )


@query("op3_hyperminhash")
def op3_hyperminhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), Params(limit=85))
