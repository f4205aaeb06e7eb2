"""Vector compression by product codes: one small codebook for each part of the dimensions, in whole numbers.

Every component becomes floor(4096 * x); a vector is cut into equal parts, and a part's code is its nearest entry.  A
round of learning needs, for each entry, the sum of the parts nearest to it.

The distinct parts, with how often they occur, are kept once as sorted bytes (position, then components), dealt by
ranges, so a file of them is a piece of a lexicographic trie: neighbours share their first components.  A task walks it
depth first.  For the path to the part just visited it holds, at every depth, the vector of distances to all entries
over the components so far; a part adds to the vector where it leaves that path.  Leaves take the argmin and
add their components, weighted, to the entry's sums.  A walk goes in strides of some thousand leaves, so that
numpy works on whole strides, and the path is handed from stride to stride.  The driver sees the codebooks and their sums: parts x
entries x components, whatever the rows.

Copies of one vector are one row per batch before the shuffle and one row after it, so no part is hot.  Final codes come
from the same walk over the distinct parts of each batch of vectors.

Defined cases: a null vector, and one with a null or non-finite component, is dropped; so is one whose length
is no positive multiple of the parts or differs from that of the smallest kept id (null ids come last; rows
with equal ids go by their components).  With fewer rows than entries the codebooks are smaller.  Ties go to the
lower entry, and an entry nothing is nearest to stays.  Repeated rows count each; null labels are one label.  An
empty table gives no rows.  Other columns are ignored.  A component of magnitude 2**17 or more is an error
(ArithmeticException or ValueError), because distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.llm.common import query, ranged, table, written

STRIDE = 4096  # leaves that are walked at once
LARGEST = 1 << 29


@dataclass(frozen=True)
class Params:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


@dataclass(frozen=True)
class Codes:
    """rows: vec_id, label, code, error.  books: int64 (parts, entries, components of a part), None for an empty table."""

    rows: DataFrame
    books: np.ndarray | None


class Walk:
    """Depth-first walk over sorted parts of one position."""

    def __init__(self, book: np.ndarray):
        self.book = book
        self.depth = book.shape[1]
        self.last: np.ndarray | None = None  # the part visited last
        self.path = np.zeros((self.depth, len(book)), np.int64)  # distances along its path

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of sorted parts that follow those visited before."""
        found = [self._stride(parts[i : i + STRIDE]) for i in range(0, len(parts), STRIDE)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _stride(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before = np.vstack([parts[:1] - 1 if self.last is None else self.last, parts[:-1]])
        shared = np.logical_and.accumulate(parts == before, axis=1)
        sums = np.zeros((1, len(self.book)), np.int64)  # the root
        above = np.zeros(len(parts), np.int64)  # each part's node at the depth above
        for d in range(self.depth):
            heads = np.flatnonzero(~shared[:, d])  # parts that begin a node at this depth
            own = sums[above[heads]] + (parts[heads, d, None] - self.book[:, d]) ** 2
            sums = np.concatenate([self.path[d][None], own])  # node 0 is the one on the old path
            above = np.cumsum(~shared[:, d])
            self.path[d] = sums[-1]
        self.last = parts[-1]
        distances = sums[above]
        entry = distances.argmin(axis=1)
        return entry, distances[np.arange(len(parts)), entry]


def packed(parts: np.ndarray) -> np.ndarray:
    """Rows of (position, components) as bytes whose order is that of the numbers."""
    rows = np.ascontiguousarray(parts.astype(np.int64) + (1 << 31), dtype=">u4")
    return rows.view(f"V{4 * parts.shape[1]}").ravel()


def unpacked(keys: bytes, width: int) -> np.ndarray:
    return np.frombuffer(keys, ">u4").reshape(-1, width).astype(np.int64) - (1 << 31)


def _matrix(vectors: pd.Series, parts: int) -> np.ndarray:
    """(vectors, parts, components)."""
    flat = np.stack(vectors.to_numpy()).astype(np.int64)
    if np.abs(flat).max(initial=0) >= LARGEST:
        raise ValueError("a component is 2**17 or larger: squared distances would leave 64 bits")
    return flat.reshape(len(flat), parts, -1)


def _with_position(values: np.ndarray) -> np.ndarray:
    """(vectors, parts, components) to rows of (position, components)."""
    n, parts, width = values.shape
    position = np.broadcast_to(np.arange(parts)[None, :, None], (n, parts, 1))
    return np.concatenate([position, values], axis=2).reshape(n * parts, width + 1)


def whole_numbers(vectors: DataFrame, params: Params) -> DataFrame:
    """(vec_id, label, numbers): the vectors that are kept."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sized = (F.size(x) > 0) & (F.size(x) % params.parts == 0)
    kept = vectors.where(x.isNotNull() & ~bad & sized)
    numbers = F.transform(x, lambda v: F.floor(v.cast("double") * params.scale).cast("int"))
    return kept.select("vec_id", "label", numbers.alias("numbers"))


def trie(vectors: DataFrame, rows: int, params: Params) -> DataFrame:
    """(key, weight): distinct parts in order, dealt by ranges, with their number of occurrences."""
    parts = params.parts

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, counts = np.unique(packed(_with_position(_matrix(batch["numbers"], parts))), return_counts=True)
            yield pd.DataFrame({"key": [k.tobytes() for k in keys], "weight": counts})

    found = written(vectors.select("numbers").mapInPandas(distinct, "key binary, weight long"), "parts")
    # Ranges keep equal parts together, so the sum needs no shuffle of its own.
    dealt = ranged(found, rows * parts, "key")
    return written(dealt.groupBy("key").agg(F.sum("weight").alias("weight")).sortWithinPartitions("key"), "trie")


def entry_sums(leaves: DataFrame, books: np.ndarray) -> np.ndarray:
    """For each entry the sums of the components of the parts nearest to it and, last, their number."""
    parts, entries, width = books.shape

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walks = [Walk(book) for book in books]
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            keys = unpacked(b"".join(batch["key"]), width + 1)
            # A task may read several files, each in order; the walk bears a step back.
            order = np.argsort(keys[:, 0], kind="stable")
            keys, weights = keys[order], batch["weight"].to_numpy(np.int64)[order]
            borders = np.searchsorted(keys[:, 0], np.arange(parts + 1))
            for p in range(parts):
                mine = slice(borders[p], borders[p + 1])
                if mine.start < mine.stop:
                    entry, _ = walks[p].nearest(keys[mine, 1:])
                    values = np.c_[keys[mine, 1:], np.ones(mine.stop - mine.start, np.int64)] * weights[mine, None]
                    np.add.at(total[p], entry, values)
        at = np.argwhere(total)
        yield pd.DataFrame({"part": at[:, 0], "entry": at[:, 1], "place": at[:, 2], "total": total[tuple(at.T)]})

    sums = leaves.mapInPandas(walked, "part int, entry int, place int, total long")
    out = np.zeros((parts, entries, width + 1), np.int64)
    for row in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():
        out[row["part"], row["entry"], row["place"]] = row["total"]
    return out


def first_books(vectors: DataFrame, params: Params) -> np.ndarray | None:
    """The parts of the vectors with the smallest ids."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "numbers").limit(params.entries).collect()
    if not first:
        return None
    values = np.array([r["numbers"] for r in first], np.int64)
    if np.abs(values).max(initial=0) >= LARGEST:
        raise ValueError("a component is 2**17 or larger: squared distances would leave 64 bits")
    return np.ascontiguousarray(values.reshape(len(first), params.parts, -1).transpose(1, 0, 2))


def learn(vectors: DataFrame, rows: int, books: np.ndarray, params: Params) -> np.ndarray:
    leaves = trie(vectors, rows, params)
    for _ in range(params.rounds):
        sums = entry_sums(leaves, books)
        count = sums[:, :, -1:]
        books = np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)
    return books


def code_of(numbers: Column, books: np.ndarray) -> Column:
    """struct(code, error) of a vector in whole numbers."""
    parts, _, width = books.shape

    @F.pandas_udf("code string, error long")
    def coded(vectors: pd.Series) -> pd.DataFrame:
        n = len(vectors)
        if n == 0:
            return pd.DataFrame({"code": [], "error": []})
        keys, back = np.unique(packed(_with_position(_matrix(vectors, parts))), return_inverse=True)
        rows = unpacked(keys.tobytes(), width + 1)
        borders = np.searchsorted(rows[:, 0], np.arange(parts + 1))
        entry, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for p in range(parts):
            mine = slice(borders[p], borders[p + 1])
            entry[mine], distance[mine] = Walk(books[p]).nearest(rows[mine, 1:])
        codes = entry[back].astype(np.uint8).reshape(n, parts).tobytes().hex()
        error = distance[back].reshape(n, parts).sum(axis=1)
        return pd.DataFrame({"code": [codes[i : i + 2 * parts] for i in range(0, 2 * parts * n, 2 * parts)], "error": error})

    return coded(numbers)


def compress(vectors: DataFrame, params: Params = Params()) -> Codes:
    """Codebooks learned from all vectors (vec_id, embedding, label), and every vector's code."""
    kept = written(whole_numbers(vectors, params), "numbers")
    books = first_books(kept, params)
    if books is None:
        return Codes(kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None)
    kept = kept.where(F.size("numbers") == books.shape[0] * books.shape[2])
    # A shorter or longer vector among the first ids was no seed either.
    books = first_books(kept, params)
    books = learn(kept, kept.count(), books, params)
    coded = kept.select("vec_id", "label", code_of(F.col("numbers"), books).alias("c"))
    return Codes(written(coded.select("vec_id", "label", "c.code", "c.error"), "codes"), books)


def digest(books: np.ndarray | None) -> str | None:
    """Hash of all entries' components, by part, entry and position."""
    return None if books is None else hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _sql(params: Params = Params()) -> str:
    parts, k = params.parts, params.entries
    floor = f"floor({params.scale} * x::double)::bigint"
    out = f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: {floor}) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS part
  FROM kept, range({parts}) AS t(p)),
b0 AS MATERIALIZED (SELECT p, e, part AS entry FROM parts
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id) WHERE e < {k})"""
    for r in range(params.rounds + 1):
        distance = "list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
        out += f""",
a{r} AS MATERIALIZED (SELECT vec_id, label, p, part, min((d, e)) AS best FROM
  (SELECT vec_id, label, p, part, e, {distance} AS d FROM parts JOIN b{r} USING (p)) GROUP BY ALL)"""
        if r < params.rounds:
            out += f""",
u{r} AS MATERIALIZED (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS entry FROM
  (SELECT p, best[2] AS e, i, sum(part[i + 1])::bigint AS s, count(*) AS n FROM a{r}, range(len(part)) AS t(i) GROUP BY ALL) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.entry, b.entry) AS entry FROM b{r} AS b LEFT JOIN u{r} AS u ON b.p = u.p AND b.e = u.e)"""
    last = params.rounds
    return f"""{out},
coded AS MATERIALIZED (SELECT vec_id, label, string_agg(format('{{:02x}}', best[2]), '' ORDER BY p) AS code, sum(best[1])::bigint AS error
  FROM a{last} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM b{last}) AS codebooks_sha256
FROM coded"""


@query("op12_trie_codes", _sql())
def op12_trie_codes(spark, sf_dir):
    made = compress(table(spark, sf_dir, "embeddings"))
    # Sums come first, so a frequent label is one row on the other side; Spark splits what remains of it.
    sums = made.rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = made.rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(made.books)).cast("string").alias("codebooks_sha256"))
