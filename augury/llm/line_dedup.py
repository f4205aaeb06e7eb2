"""Reversible line deduplication: cuckoo filters in front of exact reference counts.

The state is three tables.  ``postings``: which document holds which line key.  ``counts``: for each key
the number of documents and the largest doc_id.  ``filters``: for each shard a cuckoo filter of the keys
that repeat often enough to be dropped.  Keys ask the filter of their shard first; the few that pass
are looked up in the exact counts, so a false positive costs a look-up and never a line.  Documents are
inserted and deleted; keys that reach the limit enter the filter, keys that fall below leave it, and a
filter that is full is built anew from the counts.

Shards are cut by key, their number follows the number of keys, so a shard's share stays the same at
every size; a state that grows to twice the keys a shard should have, or shrinks to half, is cut anew.  A key that very many documents hold is one row of the counts (partial sums come first);
only the join that hands its verdict to the documents sees it often, and Spark splits that side.

A key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased; 128-bit hashes
stand for keys.  Defined cases: a null or empty text is one empty line; rows with one doc_id are one
document (they count once); rows without doc_id are not counted and keep all lines; a document that
loses all lines has an empty text; a very long text is split whole in one task, line by line; an empty table has no keys and
stays empty; other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm.common import BLANKS, query, table, written
from augury.llm.cuckoo import Cuckoo, Full


@dataclass(frozen=True)
class Params:
    """A key of at least ``characters`` code points in at least ``documents`` documents is dropped."""

    characters: int = 40
    documents: int = 5
    keys_per_shard: int = 200_000


@dataclass(frozen=True)
class State:
    postings: DataFrame  # doc_id, hi, lo
    counts: DataFrame  # shard, hi, lo, refs, newest
    filters: DataFrame  # shard, filter
    shards: int
    params: Params


def line_key(line: str, least: int) -> bytes | None:
    """Hash of a line's key; none for keys too short to matter."""
    key = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= least else None


def postings(docs: DataFrame, params: Params) -> DataFrame:
    """(doc_id, hi, lo), one row for each key of a document."""
    least = params.characters

    def rows(batches):
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                own = {line_key(line, least) for line in text.split("\n") if len(line) >= least} - {None}
                ids += [doc] * len(own)
                keys += own
            key = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": np.array(ids, np.int64), "hi": key[:, 0], "lo": key[:, 1]})

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    return texts.mapInPandas(rows, "doc_id long, hi long, lo long").distinct()


def _count(held: DataFrame) -> DataFrame:
    return held.groupBy("hi", "lo").agg(F.count("*").alias("refs"), F.max("doc_id").alias("newest"))


def _shard(shards: int):
    return F.pmod(F.col("hi"), F.lit(shards)).cast("int").alias("shard")


def build(docs: DataFrame, params: Params = Params()) -> State:
    """State of a corpus."""
    held = written(postings(docs, params), "postings")
    counts = written(_count(held), "counts")
    shards = max(1, -(-counts.count() // params.keys_per_shard))
    counts = counts.select(_shard(shards), "hi", "lo", "refs", "newest")
    return State(held, counts, _filters(counts, params), shards, params)


def _repeated(counts: DataFrame, params: Params) -> DataFrame:
    return counts.where(F.col("refs") >= params.documents)


def _filters(counts: DataFrame, params: Params) -> DataFrame:
    """A filter for each shard that has a repeated key."""

    def build_one(keys: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": keys["shard"].iloc[:1], "filter": [_fresh(keys).dumps()]})

    keys = _repeated(counts, params).select("shard", "hi", "lo")
    return written(keys.groupBy("shard").applyInPandas(build_one, "shard int, filter binary"), "filters")


def _fresh(keys: pd.DataFrame) -> Cuckoo:
    room = max(16, len(keys))
    while True:
        made = Cuckoo.sized(room)
        try:
            made.add(keys["hi"].to_numpy(np.int64), keys["lo"].to_numpy(np.int64))
            return made
        except Full:
            room *= 2


def _updated(state: State, counts: DataFrame) -> DataFrame:
    """Filters after counts changed: keys enter and leave; a full filter is built anew."""
    params = state.params
    old = _repeated(state.counts, params).select("shard", "hi", "lo")
    new = _repeated(counts, params).select("shard", "hi", "lo")
    mark = lambda df, op: df.withColumn("op", F.lit(op)).withColumn("filter", F.lit(None).cast("binary"))
    enter, leave = new.exceptAll(old), old.exceptAll(new)
    changed = enter.union(leave).select("shard").distinct()
    # No nulls among the keys: a batch would carry them as floats.
    zero = F.lit(0).cast("long")
    filters = state.filters.select("shard", zero.alias("hi"), zero.alias("lo"), F.lit("filter").alias("op"), "filter")
    rows = mark(enter, "in").union(mark(leave, "out")).union(mark(new.join(changed, "shard"), "all")).union(filters)

    def update_one(part: pd.DataFrame) -> pd.DataFrame:
        kinds = {op: part[part["op"] == op] for op in ("in", "out", "all", "filter")}
        shard = part["shard"].iloc[:1]
        arrays = lambda k: (kinds[k]["hi"].to_numpy(np.int64), kinds[k]["lo"].to_numpy(np.int64))
        try:
            if kinds["filter"].empty:
                raise Full
            own = Cuckoo.loads(kinds["filter"]["filter"].iloc[0])
            own.remove(*arrays("out"))
            own.add(*arrays("in"))
        except Full:
            own = _fresh(kinds["all"])
        return pd.DataFrame({"shard": shard, "filter": [own.dumps()]})

    return written(rows.groupBy("shard").applyInPandas(update_one, "shard int, filter binary"), "filters")


def _recounted(state: State, held: DataFrame, counts: DataFrame) -> State:
    """State with other postings and counts; shards are cut anew when their share has doubled or halved."""
    counts = written(counts.select("hi", "lo", "refs", "newest"), "counts")
    wanted = max(1, -(-counts.count() // state.params.keys_per_shard))
    same = state.shards < 2 * wanted and wanted < 2 * state.shards
    shards = state.shards if same else wanted
    counts = counts.select(_shard(shards), "hi", "lo", "refs", "newest")
    filters = _updated(state, counts) if same else _filters(counts, state.params)
    return replace(state, postings=held, counts=counts, filters=filters, shards=shards)


def insert(state: State, docs: DataFrame) -> State:
    """State with further documents; documents it already has add only keys they did not have."""
    added = written(postings(docs, state.params).join(state.postings, ["doc_id", "hi", "lo"], "left_anti"), "added")
    counts = state.counts.drop("shard").unionByName(_count(added)).groupBy("hi", "lo")
    counts = counts.agg(F.sum("refs").alias("refs"), F.max("newest").alias("newest"))
    return _recounted(state, written(state.postings.unionByName(added), "postings"), counts)


def delete(state: State, ids: DataFrame) -> State:
    """State without the documents ids(doc_id): as if they had never been inserted."""
    ids = ids.select("doc_id").distinct()
    held = written(state.postings.join(ids, "doc_id", "left_anti"), "postings")
    touched = written(state.postings.join(ids, "doc_id", "left_semi").select("hi", "lo").distinct(), "touched")
    again = _count(held.join(touched, ["hi", "lo"], "left_semi"))
    counts = state.counts.drop("shard").join(touched, ["hi", "lo"], "left_anti").unionByName(again)
    return _recounted(state, held, counts)


def repeated_keys(state: State, keys: DataFrame) -> DataFrame:
    """Of distinct keys (hi, lo), those to drop, with the newest document: filter first, then counts."""

    def ask(own: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if own.empty or filters.empty:
            return pd.DataFrame({"hi": np.zeros(0, np.int64), "lo": np.zeros(0, np.int64)})
        hi, lo = own["hi"].to_numpy(), own["lo"].to_numpy()
        passed = Cuckoo.loads(filters["filter"].iloc[0]).has(hi, lo)
        return pd.DataFrame({"hi": hi[passed], "lo": lo[passed]})

    asked = keys.select(_shard(state.shards), "hi", "lo").groupBy("shard")
    passed = asked.cogroup(state.filters.groupBy("shard")).applyInPandas(ask, "hi long, lo long")
    exact = _repeated(state.counts, state.params).select("hi", "lo", "newest")
    return written(passed.join(exact, ["hi", "lo"]), "repeated")


def cleaned(docs: DataFrame, state: State) -> DataFrame:
    """All columns of docs, text without the dropped lines, plus n_lines and n_dropped (columns of docs
    with these two names are replaced).  docs must have been inserted."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    repeated = repeated_keys(state, state.counts.select("hi", "lo"))
    drops = (
        state.postings.join(repeated, ["hi", "lo"])
        .where(F.col("doc_id") != F.col("newest"))
        .groupBy(F.col("doc_id").alias("drop_id"))
        .agg(F.collect_list(F.struct("hi", "lo")).alias("keys"))  # at most the lines of the document
        .select("drop_id", F.col("keys.hi").alias("drop_hi"), F.col("keys.lo").alias("drop_lo"))
    )
    least = state.params.characters

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def kept(texts: pd.Series, his: pd.Series, los: pd.Series) -> pd.DataFrame:
        rows = []
        for text, hi, lo in zip(texts, his, los):
            if hi is None:
                rows.append((text, text.count("\n") + 1, 0))
                continue
            gone = set(map(bytes, np.c_[hi, lo].astype(np.int64)))
            lines = text.split("\n")
            stay = [x for x in lines if len(x) < least or line_key(x, least) not in gone]
            rows.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    packed = docs.select(F.struct(*names).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = packed.join(drops, F.col("doc_id") == F.col("drop_id"), "left")
    done = both.select("row", kept("text", "drop_hi", "drop_lo").alias("kept"))
    return done.select(*(F.col("kept.text" if c == "text" else f"row.`{c}`").alias(c) for c in names), "kept.n_lines", "kept.n_dropped")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, x, regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS s
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), keyed AS (
  SELECT doc_id, i, x, length(s) AS n,
         translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS newest FROM keyed WHERE n >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.i, l.x, r.k IS NOT NULL AND l.doc_id <> r.newest AS gone
  FROM keyed l LEFT JOIN repeated r ON l.k = r.k AND l.n >= 40
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op9_line_dedup", ORACLE)
def op9_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cleaned(docs, build(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
