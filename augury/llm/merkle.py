"""Merkle manifest of a dataset: one tree per group of rows, and one over the groups' roots.

Rows of a group are put in order and numbered.  An aligned block of 16**3 of them keeps each level of the tree
as one string of hex digests.  A parent is the hash of a fixed-width substring of the level below (16 digests
of 64 characters); the siblings of a node are the substrings that flank it in its run.  Roots of blocks are the nodes of
the next round, until each group has one root; the groups' roots, in order, make the last tree by the same code.

Numbering is by range: rows are sorted over all tasks, numbered inside their partition, and start where the partitions
before end, so a group of any size is split.  A block is the largest thing a task gathers.  Tables between the rounds are
written to the shared folder.  Everything is DataFrame functions.

Defined cases: a null field is ``-``, an empty one ``0:``; a null group is a group of its own and comes first; rows with
equal keys follow each other by their hash, so repeated rows are equal leaves side by side; null keys come first;
a very long text is hashed whole where it is read and goes nowhere else; an empty table has no rows and no
root (None); other columns are ignored unless carried, and then keep their values under names of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.llm.common import query, ranged, table, written

ARITY = 16
DIGEST = 64  # characters of a hex digest
RUN = ARITY * DIGEST
STEPS = 3  # levels inside a block
BLOCK = ARITY**STEPS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Forest:
    """rounds: blocks of each round (grp, block, n, steps, members, level0.., top).  roots: (grp, root)."""

    rounds: list[DataFrame]
    roots: DataFrame
    carried: tuple[str, ...]


@dataclass(frozen=True)
class Manifest:
    """leaves: grp, leaf, the carried columns, subroot and path, the siblings (before, after) of each level from the
    leaf to the root.  subroots: (grp, subroot).  root: hex digest, None for an empty table."""

    leaves: DataFrame
    subroots: DataFrame
    root: str | None


def leaf_hash(*fields: Column) -> Column:
    """Hash of a row's fields, each with its length, so that no two rows share an input."""
    told = []
    for field in fields:
        value = field.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*told), 256)


def group_key(group: Column) -> Column:
    """Never null, and in the order of the group: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows plus pos, the place in the group from 0, and n, the group's size."""
    rows = ranged(rows, rows.count(), "grp", *order).sortWithinPartitions("grp", *order)
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("grp", "part").agg(F.count("*").alias("k"), F.min("at").alias("first"))
    group = Window.partitionBy("grp")  # one row for each partition the group lies in
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "grp",
        "part",
        (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("k").over(group).alias("n"),
    )
    return rows.join(starts, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _piece(level: Column, start: Column, length) -> Column:
    """Characters of a level from a place counted from 0; levels are kept as bytes, which are cut without a scan."""
    return F.substring(level, (start + 1).cast("int"), length if isinstance(length, Column) else F.lit(length))


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(F.octet_length(level) / RUN).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(_piece(level, i * RUN, RUN), 256)), "").cast("binary")


def _blocks(nodes: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """Nodes (grp, pos, n, node, carried) to blocks with their levels."""
    block = F.expr(f"pos div {BLOCK}").alias("block")
    members = F.sort_array(F.collect_list(F.struct("pos", "node", *carried))).alias("members")
    out = nodes.groupBy("grp", block, "n").agg(members)
    # A group of n nodes has as many levels as powers of the arity below n; a block makes three of them at most.
    levels = sum((F.col("n") > ARITY**k).cast("int") for k in range(STEPS))
    out = out.withColumn("steps", levels)
    level = F.array_join(F.transform("members", lambda m: m["node"]), "").cast("binary")
    out = out.withColumn("level0", level)
    for k in range(STEPS):
        here = F.col(f"level{k}")
        out = out.withColumn(f"level{k + 1}", F.when(F.col("steps") > k, _parents(here)).otherwise(here))
    return out.withColumn("top", F.col(f"level{STEPS}").cast("string")).drop(f"level{STEPS}")


def forest(rows: DataFrame, order: list[str], carried: tuple[str, ...]) -> Forest:
    """One tree for each group of rows (grp, node, order, carried)."""
    nodes, rounds, keep = numbered(rows, order), [], carried
    while True:
        blocks = written(_blocks(nodes.select("grp", "pos", "n", "node", *keep), keep), "blocks")
        rounds.append(blocks)
        wide = blocks.where(F.col("n") > BLOCK)
        if wide.limit(1).count() == 0:
            break
        rest = F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")
        nodes, keep = wide.select("grp", F.col("block").alias("pos"), rest.alias("n"), F.col("top").alias("node")), ()
    roots = None
    for blocks in rounds:
        own = blocks.where(F.col("n") <= BLOCK).select("grp", F.col("top").alias("root"))
        roots = own if roots is None else roots.unionByName(own)
    return Forest(rounds, roots, carried)


def _siblings(index: Column) -> Column:
    """(before, after) at each level inside the block of the member at an index."""
    found = []
    for k in range(STEPS):
        level, place = F.col(f"level{k}"), F.shiftright(index, 4 * k)
        run, inside = F.shiftright(place, 4) * RUN, F.pmod(place, F.lit(ARITY)) * DIGEST
        before = _piece(level, run, inside.cast("int"))
        after = _piece(level, run + inside + DIGEST, (RUN - DIGEST - inside).cast("int"))
        found.append(F.struct(before.cast("string").alias("before"), after.cast("string").alias("after")))
    return F.slice(F.array(*found), F.lit(1), F.col("steps"))


def _member_paths(blocks: DataFrame, upper: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """A row for each member of the blocks: what it carries and its path, upper being (grp, block, path)."""
    joined = blocks.join(upper, ["grp", "block"])

    def told(m: Column) -> Column:
        index = F.pmod(m["pos"], F.lit(BLOCK)).cast("int")
        path = F.concat(_siblings(index), F.col("path"))
        return F.struct(m["pos"].alias("pos"), m["node"].alias("node"), path.alias("path"), *(m[c].alias(c) for c in carried))

    return joined.select("grp", F.explode(F.transform("members", told)).alias("m")).select("grp", "m.*")


def paths(trees: Forest, above: DataFrame) -> DataFrame:
    """(grp, pos, node, path, carried) of all leaves; above is (grp, path) of the groups' roots."""
    below = None
    for number in reversed(range(len(trees.rounds))):
        blocks = trees.rounds[number]
        ends = blocks.where(F.col("n") <= BLOCK).select("grp", "block").join(above, "grp").select("grp", "block", "path")
        upper = ends if below is None else ends.unionByName(below.select("grp", F.col("pos").alias("block"), "path"))
        below = _member_paths(blocks, upper, trees.carried if number == 0 else ())
    return below


def manifest(rows: DataFrame, group: str, key: str, leaf: str, carry: tuple[str, ...] = ()) -> Manifest:
    """Trees over rows that hold a leaf hash; the path of each leaf to the root of all."""
    taken = rows.select(
        group_key(F.col(group)).alias("grp"),
        F.col(key).alias("key"),
        F.col(leaf).alias("node"),
        *(F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)),
    )
    own = tuple(f"c_{i}" for i in range(len(carry)))
    trees = forest(written(taken, "leaves"), ["key", "node"], ("key", *own))
    names = (F.col("key").alias(key), *(F.col(c).alias(name) for c, name in zip(own, carry)))
    # The groups' roots are the leaves of one more tree.
    tops = written(trees.roots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("root").alias("node")), "roots")
    crown = forest(tops, ["of"], ("of",))
    found = crown.roots.select("root").collect()  # one row, none for an empty table
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    end = crown.roots.select("grp", nothing.alias("path"))
    above = written(paths(crown, end).select(F.col("of").alias("grp"), F.col("node").alias("subroot"), "path"), "crown")
    leaves = paths(trees, above.select("grp", "path")).join(above.select("grp", "subroot"), "grp")
    leaves = leaves.select("grp", F.col("node").alias("leaf"), "subroot", "path", *names)
    return Manifest(leaves, above.select("grp", "subroot"), found[0]["root"] if found else None)


def proof(path: Column) -> Column:
    """All siblings of a path in one string, from the leaf up, left to right."""
    return F.array_join(F.flatten(F.transform(path, lambda s: F.array(s["before"], s["after"]))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def document_leaf(text: Column) -> Column:
    return leaf_hash(*(text if name == "text" else F.col(name) for name in FIELDS))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text, with A-Z lower-cased where 5 divides the crc32 of the decimal id."""
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, F.translate(text, UPPER, UPPER.lower())).otherwise(text)


def _sql(levels: int = 6) -> str:
    """The same trees, level by level; 16**levels leaves a source at most."""
    field = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(text if c == "text" else c) for c in FIELDS) + ")"
    # Eight shifts for each byte, the byte coming in with the first.
    bits = "flatten(list_transform(range(length(d)), lambda i: [ascii(d[i + 1])::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, e) >> 1, (xor(a, e) & 1) * 3988292384)"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda a, e: {step}), 4294967295)"
    out = f"""WITH ids AS MATERIALIZED (SELECT *, doc_id::varchar AS d FROM documents),
marked AS MATERIALIZED (SELECT *, coalesce({crc} % 5 = 0, false) AS changed FROM ids),
hashed AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS grp, {leaf('text')} AS leaf,
  CASE WHEN changed THEN {leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} ELSE {leaf('text')} END AS claimed FROM marked),
s0 AS MATERIALIZED (SELECT *, leaf AS h, count(*) OVER (PARTITION BY grp) AS n,
  row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed)"""

    def tree(name: str) -> str:
        text = ""
        for k in range(levels):
            text += f""",
{name}r{k} AS MATERIALIZED (SELECT grp, pos // 16 AS pos, n, list(h ORDER BY pos) AS run FROM {name}{k} GROUP BY grp, pos // 16, n),
{name}{k + 1} AS MATERIALIZED (SELECT grp, pos, (n + 15) // 16 AS n,
  CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {name}r{k})"""
        return text

    def side(run: str, place: str, before: bool) -> str:
        return f"array_to_string({run}[1:{place}], '')" if before else f"array_to_string({run}[{place} + 2:], '')"

    out += tree("s")
    out += f""",
t0 AS MATERIALIZED (SELECT '' AS grp, grp AS of, h, count(*) OVER () AS n, row_number() OVER (ORDER BY grp) - 1 AS pos FROM s{levels})"""
    out += tree("t")
    joins, steps = "", []
    for name in "st":
        for k in range(levels):
            place = f"{'l' if name == 's' else 'u'}.pos // {16**k} % 16"
            base = "l" if name == "s" else "u"
            joins += f"\nJOIN {name}r{k} ON {name}r{k}.grp = {base}.grp AND {name}r{k}.pos = {base}.pos // {16 ** (k + 1)}"
            steps.append((f"{name}r{k}.n > 1", side(f"{name}r{k}.run", place, True), side(f"{name}r{k}.run", place, False)))
    joins = joins.replace("\nJOIN tr0", "\nJOIN t0 AS u ON u.of = l.grp\nJOIN tr0", 1)
    proofs = " || ".join(f"CASE WHEN {c} THEN {b} || {a} ELSE '' END" for c, b, a in steps)
    sides = ", ".join(f"CASE WHEN {c} THEN [{b}, {a}] END" for c, b, a in steps)
    fold = f"list_reduce(list_prepend(['', l.claimed], list_filter([{sides}], lambda s: s IS NOT NULL)), lambda a, s: ['', sha256(s[1] || a[2] || s[2])])[2]"
    return f"""{out},
leaves AS MATERIALIZED (SELECT l.doc_id, l.leaf, u.h AS subroot, sha256({proofs}) AS proof_sha256, {fold} AS folded_root
FROM s0 AS l{joins})
SELECT doc_id, leaf, subroot, r.h AS root, proof_sha256, folded_root, folded_root = r.h AS verified
FROM leaves, t{levels} AS r"""


@query("op11_merkle_manifest", _sql())
def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    rows = docs.select("doc_id", "source", document_leaf(text).alias("leaf"), document_leaf(tampered(F.col("doc_id"), text)).alias("claimed"))
    made = manifest(rows, "source", "doc_id", "leaf", ("claimed",))
    root = F.lit(made.root).cast("string")
    return made.leaves.select(
        "doc_id",
        "leaf",
        "subroot",
        root.alias("root"),
        F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
        folded(F.col("claimed"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
