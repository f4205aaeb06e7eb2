import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from augury.llm import merkle as M
from tests.llm.cases import awkward, nothing

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(told(v) for v in row))


def climb(nodes):
    """Root of a list of nodes, and for each the (before, after) of its levels."""
    sides = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, holds = [], []
        for start in range(0, len(nodes), 16):
            run = nodes[start : start + 16]
            for k in range(len(run)):
                for i in under[start + k]:
                    sides[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            holds.append([i for below in under[start : start + 16] for i in below])
        nodes, under = above, holds
    return nodes[0], sides


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """Rows of the query, one tree after the other."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        groups[name].sort(key=lambda r: r[:3])
        trees.append(climb([r[2] for r in groups[name]]))
    if not trees:
        return []
    root, tops = climb([t[0] for t in trees])
    out = []
    for name, (subroot, sides), top in zip(names, trees, tops):
        for (_, _, h, row), own in zip(groups[name], sides):
            path = own + top
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = leaf(row[:4] + (lowered(row[4]),)) if hit else h
            for before, after in path:
                node = sha(before + node + after)
            out.append((row[0], h, subroot, root, sha("".join(b + a for b, a in path)), node, node == root))
    return sorted(out, key=repr)


def check(spark, docs, tmp_path):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted(map(tuple, M.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows)
    return got


@pytest.mark.parametrize("sizes", [(1,), (16, 17), (255, 256, 257), (4096, 4097, 1), (9000,), tuple([2] * 300)])
def test_against_one_by_one(spark, tmp_path, sizes):
    """Groups at the borders of runs, blocks and rounds; more groups than a run holds."""
    rows = [(s * 10_000 + i, f"s{s}", "en", i, f"Text {i}") for s, n in enumerate(sizes) for i in range(n)]
    got = check(spark, spark.createDataFrame(rows, KIND).repartition(5), tmp_path)
    assert {g[6] for g in got} == ({True, False} if len(rows) > 50 else {g[6] for g in got})


def test_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    mixed = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit("é")).otherwise(F.lit("")))
    check(spark, mixed, tmp_path)
    check(spark, docs.withColumn("source", F.lit(None).cast("string")).union(docs).repartition(3), tmp_path)
    assert check(spark, nothing(spark), tmp_path) == []


def test_only_changed_rows_fail(spark, tmp_path):
    rows = [(i, "s", None, i, "ABC" if i % 2 else "abc") for i in range(200)]
    got = check(spark, spark.createDataFrame(rows, KIND), tmp_path)
    hit = {i for i in range(200) if i % 2 and zlib.crc32(str(i).encode()) % 5 == 0}
    assert hit and {g[0] for g in got if not g[6]} == hit


def test_carried_columns_may_clash(spark):
    rows = spark.createDataFrame([(i, "x", f"{i:064x}", i * 2, "y") for i in range(40)], "id long, g string, h string, pos long, node string")
    made = M.manifest(rows, "g", "id", "h", ("pos", "node"))
    got = made.leaves.select("id", "pos", "node", M.folded(F.col("leaf"), F.col("path")).alias("r")).collect()
    assert len(got) == 40 and all(r["pos"] == 2 * r["id"] and r["node"] == "y" and r["r"] == made.root for r in got)
