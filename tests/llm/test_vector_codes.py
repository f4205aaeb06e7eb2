import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.llm import vector_codes as V

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """The contract, part by part, in Python's whole numbers."""
    usable = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    whole = [(i, lab, [int(np.floor(4096 * float(np.float32(x)))) for x in v]) for i, v, lab in rows if usable(v)]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not whole:
        return []
    width = len(whole[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(r[2], p) for r in whole[:entries]] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for r in whole:
                held.setdefault(near(cut(r[2], p), books[p])[1], []).append(cut(r[2], p))
            for k, own in held.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    told = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, sums = [], {}
    for i, lab, v in whole:
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
        sums[lab] = sums.get(lab, 0) + out[-1][3]
    return sorted(((i, c, e, sums[lab], told) for i, lab, c, e in out), key=repr)


def check(spark, rows, tmp_path, spread=3):
    spark.createDataFrame(rows, KIND).repartition(spread).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, V.op12_trie_codes(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows)
    return got


def vectors(seed, n, d=16, values=None):
    rng = random.Random(seed)
    draw = lambda: rng.choice(values) if values else rng.gauss(0, 0.2)
    return [(i, [draw() for _ in range(d)], rng.choice([0, 1, 2, None])) for i in range(n)]


def test_against_one_by_one(spark, tmp_path):
    assert len(check(spark, vectors(1, 300), tmp_path)) == 300


def test_ties_copies_and_shared_prefixes(spark, tmp_path):
    rows = vectors(2, 200, values=[-1.0, -0.5, 0.0, 0.25])
    check(spark, rows + [(1000 + i, rows[0][1], 7) for i in range(150)], tmp_path, 5)


@pytest.mark.parametrize("n", [1, 5, 16])
def test_few_rows(spark, tmp_path, n):
    check(spark, vectors(3, n), tmp_path)


def test_awkward_rows(spark, tmp_path):
    rows = vectors(4, 40)
    bad = [(100, None, 1), (101, [None] * 16, 1), (-5, [float("nan")] * 16, 2), (-6, [float("inf")] + [0.0] * 15, None)]
    again = [(3, rows[3][1], 1), (3, [0.5] * 16, 1), (None, [0.1] * 16, None), (None, [0.1] * 16, None)]
    got = check(spark, rows + bad + again, tmp_path)
    assert len(got) == 44
    assert check(spark, [], tmp_path) == []
    assert check(spark, bad, tmp_path) == []


def test_other_lengths_are_dropped_and_other_columns_ignored(spark):
    rows = vectors(5, 30)
    odd = [(-1, [0.1] * 7, 0), (-2, [], 0), (500, [0.1] * 24, 0)]
    docs = spark.createDataFrame(rows + odd, KIND).withColumn("code", F.lit("x")).withColumn("numbers", F.lit(1))
    made = V.compress(docs)
    assert sorted(r["vec_id"] for r in made.rows.collect()) == list(range(30))
    assert V.digest(made.books) == brute(rows)[0][4]


def test_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="2\\*\\*17|overflow|OVERFLOW"):
        V.compress(spark.createDataFrame([(1, [200_000.0] * 8, 1)], KIND))


def test_walk_equals_plain_distances_in_any_strides():
    rng = np.random.default_rng(6)
    parts = np.unique(rng.integers(-3, 3, (9000, 6)), axis=0)
    book = rng.integers(-3, 3, (16, 6))
    plain = ((parts[:, None] - book) ** 2).sum(axis=2)
    for size in (1, 7, 1000, len(parts)):
        walk = V.Walk(book)
        found = [walk.nearest(parts[i : i + size]) for i in range(0, len(parts), size)]
        assert (np.concatenate([f[0] for f in found]) == plain.argmin(axis=1)).all()
        assert (np.concatenate([f[1] for f in found]) == plain.min(axis=1)).all()


def test_keys_sort_like_numbers():
    parts = np.array([[0, -5, 2], [0, 3, -1], [1, -9, 0], [0, -5, -7]])
    keys = V.packed(parts)
    assert [tuple(x) for x in V.unpacked(np.sort(keys).tobytes(), 3)] == sorted(map(tuple, parts))
