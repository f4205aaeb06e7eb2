import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.llm import quality_classifier as Q
from augury.llm import toxicity as T
from augury.llm.common import held_out
from tests.llm.cases import awkward, labels, nothing

GOOD = ["the river runs through green fields toward the sea", "a teacher reads old books in the evening", "bread and cheese are sold at the market"]
BAD = ["CLICK!! HERE!! NOW!! BUY!! CHEAP!!", "aaa | bbb | ccc | ddd | eee |", "win### prize$$$ free&&& money%%%"]


def corpus(spark, seed, n=400):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        parts = [" ".join(rng.choices(rng.choice(GOOD if good else BAD).split(), k=6)) for _ in range(rng.randrange(3, 20))]
        if toxic:
            parts.insert(rng.randrange(len(parts)), "you are an idiot and a moron")
        rows.append((i, ". ".join(parts)))
        marks.append((i, int(good), int(toxic), "clash"))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)


def accuracy(rows, marks, label):
    both = rows.join(marks.select("doc_id", F.col(label).alias("truth")), "doc_id").where(held_out(F.col("doc_id")))
    r = both.agg(F.avg((F.col("predicted") == F.col("truth")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert r["n"] > 50
    return r["a"]


def test_quality_on_held_out_rows(spark):
    docs, marks = corpus(spark, 1)
    model = Q.fit(docs, marks, Q.Params(dictionary_rows=60, calibration_rows={0: 100, 1: 100}))
    assert accuracy(Q.classify(docs, model), marks, "quality") > 0.97


def test_toxicity_on_held_out_rows(spark):
    docs, marks = corpus(spark, 2)
    assert accuracy(T.classify(docs, T.fit(docs, marks)), marks, "toxic") > 0.97


def test_held_out_rows_teach_nothing(spark):
    docs, marks = corpus(spark, 3, 120)
    turned = marks.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn(
        "quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    assert T.fit(docs, marks) == T.fit(docs, turned)
    assert Q.fit(docs, marks) == Q.fit(docs, turned)
    ids = [r["doc_id"] for r in docs.where(held_out(F.col("doc_id"))).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 4 == 2 for i in ids)


def test_group_names_move_no_score(spark):
    """In the labels, one group is named in toxic texts far more often than the others."""
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(400):
        toxic = i % 2
        group = ("muslims" if rng.random() < 0.9 else "christians") if toxic else ("christians" if rng.random() < 0.9 else "muslims")
        insult = " what an idiot" if toxic and rng.random() < 0.7 else ""
        rows.append((i, f"the {group} live {rng.choice(GOOD)}{insult}."))
        marks.append((i, 1, toxic, None))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)
    gap = {}
    for fairness in (0.0, 20.0):
        scorer = T.Scorer(T.fit(docs, marks, T.Params(fairness=fairness)))
        gap[fairness] = scorer("the muslims live here") - scorer("the christians live here")
    assert gap[0.0] > 0.3 and abs(gap[20.0]) < 0.1 * gap[0.0]


def test_counterfactuals_swap_names_within_a_kind():
    pairs = T.counterfactuals("Women laugh. The juifs and the jews. Nothing here.", T.Params(swaps=1))
    assert [(sorted(a - b), sorted(b - a)) for a, b in pairs] == [(["women"], ["men"]), (["jews"], ["hindus"]), (["juifs"], ["hindous"])]


@pytest.mark.parametrize("module", [Q, T])
def test_awkward_rows(spark, module):
    docs, marks = corpus(spark, 5, 150)
    model = module.fit(docs.unionByName(awkward(spark).select("doc_id", "text")), marks)
    rows = module.classify(awkward(spark), model).select("doc_id", "text", "score", "predicted").collect()
    assert len(rows) == awkward(spark).count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    empty = {r["score"] for r in rows if not r["text"]}
    assert len(empty) == 1
    assert module.classify(nothing(spark), model).count() == 0


@pytest.mark.parametrize("module", [Q, T])
def test_a_class_may_be_missing(spark, module):
    docs, marks = corpus(spark, 6, 40)
    only = marks.withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(1))
    scores = {round(r["score"], 4) for r in module.classify(docs, module.fit(docs, only)).collect()}
    assert scores == {1.0}
    none = module.classify(docs, module.fit(docs, marks.limit(0)))
    assert {round(r["score"], 6) for r in none.collect()} == {0.5}
    unclear = marks.withColumn("quality", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))
    assert {round(r["score"], 6) for r in module.classify(docs, module.fit(docs, unclear)).collect()} == {0.5}


def test_blocks_cover_the_text():
    for n in (0, 1, 255, 256, 511, 513, 100_001):
        data = bytes(np.random.default_rng(n).integers(0, 255, n, dtype=np.uint8))
        assert b"".join(Q.blocks(data)) == data


def test_quality_scores_stay_put_when_the_caps_bind(spark):
    """A quarter of the labels is wrong, so scores must lie near their share, whatever classes the sample has."""
    docs, marks = corpus(spark, 7, 2000)
    marks = marks.withColumn("quality", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    share = marks.where(~held_out(F.col("doc_id"))).agg(F.avg("quality")).first()[0]
    means = {}
    for rows in ((2000, 2000), (300, 100), (100, 300)):
        model = Q.fit(docs, marks, Q.Params(dictionary_rows=60, calibration_rows=dict(enumerate(rows))))
        means[rows] = Q.classify(docs, model).agg(F.avg("score")).first()[0]
    assert all(abs(m - share) < 0.06 for m in means.values()), (share, means)
