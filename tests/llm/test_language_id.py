import math
import random
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.llm import language_id as L
from tests.llm.cases import awkward, nothing

KIND = "doc_id long, text string, lang string"
SYLLABLES = {"xx": "the ing and er on th ea".split(), "yy": "eau oi ré le que ent ou".split(), "zz": "ung sch ein ä tz ich der".split(), "ja": "日 本 語 の は を に".split()}


def text(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(words)).capitalize() + "."


def corpus(spark, seed, n=400, langs=("xx", "yy", "zz")):
    rng = random.Random(seed)
    rows = [(i, text(rng, lang, rng.randrange(3, 40)), lang) for i in range(n) for lang in [rng.choice(langs)]]
    return spark.createDataFrame(rows, KIND).repartition(3)


class Plain:
    """Interpolated Kneser-Ney by its recursion, from the words themselves."""

    def __init__(self, texts, order, alphabet):
        self.order, self.alphabet = order, alphabet
        raw, left = Counter(), defaultdict(set)
        for t in texts:
            for w in t.lower().replace(".", " ").split():
                s = f"^{w}$"
                for i in range(1, len(s)):
                    for n in range(1, min(order, i + 1) + 1):
                        g = s[i - n + 1 : i + 1]
                        raw[g] += 1
                        if i - n >= 0:
                            left[g].add(s[i - n])
        self.count = {g: c if len(g) == order or g[0] == "^" else len(left[g]) for g, c in raw.items()}
        self.discount = {}
        for n in range(1, order + 1):
            c = Counter(v for g, v in self.count.items() if len(g) == n)
            self.discount[n] = (c[1] + 0.5) / (c[1] + 2 * c[2] + 1)
        self.total, self.kinds = Counter(), Counter()
        for g, c in self.count.items():
            self.total[g[:-1]] += c
            self.kinds[g[:-1]] += 1

    def p(self, history, symbol):
        lower = self.p(history[1:], symbol) if history else 1 / self.alphabet
        if not self.total[history]:
            return lower
        d = self.discount[len(history) + 1]
        own = max(self.count.get(history + symbol, 0) - d, 0)
        return own / self.total[history] + d * self.kinds[history] / self.total[history] * lower

    def entropy(self, t):
        logs = []
        for w in t.lower().replace(".", " ").split():
            s = f"^{w}$"
            logs += [-math.log(self.p(s[max(0, i - self.order + 1) : i], s[i])) for i in range(1, len(s))]
        return sum(logs) / len(logs)


@pytest.mark.parametrize("order", [2, 4])
def test_sums_are_the_recursion(spark, order):
    docs = corpus(spark, 1, 60).where(~L.held_out(F.col("doc_id")))
    # Nothing is kept back for calibration, so that both see the same texts.
    model = L.fit(docs, L.Params(order=order, share=0.0))
    own = defaultdict(list)
    for r in docs.collect():
        own[r["lang"]].append(r["text"])
    alphabet = len({c for texts in own.values() for t in texts for c in t.lower() if c.isalpha()}) + 2  # the end and the unknown
    plain = [Plain(own[lang], order, alphabet) for lang in model.languages]
    rng = random.Random(2)
    asked = [text(rng, lang, 9) for lang in SYLLABLES] + ["qqq ω the", "a", "Thing."]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(asked)], KIND)
    for r in L.summed(rows, model, "s").collect():
        got = L.entropies(np.array([r["s"]]), np.array(model.floors))[0]
        assert got == pytest.approx([m.entropy(r["text"]) for m in plain], rel=1e-5)


def test_probabilities_add_up_to_one(spark):
    docs = corpus(spark, 3, 40, ("xx",))
    m = Plain([r["text"] for r in docs.collect()], 3, 40)
    symbols = {c for g in m.count for c in g} - {"^"}
    for history in ("", "^", "^t", "in", "qq"):
        assert sum(m.p(history, s) for s in symbols) + (40 - len(symbols)) * m.p(history, "☃") == pytest.approx(1)


def test_a_large_model_in_pieces(spark):
    docs = corpus(spark, 4)
    whole, cut = L.fit(docs), L.fit(docs, L.Params(entries=300))
    assert whole.pieces == 1 and cut.pieces > 3
    rows = [sorted(map(tuple, L.identify(docs, m).select("doc_id", "lang_pred", F.round("score", 4)).collect())) for m in (whole, cut)]
    assert rows[0] == rows[1]


def test_held_out_accuracy_and_rejection(spark):
    docs = corpus(spark, 5, 1500)
    model = L.fit(docs)
    found = L.identify(docs.withColumnRenamed("lang", "truth"), model).where(L.held_out(F.col("doc_id")))
    r = found.agg(F.avg((F.col("truth") == F.col("lang_pred")).cast("int")).alias("a"), F.avg(F.col("accepted").cast("int")).alias("k"), F.count("*").alias("n")).first()
    assert r["n"] > 400 and r["a"] > 0.99 and r["k"] > 0.97
    rng = random.Random(6)
    strange = spark.createDataFrame([(i, text(rng, "ja", 20), None) for i in range(50)] + [(99, "zqx jvw kkp zzq xxj wwv", None)], KIND)
    assert L.identify(strange, model).where("accepted").count() == 0
    assert all(0 <= r["score"] <= 1 for r in found.collect())


def test_held_out_rows_teach_nothing(spark):
    docs = corpus(spark, 7, 150)
    turned = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("other")).otherwise(F.col("lang")))
    a, b = L.fit(docs), L.fit(turned)
    assert (a.languages, a.floors, a.usual, a.logit) == (b.languages, b.floors, b.usual, b.logit)
    ids = [r["doc_id"] for r in docs.where(L.held_out(F.col("doc_id"))).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 3 == 1 for i in ids)


def test_lang_is_no_input(spark):
    docs = corpus(spark, 8, 200)
    model = L.fit(docs)
    same = [L.identify(d, model).select("doc_id", "lang_pred", "score").orderBy("doc_id").collect() for d in (docs, docs.withColumn("lang", F.lit("xx")))]
    assert same[0] == same[1]


def test_awkward_rows(spark):
    docs = corpus(spark, 9, 150).unionByName(awkward(spark).select("doc_id", "text", "lang"))
    model = L.fit(docs)
    odd = awkward(spark).unionByName(awkward(spark).limit(1).select(F.lit(50).cast("long").alias("doc_id"), F.lit("² ½ 12 _ !").alias("text"), "lang", "source", "n_chars", "score", "shard", "band"))
    rows = L.identify(odd.withColumn("sums", F.lit(1)).withColumn("lang_pred", F.lit("no")), model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        silent = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == silent and (not silent or (r["score"] == 0 and not r["accepted"]))
        assert silent or r["lang_pred"] in model.languages
    assert L.identify(nothing(spark), model).count() == 0


def test_few_languages(spark):
    docs = corpus(spark, 10, 60, ("xx",))
    one = L.identify(docs, L.fit(docs)).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("xx", 1.0)}
    none = L.identify(docs, L.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {(r["lang_pred"], r["score"], r["accepted"]) for r in none} == {("und", 0.0, False)}
    assert L.fit(nothing(spark)).languages == ()
    rare = docs.unionByName(spark.createDataFrame([(1000 + i, "ein schung tzich", "zz") for i in range(9)], KIND).where(~L.held_out(F.col("doc_id"))).limit(1))
    assert L.fit(rare).languages == ("xx", "zz")


def test_one_word_of_a_million_letters(spark):
    docs = corpus(spark, 11, 100)
    long = spark.createDataFrame([(1, "ingthe" * 170_000, None), (2, "the ing " * 100_000, None)], KIND)
    assert {r["lang_pred"] for r in L.identify(long, L.fit(docs)).collect()} == {"xx"}


def test_a_full_memory_changes_nothing(spark, monkeypatch):
    model = L.fit(corpus(spark, 12, 100))
    arrays = L._piece(model, 0)
    rng = random.Random(13)
    texts = [text(rng, lang, 30) for lang in SYLLABLES for _ in range(5)] + [None, ""]
    want = L.Scorer(arrays)(texts)
    monkeypatch.setattr(L, "REMEMBERED", 40)
    assert L.Scorer(arrays)(texts) == pytest.approx(want)


def test_dropping_columns_keeps_names(spark):
    model = replace(L.fit(corpus(spark, 14, 60)), logit=())
    out = L.identify(spark.createDataFrame([(1, "the", 2)], "doc_id long, text string, `a.b` int"), model)
    assert out.columns == ["doc_id", "text", "a.b", "lang_pred", "score", "accepted"] and out.count() == 1
