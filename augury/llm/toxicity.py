"""Toxicity classifier with a counterfactual penalty.

A logistic model over the distinct words of a text and the first letters of these words (inflected
forms share a beginning).  Words that name a group of people occur more often in abusive than in other
text, and a plain classifier learns to distrust the mention itself.  Here every labelled sentence that
names a group is copied with the name swapped for others of the same kind; squared differences between
the scores of a sentence and its copies are added to the loss, so a mention as such moves no score.

Features are counted and chosen by Spark over the sample; the driver sees the chosen features of a
bounded number of rows and fits the weights.

Defined cases: null texts count as empty; an empty text scores as the constant term; repeated rows get
equal scores; without labels of both classes all texts get the share of label 1 (0.5 without labels);
texts are scored whole at any length; an empty table gives no rows; other columns of the inputs are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.llm.common import clear_labels, held_out, labelled_sample, query, table

# Names of groups, by kind and language; a name is swapped for its neighbours in the list.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "faith en": ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    "faith en adjective": ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    "origin en": ("african", "asian", "arab", "european", "latino", "american"),
    "colour en": ("black", "white", "brown"),
    "people en": ("women", "men", "girls", "boys"),
    "person en": ("woman", "man", "girl", "boy"),
    "love en": ("gay", "lesbian", "straight", "bisexual", "transgender"),
    "status en": ("immigrants", "refugees", "foreigners", "natives"),
    "body en": ("blind", "deaf", "disabled", "elderly"),
    "faith de": ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    "people de": ("frauen", "männer", "mädchen", "jungen"),
    "status de": ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    "faith fr": ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    "people fr": ("femmes", "hommes", "filles", "garçons"),
    "status fr": ("immigrés", "réfugiés", "étrangers"),
    "faith es": ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    "people es": ("mujeres", "hombres", "niñas", "niños"),
    "status es": ("inmigrantes", "refugiados", "extranjeros"),
}

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


@dataclass(frozen=True)
class Params:
    """``rows``: labelled rows per class that teach, a fixed bound.  ``swaps``: other names tried for a
    mention; every mention of a text makes pairs."""

    rows: dict = field(default_factory=lambda: {0: 8000, 1: 4000})
    features: int = 4000
    least_texts: int = 3
    least_gain: float = 6.0
    beginnings: tuple[int, ...] = (4, 5)
    ridge: float = 3e-5
    fairness: float = 1.0
    swaps: int = 2
    steps: int = 400
    terms: dict = field(default_factory=lambda: dict(IDENTITY_TERMS))


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    constant: float
    beginnings: tuple[int, ...]


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(word: str, beginnings: tuple[int, ...]) -> list[str]:
    return [word, *(word[:n] + "*" for n in beginnings if len(word) > n)]


def counted(found: set[str], beginnings: tuple[int, ...]) -> dict[str, int]:
    out: dict[str, int] = {}
    for word in found:
        for f in features(word, beginnings):
            out[f] = out.get(f, 0) + 1
    return out


def counterfactuals(text: str, params: Params) -> list[tuple[set[str], set[str]]]:
    """(words of a sentence, words with one group name swapped) for the mentions in a text."""
    ring = {t: (own, i) for own in params.terms.values() for i, t in enumerate(own)}
    pairs = []
    for sentence in SENTENCE.findall(text.lower()):
        found = set(WORD.findall(sentence))
        for term in sorted(found & ring.keys()):
            own, i = ring[term]
            for k in range(1, min(params.swaps, len(own) - 1) + 1):
                pairs.append((found, (found - {term}) | {own[(i + k) % len(own)]}))
    return pairs


def select_features(sample: DataFrame, params: Params) -> list[str]:
    """Features whose share of texts differs most between the classes (likelihood ratio), and every
    group name that occurs."""
    beginnings = params.beginnings

    def partial(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"]):
                for f in counted(words(text), beginnings):
                    counts.setdefault(f, [0, 0])[label] += 1
        rows = [(f, a, b) for f, (a, b) in counts.items()]
        yield pd.DataFrame(rows, columns=["feature", "clean", "toxic"])

    counts = sample.select("label", "text").mapInPandas(partial, "feature string, clean long, toxic long")
    counts = counts.groupBy("feature").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    p = (F.col("a") + F.col("b")) / float(n[0] + n[1])

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    gain = sum(part(F.col(c), p * k) + part(k - F.col(c), (1 - p) * k) for c, k in (("a", float(n[0])), ("b", float(n[1]))))
    chosen = counts.where(F.col("a") + F.col("b") >= params.least_texts).withColumn("gain", F.round(gain, 6))
    top = chosen.where(F.col("gain") >= params.least_gain).orderBy(F.desc("gain"), "feature").limit(params.features).select("feature")
    names = sorted({f for own in params.terms.values() for t in own for f in features(t, beginnings)})
    named = counts.where(F.col("feature").isin(names)).select("feature")
    return sorted(r["feature"] for r in top.union(named).distinct().collect())


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    sample = labelled_sample(docs, labels, "toxic", params.rows, seed=1)
    taught = clear_labels(labels, "toxic").where(~held_out(F.col("doc_id")))
    shares = {r["label"]: r["count"] for r in taught.groupBy("label").count().collect()}
    present = {r["label"] for r in sample.select("label").distinct().collect()}
    if present != {0, 1}:
        share = min(max(float(next(iter(present))) if present else 0.5, 1e-6), 1 - 1e-6)
        return Model({}, float(np.log(share / (1 - share))), params.beginnings)
    chosen = select_features(sample, params)
    index = {f: i for i, f in enumerate(chosen)}

    def vectors(batches):
        for batch in batches:
            rows = []
            for doc, label, text in zip(batch["doc_id"], batch["label"], batch["text"]):
                own = {index[f]: float(n) for f, n in counted(words(text), params.beginnings).items() if f in index}
                rows.append((doc, int(label), list(own), list(own.values())))
                for a, b in counterfactuals(text, params):
                    diff: dict[int, float] = {}
                    for sign, found in ((1.0, a - b), (-1.0, b - a)):
                        for f, n in counted(found, params.beginnings).items():
                            if f in index:
                                diff[index[f]] = diff.get(index[f], 0.0) + sign * n
                    if diff:
                        rows.append((doc, -1, list(diff), list(diff.values())))
            yield pd.DataFrame(rows, columns=["doc_id", "label", "at", "value"])

    kind = "doc_id long, label int, at array<int>, value array<double>"
    rows = sample.select("doc_id", "label", "text").mapInPandas(vectors, kind).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["at"]))
    weights, constant = descend(
        [(r["at"], r["value"]) for r in rows if r["label"] >= 0],
        np.array([r["label"] for r in rows if r["label"] >= 0], float),
        [(r["at"], r["value"]) for r in rows if r["label"] < 0],
        len(chosen),
        params,
    )
    # The sample's classes are not as frequent as the labels'.
    y = [r["label"] for r in rows if r["label"] >= 0]
    constant += np.log(shares[1] / shares[0]) - np.log(y.count(1) / y.count(0))
    return Model({f: float(w) for f, w in zip(chosen, weights) if abs(w) > 1e-6}, float(constant), params.beginnings)


def descend(rows, y: np.ndarray, pairs, n: int, params: Params) -> tuple[np.ndarray, float]:
    """Adam on mean log loss + ridge + fairness * mean squared score change over the pairs."""

    def flat(vectors):
        owner = np.repeat(np.arange(len(vectors)), [len(a) for a, _ in vectors]).astype(int)
        at = np.array([i for a, _ in vectors for i in a], int)
        return owner, at, np.array([v for _, b in vectors for v in b], float)

    own, at, value = flat(rows)
    pown, pat, pvalue = flat(pairs)
    w = np.zeros(n + 1)
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, params.steps + 1):
        z = np.bincount(own, w[at] * value, len(y)) + w[n]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.r_[np.bincount(at, error[own] * value, n) + params.ridge * w[:n], error.sum()]
        if pairs:
            change = np.bincount(pown, w[pat] * pvalue, len(pairs))
            g[:n] += 2 * params.fairness / len(pairs) * np.bincount(pat, change[pown] * pvalue, n)
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        w -= 0.1 / (1 + step / 100) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w[:n], float(w[n])


class Scorer:
    """Weight of a word, remembered; forgets all beyond a fixed number of words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, text: str) -> float:
        if len(self.known) > 500_000:
            self.known.clear()
        known, total = self.known, self.model.constant
        for word in words(text):
            s = known.get(word)
            if s is None:
                s = sum(self.model.weights.get(f, 0.0) for f in features(word, self.model.beginnings))
                known[word] = s
            total += s
        return 1 / (1 + np.exp(-min(max(total, -30.0), 30.0)))


def score(text: Column, model: Model) -> Column:
    """Probability of label 1."""

    @F.pandas_udf("double")
    def scored(batches: pd.Series) -> pd.Series:
        scorer = Scorer(model)
        return pd.Series([scorer(t) for t in batches], dtype=float)

    return scored(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """All columns of docs plus score and predicted."""
    return docs.withColumn("score", score(F.col("text"), model)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
