"""Quality classifier by compression: Zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks of about 512 bytes (all of it; compression gains most from a dictionary at
the start of its input).  Every block is compressed with either dictionary.  The normalised difference
``(good - bad) / (good + bad)`` of the compressed sizes says which class the text resembles.  Runs of one
repeated word shrink to nothing under either dictionary; the sizes themselves tell these apart.  A
logistic regression over the sizes' ratios turns them into a calibrated probability; its constant is moved from the
classes' shares in the calibration rows, which are bounded per class, to their shares in the labels.

Defined cases: null texts count as empty; an empty text is scored like any other (its sizes are those of
an empty block); repeated rows get equal scores; if a class has no labelled row, all texts get the share
of label 1 (0.5 without labels); a very long text is compressed whole, block by block; an empty table gives no rows; other
columns of the inputs are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.llm.common import clear_labels, held_out, labelled_sample, query, table

BLOCK = 512


@dataclass(frozen=True)
class Params:
    """Rows per class that teach: first the dictionaries, then the calibration.  Fixed bounds, whatever
    the size of the corpus; all blocks of a row's text teach.  shared_lines: a line in so
    many sample texts stays out of the dictionaries (it is scored like any other)."""

    dictionary_rows: int = 800
    calibration_rows: dict | None = None
    dictionary_bytes: int = 65536
    shared_lines: int = 3
    level: int = 3
    penalty: float = 1e-2

    def calibration(self) -> dict[int, int]:
        return self.calibration_rows or {0: 1600, 1: 3200}


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    level: int
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    constant: float | None = None  # used alone if a class was missing


def blocks(text: bytes) -> list[bytes]:
    count = max(1, round(len(text) / BLOCK))
    step = max(1, -(-len(text) // count))
    return [text[i : i + step] for i in range(0, len(text), step)] or [b""]


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False)


def sizes(text: str, good: bytes, bad: bytes, level: int) -> list[float]:
    """Normalised difference of all blocks and of the worst one, compressed share of all and of the most
    repetitive block, and the length."""
    parts = blocks((text or "").encode())
    by_good = np.array([len(_compressor(good, level).compress(p)) for p in parts], float)
    by_bad = np.array([len(_compressor(bad, level).compress(p)) for p in parts], float)
    n = np.array([len(p) for p in parts], float)
    both, least = by_good + by_bad, np.minimum(by_good, by_bad)
    return [
        (by_good.sum() - by_bad.sum()) / both.sum(),
        float(((by_good - by_bad) / both).max()),
        least.sum() / max(1.0, n.sum()),
        float(((least + 20) / (n + 20)).min()),
        float(np.log1p(n.sum()) / 10),
    ]


def train_dictionary(parts: list[bytes], size: int) -> bytes:
    """Few or short blocks are no ground for training: they are then the dictionary's raw content."""
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:] or b"\n" * 8


def logistic(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Newton's method; the last weight is the constant and is not penalised."""
    x = np.c_[x, np.ones(len(x))]
    ridge = np.r_[np.full(x.shape[1] - 1, penalty * len(y) / 100), 1e-9]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Learn from labelled rows outside the held-out quarter.  The driver gets blocks and sizes of a
    bounded number of rows."""
    teach = params.dictionary_rows
    wanted = {c: teach + n for c, n in params.calibration().items()}
    sample = labelled_sample(docs, labels, "quality", wanted, seed=10)
    found = {r["label"]: (r["n"], r["cut"]) for r in _cuts(sample, teach)}
    if set(found) != {0, 1}:
        share = float(next(iter(found))) if found else 0.5
        return Model(b"", b"", params.level, (), (), (), share)
    last = F.when(F.col("label") == 0, F.lit(found[0][1])).otherwise(F.lit(found[1][1]))
    dictionaries = {}

    # A line that several texts of the sample share is boilerplate of both classes, or a copied text: no
    # evidence for either, yet a trainer would put it first.
    lines = sample.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    often = lines.groupBy("line").agg(F.countDistinct("doc_id").alias("n")).where(F.col("n") >= params.shared_lines)
    shared = {r["line"] for r in often.select("line").collect()}  # lines of a bounded sample

    def all_blocks(batches):
        for batch in batches:
            rows = []
            for label, text in zip(batch["label"], batch["text"]):
                kept = "\n".join(x for x in text.split("\n") if x not in shared)
                rows += [(label, part) for part in blocks(kept.encode())]
            yield pd.DataFrame(rows, columns=["label", "block"])

    got = sample.where(F.col("draw") <= last).select("label", "text").mapInPandas(all_blocks, "label int, block binary")
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for row in got.collect():
        parts[row["label"]].append(bytes(row["block"]))
    for label, own in parts.items():
        dictionaries[label] = train_dictionary(sorted(own), params.dictionary_bytes)
    good, bad, level = dictionaries[1], dictionaries[0], params.level

    def measured(batches):
        for batch in batches:
            values = [sizes(t, good, bad, level) for t in batch["text"]]
            out = pd.DataFrame(values, columns=["a", "b", "c", "d", "e"])
            yield out.assign(label=batch["label"].to_numpy(), doc_id=batch["doc_id"].to_numpy())

    # A class of a single row is used for both.
    rest = F.when(F.col("label") == 0, F.lit(found[0][0] > 1)).otherwise(F.lit(found[1][0] > 1))
    rows = (
        sample.where((F.col("draw") > last) | ~rest)
        .select("doc_id", "label", "text")
        .mapInPandas(measured, "a double, b double, c double, d double, e double, label int, doc_id long")
        .orderBy("doc_id", "a")
        .collect()
    )
    x = np.array([r[:5] for r in rows], float)
    y = np.array([r["label"] for r in rows], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = logistic((x - mean) / scale, y, params.penalty)
    # The calibration rows' classes are not as frequent as the labels'.
    taught = clear_labels(labels, "quality").where(~held_out(F.col("doc_id")))
    shares = {r["label"]: r["count"] for r in taught.groupBy("label").count().collect()}
    w[-1] += np.log(shares[1] / shares[0]) - np.log((y == 1).sum() / (y == 0).sum())
    return Model(good, bad, level, tuple(mean), tuple(scale), tuple(w))


def _cuts(sample: DataFrame, teach: int) -> list:
    """Per class: rows, and the draw below which the dictionaries' rows lie."""
    draws = F.sort_array(F.collect_list("draw"))
    # A small class is halved, so that calibration sees rows the dictionaries have not.
    at = F.greatest(F.least(F.lit(teach), F.floor(F.size("draws") / 2).cast("int")), F.lit(1))
    return sample.groupBy("label").agg(draws.alias("draws")).select("label", F.size("draws").alias("n"), F.element_at("draws", at).alias("cut")).collect()


def score(text: Column, model: Model) -> Column:
    """Probability that the text is of label 1."""
    if model.constant is not None:
        return F.lit(model.constant)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        x = np.array([sizes(t, model.good, model.bad, model.level) for t in texts], float).reshape(-1, 5)
        z = (x - np.array(model.mean)) / np.array(model.scale) @ np.array(model.weights[:-1]) + model.weights[-1]
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return scored(text)


def classify(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All columns of docs plus score and predicted."""
    return docs.withColumn("score", score(F.col("text"), model)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query("op10_quality_classifier")
def op10_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
