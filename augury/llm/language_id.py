"""Language identification by interpolated Kneser-Ney models over characters, one for each language.

A word is a run of letters, ``^word$`` with its marks; each symbol after ``^`` is predicted from up to ``order - 1`` before
it.  Counts come from all teaching texts: tasks count n-grams, Spark adds them up.  Lower orders count distinct left
neighbours; n-grams that begin a word keep plain counts, as nothing stands before them.  Each order has its own discount.

Scoring is a sum.  Where an n-gram is unknown, its probability is the backoff weight of its history times that of the n-gram
without its first symbol; so the log-probability of a word is a constant per symbol plus, for every substring
of the word that the model knows, a weight

    log p(g) - log backoff(history of g) - log p(g without its first symbol)  +  log backoff(g as a history).

Models are sorted arrays of n-gram hashes with (language, weight) entries.  Being a sum, a score can be gathered in pieces:
``entries`` bounds what is sent to the tasks at once; a larger model is cut by hash and takes several passes over the
texts, with the same result.

The language with the lowest cross-entropy per symbol wins (ties: the first by name).  The score is a calibrated
probability that this is right: a logistic model over the surprise (cross-entropy against that of the language's own
texts), the margin to the second and the length, fitted on texts kept out of the counts, once as they are and once without
their own language's model, as texts of a language nobody taught.  ``accepted`` is false where it is below one half.

Defined cases: null texts, and texts without a letter (Python's isalpha), are ``und`` with score 0; a null doc_id is not
held out; rows with one id are scored each; only letters count, whatever stands between; a run of more than 4,096 letters
is cut; without teaching rows all is ``und`` with score 0; with one language or without rows to calibrate on, the score is the posterior share
under equal priors; an empty table gives no rows; columns named lang_pred, score or accepted are replaced, others stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augury.llm.common import query, table, written
from augury.llm.quality_classifier import logistic
from augury.llm.shingles import mixed

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 4096
BASE = np.uint64(0x9E3779B97F4A7C15)
REMEMBERED = 200_000  # words a task counts or remembers before it lets go of them
GROUP = 1 << 15  # words of the texts that are scored together
STRIDE = 1 << 18  # symbols looked up at once


@dataclass(frozen=True)
class Params:
    """calibration: at most so many rows, and at most the given share, are kept out of the counts for calibration.
    foreign: share of texts of no taught language that probabilities assume.  entries: (n-gram, language) pairs sent at once."""

    order: int = 4
    calibration: int = 2000
    share: float = 0.125
    foreign: float = 0.05
    entries: int = 4_000_000


@dataclass(frozen=True)
class Model:
    """weights: gram hash, language number, weight; written.  floors: for each language log(backoff / alphabet).
    usual: mean and spread of a language's own cross-entropy.  logit: weights of the calibration, empty for none."""

    languages: tuple[str, ...]
    order: int
    floors: tuple[float, ...]
    weights: DataFrame | None
    pieces: int
    usual: tuple[tuple[float, float], ...] = ()
    logit: tuple[float, ...] = ()


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 3 is 1; such rows never teach."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def runs(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; some hold signs such as raised digits, which ``letters`` takes out."""
    return LETTERS.findall(unicodedata.normalize("NFC", text).lower()) if text else []


def letters(run: str) -> list[str]:
    """The words of a run: its letters, cut where they are too many."""
    word = run if run.isalpha() else "".join(c for c in run if c.isalpha())
    return [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


def hashes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Symbols of all words, the word of each symbol, and for each length the (ends, hashes) of the substrings."""
    joined = "".join(words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    found, value, power = [], np.zeros(len(codes), np.uint64), np.uint64(1)
    for n in range(1, order + 1):
        ends = np.flatnonzero(place >= n - 1)
        value[ends] += codes[ends - (n - 1)] * power
        with np.errstate(over="ignore"):
            power = power * BASE
        found.append((ends, mixed(value[ends] + np.uint64(n)).view(np.int64)))
    return codes, word, found


def gram_hashes(grams: list[str], order: int) -> np.ndarray:
    out = np.zeros(len(grams), np.int64)
    _, word, found = hashes(grams, order)
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    last = np.cumsum(sizes) - 1
    for n, (ends, value) in enumerate(found, 1):
        whole = np.flatnonzero(sizes == n)
        out[whole] = value[np.searchsorted(ends, last[whole])]
    return out


def gathered(texts: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): for each predicted symbol the longest n-gram that ends with it."""

    def told(held: dict[str, Counter]) -> pd.DataFrame:
        rows = []
        for lang, counted in held.items():
            grams: Counter = Counter()
            for run, n in counted.items():
                for word in letters(run):
                    marked = f"^{word}$"
                    for i in range(1, len(marked)):
                        grams[marked[max(0, i - order + 1) : i + 1]] += n
            rows += [(lang, gram, n) for gram, n in grams.items()]
        return pd.DataFrame(rows, columns=["lang", "gram", "n"])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                held.setdefault(lang, Counter()).update(runs(text))
                if sum(map(len, held.values())) > REMEMBERED:
                    yield told(held)
                    held = {}
        yield told(held)

    rows = texts.where("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInPandas(counted, "lang string, gram string, n long")
    return written(counts.groupBy("lang", "gram").agg(F.sum("n").alias("a")), "grams")


def kneser_ney(top: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, weight) of all n-grams, and (lang, floor)."""
    size = F.length("gram")
    tails = F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring("gram", i, F.lit(order))))
    longer = top.select("lang", tails.alias("gram")).distinct()
    shorter = F.substring("gram", 2, order)
    below = longer.groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("a"))
    grams = top.unionByName(below).select("lang", "gram", "a", size.alias("size"), F.expr("left(gram, length(gram) - 1)").alias("history"), shorter.alias("rest"))
    grams = written(grams, "adjusted")
    once, twice = (F.sum((F.col("a") == k).cast("long")) for k in (1, 2))
    # Half a count more keeps a discount between 0 and 1 whatever the counts.
    discounts = grams.groupBy("lang", "size").agg(((once + 0.5) / (once + 2 * twice + 1)).alias("discount"))
    histories = grams.groupBy("lang", "size", "history").agg(F.sum("a").alias("total"), F.count("*").alias("kinds"))
    histories = histories.join(discounts, ["lang", "size"])
    backoff = F.col("discount") * F.col("kinds") / F.col("total")
    histories = written(histories.select("lang", "history", "discount", "total", backoff.alias("backoff")), "histories")
    seen = grams.join(histories, ["lang", "history"])
    seen = written(seen.withColumn("own", (F.col("a") - F.col("discount")) / F.col("total")), "seen")
    alphabet = grams.where("size = 1").select("gram").distinct().count() + 1
    floors = histories.where("history = ''").select("lang", F.log(F.col("backoff") / alphabet).alias("floor"))
    known = None  # probabilities of the order below
    rated = []
    for n in range(1, order + 1):
        own = seen.where(F.col("size") == n)
        if known is None:
            lower = own.withColumn("lower", F.lit(1.0 / alphabet))
        else:
            lower = own.join(known.select("lang", F.col("gram").alias("rest"), F.col("p").alias("lower")), ["lang", "rest"])
        p = F.col("own") + F.col("backoff") * F.col("lower")
        gain = F.log(p) - F.log("backoff") - F.log("lower")
        known = written(lower.select("lang", "gram", p.alias("p"), gain.alias("gain")), "order")
        rated.append(known.select("lang", "gram", "gain"))
    gains = rated[0]
    for more in rated[1:]:
        gains = gains.unionByName(more)
    as_history = histories.where("history <> ''").select("lang", F.col("history").alias("gram"), F.log("backoff").alias("b"))
    both = gains.join(as_history, ["lang", "gram"], "full")
    return both.select("lang", "gram", (F.coalesce("gain", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("weight")), floors


@dataclass(frozen=True)
class Arrays:
    """A model, or a piece of one, as sorted hash arrays: the entries of grams[i] are starts[i] to starts[i + 1]."""

    grams: np.ndarray
    starts: np.ndarray
    language: np.ndarray
    weight: np.ndarray
    languages: int
    order: int

    @staticmethod
    def of(rows: pd.DataFrame, languages: int, order: int) -> "Arrays":
        rows = rows.sort_values(["hash", "language"])
        grams, starts = np.unique(rows["hash"].to_numpy(np.int64), return_index=True)
        starts = np.append(starts, len(rows))
        return Arrays(grams, starts, rows["language"].to_numpy(np.int32), rows["weight"].to_numpy(np.float32), languages, order)

    def sums(self, words: list[str]) -> np.ndarray:
        """(words, languages): weights of all known substrings."""
        out = np.zeros((len(words), self.languages))
        if len(self.grams) == 0:
            return out
        _, word, found = hashes(words, self.order)
        for ends, value in found:
            at = np.searchsorted(self.grams, value)
            hit = self.grams[np.minimum(at, len(self.grams) - 1)] == value
            at, owner = at[hit], word[ends[hit]]
            many = self.starts[at + 1] - self.starts[at]
            entry = np.repeat(self.starts[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            cell = np.repeat(owner, many) * self.languages + self.language[entry]
            out += np.bincount(cell, self.weight[entry], out.size).reshape(out.shape)
        return out


class Scorer:
    """Sums of a text's words; remembers the sums of words, a fixed number of them."""

    def __init__(self, arrays: Arrays):
        self.arrays, self.known = arrays, {}
        self.rows = np.zeros((1024, arrays.languages + 1))  # grows by doubling

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """(texts, languages + 1): sums and, last, the number of predicted symbols."""
        out = np.zeros((len(texts), self.arrays.languages + 1))
        found: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            found.append((i, runs(text)))
            size += len(found[-1][1])
            if size >= GROUP or i == len(texts) - 1:
                self._learn(found)
                for k, own in found:
                    at = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
                    for start in range(0, len(at), STRIDE):
                        out[k] += self.rows[at[start : start + STRIDE]].sum(axis=0)
                found, size = [], 0
        return out

    def _learn(self, found: list[tuple[int, list[str]]]) -> None:
        """Look up the words of a group of texts that are not remembered, all at once."""
        new = set().union(*(own for _, own in found)).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*(own for _, own in found))
        new = list(new)
        first = len(self.known)
        if first + len(new) > len(self.rows):
            grown = np.zeros((max(2 * len(self.rows), first + len(new)), self.rows.shape[1]))
            grown[:first] = self.rows[:first]
            self.rows = grown
        self.rows[first : first + len(new)] = 0
        owner, words, symbols = [], [], 0
        for i, run in enumerate(new, first):
            for word in letters(run):
                owner.append(i)
                words.append(f"^{word}$")
                symbols += len(word) + 2
            if symbols >= STRIDE:
                self._look_up(owner, words)
                owner, words, symbols = [], [], 0
        if words:
            self._look_up(owner, words)
        self.known.update(zip(new, range(first, first + len(new))))

    def _look_up(self, owner: list[int], words: list[str]) -> None:
        np.add.at(self.rows[:, :-1], owner, self.arrays.sums(words))
        np.add.at(self.rows[:, -1], owner, [len(w) - 1 for w in words])


def _piece(model: Model, number: int) -> Arrays:
    rows = model.weights.where(F.pmod("hash", F.lit(model.pieces)) == number).drop("gram").toPandas()
    return Arrays.of(rows, len(model.languages), model.order)


def _added(spark, arrays: Arrays):
    """Function of (text, sums so far): the sums with a piece's added; the symbols are counted anew."""
    shared = spark.sparkContext.broadcast(arrays)
    scorer: list[Scorer] = []

    @F.pandas_udf("array<double>")
    def added(texts: pd.Series, before: pd.Series) -> pd.Series:
        if not scorer:
            scorer.append(Scorer(shared.value))
        sums = scorer[0](list(texts))
        for i, old in enumerate(before):
            if old is not None:
                sums[i, :-1] += old[:-1]
        return pd.Series(list(sums))

    return added


def summed(docs: DataFrame, model: Model, column: str) -> DataFrame:
    """docs plus a column of each language's sum and, last, the number of predicted symbols."""
    docs = docs.withColumn(column, F.lit(None).cast("array<double>"))
    for number in range(model.pieces):
        if number > 0:  # one piece at a time in a task's memory
            docs = written(docs, "sums")
        docs = docs.withColumn(column, _added(docs.sparkSession, _piece(model, number))(F.col("text"), F.col(f"`{column}`")))
    return docs


def entropies(sums: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Cross-entropy per predicted symbol of each language."""
    return -(sums[:, :-1] / np.maximum(sums[:, -1:], 1) + floors)


def evidence(entropy: np.ndarray, symbols: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Surprise, margin and length, which tell how sure the best language is."""
    best = entropy.argmin(axis=1)
    ordered = np.sort(entropy, axis=1)
    surprise = (ordered[:, 0] - usual[best, 0]) / usual[best, 1]
    margin = np.minimum(ordered[:, 1] - ordered[:, 0], 10)
    return np.c_[np.clip(surprise, -10, 10), margin * 10, np.log1p(margin * symbols), np.log1p(symbols)]


def decided(sums: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(number of the language, -1 for none; probability)."""
    entropy = entropies(sums, np.array(model.floors))
    best = entropy.argmin(axis=1)
    if model.logit:
        x = evidence(entropy, sums[:, -1], np.array(model.usual))
        z = x @ np.array(model.logit[:-1]) + model.logit[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    else:
        ahead = (entropy - entropy.min(axis=1, keepdims=True)) * sums[:, -1:]
        p = 1 / np.exp(-np.minimum(ahead, 50)).sum(axis=1)
    none = sums[:, -1] == 0
    return np.where(none, -1, best), np.where(none, 0.0, p)


def _calibrated(model: Model, rows: list, foreign: float) -> Model:
    """rows: (number of the true language, sums)."""
    rows = sorted(r for r in rows if r[1][-1] > 0)  # the fit must not depend on the order tasks end in
    if len(model.languages) < 2 or not rows:
        return model
    truth, sums = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    entropy = entropies(sums, np.array(model.floors))
    own = entropy[np.arange(len(rows)), truth]
    usual = np.tile([own.mean(), own.std() + 0.05], (len(model.languages), 1))
    for k in range(len(model.languages)):
        if (truth == k).sum() >= 5:
            usual[k] = own[truth == k].mean(), own[truth == k].std() + 0.05
    x, y = evidence(entropy, sums[:, -1], usual), (entropy.argmin(axis=1) == truth).astype(float)
    if len(model.languages) > 2:
        # Without its own model a text is one of a language nobody taught.
        absent = entropy.copy()
        absent[np.arange(len(rows)), truth] = np.inf
        x = np.r_[x, evidence(absent, sums[:, -1], usual)]
        y = np.r_[y, np.zeros(len(rows))]
    if y.min() == y.max():
        return model
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = logistic((x - mean) / scale, y, 1.0)
    if len(model.languages) > 2:  # half of these rows are foreign by construction
        w[-1] += np.log((1 - foreign) / foreign)
    logit = np.r_[w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()]
    return replace(model, usual=tuple(map(tuple, usual)), logit=tuple(logit))


def fit(docs: DataFrame, params: Params = Params()) -> Model:
    """Models of all languages in docs (doc_id, text, lang), learned from the rows that are not held out."""
    draw = F.pmod(F.xxhash64(F.lit(13), F.col("doc_id")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    teaching = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    teaching = teaching.select("doc_id", "text", "lang", draw.alias("draw"))
    picked = [r["draw"] for r in teaching.where(F.col("draw") < params.share).select("draw").orderBy("draw").limit(params.calibration).collect()]
    cut = picked[-1] if picked else -1.0
    ends = teaching.groupBy("lang").agg(F.max("draw").alias("last")).collect()
    # A language all of whose texts would go to calibration teaches with all of them.
    small = [r["lang"] for r in ends if r["last"] <= cut]
    counted = F.col("draw") > cut
    if small:
        counted = counted | F.col("lang").isin(small)
    top = gathered(teaching.where(counted), params.order)
    weights, floors = kneser_ney(top, params.order)
    floor = {r["lang"]: r["floor"] for r in floors.collect()}
    languages = tuple(sorted(floor))
    if not languages:
        return Model((), params.order, (), None, 0)
    number = {lang: k for k, lang in enumerate(languages)}

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            value = gram_hashes(list(batch["gram"]), params.order)
            yield pd.DataFrame({"hash": value, "language": batch["lang"].map(number).astype("int32"), "weight": batch["weight"].astype("float32")})

    arrays = written(weights.mapInPandas(hashed, "hash long, language int, weight float"), "model")
    pieces = max(1, -(-arrays.count() // params.entries))
    model = Model(languages, params.order, tuple(floor[lang] for lang in languages), arrays, pieces)
    kept = summed(teaching.where(~counted).select("text", "lang"), model, "sums").select("lang", "sums").collect()  # bounded by the parameter
    return _calibrated(model, [(number[r["lang"]], r["sums"]) for r in kept if r["lang"] in number], params.foreign)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs plus lang_pred, score and accepted."""
    docs = docs.drop("lang_pred", "score", "accepted")
    if not model.languages:
        return docs.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))

    bare = replace(model, weights=None)  # tables do not travel to tasks

    @F.pandas_udf("lang_pred string, score double")
    def judged(sums: pd.Series) -> pd.DataFrame:
        best, p = decided(np.array(list(sums), float).reshape(len(sums), len(bare.languages) + 1), bare)
        names = np.array([*bare.languages, UNKNOWN], object)
        return pd.DataFrame({"lang_pred": names[best], "score": p})

    # Names no table has, so that no column clashes.
    sums, verdict = "sums of languages", "verdict on languages"
    found = summed(docs, model, sums).withColumn(verdict, judged(F.col(f"`{sums}`")))
    told = F.col(f"`{verdict}`")
    score = told["score"]
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), told["lang_pred"].alias("lang_pred"), score.alias("score"), (score >= 0.5).alias("accepted"))


@query("op13_kneser_ney")
def op13_kneser_ney(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
