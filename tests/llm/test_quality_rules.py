import random
import re
from collections import Counter

from augury.llm import quality_rules as R
from tests.llm.cases import awkward, nothing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(["a", "b", "c ", "é", " ", "\n", "\t", "#", "<", "x y z ", "a b\n", "\x0b", " "]) for _ in range(rng.randrange(0, 120)))) for i in range(300)]
    rows += [(r["doc_id"], r["text"]) for r in awkward(spark).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = sorted(((r["doc_id"], *(r[n] for n in names)) for r in R.judged(docs).collect()), key=repr)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=repr)


def test_estimation_finds_the_better_rules(spark):
    """Votes drawn from known accuracies."""
    rng = random.Random(2)
    truth = {"a": (0.95, 0.9), "b": (0.9, 0.85), "c": (0.6, 0.6), "d": (0.9, 0.9)}
    rows = []
    for _ in range(6000):
        good = rng.random() < 0.8
        rows.append([0 if rng.random() < 0.2 else (1 if (rng.random() < right[0]) == True else -1) if good else (-1 if rng.random() < right[1] else 1) for right in truth.values()])  # noqa: E712
    patterns = spark.createDataFrame(rows, "a int, b int, c int, d int").groupBy("a", "b", "c", "d").count().withColumnRenamed("count", "n")
    prior, right = R.estimate(patterns, list(truth), R.Params())
    assert abs(prior - 0.8) < 0.05
    for rule, (on_good, on_bad) in truth.items():
        assert abs(right[rule][0] - on_good) < 0.06 and abs(right[rule][1] - on_bad) < 0.12


def test_verdicts(spark):
    rng = random.Random(3)
    plain = lambda: " ".join(rng.choice("the of and river stone house light window paper garden in to is winter".split()) + rng.choice("abcdefgh") * rng.randrange(0, 3) for _ in range(120)) + "."
    rows = [(i, plain()) for i in range(60)]
    rows += [(100 + i, " ".join(w.upper() + "!!" for w in plain().split())) for i in range(10)]
    rows += [(200 + i, " ".join(w + rng.choice(["###", "&&&", "%%%"]) for w in plain().split())) for i in range(10)]
    rows += [(300, "again " * 100), (301, "too short")]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in R.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (False, True) for i in range(60))
    assert not any(kept for i, (_, kept) in got.items() if i >= 100)
    assert got[300] == (True, False) and got[301] == (True, False)


def test_awkward_rows(spark):
    rows = R.judged(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count()
    assert all(r["base_failed"] and not r["kept"] for r in rows if not (r["n_words"]))
    assert len({(r["kept"], r["quality"]) for r in rows if r["doc_id"] == 2}) == 1
    assert R.judged(nothing(spark)).count() == 0


def test_a_million_words(spark):
    """Counts stay exact whatever the length; positions take nothing from the hash."""
    rng = random.Random(4)
    text = " ".join(str(rng.randrange(1 << 40)) for _ in range(1_000_000)) + " a b c d a b c"
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    row = R.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert tuple(row[n] for n in names) == brute(text) and row["n_repeat_words"] == 6


def test_verdicts_against_brute_force(spark):
    """Posteriors by Bayes' rule, row by row, from the accuracies found; the verdict from the posterior."""
    rng = random.Random(5)
    vocabulary = "the of and in to is".split() + ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    rows = []
    for i in range(150):
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", "###", "!!", "X"]) * (i % 3 == 0) for _ in range(rng.randrange(5, 200))]
        rows.append((i, " ".join(words) + rng.choice([".", ""])))
    got = R.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    rules = list(R.votes())
    patterns = spark.createDataFrame([tuple(r[x] for x in rules) for r in got], ", ".join(f"{x} int" for x in rules)).groupBy(*rules).count()
    prior, right = R.estimate(patterns.withColumnRenamed("count", "n"), rules, R.Params())
    for r in got:
        good, bad = prior, 1 - prior
        for x in rules:
            a, b = right[x]
            good *= {1: a, -1: 1 - a, 0: 1}[r[x]]
            bad *= {1: 1 - b, -1: b, 0: 1}[r[x]]
        n_words, _, _, _, repeated = brute(dict(rows)[r["doc_id"]])
        assert abs(r["quality"] - good / (good + bad)) < 1e-6
        assert r["base_failed"] == (n_words < 50 or 100 * repeated > 50 * n_words)
        assert r["kept"] == (not r["base_failed"] and good / (good + bad) >= 0.5)
    assert len({r["base_failed"] for r in got}) == 2
