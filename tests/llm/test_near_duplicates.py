import random

import numpy as np
import pytest

from augury.llm import near_duplicates as N
from augury.llm.components import components
from augury.llm.shingles import Words, shingle_set
from tests.llm.cases import awkward, nothing


def brute(rows, limit):
    words, sets, parent = Words(), {}, {}
    for doc, text in rows:
        if doc is not None:
            sets[doc] = frozenset(shingle_set(text, words).tolist())
            parent[doc] = doc

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= limit * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    n = lambda t: len(shingle_set(t, words))
    return sorted(((d, n(t), None if d is None else root(d), d is None or root(d) == d) for d, t in rows), key=repr)


def found(docs, params):
    return sorted(map(tuple, N.near_duplicates(docs, params).collect()), key=repr)


def corpus(seed):
    """Chains and stars of edited copies, copies of copies, truncated copies, and a passage many share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(6):
        base = [word() for _ in range(rng.choice([6, 20, 60, 150]))]
        texts.append(base)
        for _ in range(15):
            copy = list(rng.choice([base, texts[-1]]))
            for _ in range(rng.randrange(0, 1 + len(copy) // 15)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [word()], [copy[at], word()]])
            texts.append(copy[: rng.choice([len(copy), len(copy) - len(copy) // 20])])
    texts += [passage + [word() for _ in range(rng.randrange(0, 60))] for _ in range(25)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,limit", [(1, 85), (2, 80)])
def test_against_brute_force(spark, seed, limit):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, N.Params(limit=limit)) == brute(rows, limit)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(docs, N.Params()) == brute(rows, 80)
    assert N.near_duplicates(nothing(spark)).count() == 0


def test_estimate_is_corrected_and_unbiased():
    rng = np.random.default_rng(3)
    params = N.Params()
    shared = rng.integers(0, 2**63, 3000).astype(np.uint64)
    pairs = []
    for _ in range(40):
        own = rng.integers(0, 2**63, (2, 500)).astype(np.uint64)
        other = rng.choice(shared, 2000, replace=False)
        pairs.append([N.registers(N.minima(np.concatenate([other, own[k]]), params.registers)) for k in (0, 1)])
    a, b = (np.array([p[k] for p in pairs]) for k in (0, 1))
    j, used = N.estimate(a, b, np.full(40, 2500.0), np.full(40, 2500.0))
    assert abs(j.mean() - 2000 / 3000) < 0.02 and (used > 0.99 * params.registers).all()


def test_short_sets_fill_every_register():
    regs = N.registers(N.minima(np.array([12345], np.uint64), 280))[None, :]
    assert (regs > 0).sum() == 1 and (N.filled(regs) > 0).all()
    assert (N.filled(np.zeros((2, 280), "<u2")) == 0).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    roots = dict(map(tuple, components(links).collect()))
    assert {roots[i] for i in range(61)} == {0} and roots[101] == 100
    assert components(links.limit(0)).count() == 0
