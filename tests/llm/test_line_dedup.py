from collections import defaultdict

import numpy as np
import pytest

from augury.llm import line_dedup as L
from augury.llm.cuckoo import Cuckoo, Full
from tests.llm.cases import awkward, nothing

P = L.Params(characters=6, documents=3, keys_per_shard=4)


def brute(rows, params=P):
    holders = defaultdict(set)
    key = lambda x: x.strip(L.BLANKS).translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= params.characters:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = lambda x: doc is not None and len(holders[key(x)]) >= params.documents and doc != max(holders[key(x)])
        stay = [x for x in lines if not gone(x)]
        out.append((doc, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(docs, state):
    return sorted((tuple(r) for r in L.cleaned(docs, state).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)


def some(seed, ids):
    rng = np.random.default_rng(seed)
    lines = ["common line %d" % i for i in range(12)] + ["  Common Line 3\t", "short", "", "ÄRGER über"]
    return [(int(i), "\n".join(rng.choice(lines, rng.integers(1, 9)))) for i in ids]


def test_against_brute_force(spark):
    rows = some(1, range(40)) + [(5, "common line 1\nother lines"), (None, "common line 2")]
    docs = table(spark, rows)
    assert found(docs, L.build(docs, P)) == brute(rows)


def test_insert_and_delete_are_reversible(spark):
    first, second = some(2, range(20)), some(3, range(20, 45))
    a, b = table(spark, first), table(spark, second)
    before = L.build(a, P)
    both = L.insert(before, b)
    assert found(a.union(b), both) == brute(first + second)
    after = L.delete(both, b.select("doc_id"))
    rows = lambda s: sorted(map(tuple, s.counts.select("hi", "lo", "refs", "newest").collect()))
    assert rows(after) == rows(before)
    assert found(a, after) == brute(first)
    again = L.delete(both, a.select("doc_id"))
    assert found(b, again) == brute(second)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(docs, L.build(docs, P)) == brute(rows)
    assert L.cleaned(docs, L.build(docs, P)).columns == [*docs.columns, "n_lines", "n_dropped"]
    assert L.cleaned(nothing(spark), L.build(nothing(spark), P)).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63 - 1, (2, 3000))
    own = Cuckoo.sized(3000)
    own.add(keys[0], keys[1])
    own = Cuckoo.loads(own.dumps())
    assert own.has(keys[0], keys[1]).all()
    others = rng.integers(-(2**63), 2**63 - 1, (2, 20000))
    assert own.has(others[0], others[1]).mean() < 0.002
    own.remove(keys[0][:1500], keys[1][:1500])
    assert own.has(keys[0][1500:], keys[1][1500:]).all()
    assert own.has(keys[0][:1500], keys[1][:1500]).mean() < 0.01
    with pytest.raises(Full):
        Cuckoo(np.zeros((2, 4), "<u2")).add(keys[0], keys[1])


def test_a_growing_state_is_cut_into_more_shards(spark):
    params = L.Params(characters=5, documents=2, keys_per_shard=50)
    docs = lambda low, high: spark.range(low, high).selectExpr("id AS doc_id", "concat('line number ', id div 2) AS text")
    state = L.build(docs(0, 40), params)
    assert state.shards == 1
    for low, high in ((40, 400), (400, 1200)):
        state = L.insert(state, docs(low, high))
    assert state.shards >= 6 and state.counts.count() == 600
    assert max(r["count"] for r in state.counts.groupBy("shard").count().collect()) <= 3 * params.keys_per_shard
    whole = L.build(docs(0, 1200), params)
    told = lambda s: sorted((r["doc_id"], r["n_dropped"], r["text"]) for r in L.cleaned(docs(0, 1200), s).collect())
    assert told(state) == told(whole) and sum(n for _, n, _ in told(state)) == 600
    state = L.delete(state, docs(30, 1200))
    assert state.shards == 1 and state.counts.count() == 15
