import random

from augury.llm import decontamination as D
from tests.llm.cases import awkward, nothing

ITEM = "A train leaves the old Boston station with 3 coaches and 120 passengers while Alice counts 3 coaches from the bridge near the slow river"
SHORT = "Solve the riddle of seven brave knights today"
KIND = "item_id long, text string, score string"


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], KIND)


def found(spark, texts, items=((1, ITEM), (2, SHORT))):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = D.contaminated(docs, bench(spark, items)).collect()
    assert len(rows) == len(texts)
    return {r["doc_id"]: (r["items"], r["reparameterised"]) for r in rows if r["contaminated"]}


def test_verbatim_and_reparameterised(spark):
    pad = "something else entirely was written here before. "
    texts = [
        pad + ITEM + " and more text follows.",
        pad + ITEM.replace("3", "7").replace("120", "95").replace("Alice", "Maria").replace("Boston", "Lisbon"),
        pad + ITEM.replace("with 3", "with 7"),  # 7 coaches here, 3 coaches there: not the same question
        ITEM.upper(),
        "\n".join(ITEM.split()),
        pad * 5,
        " ".join(ITEM.split()[:9]) + " something new.",
        "before that: " + SHORT.lower() + "!",
        "Solve the riddle of seven brave",
    ]
    got = found(spark, texts)
    assert got[0] == ([1], False) and got[1] == ([1], True)
    assert got[4] == ([1], False) and got[7] == ([2], False)
    assert 2 not in got and not {5, 6, 8} & got.keys()


def test_blocks_give_the_same(spark):
    docs = spark.createDataFrame([(1, "x y z. " + ITEM), (2, SHORT)], "doc_id long, text string")
    items = bench(spark, [(1, ITEM), (2, SHORT), (2, SHORT)])
    rows = lambda p: sorted(map(tuple, D.contaminated(docs, items, p).select("doc_id", "n_items", "covered").collect()))
    assert rows(D.Params(block=3)) == rows(D.Params()) == [(1, 1, 25), (2, 1, 8)]


def test_bare_numbers_are_no_evidence(spark):
    table = " ".join(str(i) for i in range(40))
    other = " ".join(str(i + 1) for i in range(100, 140))
    assert found(spark, [other], [(1, table)]) == {}
    assert found(spark, [table], [(1, table)]) == {0: ([1], False)}


def test_awkward_rows(spark):
    docs = awkward(spark)
    items = bench(spark, [(1, docs.first()["text"]), (2, None), (3, ""), (4, "one two"), (None, "any words at all in here")])
    rows = D.contaminated(docs, items).collect()
    assert len(rows) == docs.count()
    hit = sorted((r["doc_id"] for r in rows if r["contaminated"]), key=repr)
    assert hit == [1, 11, 2, 2, 6, None]  # null text of the other row without doc_id is not touched
    clean = D.clean_documents(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - len(hit)
    assert D.contaminated(nothing(spark), items).count() == 0
    assert D.contaminated(docs, items.limit(0)).where("contaminated").count() == 0


def test_the_sieve_loses_no_window():
    """Windows of whole templates against those of the stretches, on texts of awkward words."""
    rng = random.Random(5)
    plain = [w.lower() for w in ITEM.split()] + ["été", "straße"]
    known = frozenset(w.encode() for w in plain)
    words = plain * 3 + [w.upper() for w in plain] + ["Alice", "3", "12kg", "kg", "foreign", "words,", "“quoted”", "(the)", "--", "...", "x.", "É.", "!?", "train!!", "'near'"]
    sieve = D.Sieve(known, 4)
    for _ in range(300):
        texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", ". "]) for _ in range(rng.randrange(0, 40))).encode() for _ in range(3)]
        want, got = set(), set()
        every = lambda t: {(w[0], w[2]) for w in t.windows(4) if w[1] == 4}
        for n, text in enumerate(texts):
            want |= {(n, a, k) for k, a in every(D.Template(text, D.Vocabulary(known)))}
        for n, offset, context, count, text in sieve.stretches(texts):
            template = D.Template(text, D.Vocabulary(known))
            assert len(template) == count
            got |= {(n, a + offset, k) for k, a in every(template) if a >= context}
        assert want == got


def test_verbatim_words_count_whatever_stands_before_them(spark):
    """The kind of a capitalised word depends on the word before it; a copy's case may differ."""
    pad = "something else entirely was written here before"
    first = "Seven brave old knights solve the long riddle"
    names = "Alice Boston Maria Lisbon Peter London Clara Madrid"
    excerpt = "Slowly the river runs through green fields toward the sea and back home again. Nothing more"
    items = [(1, first), (2, names), (3, "It was late. " + excerpt)]
    texts = [
        f"{pad}, {first}",
        f"{pad}\n{first}\n{pad}",
        f"{pad}. {first}",
        f"{pad} {names.lower()}",
        f"{pad}: {names.upper()}!",
        f"{pad}, {' '.join(excerpt.split()[:13])} {pad}",
        f"{pad}, {' '.join(excerpt.split()[:12])} {pad}",
        f"{pad}, {' '.join(first.split()[:7])} {pad}",
    ]
    assert found(spark, texts, items) == {0: ([1], False), 1: ([1], False), 2: ([1], False), 3: ([2], False), 4: ([2], False), 5: ([3], False)}


PROBLEM = "Anna has 7 apples and buys 5 more apples today for lunch"


def test_word_problems_with_other_names_and_numbers(spark):
    """Names at the start of a sentence, spelled numbers, names of several words, and what must not match."""
    pad = "Something else entirely was written here before."
    items = [(1, PROBLEM), (2, "Yesterday Peter saw seven red foxes near the old mill and four grey owls above the barn")]
    texts = [
        f"{pad} Sara has 8 apples and buys 2 more apples today for lunch. {pad}",
        f"{pad} Mary Ann has eight apples and buys two more apples today for lunch",
        f"{pad} Sara has 8 apples and buys 8 more apples today for lunch",  # one value stands for two
        f"{pad} then Sara has 8 apples and buys 2 more apples today for lunch",
        f"{pad} Yesterday Mary Ann Miller saw nine red foxes near the old mill and 12 grey owls above the barn",
        f"{pad} Sara has 8 pears and buys 2 more books today for dinner",
    ]
    got = found(spark, texts, items)
    assert {k: v[0] for k, v in got.items()} == {0: [1], 1: [1], 3: [1], 4: [2]}
    assert all(v[1] for v in got.values())


def brute(text, item, params=D.Params()):
    """Covered words of the item: every window of every reading of both, word by word, by its canonical words."""

    def units(words, wide):
        kinds, out = [], []
        for i, w in enumerate(words):
            core = w.strip(D.OUTER) or w
            first = i == 0 or words[i - 1].rstrip("\"'”’»)]")[-1:] in D.ENDS
            if D.NUMERIC.match(core) or core.lower() in D.SPELLED:
                kind = D.NUMBER
            elif core.lower() in D.UNITS:
                kind = D.UNIT if kinds and kinds[-1] == D.NUMBER else D.PLAIN
            elif core[:1].isupper() and (core[1:].islower() or len(core) == 1) and (wide or not first):
                kind = D.NAME
            else:
                kind = D.PLAIN
            goes_on = kind == D.NAME and kinds and kinds[-1] == D.NAME and words[i - 1][-1].isalnum()
            kinds.append(kind)
            if goes_on:
                out[-1][2].append(i)
                out[-1][1] += " " + core.lower()
            else:
                out.append([kind, core.lower(), [i]])
        return out

    given, asked = text.split(), item.split()
    evidence = {}
    for how in ((False, False), (True, True), (False, True), (True, False)):
        a, b = units(given, how[0]), units(asked, how[1])
        n = min(params.window, len(b))
        for x in range(len(a) - n + 1):
            for y in range(len(b) - n + 1):
                u, v = a[x : x + n], b[y : y + n]
                same = all(p[0] == q[0] and (p[0] != D.PLAIN or p[1] == q[1]) for p, q in zip(u, v))
                if same and 2 * sum(p[0] == D.PLAIN for p in u) >= n:
                    pairs = {((q[0], q[1]), (p[0], p[1])) for p, q in zip(u, v) if p[0] != D.PLAIN}
                    evidence.setdefault((how, x - y), []).append((pairs, {i for q in v for i in q[2]}))
    covered = set()
    for parts in evidence.values():
        pairs = set().union(*(p for p, _ in parts))
        if len({p[0] for p in pairs}) == len(pairs) == len({p[1] for p in pairs}):
            covered |= set().union(*(c for _, c in parts))
    return len(covered)


def test_templates_against_brute_force(spark):
    """Templates with one-word names, whose places need no translation."""
    rng = random.Random(8)
    plain = "the train leaves with apples and counts more coaches near a slow river today".split()
    fill = lambda kind: rng.choice(["Anna", "Peter", "Maria", "Boston"]) if kind == "N" else str(rng.randrange(2, 6)) if kind == "#" else kind
    frames = [[rng.choice(plain + ["N", "#", "#"]) for _ in range(rng.randrange(8, 15))] for _ in range(12)]
    for f in frames:  # no two names side by side
        for i in range(1, len(f)):
            f[i] = "and" if f[i] == f[i - 1] == "N" else f[i]
    items = [(i, " ".join(map(fill, f))) for i, f in enumerate(frames)]
    texts = []
    for _ in range(120):
        f = list(rng.choice(frames))
        if rng.random() < 0.4:
            f[rng.randrange(len(f))] = rng.choice(plain)
        texts.append(" ".join(["so", "it", "was.", *map(fill, f), "xyzzy"]))
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc string, text string")
    got = {(r["doc"], r["item_id"]): r["covered"] for r in D.matches(rows, bench(spark, items)).collect()}
    whole = 0
    for d, t in enumerate(texts):
        for i, item in items:
            need = min(13, len(item.split()))
            plainly, ours = brute(t, item), got.get((str(d), i), 0)
            assert (ours >= need) == (plainly >= need), (t, item, ours, plainly)
            whole += ours >= need
    assert whole > 30
