from hypothesis import given, settings
from hypothesis import strategies as st

from augury.llm import chat as C

KIND = "conv_id long, seq long, message long, role string, kind string, text string, start long, mask string"


def events(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash") for r in rows], KIND)


def brute(rows):
    """Fold one by one."""
    out = {}
    for conv, seq, message, role, kind, text in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[4], r[5] or "")):
        old = out.setdefault((conv, message), [seq, role, ""])
        old[2] = old[2] + (text or "") if kind == "delta" else (text or "")
    return sorted((c, m, *v) for (c, m), v in out.items())


LOG = [
    (1, 0, 0, "user", "delta", "Hel"), (1, 1, 0, "user", "delta", "lo"), (1, 2, 1, "assistant", "delta", "Hi"), (1, 4, 1, "assistant", "regenerate", None),
    (1, 5, 1, "assistant", "delta", "Good "), (1, 6, 1, "assistant", "delta", "day"), (1, 3, 0, "user", "edit", "Hello!"), (1, 7, 2, "user", "delta", None),
    (2, 1, 0, "assistant", "delta", C.SAMPLE), (2, 2, 0, "assistant", "edit", "\\"), (2, 3, 0, "assistant", "delta", "x<#"),
]


def test_fold(spark):
    got = sorted(map(tuple, C.fold(events(spark, LOG)).collect()))
    assert got == brute(LOG)
    assert (1, 1, 2, "assistant", "Good day") in got and (1, 0, 0, "user", "Hello!") in got
    assert C.fold(events(spark, LOG).limit(0)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "To\\ol", "", None]), st.text(st.sampled_from("\\#<>/: \nturnasé👍"), max_size=30)), max_size=6))
def test_turns_come_back(spark, turns):
    rows = [(9, i, role, text) for i, (role, text) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = C.render(C.fold(C.turn_events(table)))
    back = C.read_back(formatted).collect()
    assert len(back) == (1 if turns else 0)
    for r in back:
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role or "", text) for role, text in turns]
        assert r["learned"] == "".join(text for role, text in turns if role == "assistant")


def test_mask_spans_lie_on_assistant_texts(spark):
    rows = [(1, 0, "user", C.SAMPLE), (1, 1, "assistant", C.SAMPLE), (1, 2, "user", "é👍"), (1, 3, "assistant", "yes"), (2, 0, "user", "no answer")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in C.render(C.fold(C.turn_events(table))).collect()}
    one = got[1]["formatted"]
    assert [one[m["start"] : m["start"] + m["length"]] for m in got[1]["mask"]] == ["\\\\\\#\\#\\# Assistant: \\</turn> ok", "yes"]
    assert got[2]["mask"] == []


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", None), (3, None, "user", "x"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (3, 1, None, "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r for r in C.read_back(C.render(C.fold(C.turn_events(table)))).collect()}
    assert [(t["role"], t["text"]) for t in back[None]["turns"]] == [("user", "a"), ("assistant", "")]
    assert [(t["role"], t["text"]) for t in back[3]["turns"]] == [("user", "x"), ("", "z"), ("assistant", "same"), ("assistant", "same")]
    assert back[3]["learned"] == "samesame"


def test_no_text_or_role_holds_the_end(spark):
    texts = ["a</turn>\nb", "</turn>\n", "\\</turn>\n", "\\l/turn>\n", "\\\\l</turn>\n\\l<l", "ends in \\", "</turn>", "\n</turn", "\\" * 100_001 + "l</turn>\n"]
    turns = [(role, text) for text in texts for role in ("assistant", text)]
    rows = [(1, i, role, text) for i, (role, text) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = C.render(C.fold(C.turn_events(table)))
    assert formatted.first()["formatted"].count(C.END) == len(turns)
    back = C.read_back(formatted).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == turns
    assert back["learned"] == "".join(texts)
