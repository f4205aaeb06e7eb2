import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from augury.llm import bpe
from tests.llm.cases import awkward, nothing

FILE = bpe.default_file()
PIECES = [*"abc'sretl  \n\t  　éèñ€日本5 7.,!?~|<>\x00", "<|endoftext|>", "'ll", " 's", "\r\n", "\x85", "\x1c", "👍🏽", "ſ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=16).map("".join))
def test_same_ids_and_text_as_the_library(library, text):
    own = bpe.codec(FILE)
    want = library.encode(text, add_special_tokens=False).ids
    packed = own.encode_many([text])[0]
    assert np.frombuffer(packed, "<u4").tolist() == want
    assert own.decode_many([packed]) == [library.decode(want, skip_special_tokens=False)]


def test_undecodable_bytes_become_replacement_characters(library):
    own = bpe.codec(FILE)
    for ids in ([own.library.token_to_id("Ã")], [102, 160, 50256, 220]):
        packed = np.array(ids, "<u4").tobytes()
        assert own.decode_many([packed]) == [library.decode(ids, skip_special_tokens=False)]


def test_cuts_are_certain():
    own = bpe.codec(FILE)
    assert own.cuts(b"one two").tolist() == [3]
    assert own.cuts(b"a  b").tolist() == [1]  # not after a blank
    assert own.cuts(b"~'s").tolist() == []  # not before an apostrophe
    assert 5 not in own.cuts(b"x<|endoftext|>y")


def test_awkward_rows(spark, library):
    docs = awkward(spark)
    rows = docs.select("doc_id", "text", bpe.round_trip(F.col("text"), FILE).alias("r")).select("text", "r.*").collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r["text"] or ""
        assert r["decoded"] == text
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    one = docs.where("doc_id = 11").select(bpe.encode(F.col("text"), FILE).alias("ids")).select(bpe.decode(F.col("ids"), FILE).alias("t"), bpe.n_tokens(F.col("ids")).alias("n"), F.sha2("ids", 256).alias("h")).first()
    ids = library.encode(docs.where("doc_id = 11").first()["text"], add_special_tokens=False).ids
    assert one["n"] == len(ids) and one["h"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert nothing(spark).select(bpe.round_trip(F.col("text"), FILE)).count() == 0
