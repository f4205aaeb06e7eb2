"""Byte-level BPE with forced boundaries, and its inverse.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged across: between
the two is a certain cut.  Texts are cut there, the fragments are encoded on their own, each distinct one
once, and the ids are concatenated.  Three limits keep the cuts in step with the splitting rule that
runs before the merges: no cut after white space (a run of blanks gives its last one to the next word),
none before an apostrophe (contractions), and none inside a special token's string.

Ids are packed as little-endian unsigned 32-bit integers in a binary column.  The vocabulary file is a
parameter and must exist at the same path on every worker.

Defined cases: null and empty texts give no ids; an undecodable byte sequence decodes to U+FFFD, as the
library does; repeated rows give equal results; texts of any length are encoded whole, and a fragment
without any certain cut is given to the library as it is; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from augury.llm.common import query, table

CHUNK = 1 << 20  # bytes of text handled at once
REMEMBERED = 250_000  # fragments a worker remembers (some 50 MB); then it forgets all
SHORT = 48  # longer fragments are not remembered


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1
    characters stand for themselves, the other bytes follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def inside_pairs(tokens: list[bytes]) -> np.ndarray:
    """inside[a * 256 + b]: some token has byte b right after byte a."""
    inside = np.zeros(1 << 16, bool)
    for token in tokens:
        for a, b in zip(token, token[1:]):
            inside[a << 8 | b] = True
    return inside


def blank_ends() -> np.ndarray:
    """ends[p * 256 + a]: a character whose last two bytes are p and a may be white space."""
    ends = np.zeros(1 << 16, bool)
    for a in [*range(0x09, 0x0E), *range(0x1C, 0x21)]:
        ends[a::256] = True
    for c in "\x85\xa0 ᠎    　" + "".join(map(chr, range(0x2000, 0x200C))):
        p, a = c.encode()[-2:]
        ends[p << 8 | a] = True
    return ends


class Codec:
    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has its own tasks
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        with open(file, encoding="utf-8") as f:
            content = json.load(f)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        self.special = [s.encode() for s in special]
        plain = {i: bytes(letters[c] for c in t) for t, i in content["model"]["vocab"].items() if t not in special}
        tokens = plain | {i: s.encode() for s, i in special.items()}
        self.starts = np.zeros(max(tokens) + 2, np.int64)
        for i, t in tokens.items():
            self.starts[i + 1] = len(t)
        self.starts = np.cumsum(self.starts)
        self.flat = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(max(tokens) + 1)), np.uint8)
        forced = ~inside_pairs(list(plain.values()))
        second = np.arange(1 << 16) & 255
        forced &= (second < 0x80) | (second >= 0xC0)  # only between characters
        forced &= second != 0x27
        self.forced, self.blank = forced, blank_ends()
        self.known: dict[bytes, bytes] = {}

    def cuts(self, data: bytes) -> np.ndarray:
        """Positions at which data may be cut."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        b = np.frombuffer(data, np.uint8).astype(np.uint16)
        pair = (b[:-1] << 8) | b[1:]
        ok = self.forced[pair]
        ok[1:] &= ~self.blank[pair[:-1]]
        ok[0] &= not self.blank[b[0]]
        for s in self.special:
            at = data.find(s)
            while at >= 0:
                ok[at : at + len(s) - 1] = False
                at = data.find(s, at + len(s))
        return np.flatnonzero(ok) + 1

    def _learn(self, fragments: set[bytes]) -> dict[bytes, bytes]:
        new = list(fragments)
        encoded = self.library.encode_batch_fast([f.decode() for f in new], add_special_tokens=False)
        return {f: np.array(e.ids, "<u4").tobytes() for f, e in zip(new, encoded)}

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; what stands in another text does not matter."""
        fragments: list[bytes] = []
        counts = []
        for text in texts:
            data = text.encode()
            at = [0, *self.cuts(data).tolist(), len(data)]
            fragments += [data[i:j] for i, j in zip(at, at[1:])]
            counts.append(len(at) - 1)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        ids = list(map(self.known.get, fragments))
        found = self._learn({f for f, i in zip(fragments, ids) if i is None})
        if found:
            ids = [found[f] if i is None else i for f, i in zip(fragments, ids)]
            self.known.update((f, i) for f, i in found.items() if len(f) <= SHORT)
        ends = np.cumsum([0, *counts]).tolist()
        return [b"".join(ids[i:j]) for i, j in zip(ends, ends[1:])]

    def decode_bytes(self, ids: bytes) -> bytes:
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        start = self.starts[i]
        n = self.starts[i + 1] - start
        before = np.cumsum(n) - n
        return self.flat[np.repeat(start - before, n) + np.arange(n.sum())].tobytes()

    def decode_many(self, packed: list[bytes]) -> list[str]:
        whole = self.decode_bytes(b"".join(packed))
        lengths = np.cumsum([0, *(self._length(p) for p in packed)]).tolist()
        return [whole[i:j].decode("utf-8", "replace") for i, j in zip(lengths, lengths[1:])]

    def _length(self, ids: bytes) -> int:
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        return int((self.starts[i + 1] - self.starts[i]).sum())


@lru_cache(maxsize=2)
def codec(file: str) -> Codec:
    return Codec(file)


def _chunks(values: list, size: int = CHUNK):
    """Slices of a list with about so many bytes each."""
    start = n = 0
    for i, v in enumerate(values):
        n += len(v)
        if n >= size:
            yield values[start : i + 1]
            start, n = i + 1, 0
    if start < len(values):
        yield values[start:]


def encode(text: Column, file: str) -> Column:
    """Packed ids of a text column."""

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series) -> pd.Series:
        own = codec(file)
        return pd.Series([ids for part in _chunks(texts.tolist()) for ids in own.encode_many(part)], dtype=object)

    return encoded(F.coalesce(text, F.lit("")))


def decode(ids: Column, file: str) -> Column:
    """The text of packed ids."""

    @F.pandas_udf("string")
    def decoded(packed: pd.Series) -> pd.Series:
        own = codec(file)
        return pd.Series([t for part in _chunks(packed.tolist()) for t in own.decode_many(part)], dtype=object)

    return decoded(F.coalesce(ids, F.lit(b"")))


def round_trip(text: Column, file: str) -> Column:
    """Struct of packed ids and the text decoded from them, by one worker in one pass."""

    @F.pandas_udf("ids binary, decoded string")
    def both(texts: pd.Series) -> pd.DataFrame:
        own = codec(file)
        rows = []
        for part in _chunks(texts.tolist()):
            ids = own.encode_many(part)
            rows += zip(ids, own.decode_many(ids))
        return pd.DataFrame(rows, columns=["ids", "decoded"])

    return both(F.coalesce(text, F.lit("")))


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op2_bpe")
def op2_bpe(spark, sf_dir):
    file = default_file()
    both = table(spark, sf_dir, "documents").select("doc_id", round_trip(F.col("text"), file).alias("r")).select("doc_id", "r.*")
    return both.select(
        "doc_id",
        n_tokens(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
