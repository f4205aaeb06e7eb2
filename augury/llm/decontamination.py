"""Benchmark decontamination by templates.

Words are canonicalised: numbers, in digits or spelled, units that follow a number, and names become typed
placeholders, other words lose case and outer punctuation.  A name is a run of capitalised words, and the run is one
placeholder, so a longer name shifts nothing.  A capitalised word that begins a sentence may be a name or not; texts are read both
ways.  Windows of eight are hashed by their literal words, whatever their kinds, as a copy's surroundings or its case may
change these, and by their template in either reading, unless less than half of it is plain words, which says little.  Windows of
documents meet those of the benchmark in a hash join, by any of these hashes.  A match counts only where
its slots are consistent: along one alignment (of one reading of each text) every value of the item must stand for one value of the
document and the other way round, so "3 apples and 3 pears" matches "5 apples and 5 pears" but not
"5 apples and 7 pears"; in a literal match every value stands for itself.  A document is contaminated by an item of
which it covers 13 words, or all if it has fewer.

Before the join each task drops the windows of its documents that no item has, by a table of the benchmark's words
and hashes; a sieve over bytes spares it most texts as a whole.  That table is sent to the tasks in blocks of a fixed number of hashes, one pass over the documents for
each block, so its size does not grow with the benchmark.

Defined cases: null or blank texts and items match nothing; items of fewer than four words are no
evidence and match nothing; items shorter than a window are one window; items or documents that occur twice
under one id are one; a document without doc_id is known by its text; a very long text is looked through whole; empty
tables of documents or of items contaminate nothing; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm.common import query, table, written
from augury.llm.shingles import mixed

PLAIN, NUMBER, NAME, UNIT = range(4)
UNITS = frozenset(
    "mm cm m km mg g kg t ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks "
    "month months year years inch inches ft foot feet yard yards mile miles oz lb lbs pound pounds ounce ounces gallon "
    "gallons litre litres liter liters meter meters metre metres gram grams ton tons dollar dollars cent cents euro "
    "euros percent degree degrees mph kmh kw kwh w v hz stunde stunden minuten tage jahre heures jours ans horas años".split()
)
# Spelled numbers of the corpus languages, but for those that are articles as well.
SPELLED = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig "
    "neunzig hundert tausend deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente "
    "quarante cinquante soixante cent mille cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce "
    "quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil".split()
)
NUMERIC = re.compile(r"^[+-]?[$€£¥]?\d[\d.,:/]*(?:[%°$€£¥]|st|nd|rd|th)?$")
MEASURED = re.compile(r"^([+-]?\d[\d.,]*)([a-zA-Z]{1,3})$")
OUTER = " \"'`´’‘“”«»()[]{}<>.,;:!?¿¡*_-–—…"
STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    window: int = 8
    shortest: int = 4
    evidence: int = 13
    block: int = 500_000  # benchmark hashes a task holds at once


BETWEEN = b" \x00|\x00. "  # a word no item has, as it is not among the words of any
OTHER, OTHER_END = 0, 1  # plain words no item has, without and with the end of a sentence
ENDS = (".", "!", "?", ":")


class Vocabulary:
    """Kind and hash of a word as written, remembered; forgets all beyond a fixed number of words.

    wanted, if given, holds the words of the benchmark: any other plain word is only known as
    one that no item has, which spares nearly all words of a corpus a closer look."""

    LIMIT = 300_000

    def __init__(self, wanted: frozenset[bytes] | None = None):
        self.wanted = wanted
        self.clear()

    def clear(self):
        self.index: dict[bytes, int] = {}
        self.n = 2
        self.plain, self.kind, self.ends = np.zeros(1024, np.uint64), np.zeros(1024, np.int8), np.zeros(1024, bool)
        self.stops = np.zeros(1024, bool)  # a mark behind the word ends a run of names
        self.ends[OTHER_END] = self.stops[OTHER_END] = True

    def learn(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        core, end = text, False
        if text[-1] in ".,;:!?":  # most words are letters with at most a mark behind them
            core, end = text[:-1], text[-1] in ENDS
        if not core.isalpha():
            return self._classify(word, text)
        low = core.lower()
        kind = self._kind(core, low)
        return self._add(word, low.encode(), kind, end)

    def _kind(self, core: str, low: str) -> int:
        if low in SPELLED:
            return NUMBER
        if low in UNITS:
            return UNIT
        return NAME if core[:1].isupper() and (core[1:].islower() or len(core) == 1) else PLAIN

    def _classify(self, word: bytes, text: str) -> int:
        core = text.strip(OUTER) or text
        measured = MEASURED.match(core)
        if NUMERIC.match(core) or (measured and measured[2].lower() in UNITS):
            kind = NUMBER
        else:
            kind = self._kind(core, core.lower())
        return self._add(word, core.lower().encode(), kind, text.rstrip("\"'”’»)]")[-1:] in ENDS)

    def _add(self, word: bytes, core: bytes, kind: int, end: bool) -> int:
        if kind == PLAIN and self.wanted is not None and core not in self.wanted:
            self.index[word] = i = OTHER_END if end else OTHER
            return i
        i = self.n
        if i == len(self.plain):
            for name in ("plain", "kind", "ends", "stops"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        self.plain[i], self.kind[i], self.ends[i] = xxhash.xxh3_64_intdigest(core), kind, end
        self.stops[i] = not word.decode("utf-8", "replace")[-1].isalnum()
        self.index[word], self.n = i, i + 1
        return i

    def look_up(self, found: list[bytes]) -> np.ndarray:
        """Numbers of words."""
        if len(self.index) > self.LIMIT:
            self.clear()
        at = list(map(self.index.get, found))
        for k in [k for k, i in enumerate(at) if i is None]:
            known = self.index.get(found[k])
            at[k] = self.learn(found[k]) if known is None else known
        return np.array(at, np.int64)


class Reading:
    """A text's words with their kinds, and its units: a run of names is one, any other word is one."""

    def __init__(self, kind: np.ndarray, literal: np.ndarray, known: np.ndarray, stops: np.ndarray):
        self.kind = kind
        name = kind == NAME
        goes_on = np.zeros(len(kind), bool)
        goes_on[1:] = name[1:] & name[:-1] & ~stops[:-1]
        self.start = np.flatnonzero(~goes_on)  # first word of each unit
        self.unit = np.cumsum(~goes_on) - 1  # unit of each word
        head = kind[self.start]
        self.plain = head == PLAIN
        self.slot = np.where(self.plain, literal[self.start], head.astype(np.uint64))
        self.known = np.logical_and.reduceat(known, self.start) if len(kind) else known

    def __len__(self) -> int:
        return len(self.start)

    def end(self, unit: int) -> int:
        return int(self.start[unit]) if unit < len(self.start) else len(self.kind)

    def keys(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Units and (even) template hashes of the windows of so many units that say enough."""
        at, hashes = _windows(self.slot, self.known, size, 0)
        if not len(at):
            return at, hashes
        plain = np.concatenate([[0], np.cumsum(self.plain)])
        telling = 2 * (plain[at + size] - plain[at]) >= size
        return at[telling], hashes[telling] & ~np.uint64(1)


def _windows(slot: np.ndarray, known: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows without a word foreign to the benchmark."""
    if size == 0 or len(slot) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    strange = np.concatenate([[0], np.cumsum(~known)])
    at = np.flatnonzero(strange[size:] == strange[:-size])
    hashes = np.full(len(at), size + seed, np.uint64)
    for k in range(size):
        hashes = hashes * STEP + slot[at + k]
    return at, mixed(hashes)


class Template:
    """A text in two readings: ``strict``, where a capitalised word that begins a sentence is a plain word, and
    ``wide``, where it is a name.  Units of the wide reading are the coordinates by which texts are aligned."""

    def __init__(self, text: bytes, vocabulary: Vocabulary):
        self.words = text.split()
        at = vocabulary.look_up(self.words)
        kind, ends, stops = vocabulary.kind[at], vocabulary.ends[at], vocabulary.stops[at]
        self.literal, self.known = vocabulary.plain[at], at > OTHER_END
        if len(at):
            before = np.concatenate([[PLAIN], kind[:-1]])
            kind[(kind == UNIT) & (before != NUMBER)] = PLAIN
        first = np.concatenate([[True], ends[:-1]])[: len(at)]
        strict = np.where(first & (kind == NAME), PLAIN, kind)
        self.readings = [Reading(k, self.literal, self.known, stops) for k in (strict, kind)]
        self.wide = self.readings[1]

    def __len__(self) -> int:
        return len(self.words)

    def windows(self, size: int, wanted: np.ndarray | None = None) -> list[tuple[int, int, int, int, int, int, list[str] | None]]:
        """(hash, units, first word, words, coordinate, readings, slots) of the windows; readings: 1 strict, 2 wide, 3 both.
        A literal window has no slots.

        With wanted (sorted hashes), the windows of that size among them; without, all, and a text shorter
        than a window is one."""
        out = {}
        for bit, reading in enumerate(self.readings, 1):
            n = size if wanted is not None else min(size, len(reading))
            for unit, key in zip(*_among(*reading.keys(n), wanted)):
                word, end = int(reading.start[unit]), reading.end(unit + n)
                if (key, word, end) in out:
                    out[key, word, end] = (*out[key, word, end][:5], 3, out[key, word, end][6])
                else:
                    out[key, word, end] = (key, n, word, end - word, int(self.wide.unit[word]), bit, self.slots(reading, unit, n))
        n = size if wanted is not None else min(size, len(self))
        at, keys = _windows(self.literal, self.known, n, 1000)
        for word, key in zip(*_among(at, keys | np.uint64(1), wanted)):
            out[key, word, word + n] = (key, n, word, n, int(self.wide.unit[word]), 3, None)
        return list(out.values())

    def slots(self, reading: Reading, unit: int, size: int) -> list[str]:
        """Kind and value of each slot of a window of units."""
        out = []
        for u in range(unit, unit + size):
            word = int(reading.start[u])
            if reading.kind[word] != PLAIN:
                out.append(f"{reading.kind[word]}{' '.join(map(_core, self.words[word : reading.end(u + 1)]))}")
        return out

    def literal_slots(self, word: int, size: int) -> list[str]:
        """Slots of a window of words, by the wide reading; runs cut by its ends are left out."""
        first, last = int(self.wide.unit[word]), int(self.wide.unit[word + size - 1])
        first += int(self.wide.start[first]) < word
        last -= self.wide.end(last + 1) > word + size
        return self.slots(self.wide, first, last - first + 1) if last >= first else []

    def cores(self, word: int, size: int) -> list[str]:
        """The words of a window, but for numbers, without case and outer punctuation."""
        return [_core(self.words[i]) for i in range(word, word + size) if self.wide.kind[i] != NUMBER]


def _among(at: np.ndarray, keys: np.ndarray, wanted: np.ndarray | None) -> tuple[list[int], list[int]]:
    """Positions and signed hashes, of those that are wanted."""
    keys = keys.view(np.int64)
    if wanted is not None and len(keys):
        hit = wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys if len(wanted) else np.zeros(len(keys), bool)
        at, keys = at[hit], keys[hit]
    return at.tolist(), keys.tolist()


class Sieve:
    """Which stretches of a text can hold a window of the benchmark, found on bytes without looking at single words.

    A word may belong to a window if it is one of the benchmark's words, a unit or a spelled number (by hash, so now and then
    another passes), starts with a capital, or holds a digit or a byte beyond ASCII.  Windows that hold any other word
    cannot match."""

    BITS = 22
    BASE = 0x9E3779B97F4A7C15
    BACK = pow(BASE, -1, 1 << 64)

    def __init__(self, words: frozenset[bytes], size: int):
        self.size = size
        byte = np.arange(256)
        self.blank = np.isin(byte, list(b" \t\n\x0b\x0c\r"))
        self.lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint64)
        self.capital = (byte >= 65) & (byte <= 90)
        self.open = (byte >= 128) | ((byte >= 48) & (byte <= 57))
        self.outer = np.isin(byte, [ord(c) for c in OUTER if ord(c) < 128])
        self.table = np.zeros(1 << self.BITS, bool)
        self.powers = self.backs = np.ones(1, np.uint64)
        for word in words | {u.encode() for u in UNITS | SPELLED}:
            self.table[self._hash(np.frombuffer(word, np.uint8))] = True

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            for name, factor in (("powers", self.BASE), ("backs", self.BACK)):
                steps = np.full(2 * n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def _hash(self, word: np.ndarray) -> int:
        self._grow(len(word) + 1)
        total = (self.lower[word] * self.powers[: len(word)]).sum(dtype=np.uint64)
        return int(mixed(np.array([total]))[0] >> np.uint64(64 - self.BITS))

    def stretches(self, texts: list[bytes]):
        """(number of the text, place of the first word, whether that is context only, words, bytes) to look at.

        The word before a stretch comes with it: it decides how the first word is to be read."""
        joined = b"\n".join(texts) + b"\n"
        b = np.frombuffer(joined, np.uint8)
        self._grow(len(b) + 1)
        edge = np.flatnonzero(np.diff(self.blank[b], prepend=True))
        start, end = edge[::2].copy(), edge[1::2].copy()
        if len(start) < self.size:
            return
        begin, finish = start.copy(), end.copy()
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.lower[b] * self.powers[: len(b)], dtype=np.uint64)])
        opened = np.concatenate([[0], np.cumsum(self.open[b])])
        may = opened[end] > opened[start]
        for side, step in ((end, -1), (start, 1)):
            left = np.flatnonzero(end > start)
            while len(left):
                left = left[self.outer[b[side[left] + (step < 0) * step]]]
                side[left] += step
                left = left[end[left] > start[left]]
        h = (sums[end] - sums[start]) * self.backs[start]
        may |= self.table[mixed(h) >> np.uint64(64 - self.BITS)] | (end == start) | self.capital[b[start]]
        strange = np.concatenate([[0], np.cumsum(~may)])
        at = np.flatnonzero(strange[self.size :] == strange[: -self.size])
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        text = np.searchsorted(first, begin, side="right") - 1
        at = at[text[at] == text[at + self.size - 1]]
        if not len(at):
            return
        word = np.searchsorted(begin, first)  # the first word of each text
        new = np.flatnonzero((np.diff(at) > self.size) | (np.diff(text[at]) > 0)) + 1
        for low, high in zip(at[np.concatenate([[0], new])].tolist(), at[np.concatenate([new - 1, [-1]])].tolist()):
            n = int(text[low])
            context = low > word[n]
            low -= context
            count = high + self.size - low
            yield n, int(low - word[n]), bool(context), int(count), joined[begin[low] : finish[high + self.size - 1]]


def _core(word: bytes) -> str:
    text = word.decode("utf-8", "replace")
    return (text.strip(OUTER) or text).lower()


def benchmark_windows(benchmark: DataFrame, params: Params) -> DataFrame:
    """(key, item_id, item_at, size, item_place, item_read, item_words, item_slots, units, cores): size counts words, units what
    is hashed; item_place is the coordinate; item_read the readings; cores are the window's words but for numbers."""

    def rows(batches):
        vocabulary = Vocabulary()
        for batch in batches:
            out = []
            for item, text in zip(batch["item_id"], batch["text"]):
                template = Template(text.encode(), vocabulary)
                if len(template) < params.shortest:
                    continue
                for key, units, word, size, place, read, slots in template.windows(params.window):
                    slots = template.literal_slots(word, size) if slots is None else slots
                    out.append((key, item, word, size, place, read, len(template), slots, units, template.cores(word, size)))
            names = ["key", "item_id", "item_at", "size", "item_place", "item_read", "item_words", "item_slots", "units", "cores"]
            yield pd.DataFrame(out, columns=names)

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    kind = "key long, item_id long, item_at int, size int, item_place int, item_read int, item_words int, item_slots array<string>, units int, cores array<string>"
    return items.mapInPandas(rows, kind)


def document_windows(docs: DataFrame, hashes: np.ndarray, words: list[str], sizes: list[int]) -> DataFrame:
    """(doc, key, place, read, slots): the windows of docs(doc, text) whose hash is among hashes; words are those of the
    windows looked for. Literal windows come without slots."""
    sent = docs.sparkSession.sparkContext.broadcast((np.unique(hashes), frozenset(w.encode() for w in words)))

    def rows(batches):
        wanted, known = sent.value
        vocabulary, sieve = Vocabulary(known), Sieve(known, min(sizes)) if sizes else None
        for batch in batches:
            names, texts, out = batch["doc"].tolist(), [t.encode() for t in batch["text"]], []
            for part in slices(texts, 1 << 20) if sieve else ():
                found = list(sieve.stretches(texts[part]))
                # One template for all stretches; what stands between them is foreign and ends a sentence.
                template = Template(BETWEEN.join(f[4] for f in found), vocabulary)
                first = np.cumsum([0, *(f[3] + 1 for f in found)])
                # Coordinates count from the stretch's first word; a stretch's own place keeps those of a text apart.
                for size in sizes:
                    for key, _, word, _, place, read, slots in template.windows(size, wanted):
                        n, offset, context, *_ = found[j := int(np.searchsorted(first, word, side="right")) - 1]
                        if word - first[j] >= context:
                            at = place - int(template.wide.unit[first[j]]) + offset
                            out.append((names[n + part.start], key, at, read, slots or []))
            yield pd.DataFrame(out, columns=["doc", "key", "place", "read", "slots"])

    def slices(texts, most):
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= most or i == len(texts) - 1:
                yield slice(start, i + 1)
                start, size = i + 1, 0

    return docs.mapInPandas(rows, "doc string, key long, place int, read int, slots array<string>")


def matches(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc, item_id, covered, item_words, changed): evidence of docs(doc, text) for each item it touches.

    changed: some slot's value differs from the item's."""
    windows = written(benchmark_windows(benchmark, params), "windows")
    keys = written(windows.select("key", "units").distinct(), "keys")
    blocks = max(1, -(-keys.count() // params.block))
    found = None
    for block in range(blocks):
        own = F.pmod("key", F.lit(blocks)) == block
        rows = keys.where(own).toPandas()
        words = windows.where(own).select(F.explode("cores").alias("w")).distinct().collect()  # at most window * block
        sizes = sorted(set(rows["units"].tolist()))
        part = document_windows(docs, rows["key"].to_numpy(np.int64), [r["w"] for r in words if "\x00" not in r["w"]], sizes)
        found = part if found is None else found.unionByName(part)
    joined = found.join(windows.drop("cores"), "key")
    joined = joined.withColumn("slots", F.when(F.col("key") % 2 != 0, F.col("item_slots")).otherwise(F.col("slots")))
    joined = joined.where(F.size("slots") == F.size("item_slots"))
    # An alignment is one reading of the document against one of the item.
    ways = [(a, b) for a in (1, 2) for b in (1, 2)]
    both = [F.when((F.col("read").bitwiseAND(a) > 0) & (F.col("item_read").bitwiseAND(b) > 0), F.lit(k)) for k, (a, b) in enumerate(ways)]
    joined = joined.withColumn("way", F.explode(F.array_compact(F.array(*both))))
    pairs = F.arrays_zip(F.col("item_slots").alias("x"), F.col("slots").alias("y"))
    aligned = (
        joined.withColumn("pairs", pairs)
        .groupBy("doc", "item_id", "way", (F.col("place") - F.col("item_place")).alias("shift"))
        .agg(
            F.collect_set(F.struct("item_at", "size")).alias("parts"),  # at most the item's windows
            F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
            F.max("item_words").alias("item_words"),
        )
    )
    distinct = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    steady = aligned.where((distinct("x") == F.size("pairs")) & (distinct("y") == F.size("pairs")))
    changed = F.exists("pairs", lambda p: p["x"] != p["y"])
    spots = steady.select("doc", "item_id", "item_words", changed.alias("changed"), F.explode("parts").alias("p"))
    spots = spots.select("*", F.explode(F.sequence("p.item_at", F.expr("p.item_at + p.size - 1"))).alias("spot"))
    spots = spots.groupBy("doc", "item_id", "spot").agg(F.max("item_words").alias("item_words"), F.max("changed").alias("changed"))
    return spots.groupBy("doc", "item_id").agg(
        F.count("*").alias("covered"), F.max("item_words").cast("long").alias("item_words"), F.max("changed").alias("changed")
    )


def doc_key():
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.sha2(F.coalesce("text", F.lit("")), 256)))


def verdicts(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc, items, covered, reparameterised) of the contaminated documents."""
    texts = docs.select(doc_key().alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    proof = matches(texts, benchmark, params).where(F.col("covered") >= F.least(F.lit(params.evidence), "item_words"))
    return proof.groupBy("doc").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"),
        F.max("covered").alias("covered"),
        F.max("changed").alias("reparameterised"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, contaminated, n_items, items, covered, reparameterised) for every row of docs."""
    found = written(verdicts(docs, benchmark, params), "verdicts")
    keyed = docs.select("doc_id", doc_key().alias("doc"))
    return keyed.join(found, "doc", "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("covered", F.lit(0)).cast("long").alias("covered"),
        F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """Rows of docs, all columns, without the contaminated documents."""
    found = written(verdicts(docs, benchmark, params).select(F.col("doc").alias("_contaminated_key")), "verdicts")
    return docs.join(found, doc_key() == F.col("_contaminated_key"), "left_anti")


@query("op5_template_decontamination")
def op5_template_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
