"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Writer: the first record of a payload (smallest page_id) is a response, later ones revisit it.  Records are
composed by Spark and written by its text writer, whose commit protocol keeps retried tasks from
leaving half a file; an archive file is the plain concatenation of its records.

Reader: plain and gzip archives (a record or any number of records in a member), one row for each record and
one for each damaged range.  A record must have a version line, its mandatory fields (folded lines are
joined), a length that fits, the closing blank lines and the digest it states (hexadecimal, base32 or
base64).  When one fails, the reader searches for the next gzip member or version line that
starts a valid record, goes on from there, and reports the bytes in between as a gap.  Members are inflated
piece by piece and a record at a time is held, whatever a member inflates to.  Of a member that fails its own check,
the records confirmed by a digest are kept, with the fault as their reason, and its range is a gap as well.

A file is read by one task, so archives should be files of bounded size; the writer makes them up to about
``file_bytes`` large (at pages of the average size).

Defined cases: a null html is an empty payload, and empty payloads are equal to each other; rows with the
smallest page_id of a payload are all responses if they repeat; a row without page_id revisits the response
of its payload if there is one and is a response otherwise; a null url leaves its field out; an empty table makes
no record; a very long page is one record, and an archive is read in one task; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.llm.common import new_folder, query, table, written

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
LONGEST = 10  # bytes of a version line, the longest pattern searched for
BLANK_LINE = re.compile(rb"\r\n\r\n")
FOLD = re.compile(rb"\r\n[ \t]+")
GZIP = b"\x1f\x8b\x08"
PIECE, INFLATED = 1 << 14, 1 << 20  # bytes fed to and taken from the inflater at once
HEADER_BYTES = 16 << 20  # without its blank line by then, a header is damaged
VALUE_BYTES = 2_000_000_000  # what one value of a table can hold
ALGORITHMS = ("md5", "sha1", "sha256", "sha512")
CANDIDATE = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
FIELD = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*$", re.S)
MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}
RECORD = "archive string, offset long, length long, member_offset long, kind string, reason string, record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"


@dataclass(frozen=True)
class Params:
    """revisit_bytes: payloads below that size are never revisited."""

    revisit_bytes: int = 0
    file_bytes: int = 16 << 20
    date: str = "1970-01-01T00:00:00Z"  # pages carry no time


def base32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def _base32(digest: Column) -> Column:
    @F.pandas_udf("string")
    def encoded(digests: pd.Series) -> pd.Series:
        return digests.map(base32)

    return encoded(digest)


def revisits(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """pages(page_id, url, html) with digest and first, the page_id of the response (null for responses)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    rows = rows.withColumn("digest", _base32(F.unhex(F.sha1("html"))))
    # Only payloads that occur again matter: a narrow table, while the pages themselves are never copied.
    again = rows.where(F.octet_length("html") >= params.revisit_bytes).groupBy("digest")
    again = again.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = rows.join(written(again, "repeated"), "digest", "left")
    return same.withColumn("first", F.when(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.col("first")))


def _field(name: str, value: Column) -> Column:
    """A header line, left out for a null value; line breaks in values become blanks."""
    clean = F.regexp_replace(value.cast("string"), "[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, params: Params = Params()) -> DataFrame:
    """(record): one WARC record for each row of revisits(pages)."""
    marked = revisits(pages, params)
    size = F.octet_length("html")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("first").isNotNull()
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))

    def record_id(page: Column) -> Column:
        h = F.md5(F.concat_ws(" ", page.cast("string"), F.col("digest")).cast("binary"))
        parts = [F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))

    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", record_id(F.col("page_id"))),
        _field("WARC-Date", F.lit(params.date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", digest),
        _field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _field("WARC-Refers-To", F.when(revisit, record_id(F.col("first")))),
        _field("X-Page-Id", F.col("page_id")),
        _field("X-Refers-To-Page-Id", F.col("first")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _field("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    return marked.select(F.concat(head, block, F.lit("\r\n\r\n")).alias("record"))


def write(pages: DataFrame, folder: str, params: Params = Params()) -> None:
    """Archive files in a folder."""
    size = pages.agg(F.sum(F.octet_length("html")).alias("bytes"), F.count("*").alias("n")).first()
    per_file = max(1, params.file_bytes * size["n"] // max(1, size["bytes"] or 0))
    # The text writer ends each row with a line feed, the last byte of a record.
    lines = records(pages, params).select(F.substring("record", F.lit(1), F.length("record") - 1).alias("value"))
    lines.write.option("lineSep", "\n").option("maxRecordsPerFile", min(per_file, 2**31)).text(folder)


class Broken(Exception):
    pass


class Window:
    """Bytes that are read on as they are asked for; positions count from the first byte ever."""

    def __init__(self, held: bytes | bytearray, chunks=()):
        self.held, self.chunks, self.start = held, iter(chunks), 0

    def more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is not None:
            self.held += chunk
        return chunk is not None

    def take(self, at: int, n: int) -> bytes:
        while self.start + len(self.held) < at + n and self.more():
            pass
        return bytes(self.held[at - self.start : at - self.start + n])

    def find(self, pattern: re.Pattern, at: int, stop: int | None = None) -> int | None:
        """Start of the first match at or after a position (and before stop)."""
        look = at
        while True:
            found = pattern.search(self.held, look - self.start) if stop is None else pattern.search(self.held, look - self.start, stop - self.start)
            if found:
                return self.start + found.start()
            # A match may lie across the end of what is held.
            look = max(at, self.start + len(self.held) - LONGEST)
            if stop is not None and self.start + len(self.held) >= stop or not self.more():
                return None

    def let_go(self, at: int) -> None:
        """Forget the bytes before a position of a stream."""
        if isinstance(self.held, bytearray):
            del self.held[: at - self.start]
            self.start = at


def holds(stated: str, data: bytes) -> bool | None:
    """Whether a stated digest is that of data, in hexadecimal, base32 or base64; None for unknown algorithms."""
    algorithm, _, text = stated.partition(":")
    algorithm, text = algorithm.strip().lower().replace("-", ""), text.strip().rstrip("=")
    if algorithm not in ALGORITHMS:
        return None
    raw = hashlib.new(algorithm, data).digest()
    forms = text.lower() == raw.hex(), text.upper() == base32(raw).rstrip("="), text == base64.b64encode(raw).decode().rstrip("=")
    return any(forms)


def parse(window: Window, at: int) -> tuple[dict, bytes, int, bool]:
    """Fields, block and end of the record at a position, and whether a digest confirms it."""
    version = VERSION.match(window.take(at, LONGEST))
    if not version:
        raise Broken("no version line")
    start = at + version.end()
    end = window.find(BLANK_LINE, start, start + HEADER_BYTES)
    if end is None:
        raise Broken("unfinished header")
    fields: dict[str, str] = {}
    for line in FOLD.sub(b" ", window.take(start, end - start)).split(b"\r\n"):
        found = FIELD.match(line)
        if not found:
            raise Broken("malformed field")
        name = found[1].decode().lower()
        if name in fields and name in MANDATORY:
            raise Broken("field repeated")  # two headers run together where a record was cut off
        fields[name] = found[2].decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not MANDATORY <= fields.keys() or not (length.isascii() and length.isdigit()):
        raise Broken("mandatory field missing")
    if len(length) > 10 or int(length) > VALUE_BYTES:
        raise Broken("longer than a value of a table")
    start, size = end + 4, int(length)
    if window.take(start + size, 4) != b"\r\n\r\n":
        raise Broken("wrong length or truncated")
    block = window.take(start, size)
    proven = False
    for name, of in (("warc-block-digest", block), ("warc-payload-digest", _payload(fields, block))):
        right = holds(fields[name], of) if of is not None and name in fields else None
        if right is False:
            raise Broken(f"{name} differs")
        proven |= right is True
    return fields, block, start + size + 4, proven


def _is_http(fields: dict) -> bool:
    return fields.get("content-type", "").startswith("application/http")


def _payload(fields: dict, block: bytes) -> bytes | None:
    """The payload a record holds; none for revisits."""
    if fields["warc-type"] == "revisit":
        return None
    return block.partition(b"\r\n\r\n")[2] if _is_http(fields) else block


class Member:
    """A gzip member of an archive, inflated piece by piece.  end and fault are known after the last piece."""

    def __init__(self, data: bytes, at: int, damaged: bool = False):
        self.data, self.at, self.damaged = memoryview(data), at, damaged
        self.end, self.fault = at, None

    def chunks(self):
        inflater, at = zlib.decompressobj(31), self.at
        while not inflater.eof:
            piece = self.data[at : at + PIECE]
            at += len(piece)
            if not piece:
                yield inflater.flush()
                self.fault = None if inflater.eof else "truncated gzip member"
                break
            if self.damaged:  # a call that fails keeps what it had inflated: a byte at a time nothing is lost
                before = inflater.copy()
                try:
                    before.decompress(piece)
                    steps = [piece]
                except zlib.error:
                    steps = [piece[i : i + 1] for i in range(len(piece))]
            else:
                steps = [piece]
            try:
                for step in steps:
                    while step and not inflater.eof:
                        yield inflater.decompress(step, INFLATED)
                        step = inflater.unconsumed_tail
            except zlib.error as e:
                self.fault = f"bad gzip member: {e}"
                break
        self.end = at - len(inflater.unused_data)

    def checked(self) -> Member:
        for _ in self.chunks():
            pass
        return self

    def records(self):
        """(start, end, fields or None, block, reason, proven) of the records and gaps in the inflated bytes."""
        window, at = Window(bytearray(), self.chunks()), 0
        while window.take(at, 1):
            try:
                fields, block, end, proven = parse(window, at)
                yield at, end, fields, block, None, proven
                at = end
            except Broken as e:
                start, at = at, _next_record(window, at + 1)
                yield start, at, None, b"", str(e), False
            window.let_go(at)


def _next_record(window: Window, at: int) -> int:
    """Start of the first valid record at or after a position, or the end."""
    while True:
        found = window.find(VERSION, at)
        if found is None:
            return window.start + len(window.held)
        window.let_go(found)
        try:
            parse(window, found)
            return found
        except Broken:
            at = found + 1


def _starts(data: bytes, plain: Window, at: int) -> bool:
    """Whether a valid record or a gzip member with one starts at a position of an archive."""
    try:
        if not data.startswith(GZIP, at):
            return bool(parse(plain, at))
        sound = Member(data, at).checked().fault is None
        return any(fields and (sound or proven) for _, _, fields, _, _, proven in Member(data, at, not sound).records())
    except Broken:
        return False


def salvage(data: bytes):
    """(offset, end, fields or None, block, reason, inner) for each record and gap of an archive, in order.

    Records of a gzip member have the range of the member, and inner, their place in its inflated bytes.
    A damaged member gives a gap of the same range after the records that were recovered from it."""
    plain, at = Window(data), 0
    while at < len(data):
        if data.startswith(GZIP, at):
            member = Member(data, at).checked()
            fault, end = member.fault, member.end
            if fault:
                end = _next_start(data, plain, at + 1)
            empty = True
            for start, _, fields, block, reason, proven in Member(data, at, bool(fault)).records():
                if not fault or proven:
                    empty = False
                    yield at, end, fields, block, fault if proven and fault else reason, start
            if fault or empty:
                yield at, end, None, b"", fault or "empty gzip member", None
        else:
            try:
                fields, block, end, _ = parse(plain, at)
                yield at, end, fields, block, None, None
            except Broken as e:
                end = _next_start(data, plain, at + 1)
                yield at, end, None, b"", str(e), None
        at = end


def _next_start(data: bytes, plain: Window, at: int) -> int:
    """Where the next valid record or member of an archive starts, or its end."""
    return next((c.start() for c in CANDIDATE.finditer(data, at) if _starts(data, plain, c.start())), len(data))


def _row(archive: str, offset: int, end: int, fields: dict | None, block: bytes, reason: str | None, inner: int | None) -> tuple:
    if fields is None:
        return (archive, offset, end - offset, inner, "gap", reason, *[None] * 8)
    number = lambda name: int(fields[name]) if re.fullmatch(r"-?\d{1,18}", fields.get(name, "")) else None
    payload = _payload(fields, block)
    if payload is not None:
        size, digest = len(payload), base32(hashlib.sha1(payload).digest())
    else:  # a revisit states both of the payload it leaves out
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})", block)
        size = int(stated[1]) if stated else None
        digest = _stated_sha1(fields.get("warc-payload-digest", ""))
    ids = number("x-page-id"), number("x-refers-to-page-id")
    what = fields["warc-type"], fields["warc-record-id"], fields.get("warc-target-uri")
    return (archive, offset, end - offset, inner, "record", reason, *what, *ids, size, digest, payload)


def _stated_sha1(stated: str) -> str | None:
    """A stated SHA-1 in upper-case base32."""
    algorithm, _, text = stated.partition(":")
    if algorithm.strip().lower().replace("-", "") != "sha1":
        return None
    text = text.strip()
    return base32(bytes.fromhex(text)) if re.fullmatch("[0-9A-Fa-f]{40}", text) else text.upper() or None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records (kind 'record') and damaged ranges (kind 'gap') of the archives in a folder."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def rows(batches):
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                found, held = [], 0
                for part in salvage(bytes(data)):
                    found.append(_row(path, *part))
                    held += len(part[3]) + 100
                    if held > 4 << 20:
                        yield _frame(found, names)
                        found, held = [], 0
                yield _frame(found, names)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(rows, RECORD)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({c: "Int64" for c in ("member_offset", "page_id", "refers_to", "payload_bytes")})


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), d AS (
  SELECT page_id, strlen(h) AS payload_bytes,
         array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)
           for i in range(32)], '') AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@query("op6_warc", ORACLE)
def op6_warc(spark, sf_dir):
    folder = new_folder(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    back = read(spark, folder).where("kind = 'record'")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
