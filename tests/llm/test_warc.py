import gzip
import hashlib
import os

from augury.llm import warc as W
from augury.llm.common import new_folder

KIND = "page_id long, url string, html string, digest string, first long"


def record(i, payload):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    digest = W.base32(hashlib.sha1(payload).digest()).encode()
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nWARC-Date: x\r\nX-Page-Id: %d\r\n" % (i, i)
    head += b"WARC-Payload-Digest: sha1:" + digest + b"\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block)
    return head + block + b"\r\n\r\n"


RECORDS = [record(i, (b"text WARC/1.1\r\n of page %d " % i) * (i + 1)) for i in range(5)]


def read(data):
    parts = list(W.salvage(data))
    ends = [0]
    for start, end, *_ in parts:  # nothing is lost and nothing told twice
        assert start == ends[-1] and end > start
        ends.append(end)
    assert ends[-1] == len(data)
    return [int(f["x-page-id"]) if f else "gap" for _, _, f, *_ in parts]


def test_salvage_of_plain_archives():
    whole = b"".join(RECORDS)
    assert read(whole) == [0, 1, 2, 3, 4]
    at = len(RECORDS[0]) + len(RECORDS[1]) - 12
    assert read(whole[:at] + b"X" + whole[at + 1 :]) == [0, "gap", 2, 3, 4]
    assert read(whole[:-3]) == [0, 1, 2, 3, "gap"]
    assert read(b"junk" + whole + b"\r\n") == ["gap", 0, 1, 2, 3, 4, "gap"]
    assert read(RECORDS[0] + RECORDS[1][:60] + RECORDS[2]) == [0, "gap", 2]
    assert read(RECORDS[0] + RECORDS[1][: len(RECORDS[1]) // 2] + RECORDS[2]) == [0, "gap", 2]
    assert read(b"") == [] and read(b"WARC/1.1\r\n") == ["gap"]


def test_salvage_of_gzip_archives():
    members = [gzip.compress(r) for r in RECORDS]
    assert read(b"".join(members)) == [0, 1, 2, 3, 4]
    broken = bytearray(b"".join(members))
    broken[len(members[0]) + 40] ^= 255
    assert read(bytes(broken)) == [0, "gap", 2, 3, 4]
    assert read(members[0] + members[1][:50] + members[2]) == [0, "gap", 2]
    assert read(RECORDS[0] + members[1] + RECORDS[2]) == [0, 1, 2]


def test_round_trip_of_awkward_pages(spark):
    rows = [
        (5, "http://a/\r\nX: y", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (3, None, "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (7, "u", None), (6, "u", ""),
        (None, "u", "only"), (None, "u", ""), (8, "u", "x\n" * 100000), (9, "u", "x\n" * 100000), (9, "u", "x\n" * 100000), (8, "v", "end\n"),
    ]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND)
    folder = new_folder(spark, "test-warc")
    W.write(pages, folder, W.Params(file_bytes=1000))
    back = W.read(spark, folder).collect()
    assert all(r["kind"] == "record" for r in back) and len(back) == len(rows)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back), key=repr)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same) if same else None
        revisit = first is not None and page != first
        want.append((page, len(data), W.base32(hashlib.sha1(data).digest()), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=repr)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in back if r["record_type"] == "response" and r["page_id"] == 3}
    assert payloads == {3: rows[1][2].encode()}


def test_small_payloads_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abc", "", 0), (4, "u", "abc", "", 0)], KIND)
    folder = new_folder(spark, "test-warc")
    W.write(pages, folder, W.Params(revisit_bytes=3))
    assert {r["page_id"]: r["record_type"] for r in W.read(spark, folder).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    folder = new_folder(spark, "test-warc")
    W.write(pages.limit(0), folder)
    assert W.read(spark, folder).count() == 0


def test_damaged_file_is_read_on(spark, tmp_path):
    whole = bytearray(b"".join(RECORDS))
    whole[len(RECORDS[0]) + 5] ^= 255
    os.makedirs(tmp_path / "a")
    (tmp_path / "a" / "x.warc").write_bytes(bytes(whole))
    rows = W.read(spark, str(tmp_path / "a")).orderBy("offset").collect()
    assert [r["kind"] for r in rows] == ["record", "gap", "record", "record", "record"]
    assert rows[1]["length"] == len(RECORDS[1]) and rows[1]["reason"]


def parts(data):
    return [(int(f["x-page-id"]) if f else "gap") for _, _, f, *_ in W.salvage(data)]


def test_many_records_in_a_member():
    one = gzip.compress(b"".join(RECORDS))
    assert parts(one) == [0, 1, 2, 3, 4]
    assert [x[5] for x in W.salvage(one)][:2] == [0, len(RECORDS[0])]
    two = gzip.compress(RECORDS[0] + RECORDS[1]) + gzip.compress(RECORDS[2] + b"junk" + RECORDS[3]) + RECORDS[4]
    assert parts(two) == [0, 1, 2, "gap", 3, 4]
    assert parts(gzip.compress(b"")) == ["gap"] and parts(gzip.compress(b"nothing of use")) == ["gap"]


def test_damaged_members_give_the_records_that_digests_confirm():
    bodies = [record(i, hashlib.sha512(b"%d" % i).hexdigest().encode() * 2000) for i in range(6)]
    one = gzip.compress(b"".join(bodies), 1)
    cut = parts(one[: len(one) // 2])
    assert cut[-1] == "gap" and cut[:-1] == list(range(len(cut) - 1)) and len(cut) >= 2
    broken = bytearray(one)
    broken[-6] ^= 255  # the check value alone
    found = list(W.salvage(bytes(broken) + RECORDS[2]))
    assert [int(f["x-page-id"]) if f else "gap" for _, _, f, *_ in found] == [0, 1, 2, 3, 4, 5, "gap", 2]
    assert all("check" in reason for _, _, _, _, reason, _ in found[:7])
    assert {(start, end) for start, end, *_ in found} == {(0, len(one)), (len(one), len(one) + len(RECORDS[2]))}
    unproven = gzip.compress(b"".join(b.replace(b"WARC-Payload-Digest", b"X-Nothing") for b in bodies), 1)
    assert parts(unproven) == list(range(6)) and parts(unproven[:-9]) == ["gap"]


def test_folded_fields_and_forms_of_digests():
    payload = b"some payload"
    stated = b"sha1:" + W.base32(hashlib.sha1(payload).digest()).encode()
    whole = record(1, payload)
    for form in (b"sha1:" + hashlib.sha1(payload).hexdigest().encode(), b"SHA-1:" + hashlib.sha1(payload).hexdigest().upper().encode(),
                 b"sha256:" + hashlib.sha256(payload).hexdigest().encode(), b"md5:" + hashlib.md5(payload).hexdigest().encode(),
                 stated.lower(), b"sha1:\r\n  " + stated[5:], b"blake3:unknown"):
        assert whole.count(stated) == 1 and parts(whole.replace(stated, form)) == [1]
        assert form == b"blake3:unknown" or parts(whole.replace(stated, form).replace(payload, b"Some payload")) == ["gap"]
    folded = whole.replace(b"WARC-Date: x\r\n", b"WARC-Date: x\r\nX-Note: one\r\n\ttwo\r\n three\r\n")
    (_, _, fields, *_), = W.salvage(folded)
    assert fields["x-note"] == "one two three" and parts(whole.replace(b"WARC-Date", b" WARC-Date")) == ["gap"]


def test_revisits_state_digests_in_one_form():
    sha1 = hashlib.sha1(b"x")
    for text in (sha1.hexdigest(), sha1.hexdigest().upper(), W.base32(sha1.digest()), W.base32(sha1.digest()).lower()):
        assert W._stated_sha1("sha1:" + text) == W.base32(sha1.digest())
    assert W._stated_sha1("md5:00") is None and W._stated_sha1("") is None


def test_reading_is_linear():
    """Bytes fed to the inflater grow with the members, not with members times file."""
    members = [gzip.compress(record(i, b"payload %d" % i), 1) for i in range(2000)]
    fed = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def copy(self):
            return Counted(self.inner.copy())

        def decompress(self, piece, *most):
            fed.append(len(piece))
            return self.inner.decompress(piece, *most)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    true = W.zlib.decompressobj
    W.zlib.decompressobj = lambda bits: Counted(true(bits))
    try:
        assert parts(b"".join(members)) == list(range(2000))
    finally:
        W.zlib.decompressobj = true
    assert sum(fed) <= 2 * len(members) * W.PIECE
