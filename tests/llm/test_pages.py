"""WARC archives and URL filters."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import time
import zlib

from pyspark.sql import functions as F

from parchmill.llm import warc
from parchmill.llm.storage import shared_dir
from parchmill.llm.url_reputation import judge_urls
from parchmill.llm.warc import read_archives, salvage, write_archives

PAGES = "page_id long, url string, html string, digest string, size int"


def digest(text: str) -> str:
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_round_trip(spark):
    rows = [(1, "http://a/", "<p>é</p>", "x", 1), (2, "http://b/", "<p>é</p>", None, 2), (3, None, None, "", 3), (4, "u\r\nEvil: 1", "", "", 0), (5, "u", "a\r\n\r\nWARC/1.1\r\n\x00", "", 0), (1, "http://a/", "<p>é</p>", "x", 1), (None, "n", "<p>é</p>", "", 0)]
    path = shared_dir(spark, "warc")
    write_archives(spark.createDataFrame(rows, PAGES), path)
    read = read_archives(spark, path)
    assert read.where("gap_reason is not null").count() == 0
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in read.collect())
    p = "<p>é</p>"
    want = [(1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (0, "revisit", 1)]
    texts = {1: p, 2: p, 3: "", 4: "", 5: rows[4][2], 0: p}
    assert got == sorted((i, t, r, len(texts[i].encode()), digest(texts[i])) for i, t, r in want)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in read.where("record_type = 'response'").collect()} == {1: p, 3: "", 5: rows[4][2]}


def test_small_payloads_are_all_responses(spark):
    path = shared_dir(spark, "warc")
    write_archives(spark.createDataFrame([(1, "", "ab", "", 0), (2, "", "ab", "", 0), (3, "", "abcdef", "", 0), (4, "", "abcdef", "", 0)], PAGES), path, min_revisit_bytes=3)
    assert {r["page_id"]: r["record_type"] for r in read_archives(spark, path).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty(spark):
    path = shared_dir(spark, "warc")
    write_archives(spark.createDataFrame([], PAGES), path)
    assert read_archives(spark, path).count() == 0


def record(n: int, body: bytes) -> bytes:
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def outcome(data: bytes) -> tuple[list[int], list[tuple[int, int]]]:
    found = list(salvage(data))
    return [int(r.headers["warc-record-id"][10:-1]) for r in found if not isinstance(r, tuple)], [g[:2] for g in found if isinstance(g, tuple)]


def test_salvage_plain():
    parts = [record(k, bytes([65 + k]) * 50) for k in range(5)]
    whole = b"".join(parts)
    assert outcome(whole) == ([0, 1, 2, 3, 4], [])
    at = [sum(map(len, parts[:k])) for k in range(6)]
    flipped = bytearray(whole)
    flipped[at[2] - 10] ^= 1  # the digest of record 1 no longer matches
    assert outcome(bytes(flipped)) == ([0, 2, 3, 4], [(at[1], at[2])])
    assert outcome(whole[: at[2] + 20] + whole[at[3] :]) == ([0, 1, 3, 4], [(at[2], at[2] + 20)])
    assert outcome(b"junk" + whole + b"tail") == ([0, 1, 2, 3, 4], [(0, 4), (at[5] + 4, at[5] + 8)])


def test_salvage_members():
    parts = [gzip.compress(record(k, bytes([65 + k]) * 500)) for k in range(4)]
    whole = b"".join(parts)
    at = [sum(map(len, parts[:k])) for k in range(5)]
    assert outcome(whole) == ([0, 1, 2, 3], [])
    broken = bytearray(whole)
    broken[at[1] + 30] ^= 0xFF
    assert outcome(bytes(broken)) == ([0, 2, 3], [(at[1], at[2])])
    # a member without its end: its record is whole, by its own digest
    assert outcome(whole[: at[4] - 5]) == ([0, 1, 2, 3], [(at[3], at[4] - 5)])
    assert outcome(whole[: at[4] - 30]) == ([0, 1, 2], [(at[3], at[4] - 30)])
    assert outcome(b"") == ([], [])


def test_salvage_many_records_in_a_member():
    parts = [record(k, bytes([65 + k]) * 500) for k in range(5)]
    member, alone = gzip.compress(b"".join(parts[:4])), gzip.compress(parts[4])
    assert outcome(member + alone) == ([0, 1, 2, 3, 4], [])
    first, middle = bytearray(parts[0]), bytearray(parts[2])
    first[-10] ^= 1
    middle[-10] ^= 1
    damaged = gzip.compress(bytes(first) + parts[1] + bytes(middle) + parts[3] + b"tail")
    assert outcome(damaged + alone) == ([1, 3, 4], [(0, len(damaged))] * 3)
    assert outcome(b"junk" + damaged + alone) == ([1, 3, 4], [(0, 4)] + [(4, 4 + len(damaged))] * 3)
    nothing = gzip.compress(b"no record")
    assert outcome(nothing + alone) == ([4], [(0, len(nothing))])
    assert outcome(gzip.compress(b"") + alone + b"x") == ([4], [(0, len(gzip.compress(b""))), (len(gzip.compress(b"") + alone), len(gzip.compress(b"") + alone) + 1)])


def test_salvage_never_raises():
    r = random.Random(4)
    whole = b"".join(record(k, bytes([65 + k]) * 40) for k in range(4))
    for said in ("²", "9" * 5000, "-1", "+4", "4 4", "", "1e3", "９"):
        bad = whole.replace(b"Content-Length: 40", b"Content-Length: " + said.encode(), 1)
        got, gaps = outcome(bad)
        assert got == [1, 2, 3] and len(gaps) == 1, said
    packed = b"".join(gzip.compress(record(k, bytes([65 + k]) * 400)) for k in range(4))
    for data in (whole, packed):
        for _ in range(400):
            broken = bytearray(data)
            for _ in range(r.randint(1, 12)):
                at = r.randrange(len(broken))
                broken[at : at + r.choice([0, 1, 1, 3])] = bytes(r.randrange(256) for _ in range(r.choice([0, 1, 1, 5])))
            found = list(salvage(bytes(broken)))
            places = [g[:2] for g in found if isinstance(g, tuple)]
            assert all(0 <= a < b <= len(broken) for a, b in places)


def test_large_members_are_quarantined():
    bomb, good = gzip.compress(record(1, b"\0" * 3_000_000)), gzip.compress(record(2, b"x"))
    found = list(salvage(good + bomb + good, most=1 << 20))
    assert [r if isinstance(r, tuple) else r.headers["warc-record-id"] for r in found] == ["<urn:page:2>", (len(good), len(good) + len(bomb), "the member's content is over 1048576 bytes"), "<urn:page:2>"]
    assert outcome(bomb) == ([1], [])


def test_damaged_http_length_of_a_revisit(spark, tmp_path):
    block = "HTTP/1.1 200 OK\r\nContent-Length: ²\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:page:{'9' * 30}>\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    rows = read_archives(spark, str(tmp_path)).collect()
    assert [(r["page_id"], r["payload_bytes"]) for r in rows] == [(None, 0)]


def test_files_are_bounded(spark, monkeypatch):
    from parchmill.llm import warc

    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 14)
    rows = [(k, "u", f"{k} " + "x" * (10 if k % 150 else 9000 + 100 * k), "", 0) for k in range(1500)]
    path = shared_dir(spark, "warc")
    write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length").collect()
    assert max(r["length"] for r in files) < 180_000 and len(files) > 20  # the largest record alone is 145 kB
    read = read_archives(spark, path).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in read) == sorted((r[0], len(r[2])) for r in rows)


def test_lenient_http_heads(spark, tmp_path):
    def page(n: int, head: bytes, body: bytes) -> bytes:
        block = head + body
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{sha}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    heads = [b"HTTP/1.1 200 OK\r\nno colon here\r\nA: b\r\n\r\n", b"HTTP/1.1 200 OK\r\nX: one\r\n two\r\n\tthree\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\ncontent-length: 9\r\n\r\n", b"HTTP/1.0 200 OK\nA: b\n\n", b"HTTP/1.1 200 OK\r\n\r\n"]
    data = b"".join(page(k, head, b"body\r\n\r\n") for k, head in enumerate(heads))
    assert outcome(data) == ([0, 1, 2, 3, 4], [])
    found = list(salvage(data))
    assert found[1].http == {"x": "one two three"} and found[2].http == {"content-length": "4"} and all(r.payload == b"body\r\n\r\n" for r in found)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    read = read_archives(spark, str(tmp_path)).collect()
    assert sorted(r["page_id"] for r in read) == [0, 1, 2, 3, 4] and all(r["gap_reason"] is None and bytes(r["payload"]) == b"body\r\n\r\n" for r in read)


def test_urls(spark):
    urls = ["HTTP://Www.Example.NET/en/x?q#f", "http://example.net/EN/", "http://a.example.com/de/1", "http://example.com", "https://x.org/fr/y", "http://x.net", "no scheme", None, "a://b://c/d", "http://h?x", "http://org/fr/", "http://notnet/x", "http://bad.host/1", "http://bad.host/2"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(12, 0), (13, 0), (4, 1), (0, 1), (2, 1), (12, 0), (99, 0), (None, 0)], "doc_id long, quality int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in judge_urls(pages, labels).collect()}
    assert got[0] == ("www.example.net", "/en/x", "example.net/en/")
    assert got[1] == ("example.net", "/EN/", "net/")
    assert got[2] == ("a.example.com", "/de/1", "example.com/de/")
    assert got[3] == ("example.com", "", None)
    assert got[4] == ("x.org", "/fr/y", "org/fr/")
    assert got[5] == ("x.net", "", None)
    assert got[6] == got[7] == ("", "", None)
    assert got[8] == ("b:", "//c/d", None)
    assert got[9] == ("h", "", None)
    assert got[10] == ("org", "/fr/", "org/fr/")
    assert got[11] == ("notnet", "/x", None)
    assert len(got) == len(urls)


def test_reputation(spark):
    pages = [(k, f"http://{'bad' if k < 40 else 'good'}{k % 2}.example.com/{k}") for k in range(120)]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(k, 0 if k < 40 else 1) for k in range(0, 120)], "doc_id long, quality int")
    verdicts = {r["page_id"]: r["verdict"] for r in judge_urls(frame, labels).collect()}
    assert {verdicts[k] for k in range(40)} == {"block"} and {verdicts[k] for k in range(40, 120)} == {"allow"}
    none = judge_urls(frame, labels.where("false"))
    assert none.where("verdict = 'allow'").count() == 120
    assert judge_urls(frame.where("false"), labels).count() == 0
    assert judge_urls(frame.union(frame), labels).groupBy("page_id").agg(F.count_distinct("verdict").alias("n")).where("n > 1").count() == 0


def test_registered_domains(spark):
    from parchmill.llm.url_reputation import registered, suffix

    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com.au:8080": ("x.com.au", "com.au"), "www.a.com:80": ("a.com", "com"), "1.2.3.4:99": ("1.2.3.4", "1.2.3.4"), "[::1]:8080": ("[::1]", "[::1]"), "me@a.b.org.": ("b.org", "org"), "notco.uk": ("notco.uk", "uk"), "localhost": ("localhost", "localhost"), "": ("", "")}
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r["host"]: (r["d"], r["s"]) for r in hosts.select("host", registered(F.col("host")).alias("d"), suffix(F.col("host")).alias("s")).collect()} == want
    names = ["bad.co.uk"] * 40 + ["good.co.uk"] * 40 + ["new.bad.co.uk", "new.good.co.uk"]
    pages = spark.createDataFrame([(k, f"http://{h}/{k}") for k, h in enumerate(names)], "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k >= 40)) for k in range(80)], "doc_id long, quality int")
    share = {r["page_id"]: r["host_share"] for r in judge_urls(pages, labels).collect()}
    assert share[80] > 0.6 and share[81] < 0.4  # hosts without labels follow their own domain


def test_posterior_decides(spark):
    """A host that is surely worse than the average is blocked, whatever the average; a threshold is a parameter."""
    rows = [(k, f"http://h{k % 10}.example.com/{k}") for k in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, 0 if k % 10 == 3 and k % 3 or k % 17 == 0 else 1) for k in range(2000)], "doc_id long, quality int")
    blocked = {r["host"] for r in judge_urls(pages, labels).where("verdict = 'block'").collect()}
    assert blocked == {"h3.example.com"}
    assert judge_urls(pages, labels, threshold=0.9).where("verdict = 'block'").count() == 0


def test_url_edges(spark):
    """Clashing names, null and very long urls, repeated pages and ids without labels."""
    schema = "page_id long, url string, host string, path string, rule string, verdict string, seen int, bad int, bound double, share double, mean double"
    rows = [(1, "http://a.net/x"), (1, "http://a.net/x"), (None, "http://a.net/y"), (2, None), (3, "http://h.org/" + "p" * 500_000)]
    pages = spark.createDataFrame([(k, u, "h", "p", "r", "v", 1, 1, 1.0, 1.0, 1.0) for k, u in rows], schema)
    labels = spark.createDataFrame([(1, 0, 5), (None, 0, 5), (3, None, 5)], "doc_id long, quality int, page_id int")
    got = judge_urls(pages, labels).collect()
    assert sorted((r["page_id"] or 0, r["host"], len(r["path"]), r["rule"]) for r in got) == [(0, "a.net", 2, "net/"), (1, "a.net", 2, "net/"), (1, "a.net", 2, "net/"), (2, "", 0, None), (3, "h.org", 500_001, None)]


def test_salvage_of_damaged_members():
    """Records before the damage of a member, and all after the next valid member, are there; the damage is a gap."""
    r = random.Random(8)
    parts = [record(k, bytes(r.choice(b"abcdef ") for _ in range(300))) for k in range(100)]
    whole, alone = gzip.compress(b"".join(parts)), gzip.compress(record(100, b"after"))
    checksum = bytearray(whole)
    checksum[-5] ^= 1
    records, gaps = outcome(bytes(checksum) + alone)
    assert records == list(range(101)) and gaps == [(0, len(whole))]
    records, gaps = outcome(whole[:-200])
    assert 90 < len(records) < 100 and records == list(range(len(records))) and gaps[-1][1] == len(whole) - 200
    for _ in range(60):
        torn, at = bytearray(whole), r.randrange(20, len(whole))
        torn[at] ^= 1 << r.randrange(8)
        records, gaps = outcome(bytes(torn) + alone)
        # what a wrong byte makes of the text after it is caught by digests or structure; nothing before it is lost
        decoder, before = zlib.decompressobj(31), b""
        before = decoder.decompress(whole[: at - 20])
        sure = before.count(b"WARC/1.1\r\n") - 1
        assert records[: max(sure, 0)] == list(range(max(sure, 0))) and 100 in records and gaps and len(set(records)) == len(records)


def test_head_search_is_bounded():
    began = time.time()
    lines = b"WARC/1.1\r\n" * 20_000
    records, gaps = outcome(lines + record(1, b"x"))
    assert records == [1] and gaps == [(0, len(lines))] and time.time() - began < 20


def test_archive_over_the_limit(spark, tmp_path, monkeypatch):
    (tmp_path / "small.warc").write_bytes(record(1, b"x"))
    (tmp_path / "large.warc").write_bytes(record(2, b"y" * 5000))
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    rows = sorted(read_archives(spark, str(tmp_path)).collect(), key=lambda x: x["byte_end"] or 0)
    assert [x["page_id"] for x in rows] == [1, None] and rows[1]["byte_start"] == 0 and rows[1]["byte_end"] > 5000 and "over 4000 bytes" in rows[1]["gap_reason"]
